"""PII redaction as Spark SQL expressions (no Python UDF).

Seven detectors run in order, each over the previous detector's output. Every
match is checked by its validator; a valid match becomes
``[KIND:<first 8 hex of sha256(salt || match without spaces/dashes)>]``, an
invalid one is kept verbatim (and, as with a global regex replace, consumed).

Per detector step:
  * a cheap guard (a substring or a short run of digits that every match has) —
    most texts fail it and skip the rest;
  * ``regexp_extract_all`` (the matches) and ``split`` (the text between them)
    use the same leftmost, non-overlapping scan, so the two arrays interleave;
  * the replacement array is built with ``transform``; text is re-assembled
    with ``zip_with`` + ``flatten`` + ``concat_ws``.
Each step is staged as its own column (see :func:`with_redaction`), so the
plan grows linearly with the number of detectors instead of nesting seven
copies of the text expression into each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import DEFAULT_REDACTION_SALT

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly): detector order, kinds and
# patterns, written in the reference's JavaScript regex dialect.
# ---------------------------------------------------------------------------
DETECTORS_JS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("APIKEY", r"\b(?:sk-ant-[A-Za-z0-9_-]{20,}|sk-proj-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{32,}|ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,})\b"),
    ("CARD", r"\b(?:\d[ -]?){13,19}\b"),
    ("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    ("PHONE", r"(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b"),
    ("IP", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
]
KINDS = [k for k, _ in DETECTORS_JS]
# SSN areas never issued; IP addresses that carry no personal data.
SSN_BAD_AREAS = ["000", "666"]
IP_IGNORED = ["127.0.0.1", "0.0.0.0"]

# JavaScript ``\s`` (Unicode white space), spelled out for Java and RE2.
JS_SPACE_CLASS = (r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                  r"\x{202F}\x{205F}\x{3000}\x{FEFF}")
# JavaScript ``\b`` is an ASCII word boundary; Java's ``\b`` also counts
# accented letters as word characters, so spell it with ASCII ``\w`` look-arounds.
JAVA_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _replace_escape(pattern: str, esc: str, repl_outside: str, repl_inside: str) -> str:
    """Replace the escape ``\\<esc>`` by ``repl_outside`` outside character
    classes and by ``repl_inside`` inside them."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i:i + 2]
            if pair == "\\" + esc:
                out.append(repl_inside if in_class else repl_outside)
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def js_to_java(pattern: str) -> str:
    p = _replace_escape(pattern, "s", f"[{JS_SPACE_CLASS}]", JS_SPACE_CLASS)
    return _replace_escape(p, "b", JAVA_ASCII_BOUNDARY, r"\b")


def js_to_re2(pattern: str) -> str:
    """RE2 (DuckDB) already has an ASCII ``\\b``; only ``\\s`` needs widening."""
    return _replace_escape(pattern, "s", f"[{JS_SPACE_CLASS}]", JS_SPACE_CLASS)


DETECTORS = [(k, js_to_java(p)) for k, p in DETECTORS_JS]
STRIP_PATTERN = f"[{JS_SPACE_CLASS}-]"
SSN_SPLIT = f"[{JS_SPACE_CLASS}-]"


def guard_sql(kind: str, x: str) -> str:
    """A cheap condition that every text with a match of the detector meets."""
    if kind == "EMAIL":
        return f"contains({x}, '@')"
    if kind == "JWT":
        return f"contains({x}, 'eyJ')"
    if kind == "APIKEY":
        return "(" + " OR ".join(f"contains({x}, '{k}')" for k in ("sk-", "ghp_", "gho_", "AKIA", "xox")) + ")"
    if kind == "CARD":
        return f"{x} RLIKE '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'"
    if kind == "IP":
        return f"{x} RLIKE '[0-9][.][0-9]'"
    return f"{x} RLIKE '[0-9]{{4}}'"  # SSN and PHONE end in four digits


def sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn_sql(x: str) -> str:
    """Luhn check of the digits in ``x`` (13..19 digits; every second digit from
    the right doubled, 9 subtracted above 9; sum divisible by 10)."""
    d = f"regexp_replace({x}, '[^0-9]', '')"
    body = (f"aggregate(sequence(1, length(_d)), 0, (acc, i) -> acc + "
            f"IF((length(_d) - i) % 2 = 1, "
            f"IF(CAST(substring(_d, i, 1) AS INT) * 2 > 9, CAST(substring(_d, i, 1) AS INT) * 2 - 9, "
            f"CAST(substring(_d, i, 1) AS INT) * 2), CAST(substring(_d, i, 1) AS INT)))")
    return (f"element_at(transform(array({d}), _d -> "
            f"length(_d) BETWEEN 13 AND 19 AND {body} % 10 = 0), 1)")


def ssn_valid_sql(x: str) -> str:
    parts = f"split({x}, {sql_str(SSN_SPLIT)})"
    bad = ", ".join(f"'{a}'" for a in SSN_BAD_AREAS)
    return (f"(NOT (element_at({parts}, 1) IN ({bad}) OR startswith(element_at({parts}, 1), '9')) "
            f"AND element_at({parts}, 2) <> '00' AND element_at({parts}, 3) <> '0000')")


def validator_sql(kind: str, x: str) -> str:
    if kind == "CARD":
        return luhn_sql(x)
    if kind == "SSN":
        return ssn_valid_sql(x)
    if kind == "IP":
        return f"NOT ({x} IN ({', '.join(sql_str(a) for a in IP_IGNORED)}))"
    return "true"


def token_sql(kind: str, x: str, salt: str) -> str:
    stripped = f"regexp_replace({x}, {sql_str(STRIP_PATTERN)}, '')"
    return f"concat('[{kind}:', substring(sha2(concat({sql_str(salt)}, {stripped}), 256), 1, 8), ']')"


def with_redaction(df: DataFrame, text_col: str, out_prefix: str = "redacted",
                   salt: str = DEFAULT_REDACTION_SALT, by_kind: bool = True) -> DataFrame:
    """Add ``<out_prefix>_text``, ``<out_prefix>_hits`` and (optionally) one
    ``<out_prefix>_<kind>`` count per detector.

    NULL or empty input gives the input text (NULL -> ''), 0 hits.
    """
    cur = f"_{out_prefix}_t0"
    out = df.withColumn(cur, F.expr(f"coalesce({text_col}, '')"))
    hit_cols = []
    for n, (kind, pat) in enumerate(DETECTORS, start=1):
        p = sql_str(pat)
        m, v, nxt, h = (f"_{out_prefix}_m{n}", f"_{out_prefix}_v{n}", f"_{out_prefix}_t{n}",
                        f"{out_prefix}_{kind.lower()}")
        out = out.withColumn(m, F.expr(f"IF({guard_sql(kind, cur)}, regexp_extract_all({cur}, {p}, 0), "
                                       f"CAST(array() AS array<string>))"))
        out = out.withColumn(v, F.expr(f"transform({m}, x -> {validator_sql(kind, 'x')})"))
        repl = f"zip_with({m}, {v}, (x, ok) -> IF(ok, {token_sql(kind, 'x', salt)}, x))"
        out = out.withColumn(nxt, F.expr(
            f"IF(size({m}) = 0, {cur}, concat_ws('', flatten(zip_with(split({cur}, {p}, -1), {repl}, "
            f"(seg, r) -> array(seg, r)))))"))
        out = out.withColumn(h, F.expr(f"size(filter({v}, ok -> ok))"))
        out = out.drop(m, v, cur)
        hit_cols.append(h)
        cur = nxt
    out = out.withColumnRenamed(cur, f"{out_prefix}_text")
    out = out.withColumn(f"{out_prefix}_hits", F.expr(" + ".join(hit_cols)))
    if not by_kind:
        out = out.drop(*hit_cols)
    return out


def with_preview(df: DataFrame, text_col: str, max_chars: int, out_col: str,
                 salt: str = DEFAULT_REDACTION_SALT) -> DataFrame:
    """Redact, then truncate to ``max_chars`` and append '…'. NULL or empty input
    gives NULL text and 0 hits. Adds ``out_col`` and ``<out_col>_hits``."""
    tmp = f"_pv_{out_col}"
    r = with_redaction(df, text_col, tmp, salt, by_kind=False)
    return (r.withColumn(out_col, F.expr(
                f"CASE WHEN {text_col} IS NULL OR {text_col} = '' THEN NULL "
                f"WHEN length({tmp}_text) <= {int(max_chars)} THEN {tmp}_text "
                f"ELSE concat(substring({tmp}_text, 1, {int(max_chars)}), '…') END"))
            .withColumn(f"{out_col}_hits", F.expr(
                f"IF({text_col} IS NULL OR {text_col} = '', 0, {tmp}_hits)"))
            .drop(f"{tmp}_text", f"{tmp}_hits"))


TOKEN_PATTERN = r"\[([A-Z]+):([0-9a-f]{8})\]"
