"""DuckDB statement of the redaction detectors (RE2 dialect), for the oracle.

Same semantics as :mod:`callgauge.functions.redact`: detectors in order, each
over the previous output; matches and in-between segments interleaved; tokens
from sha256(salt || match without spaces/dashes).
"""

from __future__ import annotations

from callgauge.constants import DEFAULT_REDACTION_SALT
from callgauge.functions.redact import (DETECTORS_JS, IP_IGNORED, JS_SPACE_CLASS, SSN_BAD_AREAS,
                                        js_to_re2)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def luhn_duck(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    digit = f"CAST(substring({d}, i, 1) AS INTEGER)"
    term = (f"CASE WHEN (length({d}) - i) % 2 = 1 THEN "
            f"CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END ELSE {digit} END")
    return (f"(length({d}) BETWEEN 13 AND 19 AND "
            f"list_sum(list_transform(generate_series(1, length({d})), lambda i: {term})) % 10 = 0)")


def ssn_duck(x: str) -> str:
    parts = f"string_split_regex({x}, {q('[' + JS_SPACE_CLASS + '-]')})"
    bad = ", ".join(q(a) for a in SSN_BAD_AREAS)
    return (f"(NOT ({parts}[1] IN ({bad}) OR starts_with({parts}[1], '9')) "
            f"AND {parts}[2] <> '00' AND {parts}[3] <> '0000')")


def valid_duck(kind: str, x: str) -> str:
    if kind == "CARD":
        return luhn_duck(x)
    if kind == "SSN":
        return ssn_duck(x)
    if kind == "IP":
        return f"NOT ({x} IN ({', '.join(q(a) for a in IP_IGNORED)}))"
    return "true"


def token_duck(kind: str, x: str, salt: str) -> str:
    stripped = f"regexp_replace({x}, {q('[' + JS_SPACE_CLASS + '-]')}, '', 'g')"
    return f"('[{kind}:' || substring(sha256({q(salt)} || {stripped}), 1, 8) || ']')"


def redaction_ctes(src: str, text_col: str, prefix: str = "rd", salt: str = DEFAULT_REDACTION_SALT) -> tuple[str, str]:
    """CTE chain over ``src``; returns (ctes, final_cte_name). The final CTE has
    all source columns plus ``<prefix>_text``, ``<prefix>_hits`` and one
    ``<prefix>_<kind>`` count per detector."""
    ctes = [f"{prefix}0 AS (SELECT *, coalesce({text_col}, '') AS _t0 FROM {src})"]
    prev = f"{prefix}0"
    for n, (kind, pat_js) in enumerate(DETECTORS_JS, start=1):
        p = q(js_to_re2(pat_js))
        t_prev = f"_t{n - 1}"
        m = f"CASE WHEN regexp_matches({t_prev}, {p}) THEN regexp_extract_all({t_prev}, {p}, 0) ELSE [] END"
        ctes.append(f"{prefix}{n}m AS (SELECT *, {m} AS _m{n} FROM {prev})")
        ctes.append(f"{prefix}{n}v AS (SELECT *, list_transform(_m{n}, lambda x: {valid_duck(kind, 'x')}) AS _v{n} "
                    f"FROM {prefix}{n}m)")
        repl = (f"list_transform(_m{n}, lambda x, i: CASE WHEN _v{n}[i] THEN {token_duck(kind, 'x', salt)} "
                f"ELSE x END)")
        ctes.append(f"{prefix}{n}r AS (SELECT *, {repl} AS _r{n} FROM {prefix}{n}v)")
        nxt = (f"CASE WHEN len(_m{n}) = 0 THEN {t_prev} ELSE array_to_string(flatten(list_transform("
               f"string_split_regex({t_prev}, {p}), lambda s, i: [s, coalesce(_r{n}[i], '')])), '') END")
        ctes.append(f"{prefix}{n} AS (SELECT * EXCLUDE (_m{n}, _v{n}, _r{n}), {nxt} AS _t{n}, "
                    f"CAST(len(list_filter(_v{n}, lambda ok: ok)) AS INTEGER) AS {prefix}_{kind.lower()} "
                    f"FROM {prefix}{n}r)")
        prev = f"{prefix}{n}"
    kinds = [k.lower() for k, _ in DETECTORS_JS]
    hits = " + ".join(f"{prefix}_{k}" for k in kinds)
    drop = ", ".join(f"_t{i}" for i in range(len(DETECTORS_JS) + 1))
    ctes.append(f"{prefix} AS (SELECT * EXCLUDE ({drop}), _t{len(DETECTORS_JS)} AS {prefix}_text, "
                f"{hits} AS {prefix}_hits FROM {prev})")
    return ",\n".join(ctes), prefix
