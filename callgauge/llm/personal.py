"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed patterns find in whole texts: emails, IPv4 addresses, card numbers with a right
checksum and international phone numbers. Their neighbouring words become lexical patterns, and other
strings that look like identifiers (numbers of many digits, codes, spelled-out addresses) are candidates. A table
holds the graph of patterns and instances (distinct identifiers, whatever document they
are in), and Spark scores it in rounds:

* a pattern's confidence for a kind is the share of that kind among its instances, pos / (pos + neg + 1),
  where each instance counts once, with its score, and needs ``least_support`` of pos;
* a candidate's score for a kind is 1 - the product of (1 - confidence) over its patterns of
  ``least_confidence`` or more, if it looks like one of that kind (``plausible``);
* from ``least_score`` on it counts as an instance of the kind in the next round.

All occurrences of the candidates that are accepted at the end are spans as well.

Result of ``find_personal``, a row a document: doc_id, n_email, n_ip, n_card, n_phone (seeds),
base_sha256 and base_spans (the seeds) and spans (seeds and discovered ones), as kind:start:end in
code points, end exclusive, by start, then kind, comma-joined.

Defined results: a null text is empty, without spans; an instance that several kinds accept is of the one
of the higher score (ties: email, ip, card, phone); equal rows give equal rows; discovered spans don't
overlap seeds or each other; an empty table gives no row. Texts of any length are scanned whole in time in
proportion to their length, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE = 3, 0.8, 0.8

# --- seeds: the leftmost matches of each kind that don't overlap -------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits matches from its start or not at all
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, each from its @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def seeds(text: str) -> list[tuple[int, int, int]]:
    """start, kind's number and end of all seeds, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- candidates and the words around them ------------------------------------------------------

_NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[().\x20/-]{0,2}[0-9])++")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
_CODE = re.compile(r"[A-Za-z0-9_-]++")
_WORD = re.compile(r"[^\W\d_]+")
_AROUND = 80
_LEAST_DIGITS = 5


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings that look like identifiers and overlap none of ``taken`` nor each other: spelled-out
    addresses first, then numbers and then codes, each of five digits or more."""
    found, spans = [], [(a, b) for a, _, b in taken]

    def add(matches):
        nonlocal spans
        new, k, end = [], 0, 0
        for a, b in matches:
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            if a >= end and not (k < len(spans) and spans[k][0] < b):
                new.append((a, b))
                end = b
        found.extend(new)
        spans = _apart(sorted(spans + new))

    if "(at" in text.lower() or "[at" in text.lower():
        add([m.span() for m in _SPELLED.finditer(text)])
    if _DIGIT.search(text):
        add([m.span() for m in _NUMBER.finditer(text) if len(_DIGIT.findall(m.group())) >= _LEAST_DIGITS])
        codes, end = [], 0
        for m in re.finditer("[0-9]++", text):
            if m.start() < end:
                continue
            a = m.start()
            while a > end and _CODE.match(text, a - 1):
                a -= 1
            end = _CODE.match(text, m.start()).end()
            if len(_DIGIT.findall(text, a, end)) >= _LEAST_DIGITS:
                codes.append((a, end))
        add(codes)
    return sorted(found)


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones (seeds of several kinds) as one."""
    out = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a string's place: the words before and after it, alone and in pairs, lower-cased."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - _AROUND): start])[-2:]]
    after = [w.lower() for w in _WORD.findall(text[end: end + _AROUND])[:2]]
    out = []
    if before:
        out.append(f"{before[-1]} _")
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if after:
        out.append(f"_ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def identity(string: str) -> str:
    """What an identifier is, however it is written: lower-cased, without spaces, brackets, dots and hyphens."""
    return re.sub(r"[\x20()\[\]./-]", "", string.lower())


def plausible(string: str) -> list[int]:
    """The kinds (by number) that a candidate looks like."""
    if _SPELLED.fullmatch(string):
        return [0]
    n, plain = len(_DIGIT.findall(string)), _NUMBER.fullmatch(string)
    return [k for k, ok in ((1, plain and string.count(".") >= 2), (2, 10 <= n <= 19), (3, plain and 6 <= n <= 15)) if ok]


# --- the graph ---------------------------------------------------------------------------------

_SPAN = "struct<start:int,kind:int,end:int>"
_MENTION = "struct<start:int,end:int,kind:int,instance:string,patterns:array<string>,kinds:array<int>>"


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts, seeds and mentions of every document; a mention's kind is -1 for a candidate."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("base_sha256", "base_spans", "seeds", "mentions")}
            counts = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = seeds(text)
                for k in range(4):
                    counts[k].append(sum(kind == k for _, kind, _ in base))
                named = _named(base)
                out["base_spans"].append(named)
                out["base_sha256"].append(hashlib.sha256(named.encode()).hexdigest())
                out["seeds"].append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                places = [(a, b, k, [k]) for a, k, b in base] + [(a, b, -1, plausible(text[a:b])) for a, b in candidates(text, base)]
                out["mentions"].append([{"start": a, "end": b, "kind": k, "instance": f"{k} {identity(text[a:b])}" if k >= 0 else identity(text[a:b]),
                                         "patterns": patterns(text, a, b), "kinds": kinds} for a, b, k, kinds in places])
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            mention = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(out["base_sha256"], pa.string()), pa.array(out["base_spans"], pa.string()),
                 pa.array(out["seeds"], pa.list_(span)), pa.array(out["mentions"], pa.list_(mention))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", "seeds", "mentions"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base_sha256 string, base_spans string, seeds array<{_SPAN}>, mentions array<{_MENTION}>")


def discovered(mentions: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT,
               least_confidence: float = LEAST_CONFIDENCE, least_score: float = LEAST_SCORE) -> DataFrame:
    """instance and kind: the candidates that the patterns accept; mentions: instance, kind (-1: a candidate), patterns, kinds."""
    edges = common.stored(mentions.select("instance", F.col("kind").alias("seed"), "kinds", F.explode("patterns").alias("pattern"))
                          .groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("kinds").alias("kinds")), "graph")
    known = edges.where("seed >= 0").select("pattern", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    accepted = None
    total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    for _ in range(rounds):
        positive = known if accepted is None else known.unionByName(edges.select("pattern", "instance").join(accepted, "instance").select("pattern", "instance", "kind", "score"))
        support = positive.groupBy("pattern", "kind").agg(F.sum("score").alias("pos")).where(F.col("pos") >= least_support)
        confidence = F.col("pos") / (F.col("total") + 1)  # pos + neg: all its instances
        sure = common.stored(support.join(total, "pattern").select("pattern", "kind", confidence.alias("confidence"))
                             .where(F.col("confidence") >= least_confidence), "patterns")
        scores = (edges.where("seed < 0").select("pattern", "instance", "kinds").join(sure, "pattern").where("array_contains(kinds, kind)")
                  .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")))
        best = (scores.where(F.col("score") >= least_score).groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
                .select("instance", (-F.col("b.k")).alias("kind"), "b.score"))
        before, accepted = accepted, common.stored(best, "accepted")
        if accepted.isEmpty() or before is not None and accepted.join(before, ["instance", "kind"], "left_anti").isEmpty() and before.count() == accepted.count():
            break
    return accepted.select("instance", "kind")


def find_personal(docs: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT,
                  least_confidence: float = LEAST_CONFIDENCE, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, seed counts, base_sha256, base_spans and spans of every document."""
    common.prepare(docs.sparkSession)
    scanned = common.stored(_scanned(docs).withColumn("row", F.monotonically_increasing_id()), "scanned")
    mentions = scanned.where("size(mentions) > 0").select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    accepted = discovered(mentions.select("instance", "kind", "patterns", "kinds"), rounds, least_support, least_confidence, least_score)
    more = (mentions.where("kind < 0").select("row", "start", "end", "instance").join(accepted, "instance")
            .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))  # of one document
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    spans = F.expr(f"""array_join(transform(array_sort(concat(seeds, more)), s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.end)), ',')""")
    return (scanned.join(more, "row", "left")
            .select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", F.when(F.col("more").isNull(), F.col("base_spans")).otherwise(spans).alias("spans")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(common.table(spark, sf_dir, "documents"))
