"""Document fingerprints: a homomorphic multiset hash over paragraphs, in SQL expressions only.

A paragraph (a line of the text, empty ones included) is hashed to a wide vector:

* 16 *equality* lanes, the 32-bit words of its SHA-512;
* 64 *likeness* lanes and a count: a paragraph is cut into pieces (at a blank after a vowel, y or
  closing punctuation, so that an edit changes few pieces), and each piece, hashed with the one
  before it in the paragraph, adds the 64 bits of its hash, one to a lane.

A text's fingerprint is the sum of its paragraphs' vectors, each lane modulo 2**32. It doesn't
depend on the paragraphs' order; texts with the same paragraphs have the same equality lanes,
and a paragraph can be inserted or deleted by adding or subtracting its vector (``added``,
``removed``). A likeness lane holds how many of n pieces have a bit set, so 2 * lane - n is a
random projection of the multiset of pieces; the cosine of two such vectors estimates how alike
the multisets are.

``fingerprint`` gives a struct (n, equality: array of 16, likeness: array of 32 longs with two
lanes each); ``written`` its text form. Everything is JVM-side; no Python runs on the executors.

Defined results: a null text is an empty one, which has one empty paragraph and no piece;
fingerprints with equal equality lanes have likeness 1, else one without pieces has likeness 0;
equal doc_ids are ordered by their texts' hash, null ids come first; a single document is its
own next one; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm import common

PIECE_END = "(?<=[aeiouyAEIOUY.,;:!?|]) +"
_LOW, _PAIR = 0xFFFFFFFF, 0x100000001
#: Rows of a range of doc_ids, and the most ranges (the list of their bounds is part of the plan).
RANGE_ROWS, MOST_RANGES = 500, 1 << 16


def fingerprint(text: str) -> Column:
    """The fingerprint of a string column (by name)."""
    pieces = f"transform(split({text}, '\\n'), line -> filter(split(line, '{PIECE_END}'), p -> p <> ''))"
    hashes = f"flatten(transform({pieces}, a -> zip_with(a, slice(concat(array(''), a), 1, size(a)), (p, q) -> xxhash64(q, p))))"
    return F.expr(f"""transform(array(named_struct('paragraphs', split({text}, '\\n'), 'hashes', {hashes})), t -> named_struct(
        'n', cast(size(t.hashes) as bigint),
        'equality', aggregate(transform(t.paragraphs, p -> sha2(p, 512)), array_repeat(0L, 16),
            (acc, h) -> transform(acc, (a, i) -> (a + cast(conv(substring(h, 8 * i + 1, 8), 16, 10) as bigint)) & {_LOW}L)),
        'likeness', aggregate(t.hashes, array_repeat(0L, 32), (acc, h) -> transform(acc, (a, i) -> a + (shiftrightunsigned(h, i) & {_PAIR}L)))))[0]""")


def _combined(a: str, b: str, sign: str) -> Column:
    lane = f"((x & {_LOW}L) {sign} (y & {_LOW}L)) & {_LOW}L"
    high = f"shiftleft((shiftrightunsigned(x, 32) {sign} shiftrightunsigned(y, 32)) & {_LOW}L, 32)"
    return F.expr(f"""named_struct('n', {a}.n {sign} {b}.n,
        'equality', zip_with({a}.equality, {b}.equality, (x, y) -> {lane}),
        'likeness', zip_with({a}.likeness, {b}.likeness, (x, y) -> ({lane}) | {high}))""")


def added(a: str, b: str) -> Column:
    """The fingerprint of the paragraphs of two fingerprints (columns by name) together."""
    return _combined(a, b, "+")


def removed(a: str, b: str) -> Column:
    """The fingerprint of a's paragraphs without b's."""
    return _combined(a, b, "-")


def written(fp: str) -> Column:
    """A fingerprint as text: its count, 16 and 64 lanes in hexadecimal. ``n-`` and lanes have fixed order."""
    return F.expr(f"""concat(hex({fp}.n), '-', array_join(transform({fp}.equality, x -> lpad(lower(hex(x)), 8, '0')), ''), '-',
        array_join(transform({fp}.likeness, x -> lower(hex(x))), '.'))""")


def likeness(a: str, b: str) -> Column:
    """How alike two fingerprints are, from 0 to 1."""
    def product(x, y):
        return f"""aggregate(zip_with({x}.likeness, {y}.likeness, (p, q) ->
            cast(2 * (p & {_LOW}L) - {x}.n as double) * (2 * (q & {_LOW}L) - {y}.n)
            + cast(2 * shiftrightunsigned(p, 32) - {x}.n as double) * (2 * shiftrightunsigned(q, 32) - {y}.n)), 0D, (s, z) -> s + z)"""
    return F.expr(f"""case when {a}.equality = {b}.equality then 1D when {a}.n = 0 or {b}.n = 0 then 0D
        else greatest(0D, least(1D, {product(a, b)} / sqrt({product(a, a)} * {product(b, b)}))) end""")


def _range_bounds(docs: DataFrame) -> list[int]:
    """Values of doc_id, the least first, that cut the rows into ranges of about RANGE_ROWS."""
    n = docs.count()
    k = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k) if k > 1 else F.lit(None)).first()
    return sorted({cuts[0], *(cuts[1] or [])} - {None})


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``next_<c>`` for each carried column: its value in the
    next document by doc_id, after the last in the first. Ranges of ids are sorted apart, and
    the first document of each range follows the last of the range before."""
    bounds = _range_bounds(docs)
    k = len(bounds)
    if k > 1:
        steps = [1 << s for s in reversed(range((k - 1).bit_length()))]
        found = f"aggregate(array({', '.join(map(str, steps))}), 0, (i, s) -> if(i + s < {k} and element_at(__bounds, least(i + s, {k - 1}) + 1) <= doc_id, i + s, i))"
        docs = docs.withColumn("__bounds", F.lit(bounds)).withColumn("__range", F.coalesce(F.expr(found), F.lit(0)))
        first = docs.where("doc_id is null or element_at(__bounds, __range + 1) = doc_id").drop("__bounds")
        docs = docs.drop("__bounds")
    else:
        docs = docs.withColumn("__range", F.lit(0))
        first = docs
    tie = F.xxhash64("text")
    in_order = Window.partitionBy("__range").orderBy(F.asc_nulls_first("doc_id"), tie)
    first = (first.withColumn("__k", F.row_number().over(in_order)).where("__k = 1")
             .select(F.expr(f"pmod(__range - 1, {max(k, 1)})").alias("__range"), *(F.col(c).alias(f"__first_{c}") for c in carried)))
    # carried values are never null, so a null means the end of a range
    follow = docs.select("*", *(F.lead(c).over(in_order).alias(f"__lead_{c}") for c in carried)).join(first, "__range")
    return follow.select(*[c for c in docs.columns if c != "__range"], *(F.coalesce(f"__lead_{c}", f"__first_{c}").alias(f"next_{c}") for c in carried))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_or_empty().alias("text"))
    docs = docs.withColumn("fp", fingerprint("text"))
    moved = with_next(docs, ["text", "fp"]).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = "cast(n_chars div 4 as int)"
    moved = moved.withColumn("edited", F.expr(f"concat(left(text, cast(n_chars as int) - {quarter}), left(next_text, {quarter}))"))
    moved = moved.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint("edited").alias("edited_fp"))
    return moved.select("doc_id", "n_chars", "edited_sha256", written("fp").alias("fingerprint"), written("edited_fp").alias("edited_fingerprint"),
                        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
