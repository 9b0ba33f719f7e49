"""Ranked lexical search of many items over all documents by an Aho-Corasick scan of their texts.

Terms are maximal runs of ASCII letters and digits and of characters from U+0080 on, only A-Z
lower-cased. There is no index of the documents: the items' terms, each guarded by a space on either
side, make one automaton, and a text whose other characters are spaces is run through it, so that
each output is a whole term of the text. A first scan counts the documents that hold a term, and
the corpus' totals; a second one counts the terms of each text (tf), maps them to the items that hold them
and keeps each item's best documents of a task.

A term's weight is w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and a document's length norm
m = 100 - 25 + (25 * n * N) div L, with N the documents that have a term, L all their terms and n this
document's, repeats included. The score is the sum of w * ((10**9 * tf) div (1000 * tf + 12 * m)) over the item's terms,
repeats included, in whole numbers.

How much is broadcast: items are dealt by hash into blocks of about ``block_bytes`` of terms, each with
its own automaton and pair of scans, so no more than a block (or a single longer item) is sent out.
A task keeps k documents an item; these are ranked in two steps, by item and hash of the doc_id first.

Result of ``search``: item_id, rank (from 1), doc_id, score (long): each item's k highest scores
above 0, all if fewer; equal scores by ascending doc_id.

Defined results: null, empty and wordless texts have no terms and count nowhere; rows of one
item_id (or of none) are one item with the terms of all its rows; an item without terms has no
row; rows of one doc_id are documents of their own, a null doc_id comes last among equal scores;
no documents or no items give no row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm import common
from callgauge.llm.textbytes import Words, flat

TOP = 20
BLOCK_BYTES = 1 << 23
#: Parts that an item's documents are ranked in before the last step.
PARTS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z lower-cased, and a space for every byte that is in no term.
_SPACED = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and how often the item's texts hold it."""
    text = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    terms = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


@dataclass
class Block:
    """The terms and items of one block: term k is in items ``item[first[k]: first[k + 1]]``, that often."""

    key: str
    terms: list[str]
    n_items: int
    first: np.ndarray
    item: np.ndarray
    repeats: np.ndarray
    ids: list = field(default_factory=list)

    @classmethod
    def of(cls, key: str, rows) -> Block:
        at, ids = defaultdict(list), {}
        for r in rows:
            at[r["term"]].append((ids.setdefault(r["item_id"], len(ids)), r["repeats"]))
        terms = sorted(at)
        pairs = [p for t in terms for p in at[t]]
        first = np.concatenate([[0], np.cumsum([len(at[t]) for t in terms])]).astype(np.int64)
        return cls(key, terms, len(ids), first, np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64), list(ids))


_built: dict = {}


def automaton(block: Block):
    """The block's automaton, built once in a worker."""
    if block.key not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, term in enumerate(block.terms):
            found.add_word(f" {term} ", k)
        found.make_automaton()
        _built.clear()
        _built[block.key] = found
    return _built[block.key]


def term_counts(block: Block, col) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text: its number of terms, the block's terms that it holds, and how often."""
    find = automaton(block).iter
    data, offsets = flat(col)
    totals = Words(data, offsets, hashed=False).counts().tolist()
    for n, a, b in zip(totals, offsets[:-1].tolist(), offsets[1:].tolist()):
        text = (b" " + data[a:b].tobytes().translate(_SPACED) + b" ").decode()
        yield n, *np.unique(np.fromiter((k for _, k in find(text)), dtype=np.int64), return_counts=True)


def _statistics(docs: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """N, L and each term's df. The driver gets a row a term of the block."""
    def count(batches):
        df = np.zeros(len(block.value.terms), dtype=np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for n, terms, _ in term_counts(block.value, batch.column(0)):
                n_docs += n > 0
                n_terms += n
                df[terms] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n_docs, n_terms]))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(len(block.value.terms), dtype=np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-1, 0), found.get(-2, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class Best:
    """Each item's k best documents among those shown so far."""

    def __init__(self, k: int, n_items: int):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)  # a score must be above 0
        self.item, self.score, self.no_id, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def show(self, item, score, no_id, doc) -> None:
        keep = score >= self.least[item]
        if not keep.any():
            return
        item, score, no_id, doc = (np.concatenate(x) for x in zip((self.item, self.score, self.no_id, self.doc), (x[keep] for x in (item, score, no_id, doc))))
        order = np.lexsort((doc, no_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        last = item[rank == self.k - 1]
        self.item, self.score, self.no_id, self.doc = item[rank < self.k], score[order], no_id[order], doc[order]
        self.least[last] = self.score[np.searchsorted(self.item, last, "right") - 1]


def score_batch(block: Block, w: np.ndarray, n_docs: int, n_terms: int, col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, item and score of all pairs of a text and an item that share a term."""
    rows, terms, parts = [], [], []
    for row, (n, found, tf) in enumerate(term_counts(block, col)):
        if len(found):
            m = 100 - 25 + 25 * n * n_docs // n_terms
            parts.append(w[found] * (1_000_000_000 * tf // (1000 * tf + 12 * m)))
            terms.append(found)
            rows.append(np.full(len(found), row))
    if not rows:
        return (np.zeros(0, dtype=np.int64),) * 3
    row, term, part = np.concatenate(rows), np.concatenate(terms), np.concatenate(parts)
    count = block.first[term + 1] - block.first[term]
    upto = np.cumsum(count)
    at = np.repeat(block.first[term] - (upto - count), count) + np.arange(upto[-1])
    pair = np.repeat(row, count) * block.n_items + block.item[at]
    value = np.repeat(part, count) * block.repeats[at]
    size = len(col) * block.n_items
    # in two halves, so that sums of doubles are exact
    total = (np.bincount(pair, value >> 24, size).astype(np.int64) << 24) + np.bincount(pair, value & 0xFFFFFF, size).astype(np.int64)
    found = np.flatnonzero(total)
    return found // block.n_items, found % block.n_items, total[found]


def _block_best(docs: DataFrame, items: DataFrame, block: Block, k: int) -> DataFrame | None:
    """item_id, doc_id and score: of each task, the k best documents of each item."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    n_docs, n_terms, df = _statistics(docs, shared)
    if not n_terms:
        return None
    w = weights(n_docs, df)

    def run(batches):
        best = Best(k, block_items)
        for batch in batches:
            row, item, score = score_batch(shared.value, w, n_docs, n_terms, batch.column("text"))
            doc = batch.column("doc_id")
            best.show(item, score, doc.is_null().to_numpy(zero_copy_only=False)[row].astype(np.int64), doc.fill_null(0).to_numpy()[row])
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.no_id.astype(bool)), pa.array(best.score)], names=["item", "doc_id", "score"])

    block_items = block.n_items
    found = docs.mapInArrow(run, "item long, doc_id long, score long")
    id_type = items.schema["item_id"].dataType
    ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {id_type.simpleString()}")  # a row an item of the block
    return found.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = common.stored(item_terms(items), "item-terms")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    found = None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block at most, or one item
        part = _block_best(docs, items, Block.of(f"{terms.scratch_path}/{b}", rows), k) if rows else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", part).orderBy(*best_first))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents),
i AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
it AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY item_id, term),
tf AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY r, term),
total AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
norm AS (SELECT r, doc_id, 100 - 25 + (25 * len(words)::BIGINT * n_docs) // n_terms AS m FROM d, total WHERE len(words) > 0),
scores AS (
    SELECT item_id, r, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM it JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (r) GROUP BY item_id, r),
ranked AS (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
    FROM scores JOIN norm USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
