"""Benchmark decontamination by a prefix-filtered set join.

A *window* is 13 consecutive words of a benchmark item (an item of 1 to 12 words is one window).
A window's set is its five-word shingles (all its words, if it has fewer). For exact containment
every shingle is needed, so a window's necessary prefix in the global order of rarity is its one
rarest shingle: shingle occurrences are counted over all documents, and only windows whose
rarest shingle occurs at a place of a document are candidates there. Bounds come next: the
shingle's offset in the window fixes where the window would start, which must leave room for the
whole window within the document. What remains is verified word by word.

The benchmark is the query set. It is taken in blocks of about ``block_bytes`` of text, each
indexed and broadcast (so a broadcast has a bounded size however long the benchmark is), and the
documents pass once through all blocks without a shuffle; counting rarity is a pass a block.

Defined results: a null, empty or wordless document has no words, no hits and isn't
contaminated; benchmark rows with a null id or without words match nothing; repeated benchmark
rows are one item, repeated documents are judged alike; an empty benchmark contaminates nothing.
Columns of the documents named like a result column are replaced by it, others stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from callgauge.llm import common
from callgauge.llm.textbytes import U64, HashSet, Words, constants, flat, mix, windows

WINDOW, SHINGLE = 13, 5
BLOCK_BYTES = 4 << 20
RESULTS = ("n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated")
_FULL = constants(WINDOW, 91)


class BenchmarkIndex:
    """The distinct windows of a block of items. After ``order`` it finds windows by their rarest shingle."""

    def __init__(self, items: list[tuple[str, str]]):
        spans: dict[bytes, tuple[int, int]] = {}
        self.items: dict[bytes, set[str]] = {}
        w = Words(*flat(pa.array([t for _, t in items], pa.large_string())))
        for (item, _), a, b in zip(items, w.first[:-1].tolist(), w.first[1:].tolist()):
            for s in range(a, max(b - WINDOW, a) + 1 if b > a else a):
                e = min(s + WINDOW, b)
                text = w.text(s, e)
                spans.setdefault(text, (s, e))
                self.items.setdefault(text, set()).add(item)
        self.texts = list(spans)
        self.owners = [sorted(self.items.pop(t)) for t in self.texts]
        self.size = np.array([e - s for s, e in spans.values()], dtype=np.int64)
        start = np.array([s for s, _ in spans.values()], dtype=np.int64)
        self.full = self._full(w.hashes, start, self.size)
        self.shingles, self.grid = {}, {}
        for q in sorted({min(SHINGLE, n) for n in self.size.tolist()}):
            which = np.flatnonzero(np.minimum(self.size, SHINGLE) == q)
            hashes, _ = windows(w.hashes, np.array([0, len(w.hashes)]), q)  # also across items, but none of these is used
            offset = np.arange(WINDOW - q + 1)
            inside = offset[None, :] <= (self.size[which] - q)[:, None]
            grid = hashes[np.minimum(start[which][:, None] + offset[None, :], len(hashes) - 1)]
            self.shingles[q] = HashSet(grid[inside])
            self.grid[q] = (which, np.where(inside, np.searchsorted(self.shingles[q].sorted, np.where(inside, grid, self.shingles[q].sorted[0])), -1))

    @staticmethod
    def _full(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each window's words; ``start`` and ``size`` are within ``hashes``."""
        total = size.astype(U64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                more = size > j
                total[more] += hashes[start[more] + j] * _FULL[j]
            return mix(total)

    def order(self, counts: dict[int, np.ndarray]) -> BenchmarkIndex:
        """Choose each window's rarest shingle by the counts (those of ``self.shingles[q].sorted``)."""
        self.entries = {}
        for q, (which, grid) in self.grid.items():
            n = np.where(grid < 0, np.iinfo(np.int64).max, counts[q][grid])
            offset = n.argmin(axis=1)
            rarest = grid[np.arange(len(which)), offset]
            by = np.argsort(rarest, kind="stable")
            chosen = HashSet(self.shingles[q].sorted[rarest])
            first = np.searchsorted(self.shingles[q].sorted[rarest[by]], chosen.sorted)
            self.entries[q] = (chosen, np.append(first, len(by)), which[by], offset[by])
        self.grid = self.shingles = None
        return self

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and window of all occurrences in the texts of ``w``."""
        out = [(np.zeros(0, np.int64),) * 3]
        for q, (chosen, first, which, offset) in self.entries.items():
            hashes, bounds = windows(w.hashes, w.first, q)
            at, k = chosen.find(hashes)
            text = np.searchsorted(bounds, at, "right") - 1
            word = w.first[text] + at - bounds[text]
            for lo in range(0, len(at), 1 << 16):  # bounds what the candidates take
                t, p, c = text[lo: lo + (1 << 16)], word[lo: lo + (1 << 16)], k[lo: lo + (1 << 16)]
                n = first[c + 1] - first[c]
                entry = np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
                window, t = which[entry], np.repeat(t, n)
                start = np.repeat(p, n) - offset[entry]
                fits = (start >= w.first[t]) & (start + self.size[window] <= w.first[t + 1])
                t, start, window = t[fits], start[fits], window[fits]
                same = self._full(w.hashes, start, self.size[window]) == self.full[window]
                t, start, window = t[same], start[same], window[same]
                exact = np.array([w.text(s, s + n) == self.texts[x] for s, n, x in zip(start.tolist(), self.size[window].tolist(), window.tolist())], dtype=bool)
                out.append((t[exact], start[exact], window[exact]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _counted(docs: DataFrame, index: BenchmarkIndex) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in all documents (rows of the index's size reach the driver)."""
    shared = docs.sparkSession.sparkContext.broadcast(index.shingles)

    def run(batches):
        total = {q: np.zeros(len(s.sorted), np.int64) for q, s in shared.value.items()}
        for batch in batches:
            w = Words(*flat(batch.column("text")))
            for q, s in shared.value.items():
                total[q] += np.bincount(s.find(windows(w.hashes, w.first, q)[0])[1], minlength=len(s.sorted))
        for q, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(at), pa.array(n[at])], names=["q", "k", "n"])

    counts = {q: np.zeros(len(s.sorted), np.int64) for q, s in index.shingles.items()}
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "q long, k long, n long").groupBy("q", "k").agg(F.sum("n").alias("n")).collect():
        counts[r["q"]][r["k"]] = r["n"]
    return counts


def mark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids (array of string), items_sha256 and contaminated."""
    spark = docs.sparkSession
    common.prepare(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    own = [c for c in docs.columns if c not in RESULTS]
    plain = docs.select(*own)
    marked = plain.withColumn("__text", F.col("text").cast("string")).withColumn("__hit", F.lit(None).cast("binary")).withColumn("__items", F.lit(None).cast("array<string>"))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        index = BenchmarkIndex([(r["item"], r["text"]) for r in rows])
        if index.texts:
            index.order(_counted(docs, index))
        marked = _pass(marked, index, own if block == blocks - 1 else None)
    return marked


def _pass(marked: DataFrame, index: BenchmarkIndex, own: list[str] | None) -> DataFrame:
    """Add one block's hit words (a bit a word) and items to each document; after the last
    block (``own``: the columns to keep) the result columns take their place."""
    shared = marked.sparkSession.sparkContext.broadcast(index)
    kept = len(marked.columns) - 2

    def run(batches):
        index = shared.value
        for batch in batches:
            w = Words(*flat(batch.column("__text")))
            if not index.texts:
                yield as_wanted(batch, w, batch.column("__hit").to_pylist(), batch.column("__items").to_pylist())
                continue
            text, start, window = index.matches(w)
            edge = np.zeros(len(w.hashes) + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + index.size[window], -1)
            hit = np.cumsum(edge[:-1]) > 0
            bits, found = batch.column("__hit").to_pylist(), batch.column("__items").to_pylist()
            by = np.argsort(text, kind="stable")
            text, window = text[by], window[by]
            for t in np.unique(text).tolist():
                own = np.packbits(hit[w.first[t]: w.first[t + 1]])
                bits[t] = (own if bits[t] is None else own | np.frombuffer(bits[t], np.uint8)).tobytes()
                lo, hi = np.searchsorted(text, [t, t + 1])
                more = {i for x in np.unique(window[lo:hi]).tolist() for i in index.owners[x]}
                found[t] = sorted(more.union(found[t] or ()))
            yield as_wanted(batch, w, bits, found)

    def as_wanted(batch, w, bits, found):
        if own is None:
            return pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=batch.schema.names)
        words, items = w.counts(), [x or [] for x in found]
        hit = np.array([0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in bits], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(own)], pa.array(words, pa.int64()), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array((hit > 0) & (20 * hit >= words))], names=[*own, *RESULTS])

    if own is None:
        return marked.mapInArrow(run, marked.schema)
    kinds = dict(zip(RESULTS, (LongType(), LongType(), LongType(), ArrayType(StringType()), StringType(), "boolean")))
    schema = StructType([f for f in marked.schema if f.name in own])
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return marked.mapInArrow(run, schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
