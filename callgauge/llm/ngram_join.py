"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1. Every whole text becomes the set of its five-word shingles (64-bit hashes; a text of one to
   four words has one shingle, all its words). Texts with equal sets are one *representative*
   with a number of copies, so copies are never expanded into pairs.
2. A representative's MinHash signature is cut into ``TREES`` paths of ``DEPTH`` values. All paths
   of a tree, sorted, are its prefix trie: rows are sorted over ranges, and a path's longest common
   prefix with its neighbours in the order is the deepest node that it shares. Paths that share no
   node deep enough are dropped.
3. Every representative begins with its whole paths and shortens them until its recall reaches the
   target: the share of trees in which it shares a whole path gives the similarity s of what it
   meets there, s**DEPTH (the threshold where that is less), and at a depth d trees find a partner
   with probability 1 - (1 - s**d)**TREES. Below a node at a representative's depth all are its candidates.
4. Candidates are verified exactly. The components of candidates are cut into blocks of ``BLOCK_ROWS``
   texts or ``BLOCK_SHINGLES`` shingles, a row each, and every text of a component is compared with every
   other one: within its block, and block with block. So all links inside a component count, also those of
   pairs that aren't candidates themselves. n texts of one component cost n x n / 2 comparisons, of bounded
   memory and in any number of tasks, and (n / ``BLOCK_ROWS``)**2 / 2 rows that hold two blocks.
5. Classes are the connected components of the links.

Result of ``similar_documents``, a row a document: doc_id, class_id (least doc_id of its class),
class_size (documents), copies (documents of an equal set, itself among them), n_links (all other documents
that are similar to it, copies among them), link_id and similarity (the most similar document of another set;
null if none), text_key (128 bits of the text) and is_head (whether the row
is its class's first by doc_id, null last, then text_key).

The forest is the only step that may miss a link: of two texts at the threshold whose component nothing else
joins, 4 in 10**8 if one of them meets no closer text, and 2 in 10**6 if both keep their whole paths.

Defined results: null, empty and wordless texts have no shingles and are classes of their own
(class_id is their doc_id) without links; texts with equal words are copies; a class whose doc_ids are all
null has a null class_id; rows of equal doc_id and text are rows of one class, and all of them
are heads if one is; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import common
from callgauge.llm.components import connected
from callgauge.llm.textbytes import U64, Words, constants, flat, mix, windows

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 56, 7
RECALL = 1 - 1e-7
#: Texts of a component that are one row.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    w = Words(data, offsets)
    hashes, bounds = windows(w.hashes, w.first, k)
    out = []
    for i, n in enumerate(w.counts().tolist()):
        if 0 < n < k:
            short, _ = windows(w.hashes[w.first[i]: w.first[i + 1]], np.array([0, n]), n, seed=100 + n)
            out.append(short)
        else:
            out.append(np.unique(hashes[bounds[i]: bounds[i + 1]]))
    return out


def set_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that depend on the set alone; none for the empty set."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        both = [mix(shingles * c + c).sum(dtype=U64) for c in constants(2, 77)]
    return np.array(both, dtype="<u8").tobytes()


_A, _B = ((c >> U64(32)).astype(np.uint32) for c in (constants(TREES * DEPTH, 31), constants(TREES * DEPTH, 32)))
_A |= np.uint32(1)


def signature(shingles: np.ndarray) -> bytes:
    """``TREES * DEPTH`` MinHash values of 16 bits, of the shingles' upper 32 bits. The hash is monotone in
    its upper bits, so its minimum is taken over 32 bits and then mixed."""
    low, short = np.full(len(_A), ~np.uint32(0)), (shingles >> U64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 512):
            part = short[at: at + 512]
            np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
        return (mix(low.astype(U64)) >> U64(48)).astype("<u2").tobytes()


def recall_at(similarity: float, depth: int, trees: int) -> float:
    return 1 - (1 - similarity**depth) ** trees


def depth_for(shared: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a representative's recall reaches the target, if ``shared`` of its whole paths are shared."""
    likely = max(threshold, (shared / TREES) ** (1 / DEPTH))
    return next((d for d in range(DEPTH, 1, -1) if recall_at(likely, d, TREES) >= recall), 1)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, skey, n (distinct shingles) and sig of every document."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "text_key", "skey", "n", "sig"])

    return docs.mapInArrow(run, "doc_id long, text_key string, skey binary, n long, sig binary")


def shared_prefix(paths: np.ndarray) -> np.ndarray:
    """Of sorted paths (n x bytes), how many leading bytes each but the first has in common with the one before."""
    return np.cumprod(paths[1:] == paths[:-1], axis=1, dtype=np.int32).sum(axis=1)


def _trie(reps: DataFrame, least: int) -> DataFrame:
    """path (the tree's byte and its values), rep, and depth (of the deepest node shared with
    another) of every path that shares a node at depth ``least`` or below. The first and the
    last path of a range count as sharing their whole length, as their neighbours are elsewhere."""
    width = 1 + 2 * DEPTH

    def cut(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                out = np.empty((n, TREES, width), dtype=np.uint8)
                out[:, :, 0] = np.arange(TREES)
                out[:, :, 1:] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(n, TREES, 2 * DEPTH)
                offsets = np.arange(0, n * TREES * width + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_buffers(pa.binary(), n * TREES, [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())]),
                     pa.array(np.repeat(batch.column("rep").to_numpy(), TREES))], names=["path", "rep"])

    def prune(batches):
        def rows(path, rep, before, after):
            depth = (np.maximum(before, after) - 1) // 2
            keep = np.flatnonzero(depth >= least)
            return pa.RecordBatch.from_arrays([pa.array([path[i].tobytes() for i in keep], pa.binary()), pa.array(rep[keep]), pa.array(depth[keep].astype(np.int32))], names=["path", "rep", "depth"])

        held = None  # the last row waits for its neighbour
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), dtype=np.uint8).reshape(-1, width)
            rep, before = batch.column("rep").to_numpy(), np.array([width])
            if held is not None:
                path, rep, before = np.concatenate([held[0], path]), np.concatenate([held[1], rep]), held[2]
            common_ = shared_prefix(path)
            before = np.concatenate([before, common_])
            yield rows(path[:-1], rep[:-1], before[:-1], common_)
            held = path[-1:], rep[-1:], before[-1:]
        if held is not None:
            yield rows(*held, np.array([width]))

    spark = reps.sparkSession
    with common.arrow_rows(spark, 16384):
        paths = reps.select("rep", "sig").mapInArrow(cut, "path binary, rep long")
        return common.stored(paths.repartitionByRange("path", "rep").sortWithinPartitions("path", "rep").mapInArrow(prune, "path binary, rep long, depth int"), "trie")


def _candidates(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """rep and comp: the components of all representatives that are candidates of another."""
    depth_of = [depth_for(m, threshold, recall) for m in range(TREES + 1)]
    trie = _trie(reps, min(depth_of))
    needs = (trie.groupBy("rep").agg(F.count_if(F.col("depth") == DEPTH).alias("m"))
             .select("rep", F.element_at(F.array(*map(F.lit, depth_of)), F.col("m").cast("int") + 1).alias("need")))
    depths = F.array(*[F.lit(d) for d in sorted(set(depth_of))])
    nodes = (trie.join(needs, "rep").select("path", "rep", "need", F.explode(F.filter(depths, lambda d: d <= F.col("depth"))).alias("d"))
             .select(F.xxhash64("d", F.expr("substring(path, 1, 1 + 2 * d)")).alias("key"), "rep", (F.col("need") == F.col("d")).alias("asks")))
    shared = nodes.groupBy("key").agg(F.min("rep").alias("v"), F.max("rep").alias("top"), F.max("asks").alias("asks")).where("asks and v < top").select("key", "v")
    return connected(nodes.select("key", "rep").join(shared, "key").select(F.col("rep").alias("u"), "v")).select(F.col("node").alias("rep"), F.col("root").alias("comp"))


def compare(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Which pairs have Jaccard similarity of ``threshold`` or more: rows are ``sets[:split]``,
    columns ``sets[split:]``; with split 0, all sets against all. Gives similarities, 0 below."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    kept = count[column] > 1  # a shingle of one set is in no intersection
    place = np.cumsum(count > 1) - 1
    column, row, width = place[column[kept]], row[kept], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    a, b = (slice(None), slice(None)) if split == 0 else (slice(0, split), slice(split, None))
    common_ = np.zeros((len(sizes[a]), len(sizes[b])), dtype=np.float64)
    step = 2048
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        dense = np.zeros((len(sets), min(step, width - at)), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        common_ += dense[a] @ dense[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common_
    found = np.where(common_ >= threshold * union - 1e-9, common_ / union, 0.0)
    if split == 0:
        np.fill_diagonal(found, 0)
    return found


def classes(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The classes of rows and of columns that a matrix of links joins, by the least row of each; ``same`` if
    rows and columns are the same texts. Numbers of what has no link mean nothing."""
    none = np.iinfo(np.int64).max
    rows = np.arange(linked.shape[0])
    while True:
        columns = np.where(linked, rows[:, None], none).min(axis=0)
        if same:
            columns = np.minimum(columns, rows)
        least = np.minimum(rows, np.where(linked, columns[None, :], none).min(axis=1))
        if (least == rows).all():
            return rows, columns
        rows = least


class Block:
    """Some texts of a component, as one row."""

    def __init__(self, reps: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]):
        self.reps, self.copies, self.sets = reps, copies, sets

    def packed(self) -> list[bytes]:
        """Different shingles are written once, and their numbers in each text."""
        words, ids = np.unique(np.concatenate(self.sets), return_inverse=True)
        sizes = np.array([len(x) for x in self.sets])
        return [self.reps.astype("<i8").tobytes(), self.copies.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), words.astype("<u8").tobytes(), ids.astype("<u4").tobytes()]

    @classmethod
    def unpacked(cls, row: dict, prefix: str = "") -> Block:
        reps, copies, sizes, words, ids = (np.frombuffer(row[prefix + c], dtype=t) for c, t in PACKED.items())
        return cls(reps, copies, np.split(words[ids], np.cumsum(sizes)[:-1]))

    def links(self, other: Block | None, threshold: float) -> pa.RecordBatch:
        """Of every text that is linked to one of the other block (or of its own): rep, root (a text that these links
        join it with), link (the most similar), similarity and the number of documents that it is linked to."""
        found = compare(self.sets, 0, threshold) if other is None else compare(self.sets + other.sets, len(self.sets), threshold)
        to = self if other is None else other
        rows, columns = classes(found > 0, other is None)
        parts = [self._linked(found, rows, self.reps, to)]
        if other is not None:
            parts.append(to._linked(found.T, columns, self.reps, self))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=[c.split()[0] for c in LINKS.split(", ")])

    def _linked(self, found: np.ndarray, root: np.ndarray, roots: np.ndarray, to: Block):
        linked = found > 0
        at = np.flatnonzero(linked.any(axis=1))
        best = found[at].argmax(axis=1)
        return self.reps[at], roots[root[at]], to.reps[best], found[at, best], linked[at] @ to.copies


#: The columns of a packed block and their kinds.
PACKED = {"reps": "<i8", "copies": "<i8", "sizes": "<i4", "words": "<u8", "ids": "<u4"}
LINKS = "rep long, root long, link long, similarity double, documents long"


def _blocks(dealt: DataFrame) -> DataFrame:
    """comp, block, blocks and the packed texts, from rows of comp, block, blocks, rep, copies and shingles."""
    cols = ["comp", "block", "blocks"]
    dealt = dealt.repartition("comp", "block").sortWithinPartitions("comp", "block", "rep")

    def rows(batches):
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in cols))
            for key, rep, copies, x in zip(keys, batch.column("rep").to_pylist(), batch.column("copies").to_pylist(), batch.column("shingles")):
                yield key, rep, copies, np.frombuffer(x.as_buffer(), dtype="<u8").copy()

    def pack(batches):
        for key, group in groupby(rows(batches), key=lambda r: r[0]):
            texts = {rep: (copies, x) for _, rep, copies, x in group}  # rows of one doc_id and text give one set
            block = Block(np.array(list(texts)), np.array([c for c, _ in texts.values()]), [x for _, x in texts.values()])
            yield pa.RecordBatch.from_pylist([dict(zip([*cols, *PACKED], [*key, *block.packed()]))], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in cols] + [(c, pa.binary()) for c in PACKED])
    return dealt.mapInArrow(pack, ", ".join([f"{c} long" for c in cols] + [f"{c} binary" for c in PACKED]))


def _links(blocks: DataFrame, threshold: float) -> DataFrame:
    """The LINKS columns: a row a text and block that it has links in."""
    def within(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if len(row["reps"]) > 8:  # more than one text
                    yield Block.unpacked(row).links(None, threshold)

    def across(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield Block.unpacked(row).links(Block.unpacked(row, "other_"), threshold)

    found = common.stored(blocks.mapInArrow(within, LINKS), "links")
    cut = blocks.where("blocks > 1")
    if cut.isEmpty():
        return found
    one = cut.where("block < blocks - 1").withColumn("other", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    other = cut.select("comp", F.col("block").alias("other"), *[F.col(c).alias(f"other_{c}") for c in PACKED])
    with common.arrow_rows(cut.sparkSession, 4):  # a row has some MB
        pairs = one.join(other.hint("merge"), ["comp", "other"]).select(*PACKED, *[f"other_{c}" for c in PACKED])
        return found.unionByName(common.stored(pairs.mapInArrow(across, LINKS), "links"))


def text_key(text) -> Column:
    """128 bits of a text."""
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_key, class_id, class_size, copies, n_links, link_id, similarity and is_head of every document."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", text_key(F.col("text")))
    signed = common.stored(_signed(docs), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")  # a null doc_id comes last
    reps = common.stored(signed.where("skey is not null").groupBy("skey")
                         .agg(F.min(row).alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
                         .withColumn("rep", F.monotonically_increasing_id()), "representatives")
    members = common.stored(_candidates(reps, threshold, recall).join(reps.select("rep", "n", "copies", "head.doc_id", "head.text_key"), "rep"), "members")
    per_comp = common.stored(members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")), "components")

    def to_sets(batches):
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(*flat(batch.column("text")))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in placed), sets], names=[*placed, "shingles"])

    placed = ["comp", "block", "blocks", "rep", "copies"]
    wanted = members.join(per_comp, "comp").select("comp", F.expr("pmod(xxhash64(rep, 5L), blocks)").alias("block"), "blocks", "rep", "copies",
                                                   F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    # merged at every size: the texts' one shuffle then grows with them
    texts = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))).select(*placed, "text")
    blocks = common.stored(_blocks(texts.mapInArrow(to_sets, ", ".join(f"{c} long" for c in placed) + ", shingles binary")), "blocks")
    links = _links(blocks, threshold)

    classes = connected(links.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    best = (links.groupBy("rep").agg(F.max(F.struct("similarity", (-F.col("link")).alias("l"))).alias("b"), F.sum("documents").alias("documents"))
            .select("rep", "b.similarity", (-F.col("b.l")).alias("link"), "documents")
            .join(reps.select(F.col("rep").alias("link"), F.col("head.doc_id").alias("link_id")), "link").drop("link"))
    known = reps.select("rep", "skey", "head", "copies").join(best, "rep", "left").join(classes, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # both written, so that the joins have two plain shuffles, of which AQE splits a large class's or set's
    of_class = common.stored(known.groupBy("root").agg(F.min("head").alias("first"), F.sum("copies").alias("class_size")), "classes")
    known = common.stored(known.join(of_class, "root").select("skey", "first", "class_size", "copies", (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "link_id", "similarity"), "known")
    result = ["doc_id", "text_key", "class_id", "class_size", "copies", "n_links", "link_id", "similarity", "is_head"]
    worded = (signed.where("skey is not null").select("doc_id", "text_key", "skey").join(known, "skey")
              .withColumn("class_id", F.col("first.doc_id")).withColumn("is_head", row.eqNullSafe(F.col("first"))).select(*result))
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    wordless = signed.where("skey is null").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), one.alias("class_size"), one.alias("copies"), F.lit(0).cast("long").alias("n_links"),
                                                   none.alias("link_id"), F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("is_head"))
    return worded.unionByName(wordless)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(common.table(spark, sf_dir, "documents"))
