"""Token ids in binary shards: frequency-ranked ids in byte-aligned variable-length code.

Each text is tokenised, an end id is appended, and every id is replaced by its rank by
falling frequency over the whole corpus, so that the commonest 256 ids take one byte. A
shard holds blocks of ranks: first a control byte for each four ranks (two bits a rank: its
length in bytes less one), then the data bytes. Decoding is a numpy table lookup by control
byte. Shards are in ascending ``doc_id`` order, and so are the documents of a shard.

Shard layout (little-endian)::

    b"CGTS" version:u32
    block*:      control bytes, data bytes
    blocks:      n x (n_ids:u64, control bytes:u64, data bytes:u64)
    documents:   valid:u8 * n, doc_id:i64 * n, n_ids:u64 * n
    tail:        n_blocks:u64 n_documents:u64 n_ids:u64 footer offset:u64 b"CGTS"

``ranks.bin`` beside the shards maps a rank to its id (u32 each). A manifest table, written
by Spark's commit protocol, names the shards that count; a file that a lost task left behind
is in no manifest.

Defined results: a null text is an empty text (its end id alone); equal ``doc_id`` are
ordered by their ids' hash, a null ``doc_id`` comes first; an empty table gives no shard and
no row. Texts of any length are encoded whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm import common

MAGIC, VERSION = b"CGTS", 1
BLOCK_IDS = 1 << 18
IDS_PER_SHARD = 1 << 24
END_ID = 2

# --- byte-aligned code with separate control bytes -------------------------------------------

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # of the four ranks of a control byte
_TOTAL = _LENGTHS.sum(axis=1)
_BEFORE = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TAKE = (_BEFORE[:, :, None] + np.arange(4)).reshape(256, 16)  # which data byte goes to which of 16 output bytes
_USED = (np.arange(4) < _LENGTHS[:, :, None]).reshape(256, 16)
_TAKE[~_USED] = 0
_MASK = _USED.astype(np.uint8) * np.uint8(255)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks`` (unsigned, below 2**32)."""
    v = ranks.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[: len(v)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(control, dtype=np.uint8)
    ends = np.cumsum(_TOTAL[c])
    padded = np.frombuffer(data + bytes(16), dtype=np.uint8)  # missing ranks of the last quad read zeros
    out = padded[(ends - _TOTAL[c])[:, None] + _TAKE[c]] & _MASK[c]
    return out.view("<u4").reshape(-1)[:n]


# --- tokenising -------------------------------------------------------------------------------

_TAIL = ".,!?;:%$&#*"
#: Letters besides ASCII that no normaliser step of the tokenizer changes but for lower-casing one by one.
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SPACE = re.compile("[ \t-\r]")


#: The parts of a tokenizer file that make its ids those of its white-space chunks, one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_white_space(path: str) -> bool:
    """Whether the tokenizer of this file composes and lower-cases characters, drops white space,
    cuts words from digits and punctuation and encodes each piece by a plain BPE over bytes: then
    no id depends on more than its white-space chunk."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = (t["pre_tokenizer"] or {}).get("pretokenizers", [])
    model = t["model"]
    return ((t["normalizer"] or {}).get("normalizers") == _NORMALIZERS and len(pre) == 2
            and pre[0] == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and t["truncation"] is None and t["padding"] is None
            and all(a["content"].startswith("<|") and not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not re.search(r"\s", a["content"]) for a in t["added_tokens"]))


def _laid_out(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces ``at`` one after the other, and the len(at) + 1 offsets of the pieces;
    piece k's ids are ``ids[first[k]: first[k + 1]]``."""
    begin = first[at]
    upto = np.concatenate([[0], np.cumsum(first[at + 1] - begin)])
    return ids[np.repeat(begin - upto[:-1], np.diff(upto)) + np.arange(upto[-1])], upto


class ChunkEncoder:
    """Whole-text encoding by a word-level tokenizer, each different piece of a text once.

    The tokenizer drops white space and lets no token span it, so a text's ids are its white-space
    chunks' ids in order. It also ends a run of letters at closing punctuation and lower-cases, so
    a chunk of Latin letters and closing punctuation is cut into a lower-cased word and the rest.
    Arrow splits texts, numbers the different chunks and pieces and finds the pieces that were met
    before; the others are encoded, and numpy lays all ids out. A word goes straight to the
    tokenizer's model, in its byte alphabet; any other piece is encoded as it stands. All ids come
    from the tokenizers library. With a tokenizer file of another kind
    (``splits_at_white_space``), whole texts are encoded as they stand."""

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.by_chunk = splits_at_white_space(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        """Known pieces (the first is empty), the ids of all of them, and where each one's begin."""
        self.known, self.ids, self.first = pa.array([""], pa.large_string()), np.zeros(0, self.dtype), np.zeros(2, dtype=np.int64)

    def _ids_of(self, piece: str) -> list[int]:
        if _WORD.fullmatch(piece):
            return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _find(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """The places of different pieces among the known ones; new ones are encoded and become known."""
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count and len(self.known) + at.null_count > self.limit:
            self._forget()
            at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            new = pieces.filter(at.is_null())
            ids = [self._ids_of(c) for c in new.to_pylist()]
            at = at.fill_null(-1).to_numpy().copy()
            at[at < 0] = np.arange(len(self.known), len(self.known) + len(new))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in ids])])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.dtype)])
            self.known = pa.concat_arrays([self.known, new])
            return at
        return at.to_numpy()

    def _of_chunks(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, and their offsets."""
        core = pc.ascii_rtrim(chunks, characters=_TAIL)
        worded = pc.match_substring_regex(core, _LATIN)
        closed = pc.and_(worded, pc.not_equal(pc.binary_length(core), pc.binary_length(chunks)))
        tails = pc.replace_substring_regex(chunks.filter(closed), "^[^" + _TAIL + "]+", "")
        words, tails = (pc.dictionary_encode(x) for x in (pc.if_else(worded, pc.utf8_lower(core), chunks), tails))
        both = pc.dictionary_encode(pa.concat_arrays([words.dictionary, tails.dictionary]))
        place = self._find(both.dictionary)[both.indices.to_numpy()]
        at = np.zeros((len(chunks), 2), dtype=np.int64)  # the word and the rest, which is empty for most
        at[:, 0] = place[words.indices.to_numpy()]
        at[closed.to_numpy(zero_copy_only=False), 1] = place[len(words.dictionary):][tails.indices.to_numpy()]
        ids, upto = _laid_out(self.ids, self.first, at.ravel())
        return ids, upto[::2]

    def encode(self, texts: pa.LargeStringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and the n + 1 offsets of the texts' ids."""
        if not self.by_chunk:
            done = [np.array([*e.ids, end_id], dtype=self.dtype) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(done), np.concatenate([[0], np.cumsum([len(x) for x in done])])
        lists = pc.ascii_split_whitespace(texts)
        chunks = pc.dictionary_encode(lists.flatten())
        ids, first = self._of_chunks(chunks.dictionary)
        ids, first = np.append(ids, self.dtype.type(end_id)), np.append(first, len(ids) + 1)  # the end id is one more chunk
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        out, upto = _laid_out(ids, first, np.insert(chunks.indices.to_numpy(), bounds[1:], len(first) - 2))
        return out, upto[bounds + np.arange(len(bounds))]


#: The byte alphabet of byte-level tokenizers: bytes without a printable Latin-1 character get the letters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Bytes of texts that are encoded at once.
PIECE = 1 << 21


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One in each Python worker, so that its chunks serve the worker's next tasks."""
    return ChunkEncoder(path)


def _pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that end at ASCII white space."""
    while len(text) > size:
        cut = _SPACE.search(text, size)
        if cut is None:
            break
        yield text[: cut.start()]
        text = text[cut.start():]
    yield text


def _encoded(encoder: ChunkEncoder, col, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of texts, ids and offsets, for some texts at a time; a long text comes alone, by its pieces."""
    texts = pc.fill_null(col.cast(pa.large_string()), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    i = 0
    while i < len(texts):
        before = upto[i - 1] if i else 0
        n = max(1, int(np.searchsorted(upto, before + PIECE, "right")) - i)
        if upto[i] - before > PIECE and encoder.by_chunk:
            parts = [encoder.encode(pa.array([p], pa.large_string()), end_id)[0] for p in _pieces(texts[i].as_py(), PIECE)]
            ids = np.concatenate([p[:-1] for p in parts] + [parts[-1][-1:]])
            yield 1, ids, np.array([0, len(ids)])
        else:
            yield n, *encoder.encode(texts.slice(i, n), end_id)
        i += n


def _gathered(batches, size: int):
    """Batches of about ``size`` bytes from smaller ones."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, width (bytes an id), and ids (unsigned, little-endian) of every text, the end id included."""
    def run(batches):
        encoder = _encoder(tokenizer)
        width = encoder.dtype.itemsize
        for batch in _gathered(batches, PIECE):
            at = 0
            for n, ids, offsets in _encoded(encoder, batch.column("text"), end_id):
                done = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array([width] * n, pa.int32()), done.cast(pa.binary())], names=["doc_id", "width", "ids"])
                at += n

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, width int, ids binary")


def _ids(batch) -> Iterator[np.ndarray]:
    for width, x in zip(batch.column("width").to_pylist(), batch.column("ids")):
        yield np.frombuffer(x.as_buffer(), dtype=f"<u{width}")


def frequencies(tokens: DataFrame) -> DataFrame:
    """How often each id occurs: id, n."""
    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for x in _ids(batch):
                c = np.bincount(x, minlength=len(total))
                c[: len(total)] += total
                total = c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- shards -----------------------------------------------------------------------------------


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; holds a block of ids and the table of its documents."""

    def __init__(self, out, rank_of: np.ndarray):
        self.out, self.rank_of, self.at = out, rank_of, 8
        self.parts, self.pending, self.total = [], 0, 0
        self.blocks: list[tuple[int, int, int]] = []
        self.valid, self.ids, self.sizes = bytearray(), [], []
        out.write(MAGIC + np.array([VERSION], dtype="<u4").tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.valid.append(doc_id is not None)
        self.ids.append(doc_id or 0)
        self.sizes.append(len(ids))
        for k in range(0, len(ids), BLOCK_IDS):  # a very long text takes many blocks
            part = ids[k: k + BLOCK_IDS]
            self.parts.append(part)
            self.pending += len(part)
            if self.pending >= BLOCK_IDS:
                self.flush()

    def flush(self) -> None:
        if self.pending:
            control, data = encode_ranks(self.rank_of[np.concatenate(self.parts)])
            self.out.write(control)
            self.out.write(data)
            self.blocks.append((self.pending, len(control), len(data)))
            self.at += len(control) + len(data)
            self.total += self.pending
            self.parts, self.pending = [], 0

    def close(self) -> int:
        self.flush()
        for part in (np.array(self.blocks, dtype="<u8").reshape(-1, 3), np.frombuffer(bytes(self.valid), dtype=np.uint8),
                     np.array(self.ids, dtype="<i8"), np.array(self.sizes, dtype="<u8"),
                     np.array([len(self.blocks), len(self.ids), self.total, self.at], dtype="<u8")):
            self.out.write(part.tobytes())
        self.out.write(MAGIC)
        return self.total


class ShardReader:
    """Reads a shard's table of documents at once and its ids block by block."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(36, size - 36)
        if tail[-4:] != MAGIC:
            raise ValueError(f"no token shard: {uri}")
        n_blocks, n_docs, self.n_ids, at = (int(x) for x in np.frombuffer(tail[:32], dtype="<u8"))
        foot = self.file.read_at(size - 36 - at, at)
        self.blocks = np.frombuffer(foot, "<u8", 3 * n_blocks).reshape(-1, 3).astype(np.int64)
        at = 24 * n_blocks
        self.valid = np.frombuffer(foot, np.uint8, n_docs, at).astype(bool)
        self.doc_ids = np.frombuffer(foot, "<i8", n_docs, at + n_docs)
        self.sizes = np.frombuffer(foot, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)

    def ids(self, id_of: np.ndarray) -> Iterator[np.ndarray]:
        at = 8
        for n, control, data in self.blocks.tolist():
            raw = self.file.read_at(control + data, at)
            at += control + data
            yield id_of[decode_ranks(raw[:control], raw[control:], n)]

    def documents(self, id_of: np.ndarray) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Each document's id, ids before it in this shard, and its ids in pieces, which are to
        be used up before the next document."""
        blocks, block, used = self.ids(id_of), np.zeros(0, "<u4"), 0
        start = 0
        for valid, doc, size in zip(self.valid.tolist(), self.doc_ids.tolist(), self.sizes.tolist()):
            def pieces(left=size):
                nonlocal block, used
                while left:
                    if used == len(block):
                        block, used = next(blocks), 0
                    part = block[used: used + left]
                    used += len(part)
                    left -= len(part)
                    yield part
            yield (doc if valid else None), start, pieces()
            start += size


@dataclass
class TokenStore:
    """A written store: its folder, its manifest table (shard, path, n_docs, n_ids) and the path of its ranks."""

    path: str
    manifest: DataFrame

    @property
    def ranks(self) -> str:
        return f"{self.path}/ranks.bin"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, ids_per_shard: int = IDS_PER_SHARD) -> TokenStore:
    """Tokenise every text and write the shards under ``path`` (a folder that all executors share)."""
    spark = docs.sparkSession
    common.prepare(spark)
    tokens = common.stored(tokenize(docs, tokenizer, end_id).withColumn("tie", F.xxhash64("ids")), "tokens")
    # The driver gets one row for each id of the vocabulary, whatever the corpus' size.
    counted = [(r["id"], r["n"]) for r in frequencies(tokens).orderBy(F.desc("n"), "id").collect()]
    id_of = np.array([i for i, _ in counted], dtype="<u4")
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, dtype="<u4")
    rank_of[id_of] = np.arange(len(id_of))
    fs, folder = _open(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/ranks.bin", compression=None) as f:
        f.write(id_of.tobytes())
    ranks = spark.sparkContext.broadcast(rank_of)
    shards = max(1, math.ceil(sum(n for _, n in counted) / ids_per_shard))

    def write(batches):
        writer = out = None
        fs, folder = _open(path)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _ids(batch)):
                if writer is None:
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = ShardWriter(out, ranks.value)
                writer.add(doc, ids)
        if writer is not None:
            n = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": f"{path}/{name}", "n_docs": len(writer.sizes), "n_ids": n}])

    rows = (tokens.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "width", "ids")
            .mapInArrow(write, "shard long, path string, n_docs long, n_ids long"))
    return TokenStore(path, common.stored(rows, "token-manifest"))


def read_store(spark: SparkSession, store: TokenStore) -> DataFrame:
    """What the shards hold, document by document: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard, no more
    files = store.manifest.select("path", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    ranks_path = store.ranks

    def read(batches):
        id_of = None
        for batch in batches:
            for row in batch.to_pylist():
                if id_of is None:
                    fs, path = _open(ranks_path)
                    with fs.open_input_stream(path, compression=None) as f:
                        id_of = np.frombuffer(f.read(), dtype="<u4")
                shard, out = ShardReader(row["path"]), []
                for (doc, start, pieces), size in zip(shard.documents(id_of), shard.sizes.tolist()):
                    crc = 0
                    for part in pieces:
                        crc = zlib.crc32(part, crc)
                    out.append((doc, row["before"] + start, size, crc))
                for k in range(0, len(out), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k: k + 65536])],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, store.manifest.count())
    return files.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = common.table(spark, sf_dir, "documents")
    store = write_store(docs, common.scratch_path(spark, "token-store"), path("word_bpe_49k.json"))
    return read_store(spark, store)
