"""Edge rows through every operator, and each operator against brute force or a round trip."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.llm import decontaminate, fingerprints, licenses, mixing, ngram_join, quality, secrets, token_store, toxicity
from callgauge.llm.components import connected
from callgauge.llm.textbytes import Words, flat

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """doc_id, text, source: nulls, blanks, one word, a very long text, copies, repeated rows, links."""
    rng = random.Random(4)
    base = prose(rng, 120, 10_000)
    near = base.split()
    near[7] = "changed"
    long = prose(rng, 60_000)
    return [
        (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "word", "b"), (5, "Word!", "b"), (6, long, "b"),
        (7, base, "a"), (7, base, "a"), (8, base.upper(), "c"), (9, " ".join(near), "c"), (10, long + " tail", None),
        (None, "no id but " + prose(rng, 30), "c"), (11, "Released under the MIT License.\nÉtat ☃ 𝄞 x", "a"), (12, "a\nb\n\na", "a"), (13, "b\na\na\n", "a"),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # columns with names that the operators use or return
    for name in ("score", "label", "n", "key", "rep", "links", "size", "target", "times", "n_words", "n_hit", "labels", "w", "ids", "fp", "before", "word"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def brute_links(texts, threshold=0.8):
    """The similarities of all pairs of texts that are alike, and the least index of each text's class."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = {}, list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i, j] = links[j, i] = len(a & b) / len(a | b)
                root[max(top(i), top(j))] = min(top(i), top(j))
    return links, [top(i) for i in range(len(texts))]


def test_join_edges(spark, docs, rows, empty):
    found = ngram_join.similar_documents(docs).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert [got[k].class_id for k in (1, 2, 3, None)] == [1, 2, 3, None]
    assert got[4].class_id == got[5].class_id == 4 and got[4].copies == 2 and got[4].link_id is None
    assert {got[k].class_id for k in (7, 8, 9)} == {7} and got[9].class_size == 4
    assert got[9].link_id == 7 and got[8].link_id == got[7].link_id == 9 and got[7].copies == 3
    assert got[6].class_id == got[10].class_id == 6 and got[6].link_id == 10 and got[10].link_id == 6
    heads = collections.Counter(r.class_id for r in found if r.is_head)
    assert heads.pop(7) == 2 and set(heads.values()) == {1}  # both rows of document 7
    assert ngram_join.similar_documents(empty).count() == 0


@pytest.mark.parametrize("block_rows", [1024, 24])
def test_join_against_brute_force(spark, monkeypatch, block_rows):
    """Whole components at once, and in several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    rng = random.Random(9)
    texts = []
    for _ in range(12):  # families of edited copies: some of each are linked, some by others only, some not at all
        base = prose(rng, rng.choice([8, 40, 200, 600]), 5000).split()
        for _ in range(rng.choice([1, 2, 5, 90])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(t[: len(t) - rng.choice([0, 0, 3])]))
    rng.shuffle(texts)
    links, root = brute_links(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.similar_documents(df).collect()}
    assert [got[i].class_id for i in range(len(texts))] == root
    assert collections.Counter(root) == {k: got[k].class_size for k in set(root)}
    assert {i: got[i].n_links for i in range(len(texts))} == {i: sum((i, j) in links for j in range(len(texts))) for i in range(len(texts))}
    for i in range(len(texts)):  # the link is the most similar of those to other texts
        others = [links[i, j] for j in range(len(texts)) if (i, j) in links and texts[j] != texts[i]]
        assert (got[i].link_id is not None) == bool(others)
        if others:
            assert got[i].similarity == pytest.approx(max(others)) == pytest.approx(links[i, got[i].link_id])


def test_links_of_a_document(spark, rows, docs):
    """Rows of an equal set are links of each other; a text without words has none."""
    got = {r.doc_id: r.n_links for r in ngram_join.similar_documents(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 3, 8: 3, 9: 3, 10: 1, None: 0, 11: 0, 12: 0, 13: 0}


def test_classes_of_a_matrix():
    """Classes within a block and across two, against one node after the other, and blocks that are packed and unpacked."""
    rng = np.random.default_rng(2)
    for n, m in [(1, 1), (6, 4), (30, 30), (30, 17)] * 5:
        linked, same = rng.random((n, m)) < 1.2 / n, n == m
        if same:
            linked = (linked | linked.T) & ~np.eye(n, dtype=bool)
        rows, columns = ngram_join.classes(linked, same)
        label = np.arange(n + m)
        for i, j in [(i, j if same else n + j) for i, j in zip(*np.nonzero(linked))] * (n + m):
            label[[i, j]] = label[[i, j]].min()
        assert (rows[linked.any(axis=1)] == label[:n][linked.any(axis=1)]).all()
        assert (columns[linked.any(axis=0)] == (label[:n] if same else label[n:])[linked.any(axis=0)]).all()
    block = ngram_join.Block(np.array([3, 9]), np.array([1, 4]), [np.array([5, 2**64 - 1], dtype=np.uint64), np.array([5], dtype=np.uint64)])
    again = ngram_join.Block.unpacked(dict(zip(ngram_join.PACKED, block.packed())))
    assert again.reps.tolist() == [3, 9] and again.copies.tolist() == [1, 4] and [x.tolist() for x in again.sets] == [[5, 2**64 - 1], [5]]


def test_all_links_of_a_tight_family_in_few_rows(spark, monkeypatch):
    """300 texts that are all alike: each has 299 links, and 38 blocks are compared in 703 rows, not 300 x 300."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rng = random.Random(12)
    base, texts = prose(rng, 200, 9000).split(), []
    for i in range(300):
        texts.append(" ".join(base[:-1] + [f"only{i}"]))
    blocks = []
    real = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda packed, threshold: blocks.append(packed.count()) or real(packed, threshold))
    got = ngram_join.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.class_id, r.class_size, r.n_links) for r in got} == {(0, 300, 299)} and blocks == [38]


def test_prefixes_shorten_until_the_recall():
    """A text that shares most of its whole paths keeps them; one that shares few shortens them to what the threshold needs."""
    need = [ngram_join.depth_for(m, 0.8, ngram_join.RECALL) for m in range(ngram_join.TREES + 1)]
    assert need[0] == 6 and need[-1] == ngram_join.DEPTH and need == sorted(need)
    for m, d in enumerate(need):
        s = max(0.8, (m / ngram_join.TREES) ** (1 / ngram_join.DEPTH))
        assert ngram_join.recall_at(s, d, ngram_join.TREES) >= ngram_join.RECALL
        assert d == ngram_join.DEPTH or ngram_join.recall_at(s, d + 1, ngram_join.TREES) < ngram_join.RECALL


def test_components(spark):
    """Paths in the order of their ids, a hub, loops, parallel edges, and no edges."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(2000, 2000), (2001, 2002), (2002, 2001)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(220)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[max(top(u), top(v))] = min(top(u), top(v))
    got = connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(r.node for r in got) == sorted({x for e in edges if e[0] != e[1] for x in e})
    of = {r.node: r.root for r in got}
    assert all(of[r] == r and top(n) == top(r) for n, r in of.items())
    assert len(set(of.values())) == len({top(n) for n in of})
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_trie_keeps_every_shared_path(spark):
    """The sorted, pruned trie holds all paths that share a node, across ranges and batches."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, (400, ngram_join.TREES * ngram_join.DEPTH)).astype("<u2")  # few values: many shared prefixes
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(values)], "rep long, sig binary")
    got = {(r.path[0], r.rep): r.depth for r in ngram_join._trie(df.repartition(5), 4).collect()}
    paths = values.reshape(400, ngram_join.TREES, ngram_join.DEPTH)
    for tree in range(ngram_join.TREES):
        for d in (4, 5, 6, 7):
            groups = collections.Counter(paths[i, tree, :d].tobytes() for i in range(400))
            for i in range(400):
                if groups[paths[i, tree, :d].tobytes()] > 1:
                    assert got[tree, i] >= d


def test_word_bytes_match_the_pattern():
    import pyarrow as pa
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ09 .,-_é☃\n\x7f\x00") for _ in range(rng.randrange(80))) for _ in range(300)] + [None, ""]
    w = Words(*flat(pa.array(texts)))
    for i, t in enumerate(texts):
        a, b = int(w.first[i]), int(w.first[i + 1])
        assert [w.text(k, k + 1).decode() for k in range(a, b)] == words(t)
    seen = {}
    for k in range(len(w.hashes)):
        assert seen.setdefault(w.text(k, k + 1), w.hashes[k]) == w.hashes[k]
    assert len(set(seen.values())) == len(seen)


# --- decontamination --------------------------------------------------------------------------


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for s in range(max(1, len(iw) - 12) if iw else 0):
            q = iw[s:s + 13]
            for p in range(len(w) - len(q) + 1):
                if w[p:p + len(q)] == q:
                    hit.update(range(p, p + len(q)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(block_bytes)
    items = [(i, prose(rng, rng.choice([0, 1, 4, 9, 13, 14, 30]), rng.choice([2, 50]))) for i in range(25)] + [(3, "again " * 20), (None, "w1x"), (40, None), (9, "w1x w2x")]
    items += items[:3]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.choice([0, 5, 40]), rng.choice([2, 50])), rng.choice(items)[1] or "", prose(rng, rng.choice([0, 300]), 50)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts + [None])], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, n_words string")
    got = {r.doc_id: r for r in decontaminate.mark(df, bench, block_bytes).collect()}
    known = [r for r in items if r[0] is not None]
    for i, t in enumerate(texts + [None]):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(t, known)


def test_decontamination_edges(spark, docs, rows, empty):
    bench = spark.createDataFrame([(1, "word")], "item_id long, text string")
    marked = decontaminate.mark(docs, bench)
    assert marked.count() == len(rows) and "score" in marked.columns
    got = {r.doc_id: r.n_hit for r in marked.collect()}
    assert got[4] == got[5] == 1 and got[1] == got[2] == 0
    assert decontaminate.mark(empty, bench).count() == 0
    assert decontaminate.mark(docs, bench.where("false")).where("contaminated").count() == 0


# --- mixing -----------------------------------------------------------------------------------


def brute_targets(sizes):
    """sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, weights = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / weights for s in names}
        more = {s for s in names if out[s] > 3 * sizes[s]}
        if not more:
            return out
        capped |= more


def test_mixing(spark, docs, rows, empty):
    rng = random.Random(2)
    more = [(100 + i, " ".join("x" for _ in range(rng.choice([0, 1, 3, 7, 7, 20, 55]))), rng.choice(["a", "b", "é", "Z", "tiny" if i < 3 else "b", None])) for i in range(900)]
    df = docs.select("doc_id", "text", "source", "score").unionByName(spark.createDataFrame([(*r, "mine") for r in more], "doc_id long, text string, source string, score string"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) + 900 and got[0].score == "mine"
    sizes = collections.Counter()
    for r in got:
        assert r["size"] == len(SIZE.findall(r.text or "")) and r.taken == r.times * r["size"] and r.times <= 3
        sizes[r.source] += r["size"]
    target, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s in sizes:
        # a source with one very long text can't be nearer than it is long
        slack = max([1] + [x["size"] for x in got if x.source == s and x["size"] > 50_000])
        assert abs(taken[s] - target[s]) <= slack
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    assert mixing.mix(empty).count() == 0


def test_mixing_of_many_documents_of_a_size(spark):
    """More documents of a (source, size) than a hash range holds, less and more than half of them taken."""
    df = spark.createDataFrame([(i, "x x x x x", "ab"[i % 2]) for i in range(8000)], "doc_id long, text string, source string")
    got = {r.source: (r.target, r.taken) for r in mixing.mix(df).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert set(got) == {"a", "b"} and all(0 <= round(target) - taken < 5 for target, taken in got.values()), got


@pytest.mark.parametrize("doc_id", ["cast(null as long)", "if(id % 4 < 2, 7, id)", "5L"])
def test_mixing_takes_exactly_the_fit_of_equal_rows(spark, doc_id):
    """Null ids, half the rows under one id, and rows that are equal in all columns."""
    df = spark.range(2000).selectExpr(f"{doc_id} as doc_id", "if(id % 8 < 6, 'x x x x x', concat('x x x x ', id)) as text", "if(id % 2 = 0, 'a', 'b') as source", "array(1) as odd")
    mixed = mixing.mix(df)
    assert mixed.count() == 2000
    got = mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("times").alias("times")).collect()
    assert {r.source for r in got} == {"a", "b"} and all(0 <= r.target - r.taken < 5 and r.times <= 2 for r in got), got
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text, r.taken) for r in again) == sorted((str(r.doc_id), r.text, r.taken) for r in mixed.collect())


def test_budget_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(60):
        sizes = np.array(sorted(rng.sample(range(60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 5) for _ in sizes])
        budget = rng.randint(0, int((sizes * counts).sum()))
        take = mixing.fit_budget(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts):
            for _ in range(c):
                sums |= {x + int(s) for x in sums}
        assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(take * sizes) == max(x for x in sums if x <= budget)


def test_budget_of_very_long_documents():
    """Documents longer than the dynamic programme's largest budget, against brute force."""
    def brute(sizes, counts, budget):
        sums = {0}
        for s, c in zip(sizes, counts):
            for _ in range(c):
                sums |= {x + int(s) for x in sums if x + int(s) <= budget}
        return max(sums)

    def taken(sizes, counts, budget):
        take = mixing.fit_budget(np.array(sizes), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        return sum(int(t) * s for t, s in zip(take, sizes))

    assert taken([280_000, 285_000, 290_000], [1, 1, 1], 300_000) == 290_000
    assert taken([150_000, 200_000], [2, 1], 300_000) == 300_000
    rng = random.Random(5)
    for _ in range(20):
        sizes = sorted(rng.sample(range(1, 900_000), rng.randint(1, 7)))
        counts = [rng.randint(1, 2) for _ in sizes]
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts)))
        assert taken(sizes, counts, budget) == brute(sizes, counts, budget)
    # more sums than can be kept, and more words than the share search sees
    sizes = sorted(rng.sample(range(140_000, 900_000), 60))
    for budget in (3_000_000, 11_000_000):
        assert taken(sizes, [1] * 60, budget) == budget


# --- token ids --------------------------------------------------------------------------------


def test_token_store_round_trip(spark, docs, rows, empty, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    store = token_store.write_store(docs, str(tmp_path / "s"), path("word_bpe_49k.json"), ids_per_shard=50_000)
    got = sorted(token_store.read_store(spark, store).collect(), key=lambda r: r.start)
    assert store.manifest.count() > 1 and len(got) == len(rows)
    at, texts = 0, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (doc, text, _) in zip(got, texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    none = token_store.write_store(empty, str(tmp_path / "e"), path("word_bpe_49k.json"))
    assert token_store.read_store(spark, none).count() == 0


def encoded(encoder, texts):
    import pyarrow as pa
    out = []
    for n, ids, offsets in token_store._encoded(encoder, pa.array(texts, pa.string()), 2):
        out += [ids[offsets[i]: offsets[i + 1]].tolist() for i in range(n)]
    return out


def test_chunk_encoder_equals_the_library(monkeypatch):
    from public_tokenizers import path
    encoder = token_store.ChunkEncoder(path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = [*"aAbBsStTÀÖØöÿßŒž'’.,!<|>é É́̇İßΣσ9٣ \t\n\x0b\x0c\r\x1c\x85\xa0 中$%", "<|endoftext|>", "'s", "'RE", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, "", " ", "x" * 3000]
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert encoded(encoder, texts) == want
    encoder.limit = 50  # known pieces are forgotten again and again
    assert encoded(encoder, texts) == want
    monkeypatch.setattr(token_store, "PIECE", 20)  # most texts are longer than a piece
    assert encoded(encoder, texts) == want


def test_chunk_encoder_on_the_documents():
    import pyarrow.parquet as pq
    from public_tokenizers import path
    encoder = token_store.ChunkEncoder(path("word_bpe_49k.json"))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[:1000]
    want = [[*e.ids, 2] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoder.by_chunk and encoded(encoder, texts) == want


def test_another_tokenizer_encodes_whole_texts():
    """A file whose ids depend on white space isn't cut at it."""
    from public_tokenizers import path
    encoder = token_store.ChunkEncoder(path("byte_bpe_50k.json"))
    texts = ["two  words", " a\n\n b", "", None]
    assert not encoder.by_chunk
    assert encoded(encoder, texts) == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def brute_grams(text):
    """The n-grams of a text's words, with a space at either end."""
    out = set()
    for w in words(text):
        w = f" {w} "
        out |= {w[i:i + n] for n in toxicity.SIZES for i in range(len(w) - n + 1)}
    return out


def test_grams_are_of_characters():
    import pyarrow as pa
    texts = ["ab", "Été", "これは毒です", "one two", "", "x" * 9, "毒 é"]
    for text, f in zip(texts, toxicity.features(pa.array(texts))):
        assert len(f) == len(brute_grams(text)), text  # no two of these few fall on one place


@pytest.mark.parametrize("n", [2, 3, 4, 8, 14, 20, 40])
def test_toxicity_of_few_labelled_rows(n):
    """Small samples keep their best features; samples without any difference predict nothing toxic."""
    import pyarrow as pa
    rng = random.Random(n)
    texts = [prose(rng, 30) + (" you vile awful fool" if i % 2 else " a kind and gentle day") for i in range(n + 20)]
    f = toxicity.features(pa.array(texts))
    w, bias = toxicity.fit([(f[i], i % 2) for i in range(n)])
    scores = [1 / (1 + np.exp(-(w[x].sum() + bias))) for x in f[n:]]
    right = sum((s >= 0.5) == bool((n + i) % 2) for i, s in enumerate(scores))
    assert right >= (19 if n >= 4 else 10) and sum(s >= 0.5 for s in scores) <= 12
    same = toxicity.features(pa.array(["same words"] * n))
    w, bias = toxicity.fit([(same[i], i % 2) for i in range(n)])
    assert not w.any() and bias < -10


def test_rank_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 10_007):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4")
        assert (token_store.decode_ranks(*token_store.encode_ranks(ranks), n) == ranks).all()


# --- classifiers ------------------------------------------------------------------------------


@pytest.mark.parametrize("module, op, label, folds, fold", [(toxicity, toxicity.op6_toxicity, "toxic", 5, 0), (quality, quality.op7_quality, "quality", 3, 1)])
def test_classifier_on_held_out_labels(spark, module, op, label, folds, fold):
    sf = "/root/testdata/sf0.1"
    found = op(spark, sf).collect()
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, known[r.doc_id]) for r in found if r.held_out and known.get(r.doc_id) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_edges(spark, docs, rows, empty, module, label):
    labels = spark.createDataFrame([(4, 1, 1, "x"), (5, 0, 0, "x"), (5, 0, 0, "x"), (6, 1, 1, "x"), (7, 0, 0, "x"), (8, None, None, "x"), (None, 1, 1, "x"), (9, 7, 7, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    model = module.train(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == len(rows) and got[0]["label"] == "mine" and all(0 <= r.score <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.text or ""].add(r.score)
    assert all(len(x) == 1 for x in by.values())
    assert module.score(empty, model).count() == 0
    assert {r.predicted for r in module.score(docs, module.train(docs, labels.where("false"))).collect()} == {0}
    assert {r.predicted for r in module.score(docs, module.train(empty, labels)).collect()} == {0}


# --- licenses ---------------------------------------------------------------------------------


def brute_licenses(text):
    w, starts, labels, score = words(text), [], set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for s in range(len(w) - len(p) + 1):
            if w[s:s + len(p)] == p:
                starts.append(s)
                labels.add(label)
                score = 1.0
    every = set(labels)
    for template, label, share in licenses.TEMPLATES:
        t = words(template)
        for s in range(0, len(w), len(t)):
            n = len(set(t) & set(w[s:s + 2 * len(t)])) / len(set(t))
            if n >= share - 1e-9:
                every.add(label)
                score = max(score, n)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), pytest.approx(score)


def test_licenses_against_brute_force(spark, docs, rows, empty):
    rng = random.Random(5)
    vocabulary = sorted({x for t, _, _ in licenses.TEMPLATES for x in words(t)}) + ["zz", "The", "GNU"]
    texts = []
    for _ in range(150):
        x = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 30, 100]))]
        t = rng.choice([a[0] for a in licenses.TEMPLATES + licenses.PHRASES]).split()
        if rng.random() < 0.4:
            t = [a for a in t if rng.random() < 0.9]
        k = rng.randint(0, len(x))
        texts.append(rng.choice([" ", "-", "\n"]).join([*x[:k], *t, *x[k:]]))
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    for r in licenses.scan(df).collect():
        assert tuple(r[c] for c in licenses.RESULTS) == brute_licenses(r.text)
    for r in licenses.scan(docs).collect():
        assert tuple(r[c] for c in licenses.RESULTS) == brute_licenses(r.text) and r["n"] == "mine"
    assert licenses.scan(empty).count() == 0


# --- fingerprints -----------------------------------------------------------------------------


def test_fingerprints(spark, docs, rows, empty):
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = df.withColumn("fp", fingerprints.fingerprint("text")).select("doc_id", "text", "fp", fingerprints.written("fp").alias("said")).collect()
    said = {}
    for r in got:
        assert said.setdefault(r.text, r.said) == r.said
    by = {r.doc_id: r for r in got}
    assert by[12].said == by[13].said, "the same paragraphs in another order"
    assert by[1].said == by[2].said and len({r.said for r in got}) == len(said) - 1
    assert all(0 <= x < 2**32 for r in got for x in r.fp.equality)


def test_fingerprints_add_and_remove_paragraphs(spark):
    rng = random.Random(6)
    pairs = [(prose(rng, 30) + "\n" + prose(rng, 5), prose(rng, 50, 9)) for _ in range(10)] + [("", "x"), ("a. b", "")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("ab", F.concat_ws("\n", "b", "a"))
    for c in ("a", "b", "ab"):
        df = df.withColumn(f"f{c}", fingerprints.fingerprint(c))
    df = df.withColumn("sum", fingerprints.added("fa", "fb")).withColumn("back", fingerprints.removed("fab", "fb"))
    for r in df.collect():
        assert r["sum"] == r.fab and r.back == r.fa


def test_next_documents(spark, rows, tmp_path, monkeypatch):
    from callgauge.llm import common
    rng = random.Random(8)
    for k, table in enumerate([rows, [(5 * i, prose(rng, rng.randrange(40)), "s") for i in range(700)], rows[:1], []]):
        spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        for size in (500, 7):
            monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
            got = fingerprints.op10_fingerprints(spark, str(tmp_path / str(k))).collect()
            assert len(got) == len(table)
            if len({r[0] for r in table}) == len(table):
                in_order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0))
                by = {r.doc_id: r for r in got}
                for i, (doc, text, _) in enumerate(in_order):
                    text, after = text or "", in_order[(i + 1) % len(in_order)][1] or ""
                    n = len(text) // 4
                    edited = text[: len(text) - n] + after[:n]
                    assert by[doc].n_chars == len(text) and by[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
                    if edited == text:
                        assert by[doc].near_edited == 1.0 and by[doc].fingerprint == by[doc].edited_fingerprint


# --- secrets ----------------------------------------------------------------------------------


def test_secrets_found_and_words_left_alone(spark):
    rng = random.Random(12)
    plain = ["".join(rng.choice(["on", "er", "the", "ing", "st", "ed"]) for _ in range(9)) for _ in range(40)]
    texts, planted = [], set()
    for i in range(160):
        body = [rng.choice(plain + ["the", "and", "with"]) for _ in range(30)]
        kind = i % 4
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        if kind == 0:
            body.insert(5, f'token = "{value}"')
        elif kind == 1:
            body.insert(9, key)
        elif kind == 2:
            body.insert(3, f"sha1: {value}")
        if kind < 2:
            planted.add((i, hashlib.sha256((value if kind == 0 else key).encode()).hexdigest()))
        texts.append((i, " ".join(body), rng.choice(["src/app.py", "tests/data.txt", None]), "mine"))
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, value string")
    got = secrets.scan(df, dictionary_min=2).collect()
    assert {(r.doc_id, r.secret_sha256) for r in got} == planted


def test_secrets_context_and_short_values(spark):
    long = "wJalrXUtnFEMIK7MDENGbPxRfiCYzzEXKEY0" + "/+9"
    texts = [f"a AWS_SECRET_ACCESS_KEY={long} b", f'aws_secret_access_key = "{long}"', "x password=hunter2! y", '{"db_password": "p@ss w", "n": 1}', "pwd=a,pwd=b;api_key: 'k3y'",
             "author: Smith, secretary: Jones, the token ring", " ".join(f"é𝄞 {c * 17}" for c in "abcdefgh"), "A" * 16 + "==" + "B" * 90 + " " + "C" * 20, "x" * 60 + " token=" + "y" * 60 + "=z"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    stored = secrets.candidates(df)
    found = collections.defaultdict(list)
    for r in stored.orderBy("doc_id", "ordinal").collect():
        found[r.doc_id].append(r)
    for i, text in enumerate(texts):  # contexts by position, from the whole text
        at = 0
        for r in found[i]:
            at = text.index(r.value, at)
            assert (r.before, r.after) == (text[max(0, at - 48): at], text[at + len(r.value):][:48])
            at += len(r.value)
    assert [[r.value for r in found[i]] for i in range(6)] == [["AWS_SECRET_ACCESS_KEY=", long], ["aws_secret_access_key", long], ["hunter2!"], ["p@ss"], ["a", "b", "k3y"], []]
    labels = {(r.doc_id, r.ordinal): r.label for r in secrets.rule_labels(stored).collect()}
    assert labels[0, 1] == labels[1, 1] == labels[2, 0] == 1 and labels[0, 0] == 0
    features = {(r.doc_id, r.ordinal): r for r in secrets.with_features(stored, secrets.corpus_words(df)).collect()}
    assert (features[0, 1].named, features[0, 1].assigned) == (1, 1) and (features[1, 1].named, features[1, 1].quoted) == (1, 1)


def test_secrets_do_not_depend_on_the_rows_order(spark):
    """The forest draws its samples in one order, however the rows lie."""
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789") for _ in range(n))
    texts = [f"{rng.choice(['password = ', 'token: ', 'sha256 ', 'see ', 'id='])}{key(rng.randrange(16, 30))} and {prose(rng, 3)}longplainwordswithoutdigits" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("a"))
    got = [sorted(map(tuple, secrets.scan(d).collect())) for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("doc_id")))]
    assert got[0] and got[0] == got[1] == got[2]


def test_secrets_numbers_are_labelled(spark):
    """Bare numbers are like no other labelled kind: without labels of their own, chance kept all or none."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = ["paid with 4111111111111111 today", "4111-1111-1111-1111", "bearer 1234567890123456", "order: 1234567890123456", "password = 1234567890123456", "see 12345678901234567a"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: r.label for r in secrets.rule_labels(secrets.candidates(df)).collect()} == {0: 0, 1: 0, 4: 1}
    for part in range(2):
        texts, planted = [], set()
        for i in range(400):
            kind, value = i % 8, "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 40])))
            texts.append((i, f"{prose(rng, 6)} {[f'token = {value}', digits(16), 'longplainwordswithoutdigits'][min(kind, 2)]} {prose(rng, 6)}", "p"))
            planted |= {i} if kind == 0 else set()
        got = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()
        assert {r.doc_id for r in got} == planted, part


def test_secrets_sample_keeps_the_labels_shares(spark):
    """A form of which most findings are labelled 0 is not kept because one label's rows are sampled more thinly."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(2500):
        like = i % 25 < 4  # of one form: 100 labelled 1 and 300 labelled 0
        value = "".join(rng.choice("0123456789abcdef") for _ in range(24)) if like else "longplainwordswithoutdigits"
        rows.append((i, f"a b {value} c d", "p"))
        labels.append((i, 0, int(i % 25 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    given = spark.createDataFrame(labels, "doc_id long, ordinal int, label int")
    whole, thin = ({r.doc_id for r in secrets.scan(df, labels=given, train_rows=n).collect()} for n in (5000, 400))
    assert len(whole) < 100 and len(thin) < 100


def test_secrets_edges(spark, docs, empty):
    assert secrets.scan(empty).count() == 0
    assert secrets.scan(docs).where("score < 0.5").count() == 0
    one = spark.createDataFrame([(1, "x" * 40 + " " + "AKIA" + "B2" * 8, None), (2, None, "p"), (3, "A" * 200_000, "p")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (9, 0, 0)], "doc_id long, ordinal int, label int")
    assert {(r.doc_id, r.ordinal) for r in secrets.scan(one, labels=labels.where("label = 1")).collect()} == {(1, 0), (1, 1), (3, 0)}
