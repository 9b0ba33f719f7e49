"""Spelling variants, personal data and ranked search: edge rows, and each against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from callgauge.llm import lexical_search, personal, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def clashing(df):
    for name in ("word", "n", "near", "node", "term", "score", "rank", "item", "row", "spans", "kind", "pattern", "h", "run", "d"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Word word WORD"), (4, "Word word WORD"), (None, "word ÉTÉ été"), (5, "x" * 50_000 + " " + "a b " * 20_000), (6, "☃ 𝄞 ☃")]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


# --- spelling variants ------------------------------------------------------------------------


def brute_variants(counts, ratio=2):
    near = collections.defaultdict(set)
    whole = set(counts)
    for w in counts:
        cuts = {w[:i] + w[i + 1:] for i in range(len(w))}
        for v in cuts & whole:
            near[w].add(v)
            near[v].add(w)
    at = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            at[w[:i], w[i + 1:]].add(w)
    for group in at.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def brute_counts(rows, least=3):
    counts = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def as_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_variants_against_brute_force(spark):
    """Words over few letters, so that most have many neighbours, with repeated letters, prefixes of each other and long tails."""
    rng = random.Random(6)
    counts = {}
    for _ in range(1500):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 6, 7, 8, 9])))
        counts[w] = rng.randint(3, 60)
    for w in list(counts)[:100]:
        counts[w + "tail" * 3] = rng.randint(3, 60)
        counts[w + "tail" * 2 + "tai"] = rng.randint(3, 60)
        counts["ÿ" + w] = 4
    for k in range(5, 20):
        counts["a" * k] = 3 * k
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(spelling.variants(df)) == brute_variants(counts)


def test_roots_follow_long_chains(spark):
    counts = {}
    word = "aaaaaaaaaa"
    for k in range(10):
        counts[word[:k] + "b" * k + word[2 * k:] if 2 * k < 10 else "b" * k + word[k:]] = 3 * 2**k
    chain = {"abcde": 3, "abcdf": 6, "abcgf": 12, "abhgf": 24, "aihgf": 48, "jihgf": 96, "jihgfk": 192}
    counts.update(chain)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = as_rows(spelling.variants(df))
    assert got == brute_variants(counts) and {r[2] for r in got if r[0] in chain} == {"jihgfk"}


def test_counts_of_documents_against_brute_force(spark, docs):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéÀ÷") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    rows = [(i if i % 5 else None, rng.choice([" ", "-1-", "\n"]).join(rng.choice(vocabulary) for _ in range(60))) for i in range(300)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = brute_counts(rows)
    found = spelling.word_counts(spelling.misspelt(spelling.runs(df)))
    assert {r.word: r.n for r in found.collect()} == counts and len(counts) > 100
    assert as_rows(spelling.variants(found)) == brute_variants(counts)
    edge = spelling.word_counts(spelling.misspelt(spelling.runs(docs)), 3, 2)
    assert {"word": 5}.items() <= {r.word: r.n for r in spelling.word_counts(spelling.misspelt(spelling.runs(docs.where("doc_id = 4"))), 1, 2).collect()}.items() or edge.count() >= 1
    assert spelling.variants(spelling.word_counts(spelling.misspelt(spelling.runs(docs.where("false"))))).count() == 0


# --- personal data ----------------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_seeds(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = [c for c in m.group() if c in "0123456789"]
            odd = [int(c) for c in digits[::-1][::2]]
            even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or k == 2 and 12 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0 or k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_seeds_against_the_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "-", "+", "1", "22", "255", "256", "300.", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-0123", "é", "𝄞", " ", "x", "%", "0", "()", "\n", "@x.y", "12345678901234567890"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        assert personal.seeds(text) == brute_seeds(text), text
    assert personal.seeds("a" * 200_000 + "@") == [] and personal.seeds("1" * 200_000) == []  # in proportion to the length


def test_base_columns(spark, docs):
    texts = ["mail x.y@example.org or +44 20 7946 0018 from 10.1.2.3, card 4111 1111 1111 1111", "𝄞 a@b.cd 999.1.1.1", None, "", "none"]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in personal.find_personal(df).collect():
        text = texts[r.doc_id] or ""
        base = brute_seeds(text)
        named = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest() and r.base_spans == named and set(filter(None, named.split(","))) <= set(filter(None, r.spans.split(",")))
    assert personal.find_personal(docs).count() == docs.count()
    assert {(r.n_email, r.spans) for r in personal.find_personal(docs).collect()} == {(0, "")}
    assert personal.find_personal(docs.where("false")).count() == 0


def brute_discovered(texts, rounds=3):
    """The rounds of the graph over all mentions, in Python."""
    edges = {}
    for t in texts:
        base = personal.seeds(t)
        for a, b, k in [(a, b, k) for a, k, b in base] + [(a, b, -1) for a, b in personal.candidates(t, base)]:
            who = f"{k} {personal.identity(t[a:b])}" if k >= 0 else personal.identity(t[a:b])
            for p in personal.patterns(t, a, b):
                kinds = [k] if k >= 0 else personal.plausible(t[a:b])
                edges[p, who] = max(edges.get((p, who), (k, kinds))[0], k), max(edges.get((p, who), (k, kinds))[1], kinds)
    total = collections.Counter(p for p, _ in edges)
    accepted = {}
    for _ in range(rounds):
        pos = collections.Counter()
        for (p, who), (k, _) in edges.items():
            if k >= 0:
                pos[p, k] += 1.0
            elif who in accepted:
                pos[p, accepted[who][0]] += accepted[who][1]
        sure = {pk: n / (total[pk[0]] + 1) for pk, n in pos.items() if n >= 3 and n / (total[pk[0]] + 1) >= 0.8}
        scores = collections.defaultdict(lambda: 1.0)
        for (p, who), (k, kinds) in edges.items():
            for kind in kinds if k < 0 else ():
                if (p, kind) in sure:
                    scores[who, kind] *= 1 - sure[p, kind]
        accepted = {}
        for (who, kind), miss in scores.items():
            if 1 - miss >= 0.8 - 1e-12 and (who not in accepted or (1 - miss, -kind) > (accepted[who][1], -accepted[who][0])):
                accepted[who] = kind, 1 - miss
    return {who: kind for who, (kind, _) in accepted.items()}


def test_patterns_discover_unseen_identifiers(spark):
    """Local numbers and spelled-out addresses where seeds stand elsewhere are found, also where no pattern is; order
    numbers in other places aren't. A second-round identifier stands only beside those found in the first."""
    rng = random.Random(3)
    texts = []
    for i in range(30):
        texts.append(f"you can phone me +1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} after lunch")
        texts.append(f"or write to user{i}@mail.example.org when ready")
        texts.append(f"the order number {rng.randrange(10**9, 10**10)} was shipped from 10.0.{i}.7 today")
    texts += [f"you can phone me +1 555 {k:07d} after lunch" for k in range(120)]
    texts += ["you can phone me (555) 123-4567 after lunch", "or write to jo (at) example (dot) org when ready", "it says 555.123.4567 somewhere", "nothing 998877665544 here"]
    texts += ["ring back 555 123 4567 tonight", "ring back 555 222 3333 tonight", "you can phone me 555 222 3333 after lunch"] * 2
    texts += [f"ring back 555 999 {k:04d} tonight" for k in range(15)] + [f"you can phone me 555 999 {k:04d} after lunch" for k in range(15)] + ["ring back 555 999 7777 tonight"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal.find_personal(df).collect()}
    accepted = brute_discovered(texts)
    for i, t in enumerate(texts):
        base = brute_seeds(t)
        found = [(a, accepted[personal.identity(t[a:b])], b) for a, b in personal.candidates(t, base) if personal.identity(t[a:b]) in accepted]
        assert got[i].spans == ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + found)), t
    spans = {t: got[i].spans for i, t in enumerate(texts)}
    assert spans["you can phone me (555) 123-4567 after lunch"] == "phone:17:31"
    assert spans["or write to jo (at) example (dot) org when ready"].startswith("email:12:")
    assert spans["it says 555.123.4567 somewhere"] == "phone:8:20"  # the same number, without a pattern
    assert spans["nothing 998877665544 here"] == "" and "order" in texts[2] and got[2].spans.count(":") == 2
    assert spans["ring back 555 999 7777 tonight"] == "phone:10:22"  # by a pattern of the first round's finds


# --- ranked search ----------------------------------------------------------------------------


def brute_search(docs, items, k=20):
    docs = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    out, queries = {}, collections.defaultdict(list)
    for item, text in items:
        queries[item] += TERM.findall((text or "").translate(LOWER))
    counts = [collections.Counter(w) for _, w in docs]
    for item, terms in queries.items():
        scored = []
        for (doc, w), tf in zip(docs, counts):
            if w:
                m = 100 - 25 + (25 * len(w) * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms if tf[t])
                if s > 0:
                    scored.append((-s, doc is None, doc or 0, doc))
        out[item] = [(doc, -s) for s, _, _, doc in sorted(scored, key=lambda x: x[:3])[:k]]
    return out


def got_search(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.mark.parametrize("block_bytes", [1 << 23, 400])
def test_search_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "ab", "a", "b", "𝄞"]
    docs = [(rng.choice([None, i, i, i, 7]), rng.choice([" ", "-", ". "]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 80])))) for i in range(250)]
    docs += [(500 + i, "W1 w2-w3") for i in range(30)] + [(900, None)]  # ties
    items = [(i, " ".join(rng.choices(vocabulary + ["unknown"], k=rng.choice([0, 1, 3, 12])))) for i in range(25)] + [(3, "w1 w1 w2"), (None, "ab a b"), (60, None), (61, "w1 w2 w3")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = got_search(lexical_search.search(df, bench, block_bytes=block_bytes))
    want = {k: v for k, v in brute_search(docs, items).items() if v}
    assert got == want


def test_search_edges(spark, docs):
    items = spark.createDataFrame([("q1", "WORD"), ("q2", "nowhere"), ("q3", None)], "item_id string, text string")
    assert got_search(lexical_search.search(docs, items)).keys() == {"q1"}
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0
    with_ties = got_search(lexical_search.search(docs.where("doc_id = 4").unionByName(docs.where("doc_id = 2")), items, k=1))
    assert with_ties == {} or len(with_ties["q1"]) == 1
