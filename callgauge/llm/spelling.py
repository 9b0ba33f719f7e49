"""Spelling variants: words one edit apart, found by a relational trie frontier.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased, counted over all whole texts
(``misspelt`` first deletes a character of some runs, chosen by a checksum).

All words make a trie, held as a table of edges: parent and child node (hashes of the prefixes),
character, the characters that follow the child, the word that ends there, and, where only one word
lies below the child, that word and its rest. States (word, rest of the word from its position on, node, edits)
are joined with the edges of one depth after the other: an edge matches the next character, or, for
the one edit, replaces it, is inserted before it, or matches the one after it, which deletes it. A state that ends with one
edit on a word has found a neighbour; one whose next character doesn't follow the child dies before it is shuffled,
and below a node with a single word the rest is compared at once.

An edit in the second half of a word leaves its first half as it is, and one in the first half the second:
so a word starts at the node of its first half in the trie of the words, and at that of its
second half, reversed, in the trie of the reversed words, and not at the root, whose edges all words would share.

Result of ``variants``, a row a word: word, form (its near word of largest n, ties by the smallest in
code-point order, if that n is ``ratio`` times the word's or more; else null), root (the last of
following forms; the word itself without any), n, n_near (how many near words) and form_n.

Defined results: null and empty texts have no words; a null doc_id is empty in the checksum; equal rows
count each; an empty table gives no row. Other columns are not read. The number of levels is the longest prefix
that two words share; each is a job, whatever the words' length beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm import common

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-z\u00C0-\u00FF]+"
DELETED = 97


def runs(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """doc_id and run: every maximal run of that many letters or more, lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    found = found.where(F.char_length("run") >= least_length)
    ascii_ = F.octet_length("run") == F.char_length("run")  # lower() changes other letters as well
    return found.withColumn("run", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())))


def misspelt(found: DataFrame, every: int = DELETED) -> DataFrame:
    """word: runs, of which a checksum of doc_id and run picks one in ``every`` to lose a character."""
    found = (found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))))
    return found.select(F.expr(f"if(h % {every} = 0, concat(substring(run, 1, cast(h % char_length(run) as int)), substring(run, cast(h % char_length(run) as int) + 2)), run)").alias("word"))


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _bit(letter: str) -> str:
    """The place of a letter among a-z and U+00C0 to U+00FF."""
    return f"if(ascii({letter}) < 192, ascii({letter}) - 97, ascii({letter}) - 166)"


def _edges(words: DataFrame) -> DataFrame:
    """The edges of both tries below nodes that two words or more share: parent, depth (the
    parent's), letter, child, low and high (bits of the letters after the child), here (the word that ends
    at the child), only and tail (the only word below the child, and its rest from there)."""
    rows = (words.selectExpr("word", "inline(array(struct(0 as way, word as s), struct(1 as way, reverse(word) as s)))")
            .selectExpr("word", "way", "s", "explode(sequence(3, char_length(s) + 1)) as k")  # no word starts above depth 2; the last is the word's end
            .selectExpr("word", "k - 1 as depth", "xxhash64(way, substring(s, 1, k - 1)) as parent", "substring(s, k, 1) as letter",
                        "xxhash64(way, substring(s, 1, k)) as child", "substring(s, k + 1) as tail"))
    bit = _bit("tail")
    edges = rows.groupBy("parent", "depth", "letter", "child").agg(
        F.count("*").alias("c"), F.min("word").alias("only"), F.min("tail").alias("tail"), F.min(F.expr("if(tail = '', word, null)")).alias("here"),
        F.bit_or(F.expr(f"if(tail <> '' and {bit} < 63, shiftleft(1L, {bit}), 0L)")).alias("low"),
        F.bit_or(F.expr(f"if(tail <> '' and {bit} >= 63, shiftleft(1L, {bit} - 63), 0L)")).alias("high"))
    below = F.sum("c").over(Window.partitionBy("parent"))  # at most one edge a letter, and the end of a word
    return (edges.withColumn("below", below).where("below > 1 and letter <> ''")
            .select("parent", "letter", "child", "low", "high", "here", F.expr("if(c = 1, only, null)").alias("only"), F.expr("if(c = 1, tail, null)").alias("tail"), "depth"))


_FIRST = _bit("rest")
#: What an edge does to a state: it matches the next letter (1), replaces it (2), is inserted (3), or matches the one after it (4).
_MOVES = """case move when 1 then s_rest <> '' and letter = substring(s_rest, 1, 1)
    when 2 then s_edits = 0 and s_rest <> '' and letter <> substring(s_rest, 1, 1)
    when 3 then s_edits = 0
    else s_edits = 0 and char_length(s_rest) > 1 and letter = substring(s_rest, 2, 1) end"""
_REST = "substring(s_rest, case move when 3 then 1 when 4 then 3 else 2 end)"
#: A word found: the only one below the child, the one that ends there, or the state's own without its last letter.
_NEAR = """case when edits = 1 and only is not null then if(rest = tail, only, null)
    when edits = 1 and rest = '' then here
    when edits = 0 and only is null and char_length(rest) = 1 then here end"""
_ALIVE = f"""only is null and (edits = 0 or rest <> '' and if({_FIRST} < 63, getbit(low, {_FIRST}), getbit(high, {_FIRST} - 63)) = 1)"""


def near_words(words: DataFrame) -> DataFrame:
    """word and near: all ordered pairs of words (distinct, of ``LEAST_LENGTH`` letters or more) that one edit turns into each other."""
    spark = words.sparkSession
    path = common.scratch_path(spark, "trie-edges")
    _edges(words).write.partitionBy("depth").option("compression", "zstd").parquet(path)
    schema = "parent long, letter string, child long, low long, high long, here string, only string, tail string, depth int"
    edges = spark.read.schema(schema).parquet(path)
    starts = (words.selectExpr("word", "inline(array(struct(0 as way, word as s, cast(floor(char_length(word) / 2) as int) as d), "
                               "struct(1 as way, reverse(word) as s, cast(ceil(char_length(word) / 2) as int) as d)))")
              .selectExpr("word", "substring(s, d + 1) as s_rest", "xxhash64(way, substring(s, 1, d)) as node", "0 as s_edits", "d")
              .join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_semi"))
    starts = common.stored(starts.select("word", "s_rest", "node", "s_edits", "d"), "trie-starts")
    depths = {r["d"]: True for r in starts.select("d").distinct().collect()}  # a row a length of half a word
    pairs, alive, k = [], None, min(depths, default=0)
    while depths or alive is not None:
        states = starts.where(F.col("d") == k).drop("d") if depths.pop(k, None) else None
        if alive is not None:
            states = alive if states is None else states.unionByName(alive)
        level = edges.where(F.col("depth") == k).drop("depth")
        moved = (states.join(level, (F.col("node") == F.col("parent")) & ((F.col("s_edits") == 0) | (F.col("letter") == F.substring("s_rest", 1, 1))))
                 .withColumn("move", F.explode(F.array(*map(F.lit, range(1, 5))))).where(_MOVES)
                 .selectExpr("word", "child", "low", "high", "here", "only", "tail", f"{_REST} as rest", "if(move = 1, s_edits, 1) as edits")
                 .selectExpr("word", "rest", "child", "edits", f"{_NEAR} as near", f"coalesce({_ALIVE}, false) as alive").where("alive or near is not null"))
        moved = common.stored(moved, f"trie-level-{k}")
        pairs.append(moved.where("near is not null").select("word", "near"))
        alive = moved.where("alive").select("word", F.col("rest").alias("s_rest"), F.col("child").alias("node"), F.col("edits").alias("s_edits"))
        if alive.isEmpty():
            alive, k = None, min(depths, default=0)
        else:
            k += 1
    found = pairs[0] if pairs else spark.createDataFrame([], "word string, near string")
    for more in pairs[1:]:
        found = found.unionByName(more)
    return found.distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of counted words (word, n)."""
    words = common.stored(words, "words")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (near_words(words.select("word")).join(counts, "near").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")))
    takes = F.col("form_n") >= ratio * F.col("n")
    formed = (words.join(best, "word", "left").withColumn("form_n", -F.col("b.m"))
              .select("word", F.when(takes, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form_n")).alias("form_n")))
    formed = common.stored(formed, "forms")
    # n grows along forms by the ratio at least, and each round follows twice as many
    to = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        to = common.stored(to, "roots")
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if to.join(further, "root", "left_semi").isEmpty():
            break
        to = to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return (formed.join(to, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


ORACLE = r"""
WITH RECURSIVE tab AS MATERIALIZED (
    SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
found AS MATERIALIZED (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
keyed AS (SELECT run, count(*) AS c, concat(doc_id, ':', run) AS k FROM found GROUP BY doc_id, run),
hexed AS (SELECT run, c, hex(encode(k)) AS x FROM keyed),
hashed AS (
    SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                                   lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h
    FROM hexed, tab),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
    SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
best AS (
    SELECT near.word, count(*) AS n_near, min_by(near, (-m.n, near)) AS form, max(m.n) AS form_n
    FROM near JOIN words m ON m.word = near.near GROUP BY near.word),
formed AS MATERIALIZED (
    SELECT w.word, CASE WHEN form_n >= 2 * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
follow AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT follow.word, f.form FROM follow JOIN formed f ON f.word = follow.root WHERE f.form IS NOT NULL),
last AS (SELECT follow.word, root FROM follow JOIN formed f ON f.word = root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    return variants(word_counts(misspelt(runs(docs, LEAST_LENGTH))))  # a run only gets shorter
