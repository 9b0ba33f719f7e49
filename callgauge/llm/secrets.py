"""Secret scans: a random forest removes false findings, in DataFrame and SQL operations only.

Candidates are all runs of 16 or more of ``[A-Za-z0-9_+/-]`` with up to two ``=`` after them,
anywhere in a whole text, and values of any length and form right after a credential's name and
an assignment (up to white space, a quote, a bracket, a comma or a semicolon). Their features:

* length, and the shares of digits, of upper and lower case and of distinct characters;
* character transitions: changes of character class, and the mean log-probability of adjacent
  letters under a table of letter pairs counted over all documents' words;
* dictionary coverage: the share of characters in parts that are words of the corpus (letters
  only, 3 to 24, seen at least ``dictionary_min`` times over all documents);
* path: depth, whether it looks like a test or an example, and one of 16 hash buckets;
* neighbouring words, in the 48 characters on either side, other candidates included: a
  credential's name before, an assignment or a quote right before, words for checksums and for
  samples on either side.

The forest (Spark's own) is fitted on a bounded sample of labelled findings: ``train_rows`` of
each label, those with the smallest hash, weighted by the number of findings that each stands for,
so that a score doesn't depend on how many more there are. Labelled findings are a parameter
(doc_id, ordinal, label); without them, ``rule_labels`` labels those whose form leaves no doubt:
published key formats and values assigned to a credential's name against plain words, named
checksums and bare numbers. A kind like none of the labelled ones has an arbitrary score.

Result: a row a finding that the forest keeps: doc_id, ordinal (its number among the document's
candidates, from 0), secret_sha256, n_chars and score. The secret itself isn't returned.

Defined results: null and empty texts have no candidates; a null path is an empty one; repeated
rows are scanned alike; without labelled findings of both kinds every candidate is kept with
score 1; an empty table gives no row. Columns besides doc_id, text and path are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import common

#: In SQL strings, so backslashes and quotes are doubled or written as codes. A value's place is tested for an assignment first, which is cheap.
CANDIDATE = (r"[A-Za-z0-9_+/\\-]{16,}={0,2}|(?<=[=:]\\s{0,2}[\\x22\\x27]?)"
             r"(?<=(?i:passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|bearer|credentials?)(?:[_-][A-Za-z0-9_-]{1,16})?[\\x22\\x27]?\\s{0,2}[=:]\\s{0,2}[\\x22\\x27]?)"
             r"[^\\s\\x22\\x27\\x60,;()<>{}\\[\\]=:][^\\s\\x22\\x27\\x60,;()<>{}\\[\\]]*")
CONTEXT = 48
TRAIN_ROWS = 5_000
TREES, DEPTH, SEED = 24, 6, 11
DICTIONARY_MIN = 5

_NAMES = "(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)"
_SAMPLES = "(?i)(example|sample|dummy|placeholder|changeme|your[_-])"
_SUMS = "(?i)(sha-?[0-9]*|md5|checksum|digest|commit|uuid|etag)"
FEATURES = ["log_length", "digits", "upper", "lower", "other", "distinct_chars", "changes", "hex", "pair_logp", "coverage",
            "path_depth", "path_sample", "path_bucket", "named", "assigned", "quoted", "summed", "sampled"]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """fid (unique), doc_id, path, ordinal, value, before and after of every candidate, as a stored table."""
    texts = docs.select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    found = texts.select("doc_id", "path", F.expr(f"regexp_extract_all(text, '{CANDIDATE}', 0)").alias("values"), F.expr(f"split(text, '{CANDIDATE}', -1)").alias("between"))
    # p holds, for each candidate, the last characters up to its end and the first from its start on; a
    # candidate has a character at least, so that CONTEXT neighbours always cover the context
    ends = f"transform(values, (v, i) -> right(concat(right(between[i], {CONTEXT}), v), {CONTEXT}))"
    starts = f"transform(values, (v, i) -> left(concat(v, left(between[i + 1], {CONTEXT})), {CONTEXT}))"
    before = f"right(concat(array_join(slice(p.ends, greatest(i - {CONTEXT}, 0) + 1, least(i, {CONTEXT})), ''), right(between[i], {CONTEXT})), {CONTEXT})"
    after = f"left(concat(left(between[i + 1], {CONTEXT}), array_join(slice(p.starts, i + 2, {CONTEXT}), '')), {CONTEXT})"
    rows = found.where(F.size("values") > 0).select("doc_id", "path", F.posexplode(F.expr(
        f"transform(array(struct({ends} as ends, {starts} as starts)), p -> transform(values, (v, i) -> struct(v as value, {before} as before, {after} as after)))[0]")).alias("ordinal", "c"))
    return common.stored(rows.select("doc_id", "path", "ordinal", "c.*").withColumn("fid", F.monotonically_increasing_id()), "candidates")


def corpus_words(docs: DataFrame) -> DataFrame:
    """word and n over all whole texts: runs of 3 to 24 ASCII letters, lower-cased."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word"))
    return common.stored(words.where(F.length("word").between(3, 24)).groupBy("word").agg(F.count("*").alias("n")), "words")


def pair_table(words: DataFrame) -> list[float]:
    """Log-probabilities of a letter after a letter (26 x 26), from all words; 676 rows reach the driver."""
    pairs = words.select("n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> (ascii(substring(word, i, 1)) - 97) * 26 + ascii(substring(word, i + 1, 1)) - 97)")).alias("pair"))
    seen = {r["pair"]: float(r["n"]) for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    after = [sum(seen.get(a * 26 + b, 0.0) for b in range(26)) for a in range(26)]
    return [math.log((seen.get(a * 26 + b, 0.0) + 0.5) / (after[a] + 13)) for a in range(26) for b in range(26)]


def with_features(found: DataFrame, words: DataFrame, dictionary_min: int = DICTIONARY_MIN) -> DataFrame:
    """``found`` with the FEATURES columns."""
    table = pair_table(words)
    neutral = math.log(1 / 36)  # a pair that isn't two letters
    parts = found.select("fid", F.explode(F.expr("transform(regexp_extract_all(value, '[A-Z]?[a-z]{2,}|[A-Z]{3,}', 0), p -> lower(p))")).alias("word"))
    covered = parts.join(words.where(F.col("n") >= dictionary_min).select("word"), "word").groupBy("fid").agg(F.sum(F.length("word")).alias("covered"))
    found = found.join(covered, "fid", "left").withColumn("__chars", F.expr("split(value, '')")).withColumn("__pairs", F.lit(table))
    logp = f"""aggregate(zip_with(slice(__chars, 1, length(value) - 1), slice(__chars, 2, length(value) - 1),
        (a, b) -> if(lower(a) between 'a' and 'z' and lower(b) between 'a' and 'z', element_at(__pairs, cast((ascii(lower(a)) - 97) * 26 + ascii(lower(b)) - 96 as int)), {neutral}D)),
        0D, (s, x) -> s + x) / greatest(length(value) - 1, 1)"""

    def share(chars: str):
        return f"regexp_count(value, '{chars}') / length(value)"
    return found.select(
        "fid", "doc_id", "ordinal", "value", "before",
        F.expr("ln(length(value))").alias("log_length"), F.expr(share("[0-9]")).alias("digits"), F.expr(share("[A-Z]")).alias("upper"),
        F.expr(share("[a-z]")).alias("lower"), F.expr(share("[^A-Za-z0-9]")).alias("other"), F.expr("size(array_distinct(__chars)) / length(value)").alias("distinct_chars"),
        F.expr("(regexp_count(value, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') - 1) / length(value)").alias("changes"), F.expr(share("[0-9a-f]")).alias("hex"),
        F.expr(logp).alias("pair_logp"), F.expr("least(1D, coalesce(covered, 0) / length(value))").alias("coverage"),
        F.expr("cast(regexp_count(path, '/') as double)").alias("path_depth"), F.col("path").rlike("(?i)(test|example|sample|fixture|doc)").cast("double").alias("path_sample"),
        F.expr("cast(pmod(xxhash64(path), 16) as double)").alias("path_bucket"), F.col("before").rlike(_NAMES).cast("double").alias("named"),
        F.col("before").rlike("[=:]\\s*[\"']?$").cast("double").alias("assigned"), F.col("before").rlike("[\"']$").cast("double").alias("quoted"),
        (F.col("before").rlike(_SUMS) | F.col("after").rlike(_SUMS)).cast("double").alias("summed"),
        (F.col("before").rlike(_SAMPLES) | F.col("after").rlike(_SAMPLES) | F.col("value").rlike(_SAMPLES)).cast("double").alias("sampled"))


def rule_labels(found: DataFrame) -> DataFrame:
    """doc_id, ordinal and label (1 or 0) of the findings whose form leaves no doubt."""
    key = F.col("value").rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})$")
    assigned = F.col("before").rlike(_NAMES + "[A-Za-z_-]*[\"']?\\s*[=:]\\s*[\"']?$") & F.col("value").rlike("[0-9]") & ((F.length("value") >= 16) | F.col("value").rlike("[A-Za-z]"))
    loose = ~F.col("before").rlike("[=:]\\s*[\"']?$")
    word = ~F.col("value").rlike("[0-9]") & loose
    number = ~F.col("value").rlike("[A-Za-z]") & loose & ~F.col("before").rlike(_NAMES + "[A-Za-z_-]*[\"']?\\s*$")
    named_sum = F.col("before").rlike(_SUMS + "\\s*[=:]?\\s*[\"']?$")
    label = F.when((key | assigned) & ~named_sum, 1).when(word | number | named_sum, 0)
    return found.select("doc_id", "ordinal", label.alias("label")).where("label is not null")


def train(features: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """A forest from at most ``train_rows`` findings of each label; None without both labels."""
    rank = F.xxhash64("doc_id", "ordinal")
    labels = labels.select("doc_id", "ordinal", F.col("label").cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0))
    labels = common.stored(labels.groupBy("doc_id", "ordinal").agg(F.max("label").alias("label")), "labels")
    n = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if len(n) != 2:
        return None
    chosen = [labels.where(F.col("label") == x).orderBy(rank, "doc_id", "ordinal").limit(train_rows).withColumn("weight", F.lit(n[x] / min(n[x], train_rows))) for x in (0.0, 1.0)]
    known = common.stored(chosen[0].unionByName(chosen[1]), "labelled")
    rows = (features.drop("label", "weight").join(F.broadcast(known), ["doc_id", "ordinal"])  # known: at most 2 * train_rows rows
            .groupBy("doc_id", "ordinal").agg(F.min(F.struct("label", "weight", *FEATURES)).alias("r")).select("r.*"))
    # in one order: the forest draws its samples by the place of a row, and would differ from run to run
    ordered = rows.repartition(1).sortWithinPartitions("label", *FEATURES)
    sample = common.stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ordered).select("label", "weight", "features"), "forest-sample")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(sample)


def scan(docs: DataFrame, path: str = "source", labels: DataFrame | None = None, threshold: float = 0.5, train_rows: int = TRAIN_ROWS,
         dictionary_min: int = DICTIONARY_MIN) -> DataFrame:
    """doc_id, ordinal, secret_sha256, n_chars and score of every finding that the forest keeps."""
    found = candidates(docs, path)
    features = common.stored(with_features(found, corpus_words(docs), dictionary_min), "secret-features")
    model = train(features, rule_labels(found) if labels is None else labels, train_rows)
    if model is None:
        scored = features.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features)).withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select(
        "doc_id", "ordinal", F.sha2("value", 256).alias("secret_sha256"), F.length("value").cast("long").alias("n_chars"), "score")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
