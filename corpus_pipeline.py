"""A corpus pipeline: each stage applies one operator of ``callgauge.llm`` to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents:

1. toxicity: documents scored 0.5 or more go;
2. near_duplicates: of each class of texts linked by a five-word Jaccard similarity of 0.8 or more,
   one row stays: that of the least doc_id (null last) and text key;
3. decontamination: documents of which a twentieth or more of the words lies in benchmark windows go;
4. mixing: each document comes as many times as the mix to the sources' targets takes it;
5. token_ids: binary shards of frequency-ranked ids; a row a document from what the shards hold.

Defined results: a null text is scored, kept and mixed like an empty one, and gives the end id alone;
texts without words are near duplicates of none; rows with a null or a repeated doc_id are
told apart by their text, and only rows of equal doc_id and text are one; an empty table goes
through all stages and gives no row; columns of documents with names that an operator gives its
results (score, size, ...) keep their own values; with too few labels to tell the classes apart nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import common, decontaminate, mixing, ngram_join, token_store, toxicity


def _aside(docs: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """``docs`` with its own columns of an operator's result names out of the way."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in results})


def _back(found: DataFrame, docs: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` of what an operator found."""
    return found.select(*(F.col(f"__own_{c}").alias(c) if c in results else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_aside(docs, toxicity.RESULTS), model).where("predicted = 0"), docs, toxicity.RESULTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heads = (ngram_join.similar_documents(docs).where("is_head").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
             .agg(F.when(F.max("copies") > 1, F.count("*")).otherwise(1).alias("__rows")))
    key = ngram_join.text_key(F.col("text").cast("string"))
    kept = docs.join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__key")))
    repeated = kept.where("__rows > 1").dropDuplicates(["__id", "__key"])  # rows of equal doc_id and text
    return kept.where("__rows = 1").unionByName(repeated).select(*(docs[c] for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(_aside(docs, decontaminate.RESULTS), common.table(spark, sf_dir, "benchmark"))
    return _back(marked.where("not contaminated"), docs, decontaminate.RESULTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_aside(docs, mixing.RESULTS)).where("times > 0")
    return _back(mixed.withColumn("__time", F.explode(F.expr("sequence(1L, times)"))), docs, mixing.RESULTS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    store = token_store.write_store(docs, common.scratch_path(spark, "token-store"), path("word_bpe_49k.json"))
    return token_store.read_store(spark, store)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL can't express the trained classifier, the tokenizer or the seeded choice of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
