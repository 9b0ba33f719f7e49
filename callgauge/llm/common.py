"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings of the Arrow operators (small batches bound the Python workers' memory)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` for what runs inside, for narrow rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or, where that is
    unset, a folder in the warehouse, which executors and driver share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/callgauge-llm/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; each call gives another one."""
    return f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: this cuts the lineage,
    and a lost executor costs the readers nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing will read again."""
    for table_ in tables:
        _delete(table_.sparkSession, table_.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application's operators left in the shared folder. Call it when their
    results have been written: results read their scratch tables."""
    _delete(spark, _own_scratch(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(doc_id, folds: int, fold: int):
    """True where crc32 of ``doc_id`` as text falls in ``fold``; a null id is never held out
    (its labels can't be joined either)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int, fold: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``rows`` documents outside the held-out fold, in
    one partition: those whose doc_id has the smallest hash. A doc_id counts once, with its
    greatest label and its least text."""
    rank = F.xxhash64("doc_id")
    known = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
             .groupBy("doc_id").agg(F.max("label").alias("label"))
             .orderBy(rank, "doc_id").limit(rows))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")  # at most ``rows`` rows
    return (texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
            .repartition(1).sortWithinPartitions(rank, "doc_id"))
