"""Loads that store several tables as one commit, and changes of what is stored.

A load writes its rows of every table under partitions of its own (source,
epoch, attempt) and then appends one row a partition to the manifest, in one
file: only that append makes the load visible, in all its tables at once. What
an attempt left that never came so far is in no reader's way, and a load that
is in the manifest is not written again.

A later change (erasure, retention) replaces single partitions: it writes new
ones under an attempt of its own and appends rows of a higher version, or rows
without an attempt for partitions that are gone. Readers take the newest version of
each partition; the files of older ones are deleted afterwards.

Partitions of a table are by load, and by the column that ``PARTS`` names for
it. The manifest holds a row a partition, with its number of rows; nothing here
reads data to plan a change by time. Each (source, epoch) has one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from callgauge.constants import RETENTION_DAYS

LOAD = ["source", "epoch"]
#: The columns that a load adds to its rows.
ADDED = [StructField("source", StringType()), StructField("epoch", LongType()), StructField("attempt", StringType())]
#: The column (besides the load) by which a table is partitioned.
PARTS = {"events": "event_month", "keys": "event_month", "rollup_delta": "bucket_day", "dlq": "seen_day"}
MANIFEST = "manifest"
MANIFEST_SCHEMA = "table_name string, source string, epoch long, part string, version long, attempt string, rows long"
#: Tables that age: the policy's name for each, and the pattern of a partition's first day and its length.
AGING = {"events": ("raw", "concat(part, '-01')", "INTERVAL 1 MONTH"), "rollup_delta": ("rollup", "part", "INTERVAL 1 DAY"), "dlq": ("dlq", "part", "INTERVAL 1 DAY")}


def stored(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """The table at ``path``; None if nothing was written there yet. Any other error is raised."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def new_attempt() -> str:
    return f"a{uuid.uuid4().hex}"


def manifest(spark: SparkSession, base: str) -> DataFrame | None:
    return stored(spark, f"{base}/{MANIFEST}", MANIFEST_SCHEMA)


def live_parts(spark: SparkSession, base: str, table: str | None = None) -> DataFrame | None:
    """The manifest's newest row of each partition that is not gone."""
    m = manifest(spark, base)
    if m is None:
        return None
    if table is not None:
        m = m.where(F.col("table_name") == table)
    newest = m.groupBy("table_name", *LOAD, "part").agg(F.max(F.struct("version", "attempt", "rows")).alias("n"))
    return newest.where("n.attempt IS NOT NULL").select("table_name", *LOAD, "part", "n.version", "n.attempt", "n.rows")


def is_committed(spark: SparkSession, base: str, source: str, epoch: int) -> bool:
    m = manifest(spark, base)
    return m is not None and not m.where((F.col("source") == source) & (F.col("epoch") == epoch)).isEmpty()


def _part(table: str):
    return F.col(PARTS[table]).cast("string") if table in PARTS else F.lit("")


def read_attempts(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The rows of a table's live partitions, with source, epoch and attempt."""
    data, parts = stored(spark, f"{base}/{table}"), live_parts(spark, base, table)
    if data is None or parts is None:
        return None
    parts = parts.select(F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), F.col("attempt").alias("_attempt"), F.col("part").alias("_part"))
    mine = (F.col("source").cast("string") == F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("attempt") == F.col("_attempt")) & (_part(table) == F.col("_part"))
    return data.join(parts, mine, "left_semi")


def read_table(spark: SparkSession, base: str, table: str, but: tuple[str, int] | None = None) -> DataFrame | None:
    """A table's rows as of the last commit, with source and epoch, without those of the load ``but``; None before the first."""
    rows = read_attempts(spark, base, table)
    if rows is None:
        return None
    if but is not None:
        rows = rows.where(~((F.col("source").cast("string") == but[0]) & (F.col("epoch") == but[1])))
    return rows.drop("attempt")


def write_part(df: DataFrame, base: str, table: str, source: str, epoch: int, attempt: str) -> None:
    """One table's rows of a load, in partitions that no reader sees before :func:`commit`."""
    by = [PARTS[table]] if table in PARTS else []
    (df.withColumn("source", F.lit(source)).withColumn("epoch", F.lit(epoch)).withColumn("attempt", F.lit(attempt))
     .write.mode("append").option("compression", "zstd").partitionBy(*LOAD, "attempt", *by).parquet(f"{base}/{table}"))


def _written(spark: SparkSession, base: str, table: str, attempt: str, version) -> DataFrame | None:
    """Manifest rows of what an attempt wrote of a table, counted in its files (by their footers: no column is read)."""
    part = f", {PARTS[table]} string" if table in PARTS else ""
    data = stored(spark, f"{base}/{table}", f"source string, epoch long, attempt string{part}")
    if data is None:  # no load has had a row yet
        return None
    return (data.where(F.col("attempt") == attempt).groupBy(*LOAD, _part(table).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table_name"), F.col("source").cast("string").alias("source"), F.col("epoch").cast("long").alias("epoch"), "part",
                    F.lit(version).cast("long").alias("version"), F.lit(attempt).alias("attempt"), "rows"))


def commit(rows: DataFrame, base: str) -> None:
    """Append rows to the manifest in one file: all of them count from then on, or none."""
    rows.select(*(c.split()[0] for c in MANIFEST_SCHEMA.split(", "))).coalesce(1).write.mode("append").parquet(f"{base}/{MANIFEST}")


def _read_attempt(spark: SparkSession, base: str, table: str, df: DataFrame, source: str, epoch: int, attempt: str) -> DataFrame:
    """What an attempt wrote of ``df``, read back by the schema of ``df``: the files of other loads may have other columns."""
    df = df.drop(*LOAD, "attempt")
    data = stored(spark, f"{base}/{table}", StructType([*df.schema, *ADDED]))
    if data is None:  # it had no row, and none was stored before
        return df.limit(0)
    mine = (F.col("source").cast("string") == source) & (F.col("epoch") == epoch) & (F.col("attempt") == attempt)
    return data.where(mine).drop(*LOAD, "attempt")


def write_load(spark: SparkSession, base: str, source: str, epoch: int, tables: dict[str, DataFrame | Callable]) -> bool:
    """Store a load's tables as one commit. False, and nothing written, if the load is stored already. A table
    may be a function of the tables before it, as they were written: these aren't computed once more for it then."""
    if is_committed(spark, base, source, epoch):
        return False
    attempt, before = new_attempt(), {}
    for table, df in tables.items():
        if callable(df):
            df = df({t: _read_attempt(spark, base, t, d, source, epoch, attempt) for t, d in before.items()})
        write_part(df, base, table, source, epoch, attempt)
        before[table] = df
    rows = spark.createDataFrame([("load", source, epoch, "", 0, attempt, 0)], MANIFEST_SCHEMA)  # a load without a row is one as well
    for table in tables:
        written = _written(spark, base, table, attempt, 0)
        rows = rows if written is None else rows.unionByName(written)
    commit(rows, base)
    return True


def _delete_dead(spark: SparkSession, base: str, table: str) -> int:
    """Delete the files of partitions that were committed once and aren't live any more. Returns
    their number. The driver handles a row a partition to delete."""
    live = live_parts(spark, base, table).select("source", "epoch", "part", "attempt")
    dead = (manifest(spark, base).where((F.col("table_name") == table) & F.col("attempt").isNotNull()).select("source", "epoch", "part", "attempt").distinct()
            .join(live, ["source", "epoch", "part", "attempt"], "left_anti"))
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for r in dead.toLocalIterator():
        names = [("source", r["source"]), ("epoch", str(r["epoch"])), ("attempt", r["attempt"])] + ([(PARTS[table], r["part"])] if table in PARTS else [])
        path = jvm.org.apache.hadoop.fs.Path("/".join([base, table, *(f"{k}={escape(v)}" for k, v in names)]))
        n += path.getFileSystem(conf).delete(path, True)
    return n


def rewrite_events(spark: SparkSession, base: str, conversations: DataFrame, changes: dict[str, str]) -> int:
    """Set ``changes`` (column -> SQL value) in the stored events of ``conversations`` (column id),
    by writing anew only the partitions that hold one of them: found by key, replaced in one
    commit, and the old files deleted. All other files stay as they are. Returns the number of replaced partitions."""
    from callgauge.session import checkpoint_dir

    ids = conversations.select(F.col("id").alias("_id")).distinct()
    events = read_attempts(spark, base, "events")
    key = ["source", "epoch", "event_month"]
    at = f"{checkpoint_dir(spark).rstrip('/')}/rewrite-{new_attempt()}"
    (events.join(ids, F.col("conversation_id") == F.col("_id"), "left_semi").select(*key, "attempt").distinct()).write.parquet(at)
    hit = spark.read.parquet(at)
    n = hit.count()
    if n:
        attempt = new_attempt()
        rows = events.join(hit, [*key, "attempt"], "left_semi").join(ids, F.col("conversation_id") == F.col("_id"), "left")
        found = F.col("_id").isNotNull()
        rows = rows.select(*(F.when(found, F.expr(changes[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in events.columns))
        (rows.drop("attempt").withColumn("attempt", F.lit(attempt))
         .write.mode("append").option("compression", "zstd").partitionBy(*LOAD, "attempt", "event_month").parquet(f"{base}/events"))
        old = live_parts(spark, base, "events").select(*LOAD, "part", (F.col("version") + 1).alias("version"))
        commit(_written(spark, base, "events", attempt, 0).drop("version").join(old, [*LOAD, "part"]), base)
    _delete_dead(spark, base, "events")
    return n


def compact(spark: SparkSession, base: str, table: str, merge) -> int:
    """Fold the parts of each partition that has several (of one load each) into one, so that a read
    opens few files however many loads there were: one commit adds the merged rows and takes
    the parts away that are in them. ``merge`` gives a table's rows, with its partition column, from
    the folded ones. Returns the number of this compaction."""
    from callgauge.session import checkpoint_dir

    parts = live_parts(spark, base, table)
    several = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    at = f"{checkpoint_dir(spark).rstrip('/')}/compact-{new_attempt()}"
    parts.join(several, "part", "left_semi").write.parquet(at)
    fold = spark.read.schema(parts.schema).parquet(at)
    last = manifest(spark, base).where("source = 'compaction'").agg(F.max("epoch")).first()[0]
    epoch = 0 if last is None else last + 1
    if fold.isEmpty():
        return epoch
    attempt = new_attempt()
    taken = fold.select(F.col("attempt").alias("_a"), F.col("part").alias("_p"))
    rows = read_attempts(spark, base, table).join(taken, (F.col("attempt") == F.col("_a")) & (_part(table) == F.col("_p")), "left_semi")
    write_part(merge(rows.drop(*LOAD, "attempt")), base, table, "compaction", epoch, attempt)
    gone = fold.select("table_name", *LOAD, "part", (F.col("version") + 1).alias("version"), F.lit(None).cast("string").alias("attempt"), F.lit(0).cast("long").alias("rows"))
    commit(_written(spark, base, table, attempt, 0).unionByName(gone), base)
    _delete_dead(spark, base, table)
    return epoch


ERASED = {"input_preview": "CAST(NULL AS STRING)", "output_preview": "CAST(NULL AS STRING)", "user_id": "CAST(NULL AS STRING)", "session_id": "CAST(NULL AS STRING)"}
DETACHED = {"conversation_id": "CAST(NULL AS STRING)", "message_id": "CAST(NULL AS STRING)"}


def erase_conversations(spark: SparkSession, base: str, conversations: DataFrame) -> int:
    """Remove what was said in these conversations from the stored log; latency, tokens and cost stay."""
    return rewrite_events(spark, base, conversations, ERASED)


def delete_conversations(spark: SparkSession, base: str, conversations: DataFrame) -> int:
    """Detach the stored events of deleted conversations, which keep their numbers."""
    return rewrite_events(spark, base, conversations, DETACHED)


def expired_parts(spark: SparkSession, base: str, as_of: str) -> DataFrame:
    """The live partitions of each aging table and whether all of one lies behind its retention:
    from the manifest alone."""
    parts = live_parts(spark, base)
    rule = [f"WHEN table_name = '{t}' AND part RLIKE '^[0-9-]+$' THEN to_timestamp({first}) + {length} <= TIMESTAMP '{as_of}' - INTERVAL {RETENTION_DAYS[policy]} DAYS"
            for t, (policy, first, length) in AGING.items()]
    return parts.where(F.col("table_name").isin(*AGING)).withColumn("expired", F.expr(f"CASE {' '.join(rule)} ELSE false END"))


def drop_expired(spark: SparkSession, base: str, as_of: str) -> DataFrame:
    """Remove the partitions that are wholly behind their table's retention, in one commit, and
    then their files; a second run finds nothing. Returns table_name, partitions, dropped,
    rows and rows_dropped, as of before."""
    from callgauge.session import checkpoint_dir

    at = f"{checkpoint_dir(spark).rstrip('/')}/retention-{new_attempt()}"
    expired_parts(spark, base, as_of).write.parquet(at)
    parts = spark.read.parquet(at)
    gone = parts.where("expired")
    if not gone.isEmpty():
        commit(gone.select("table_name", *LOAD, "part", (F.col("version") + 1).alias("version"), F.lit(None).cast("string").alias("attempt"), F.lit(0).cast("long").alias("rows")), base)
    for table in AGING:
        _delete_dead(spark, base, table)
    return parts.groupBy("table_name").agg(F.count(F.lit(1)).alias("partitions"), F.count_if("expired").alias("dropped"), F.sum("rows").alias("rows"),
                                           F.sum(F.when(F.col("expired"), F.col("rows")).otherwise(0)).alias("rows_dropped"))
