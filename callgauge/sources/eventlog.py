"""The append-only event log on Parquet: partitioned writes, overflow routing,
retention planning and pruned time-range scans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.constants import RETENTION_DAYS

OVERFLOW = "overflow"


def month_of(col: str = "created_at"):
    return F.date_format(col, "yyyy-MM")


def route_overflow(events: DataFrame, known_months: list[str], col: str = "created_at") -> DataFrame:
    """``event_month`` = month of the event time when that month is a known
    partition, else 'overflow' (a far-off client clock lands there instead of
    failing the batch)."""
    m = month_of(col)
    return events.withColumn("event_month", F.when(m.isin(*known_months), m).otherwise(F.lit(OVERFLOW)))


def write_event_log(events: DataFrame, path: str, known_months: list[str] | None = None,
                    batch_col: str = "batch_id") -> None:
    """Append-only write partitioned by (event_month, load id). Dynamic
    partition overwrite makes a retried load replace exactly its own
    partitions; rows are sorted by ``created_at`` inside each file so Parquet
    min/max statistics prune time-range scans (the equivalent of a BRIN
    index). ``batch_col`` is a load-level id (a micro-batch or load number): a
    per-envelope id would make many tiny files. Rows are rebalanced by
    partition, so a large (month, load) is written by several tasks and small
    ones share one."""
    ev = (route_overflow(events, known_months) if known_months is not None
          else events.withColumn("event_month", month_of("created_at")))
    (ev.hint("rebalance", "event_month", batch_col).sortWithinPartitions("event_month", batch_col, "created_at")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_month", batch_col).parquet(path))


def scan_range(spark: SparkSession, path: str, as_of: str, minutes: int) -> DataFrame:
    """Events with created_at >= as_of - interval.

    The partition predicate ``event_month >= 'yyyy-MM'`` (months sort
    lexically; 'overflow' sorts after every month, so rows with far-off clocks
    stay visible) prunes directories; the created_at bound is pushed to the
    Parquet reader, where row-group min/max statistics skip the rest."""
    start = datetime.fromisoformat(as_of) - timedelta(minutes=minutes)
    return (spark.read.parquet(path)
            .filter(F.col("event_month") >= F.lit(f"{start.year:04d}-{start.month:02d}"))
            .filter(F.col("created_at") >= F.lit(start.isoformat(sep=" ")).cast("timestamp")))


def retention_plan(events: DataFrame, rollup: DataFrame, dlq: DataFrame, as_of: str) -> DataFrame:
    """Retention policy as of a date (raw 90 d, rollup 400 d, DLQ 30 d): per
    table, partitions and rows that a whole-partition drop removes, and rows
    already past the cut-off. One aggregate per table over the partition key."""
    def plan(df: DataFrame, table: str, ts: str, days: int) -> DataFrame:
        cutoff = f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS"
        p = df.selectExpr(f"date_format({ts}, 'yyyy-MM') AS part",
                          f"{ts} < {cutoff} AS past",
                          f"add_months(to_timestamp(concat(date_format({ts}, 'yyyy-MM'), '-01')), 1) <= {cutoff} "
                          "AS part_past")
        return p.agg(F.lit(table).alias("table_name"), F.lit(days).alias("retention_days"),
                     F.count_distinct("part").alias("partitions"),
                     F.expr("count(DISTINCT IF(part_past, part, NULL))").alias("partitions_dropped"),
                     F.count(F.lit(1)).alias("rows"),
                     F.count_if("part_past").alias("rows_in_dropped_partitions"),
                     F.count_if("past").alias("rows_past_cutoff"))
    return (plan(events, "inference_events", "created_at", RETENTION_DAYS["raw"])
            .unionByName(plan(rollup, "inference_rollup_1m", "bucket", RETENTION_DAYS["rollup"]))
            .unionByName(plan(dlq, "dlq", "first_seen_at", RETENTION_DAYS["dlq"])))
