"""De-duplication and the per-minute rollup with mergeable histograms.

The rollup is a table of *delta rows* keyed (bucket, provider, model). Deltas
from any number of batches merge with a plain ``groupBy + sum`` (counters and
histogram slots are sums), so the read side never needs MERGE/UPSERT and every
aggregate is partial-aggregation friendly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.functions.histogram import N_BUCKETS, bucket_index_sql, histogram_counts_of_index, slot_sql

ROLLUP_KEY = ["bucket", "provider", "model"]
COUNTERS = ["calls", "errors", "cancelled", "streamed_calls", "sum_latency_ms", "sum_ttft_ms",
            "ttft_count", "input_tokens", "output_tokens"]
DEDUP_KEY = ["event_id", "created_at"]


def rollup_1m(events: DataFrame) -> DataFrame:
    """Group events by minute, provider and model.

    calls, errors, cancelled, streamed_calls, Σlatency, Σttft (0 if none),
    ttft_count, Σinput/Σoutput tokens (0 if none), Σcost (NULL cost counts 0),
    and latency/TTFT histograms as 11 conditional counts each.
    """
    staged = events.selectExpr(
        "date_trunc('minute', created_at) AS bucket", "provider", "model", "status", "streamed",
        "latency_ms", "ttft_ms", "input_tokens", "output_tokens", "cost_usd",
        f"{bucket_index_sql('latency_ms')} AS _bl", f"{bucket_index_sql('ttft_ms')} AS _bt")
    return (staged
            .groupBy("bucket", "provider", "model")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.count_if(F.col("status") == "error").alias("errors"),
                 F.count_if(F.col("status") == "cancelled").alias("cancelled"),
                 F.count_if(F.col("streamed")).alias("streamed_calls"),
                 F.coalesce(F.sum("latency_ms"), F.lit(0)).cast("bigint").alias("sum_latency_ms"),
                 F.coalesce(F.sum("ttft_ms"), F.lit(0)).cast("bigint").alias("sum_ttft_ms"),
                 F.count("ttft_ms").alias("ttft_count"),
                 F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
                 F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"),
                 F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(16,8)").alias("cost_usd"),
                 histogram_counts_of_index("_bl").alias("hist_latency"),
                 histogram_counts_of_index("_bt").alias("hist_ttft")))


def rollup_merge(*deltas: DataFrame) -> DataFrame:
    """Accumulate rollup delta rows: counters add, histograms add element-wise.

    Union of the deltas followed by one ``groupBy`` on the rollup key; histogram
    slots are summed independently so the aggregate stays a partial aggregate.
    """
    u = deltas[0]
    for d in deltas[1:]:
        u = u.unionByName(d)
    aggs = [F.sum(c).cast("bigint").alias(c) for c in COUNTERS]
    aggs.append(F.sum("cost_usd").cast("decimal(16,8)").alias("cost_usd"))
    for h in ("hist_latency", "hist_ttft"):
        aggs.append(F.expr("array(" + ", ".join(f"CAST(sum({slot_sql(h, i)}) AS BIGINT)"
                                                for i in range(1, N_BUCKETS + 1)) + ")").alias(h))
    return u.groupBy(*ROLLUP_KEY).agg(*aggs)


def dedup_within_batch(batch: DataFrame, order_cols=None) -> DataFrame:
    """Keep one row per (event_id, created_at).

    Without ``order_cols`` this is ``dropDuplicates``, planned as a partial
    aggregate: copies collapse map-side before the shuffle, so a replay storm
    of one event costs one row per task. With ``order_cols`` (arrival
    position) the earliest copy wins deterministically: the earliest position
    per key is again a partial aggregate, joined back on the key (a skewed key
    becomes a skewed join that AQE splits, not a single-task window).
    """
    if not order_cols:
        return batch.dropDuplicates(DEDUP_KEY)
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    first = batch.groupBy(*DEDUP_KEY).agg(F.min(F.struct(*order_cols)).alias("_first"))
    return (batch.join(first, DEDUP_KEY)
            .filter(F.struct(*order_cols) == F.col("_first")).drop("_first"))


def dedup_new(batch: DataFrame, log: DataFrame | None = None, order_col: str | None = None) -> DataFrame:
    """Insert-if-new: rows of ``batch`` whose (event_id, created_at) is neither
    repeated earlier in the batch nor already in ``log``.

    The anti join against the log reads only the log rows whose month matches a
    month present in the batch (partition pruning when the log is partitioned by
    ``event_month``).
    """
    fresh = dedup_within_batch(batch, order_col)
    if log is None:
        return fresh
    keys = log.select(*DEDUP_KEY, *(["event_month"] if "event_month" in log.columns else []))
    if "event_month" in keys.columns:
        # Semi-join on the partition column: dynamic partition pruning limits
        # the log scan to the months present in the batch. No broadcast hint:
        # AQE broadcasts the (calendar-bounded) month list from its measured size.
        months = fresh.select(month_key(F.col("created_at")).alias("event_month")).distinct()
        keys = keys.join(months, "event_month", "left_semi")
    return fresh.join(keys.select(*DEDUP_KEY), DEDUP_KEY, "left_anti")


def month_key(ts) -> "F.Column":
    """Partition value for an event time: 'yyyy-MM' of ``created_at``."""
    return F.date_format(ts, "yyyy-MM")


def dedup_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """(total, inserted, duplicates) for a delivery, as one aggregate over the
    union of both sides (no cross join)."""
    u = (batch.select(F.lit(1).alias("_t"), F.lit(0).alias("_i"))
         .unionByName(inserted.select(F.lit(0).alias("_t"), F.lit(1).alias("_i"))))
    return u.agg(F.coalesce(F.sum("_t"), F.lit(0)).cast("bigint").alias("total"),
                 F.coalesce(F.sum("_i"), F.lit(0)).cast("bigint").alias("inserted")) \
        .withColumn("duplicates", F.col("total") - F.col("inserted"))
