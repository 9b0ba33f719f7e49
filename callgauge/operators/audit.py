"""Audit operators: rollup reconciliation, clock skew, re-pricing, id order,
head sampling, histogram self-check and capture-layer coverage."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgauge.constants import DRIFT_TOLERANCE, PRICES
from callgauge.functions.histogram import hist_percentile, hist_sum, histogram_of
from callgauge.operators import enrich, rollup

RECONCILE_COUNTERS = ["calls", "errors", "cancelled", "sum_latency_ms", "input_tokens", "output_tokens"]


def reconcile(stored: DataFrame, events: DataFrame, day: str, tol: float = DRIFT_TOLERANCE) -> DataFrame:
    """Recompute the rollup of one day from raw events, full-outer-join it with
    the stored rollup on (bucket, provider, model) and flag rows whose
    relative difference on any counter exceeds ``tol``."""
    lo, hi = f"TIMESTAMP '{day}'", f"TIMESTAMP '{day}' + INTERVAL 1 DAY"
    fresh = rollup.rollup_1m(events.filter(f"created_at >= {lo} AND created_at < {hi}"))
    st = stored.filter(f"bucket >= {lo} AND bucket < {hi}")
    s = st.select(*rollup.ROLLUP_KEY, *[F.col(c).alias(f"stored_{c}") for c in RECONCILE_COUNTERS])
    r = fresh.select(*rollup.ROLLUP_KEY, *[F.col(c).alias(f"raw_{c}") for c in RECONCILE_COUNTERS])
    j = s.join(r, rollup.ROLLUP_KEY, "full_outer")
    drift = F.greatest(*[F.expr(f"abs(coalesce(stored_{c}, 0) - coalesce(raw_{c}, 0)) / "
                                f"greatest(abs(coalesce(raw_{c}, 0)), 1)") for c in RECONCILE_COUNTERS])
    return j.withColumn("max_rel_drift", F.round(drift, 6)).withColumn("drifted", F.col("max_rel_drift") > tol)


def clock_skew(events: DataFrame) -> DataFrame:
    """Rows whose client clock is ahead of the server (client_ts > ingested_at),
    ordered by server time."""
    return (events.filter("client_ts > ingested_at")
            .withColumn("skew_ms", F.expr("(unix_micros(client_ts) - unix_micros(ingested_at)) div 1000"))
            .orderBy("ingested_at", "event_id"))


def reprice(events: DataFrame, prices_a=PRICES, prices_b=PRICES, version_a: str = "a", version_b: str = "b",
            input_scale_b: Decimal = Decimal(1)) -> DataFrame:
    """Re-price history under another price version as an explicit diff by
    model (both prices are per-row projections; one aggregate)."""
    a = enrich.price_events(events, prices_a, version_a).withColumnRenamed("cost_usd", "cost_a")
    b = enrich.price_events(a, prices_b, version_b, input_scale_b).withColumnRenamed("cost_usd", "cost_b")
    g = b.groupBy("model").agg(F.expr("coalesce(sum(cost_a), 0)").alias("cost_a"),
                               F.expr("coalesce(sum(cost_b), 0)").alias("cost_b"),
                               F.count(F.lit(1)).alias("calls"))
    return g.withColumn("diff", F.col("cost_b") - F.col("cost_a"))


def id_order_check(df: DataFrame, id_col: str, order_cols=("created_at",), range_rows: int = 100_000) -> DataFrame:
    """Whether ``id_col`` strictly increases along the order of ``order_cols``
    (the reference's ``bool_and(id > lag(id))``), computed without a global
    single-task window: rows are split into contiguous ranges of about
    ``range_rows`` of the first order column at sampled quantiles; ``lag`` runs inside each
    range, and consecutive ranges are stitched through their first/last ids
    (a row a range)."""
    first = order_cols[0]
    key = f"unix_micros({first})" if first.endswith("_at") or first == "ts" else first
    # Range boundaries from a quantile sketch (the same device Spark's range
    # partitioner uses), inlined as a literal and searched by halving.
    buckets = max(1, min(1 << 16, df.count() // range_rows))
    bounds = []
    if buckets > 1:
        qs = ", ".join(str(i / buckets) for i in range(1, buckets))
        bounds = df.agg(F.expr(f"percentile_approx({key}, array({qs}), {20 * buckets})").alias("b")).first()["b"] or []
    bounds = sorted({int(x) for x in bounds})
    if bounds:
        steps = ", ".join(str(1 << i) for i in reversed(range(len(bounds).bit_length())))
        found = (f"aggregate(array({steps}), 0, (i, s) -> IF(i + s <= {len(bounds)} AND "
                 f"element_at(_bounds, least(i + s, {len(bounds)})) < {key}, i + s, i))")
        b = df.withColumn("_bounds", F.lit(bounds)).withColumn("_bucket", F.expr(found)).drop("_bounds")
    else:
        b = df.withColumn("_bucket", F.lit(0))
    order = ", ".join(order_cols)
    w = Window.partitionBy("_bucket").orderBy(*order_cols)
    inner = (b.withColumn("_prev", F.lag(id_col).over(w))
             .agg(F.expr(f"coalesce(bool_and(IF(_prev IS NULL, true, {id_col} > _prev)), true)").alias("ok_in"),
                  F.count(F.lit(1)).alias("rows")))
    edges = b.groupBy("_bucket").agg(
        F.expr(f"min_by({id_col}, struct({order}))").alias("first_id"),
        F.expr(f"max_by({id_col}, struct({order}))").alias("last_id"))
    we = Window.orderBy("_bucket")
    stitched = (edges.withColumn("_prev_last", F.lag("last_id").over(we))
                .agg(F.expr("coalesce(bool_and(IF(_prev_last IS NULL, true, first_id > _prev_last)), true)")
                     .alias("ok_edges")))
    u = (inner.select("ok_in", F.lit(None).cast("boolean").alias("ok_edges"), "rows")
         .unionByName(stitched.select(F.lit(None).cast("boolean").alias("ok_in"), "ok_edges",
                                      F.lit(0).cast("bigint").alias("rows"))))
    return u.agg(F.expr("bool_and(coalesce(ok_in, true)) AND bool_and(coalesce(ok_edges, true))").alias("ordered"),
                 F.expr("CAST(sum(rows) - 1 AS BIGINT)").alias("pairs"))


def sample_hash_sql(id_expr: str) -> str:
    """Deterministic arithmetic hash of an integer id in [0, 1000003)."""
    return f"pmod(pmod({id_expr}, 1000003) * 7919 + 13, 1000003)"


def keep_sample(events: DataFrame, n: int = 10, slow_ms: int = 5000, id_expr: str = "CAST(event_id AS BIGINT)") -> DataFrame:
    """Head sampling that always keeps errors and slow calls: keep 1 in ``n``
    by a deterministic hash of the id, plus every error and every call slower
    than ``slow_ms``. Flags the reason kept."""
    h = sample_hash_sql(id_expr)
    return (events.withColumn("sampled", F.expr(f"{h} % {int(n)} = 0"))
            .withColumn("forced", F.expr(f"status = 'error' OR latency_ms > {int(slow_ms)}"))
            .filter("sampled OR forced"))


def histogram_selfcheck(spark: SparkSession) -> DataFrame:
    """90 x 120 ms + 10 x 9000 ms: p50 in [100, 250], p95 in [4000, 15000],
    p99 >= p95; an empty histogram reads NULL."""
    obs = (spark.range(90).selectExpr("120 AS ms").unionByName(spark.range(10).selectExpr("9000 AS ms")))
    h = obs.select(histogram_of("ms").alias("h")).agg(hist_sum("h").alias("h"))
    empty = spark.range(1).selectExpr("array_repeat(0L, 11) AS h")
    return h.select(hist_percentile("h", 0.5).alias("p50"), hist_percentile("h", 0.95).alias("p95"),
                    hist_percentile("h", 0.99).alias("p99"),
                    F.lit(None).cast("double").alias("empty_p95")).unionByName(
        empty.select(*[F.lit(None).cast("double").alias(c) for c in ("p50", "p95", "p99")],
                     hist_percentile("h", 0.95).alias("empty_p95")))


def capture_layers(events: DataFrame) -> DataFrame:
    """Events per capture layer, with and without a conversation reference."""
    return events.groupBy("captured_by", F.col("conversation_id").isNull().alias("no_conversation")).agg(
        F.count(F.lit(1)).alias("events"))
