"""Dashboard queries over the minute rollup (and, where the rollup lacks the
detail, over raw events). Each takes an explicit ``as_of`` in place of now().

Every query is a filter on a literal time bound followed by one aggregation;
rollup percentiles come from merged histograms (partial aggregation of 11 slot
sums), never from averaging per-minute percentiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import DEFAULT_RANGE, ERROR_SAMPLE_CHARS, RANGES
from callgauge.functions.histogram import hist_sum, with_percentiles
from callgauge.functions.timebin import (ISO_Z, PLAIN, date_bin_sql, origin_sql,
                                         round_div_sql, since_sql)


def range_spec(range_key: str) -> tuple[int, int]:
    """(interval minutes, bin minutes); unknown range falls back to 1h."""
    return RANGES.get(range_key, RANGES[DEFAULT_RANGE])


def in_range(df: DataFrame, ts_col: str, range_key: str, as_of: str, model: str | None = None) -> DataFrame:
    """Time-range scan (A6): ``ts_col >= as_of - interval`` and optional model."""
    minutes, _ = range_spec(range_key)
    out = df.filter(since_sql(ts_col, as_of, minutes))
    if model:
        out = out.filter(F.col("model") == model)
    return out


def timeseries(rollup: DataFrame, range_key: str, as_of: str, model: str | None = None) -> DataFrame:
    """Per bin: calls, errors, cancelled, p50/p95/p99 latency, p50/p95 TTFT,
    tokens per minute, cost (6 dp, text). Bins anchor at as_of - interval;
    empty bins are absent."""
    minutes, stride = range_spec(range_key)
    r = in_range(rollup, "bucket", range_key, as_of, model)
    g = (r.groupBy(F.expr(date_bin_sql("bucket", stride, origin_sql(as_of, minutes))).alias("_bin"))
         .agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"),
              F.sum("cancelled").alias("cancelled"),
              hist_sum("hist_latency").alias("_hl"), hist_sum("hist_ttft").alias("_ht"),
              F.expr("sum(input_tokens + output_tokens)").alias("_tok"),
              F.sum("cost_usd").alias("_cost")))
    g = with_percentiles(g, "_hl", {"p50": 0.50, "p95": 0.95, "p99": 0.99}, round_to_int=True)
    g = with_percentiles(g, "_ht", {"ttft_p50": 0.50, "ttft_p95": 0.95}, round_to_int=True)
    return g.selectExpr(
        f"date_format(_bin, \"{ISO_Z}\") AS bucket",
        "calls", "errors", "cancelled", "p50", "p95", "p99", "ttft_p50", "ttft_p95",
        f"CAST({round_div_sql('_tok', str(max(stride, 1)))} AS BIGINT) AS tokens_per_min",
        "CAST(round(_cost, 6) AS STRING) AS cost_usd",
    ).orderBy("bucket")


def totals(rollup: DataFrame, range_key: str, as_of: str, model: str | None = None) -> DataFrame:
    """One row of headline numbers (always one row; percentiles NULL when
    empty). Error rate excludes cancelled calls from the denominator and is 0
    when nothing was served."""
    minutes, _ = range_spec(range_key)
    r = in_range(rollup, "bucket", range_key, as_of, model)
    g = r.agg(F.expr("CAST(coalesce(sum(calls), 0) AS BIGINT)").alias("calls"),
              F.expr("CAST(coalesce(sum(errors), 0) AS BIGINT)").alias("errors"),
              F.expr("CAST(coalesce(sum(cancelled), 0) AS BIGINT)").alias("cancelled"),
              hist_sum("hist_latency").alias("_hl"), hist_sum("hist_ttft").alias("_ht"),
              F.expr("CAST(coalesce(sum(input_tokens), 0) AS BIGINT)").alias("input_tokens"),
              F.expr("CAST(coalesce(sum(output_tokens), 0) AS BIGINT)").alias("output_tokens"),
              F.sum("cost_usd").alias("_cost"))
    g = with_percentiles(g, "_hl", {"p50": 0.50, "p95": 0.95, "p99": 0.99}, round_to_int=True)
    g = with_percentiles(g, "_ht", {"ttft_p95": 0.95}, round_to_int=True)
    return g.selectExpr(
        "calls", "errors", "cancelled",
        f"IF(calls - cancelled > 0, {round_div_sql('errors * 100', 'calls - cancelled', 2)}, 0.0D) AS error_rate",
        "p50", "p95", "p99", "ttft_p95", "input_tokens", "output_tokens",
        "CAST(coalesce(round(_cost, 6), CAST(0 AS DECIMAL(28,6))) AS STRING) AS cost_usd",
        f"{round_div_sql('calls', str(max(minutes, 1)), 2)} AS calls_per_min",
    )


def by_model(rollup: DataFrame, range_key: str, as_of: str) -> DataFrame:
    """Per provider/model: calls, errors, p95, tokens, cost; most calls first."""
    r = in_range(rollup, "bucket", range_key, as_of)
    g = (r.groupBy("provider", "model")
         .agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"),
              hist_sum("hist_latency").alias("_hl"),
              F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
              F.sum("cost_usd").alias("_cost")))
    g = with_percentiles(g, "_hl", {"p95": 0.95}, round_to_int=True)
    return g.selectExpr("provider", "model", "calls", "errors", "p95", "input_tokens", "output_tokens",
                        "CAST(round(_cost, 6) AS STRING) AS cost_usd").orderBy(F.desc("calls"))


def by_error_type(events: DataFrame, range_key: str, as_of: str) -> DataFrame:
    """Raw errors by cause: count, last seen, and the newest row's message (first
    160 chars; a NULL message stays NULL; ties on time broken by event_id)."""
    e = in_range(events, "created_at", range_key, as_of).filter("status = 'error'")
    g = (e.groupBy(F.expr("coalesce(error_type, 'unknown')").alias("error_type"))
         .agg(F.count(F.lit(1)).alias("count"),
              F.max("created_at").alias("_last"),
              F.expr(f"max_by(named_struct('s', left(error_message, {ERROR_SAMPLE_CHARS})), "
                     f"named_struct('t', created_at, 'id', event_id)).s").alias("sample")))
    return g.selectExpr("error_type", "count", f"date_format(_last, '{PLAIN}') AS last_seen",
                        "sample").orderBy(F.desc("count"))


def exact_percentiles(df: DataFrame, value: str, ps: dict[str, float], count_name: str | None = None) -> DataFrame:
    """Exact percentile_cont of ``value`` in two stages: a parallel
    ``groupBy(value).count()`` (partial aggregation, hash-partitioned by value),
    then ``percentile(value, p, count)`` over the distinct values only. The
    final merge handles each distinct value once, instead of one value->count
    map per input partition."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter("_v IS NOT NULL")
    arr = ", ".join(repr(float(p)) for p in ps.values())
    aggs = [F.expr(f"percentile(_v, array({arr}), _n)").alias("_p")]
    if count_name:
        aggs.append(F.expr("CAST(coalesce(sum(_n), 0) AS BIGINT)").alias(count_name))
    g = counts.agg(*aggs)
    return g.select(*[F.col("_p")[i].alias(n) for i, n in enumerate(ps)],
                    *([count_name] if count_name else []))


def latency_percentiles_raw(events: DataFrame, range_key: str, as_of: str, exact: bool = True) -> DataFrame:
    """Percentiles of raw latency over non-cancelled calls.

    ``exact`` (= percentile_cont) uses :func:`exact_percentiles`: latencies are
    integers capped at 3,600,000 ms by validation, so the distinct-value table
    is bounded however many rows there are. ``exact=False`` uses the
    sketch-based ``percentile_approx``.
    """
    e = in_range(events, "created_at", range_key, as_of).filter("status <> 'cancelled'")
    ps = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if exact:
        r = exact_percentiles(e, "latency_ms", ps, "samples")
        return r.select(*[F.round(n, 4).alias(n) for n in ps], "samples")
    return e.agg(*[F.expr(f"round(CAST(percentile_approx(latency_ms, {p}, 10000) AS DOUBLE), 4)").alias(n)
                   for n, p in ps.items()], F.count(F.lit(1)).alias("samples"))


#: Whole milliseconds: distinct lags, which the exact median counts, stay few.
LAG_MS = "CAST(floor((unix_micros(ingested_at) - unix_micros(client_ts)) / 1000) AS BIGINT)"


def ingest_lag(events: DataFrame, range_key: str, as_of: str) -> DataFrame:
    """Median and max of ingested_at - client_ts in ms (rounded half-even, as a
    float->int cast does), and total redaction hits. The median is the
    two-stage exact percentile over distinct lag values."""
    e = in_range(events, "created_at", range_key, as_of).selectExpr(f"{LAG_MS} AS _lag", "redaction_hits")
    med = exact_percentiles(e, "_lag", {"_med": 0.5}).selectExpr("_med", "CAST(NULL AS BIGINT) AS _max", "CAST(NULL AS BIGINT) AS _hits")
    rest = e.agg(F.max("_lag").alias("_max"), F.sum("redaction_hits").alias("_hits")).selectExpr(
        "CAST(NULL AS DOUBLE) AS _med", "_max", "_hits")
    return med.unionByName(rest, allowMissingColumns=True).agg(
        F.expr("CAST(rint(max(_med)) AS INT)").alias("median_lag_ms"),
        F.expr("CAST(rint(max(_max)) AS INT)").alias("max_lag_ms"),
        F.expr("CAST(coalesce(sum(_hits), 0) AS BIGINT)").alias("redaction_hits"))


def events_by_layer(events: DataFrame, range_key: str, as_of: str) -> DataFrame:
    e = in_range(events, "created_at", range_key, as_of)
    return e.groupBy(F.col("captured_by").alias("layer")).agg(F.count(F.lit(1)).cast("int").alias("n"))


def ingest_health(events: DataFrame, dlq: DataFrame, range_key: str, as_of: str) -> DataFrame:
    """Lag, redaction hits, events per capture layer and pending DLQ count in
    one row. Every part is a one-row aggregate; they are combined by
    aggregating their tagged union — no join. The median is the two-stage
    exact percentile."""
    e = in_range(events, "created_at", range_key, as_of).selectExpr(
        f"{LAG_MS} AS _lag", "redaction_hits", "captured_by")
    med = exact_percentiles(e, "_lag", {"_med": 0.5})
    ev = e.agg(F.max("_lag").alias("_max"), F.sum("redaction_hits").alias("_hits"),
               *[F.count_if(F.col("captured_by") == layer).alias(f"_l_{layer}")
                 for layer in ("loader", "manual", "proxy")])
    pend = dlq.filter("replayed_at IS NULL").agg(F.count(F.lit(1)).alias("_pending"))
    u = med.unionByName(ev, allowMissingColumns=True).unionByName(pend, allowMissingColumns=True)
    return u.agg(
        F.expr("CAST(coalesce(max(_pending), 0) AS INT)").alias("dlq_pending"),
        F.expr("CAST(coalesce(max(_hits), 0) AS BIGINT)").alias("redaction_hits"),
        F.expr("CAST(rint(max(_med)) AS INT)").alias("median_lag_ms"),
        F.expr("CAST(rint(max(_max)) AS INT)").alias("max_lag_ms"),
        *[F.expr(f"CAST(coalesce(max(_l_{layer}), 0) AS INT)").alias(f"layer_{layer}")
          for layer in ("loader", "manual", "proxy")])


def known_models(rollup: DataFrame, range_key: str, as_of: str) -> DataFrame:
    return in_range(rollup, "bucket", range_key, as_of).select("model").distinct().orderBy("model")


def rollup_vs_raw_gap(rollup: DataFrame, events: DataFrame, range_key: str, as_of: str) -> DataFrame:
    """Bucketed p95 (rollup; includes cancelled), exact p95 (raw; excludes
    cancelled), exact p95 over the rollup's own population, sample count and
    relative gaps. One-row parts combined through a tagged union — no join."""
    h = in_range(rollup, "bucket", range_key, as_of).agg(hist_sum("hist_latency").alias("_h"))
    h = with_percentiles(h, "_h", {"_bucketed": 0.95}, round_to_int=True).select("_bucketed")
    e = in_range(events, "created_at", range_key, as_of)
    served = exact_percentiles(e.filter("status <> 'cancelled'"), "latency_ms", {"_exact": 0.95}, "_samples")
    every = exact_percentiles(e, "latency_ms", {"_exact_all": 0.95})
    u = h.unionByName(served, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    g = u.agg(*[F.max(c).alias(c) for c in ("_bucketed", "_exact", "_exact_all")],
              F.expr("CAST(coalesce(max(_samples), 0) AS BIGINT)").alias("samples"))
    return g.selectExpr(
        "_bucketed AS bucketed_p95", "round(_exact, 4) AS exact_p95",
        "round(_exact_all, 4) AS exact_p95_same_population", "samples",
        "round((_bucketed - _exact) / _exact, 4) AS relative_gap",
        "round((_bucketed - _exact_all) / _exact_all, 4) AS relative_gap_same_population")


def mean_latency_ttft(rollup: DataFrame, range_key: str, as_of: str) -> DataFrame:
    """Mean latency = Σlatency / calls; mean TTFT = Σttft / ttft_count (not calls)."""
    r = in_range(rollup, "bucket", range_key, as_of)
    g = r.groupBy("provider", "model").agg(
        F.sum("calls").alias("calls"), F.sum("sum_latency_ms").alias("_sl"),
        F.sum("ttft_count").alias("ttft_count"), F.sum("sum_ttft_ms").alias("_st"))
    return g.selectExpr("provider", "model", "calls", "ttft_count",
                        "IF(calls > 0, round(_sl / calls, 4), NULL) AS mean_latency_ms",
                        "IF(ttft_count > 0, round(_st / ttft_count, 4), NULL) AS mean_ttft_ms")
