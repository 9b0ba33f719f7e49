"""Plan-shape assertions: no Python UDFs on the hot paths, partition pruning
on time-range scans, pricing without a join."""

import pytest

from callgauge.plans.queries import REGISTRY

from conftest import SF_SMALL

HOT = ["rollup_1m", "timeseries", "totals", "by_model", "by_error_type", "latency_percentiles_raw",
       "redact_text", "dedup_events", "price_events", "validate_event_fields", "assemble_spans",
       "context_window", "ingest_ack"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HOT)
def test_no_python_udf(spark, name):
    p = _plan(REGISTRY[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_pricing_is_a_projection(spark):
    p = _plan(REGISTRY["price_events"](spark, SF_SMALL))
    assert "Join" not in p and "Exchange" not in p


def test_time_range_scan_prunes_partitions(spark):
    df = REGISTRY["time_range_scan"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in p and "(event_month" in p and ">= 2024-01)" in p
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in p


@pytest.mark.parametrize("name", ["timeseries", "timeseries_24h", "timeseries_model", "totals", "totals_model", "by_model", "known_models", "mean_latency_ttft"])
def test_panels_read_the_stored_rollup(spark, name):
    """No event is scanned, neither of the given tables nor of the stored log: only rollup deltas
    in the range's days, and the manifest."""
    p = _plan(REGISTRY[name](spark, SF_SMALL))
    assert "events.parquet" not in p and "/events" not in p and "rollup_delta" in p and "bucket_day" in p


@pytest.mark.parametrize("name", ["by_error_type", "latency_percentiles_raw", "ingest_lag", "events_by_layer", "rollup_vs_raw_gap", "rollup_reconcile"])
def test_time_bound_reaches_the_scan(spark, name):
    p = _plan(REGISTRY[name](spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts," in p


def test_stored_rollup_is_read_by_day(spark):
    from callgauge.sources import adapters
    from callgauge.streaming import jobs
    dst = jobs.scratch(spark, "t-days")
    jobs.load_direct(spark, adapters.envelope_lines(spark, SF_SMALL), dst, 0, now="2024-02-01 00:00:00")
    whole = jobs.read_rollup(spark, dst)
    late = jobs.read_rollup(spark, dst, since="2024-01-29 12:00:00")
    p = _plan(late)
    assert "bucket_day" in p and ">= 2024-01-29" in p
    assert sorted(map(str, late.collect())) == sorted(map(str, whole.filter("bucket >= '2024-01-29 12:00:00'").collect()))


def test_dashboard_bundle(spark):
    from callgauge.operators import enrich, rollup
    from callgauge.plans.dashboard import dashboard
    from callgauge.plans.queries import _dlq
    from callgauge.sources import adapters
    ev = enrich.price_events(adapters.inference_events(spark, SF_SMALL, dense=True))
    panels = dashboard(rollup.rollup_1m(ev), ev, _dlq(spark, SF_SMALL), "bogus", adapters.DENSE_AS_OF, "")
    assert set(panels) == {"timeseries", "totals", "by_model", "by_error_type", "ingest_health",
                           "known_models", "latency_percentiles_raw"}
    tot = panels["totals"].first()
    assert tot.calls == sum(r.calls for r in panels["timeseries"].collect())
    assert panels["known_models"].count() == panels["by_model"].count()


@pytest.mark.parametrize("name", ["ingest_ack", "dedup_events", "buffer_overflow_loss", "latency_percentiles_raw"])
def test_no_window_on_possibly_hot_keys(spark, name):
    """First delivery, dedup, per-producer loss and percentiles are aggregates
    (partial aggregation + AQE skew handling), never a window over a key that
    may hold a third of all rows."""
    p = _plan(REGISTRY[name](spark, SF_SMALL))
    assert "Window [" not in p and "WindowGroupLimit" not in p


@pytest.mark.parametrize("name", ["context_window", "micro_batches", "assign_seq"])
def test_group_windows_are_bucketed(spark, name):
    """Per-group ranks / running sums partition their big window by (group, bucket)."""
    import re
    p = _plan(REGISTRY[name](spark, SF_SMALL))
    parts = re.findall(r"Window \[.*?\], \[([^\]]*)\]", p)
    assert parts and any("_bk" in x for x in parts)
