from pyspark.sql import functions as F

from callgauge.operators import enrich, rollup
from callgauge.sources import adapters

from conftest import SF_SMALL


def _events(spark):
    return enrich.price_events(adapters.inference_events(spark, SF_SMALL, dense=True))


def test_histograms_count_calls(spark):
    r = rollup.rollup_1m(_events(spark))
    bad = r.filter("aggregate(hist_latency, 0L, (a, x) -> a + x) <> calls "
                   "OR aggregate(hist_ttft, 0L, (a, x) -> a + x) <> ttft_count")
    assert bad.count() == 0


def test_rollup_of_union_is_merge_of_rollups(spark):
    ev = _events(spark)
    a = ev.filter(F.expr("CAST(event_id AS BIGINT) % 3 = 0"))
    b = ev.filter(F.expr("CAST(event_id AS BIGINT) % 3 <> 0"))
    merged = rollup.rollup_merge(rollup.rollup_1m(a), rollup.rollup_1m(b))
    whole = rollup.rollup_1m(ev)
    cols = merged.columns
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.select(*cols).collect()))
    # merging is associative: ((a, b), c) == (a, (b, c))
    c = rollup.rollup_1m(ev.limit(0))
    left = rollup.rollup_merge(rollup.rollup_merge(rollup.rollup_1m(a), rollup.rollup_1m(b)), c)
    right = rollup.rollup_merge(rollup.rollup_1m(a), rollup.rollup_merge(rollup.rollup_1m(b), c))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.select(*left.columns).collect()))


def test_dedup_against_log_prunes_to_batch_months(spark):
    ev = adapters.inference_events(spark, SF_SMALL).withColumn("event_month", F.date_format("created_at", "yyyy-MM"))
    fresh = rollup.dedup_new(adapters.replay_input(ev.drop("event_month")), log=ev)
    assert fresh.count() == 0
