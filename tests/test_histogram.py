import random

import pytest
from pyspark.sql import functions as F

from callgauge.constants import LATENCY_BOUNDS
from callgauge.functions.histogram import (bucket_index, hist_add, hist_percentile, hist_sum, histogram_of,
                                           with_percentiles)
from callgauge.operators import audit


def test_selfcheck_matches_reference_formula(spark):
    r = audit.histogram_selfcheck(spark).collect()
    full = [x for x in r if x.p50 is not None][0]
    empty = [x for x in r if x.p50 is None][0]
    assert full.p50 == pytest.approx(100 + 150 * 50 / 90)
    assert full.p95 == pytest.approx(11500.0)
    assert full.p99 == pytest.approx(14300.0)
    assert 100 <= full.p50 <= 250 and 4000 <= full.p95 <= 15000 and full.p99 >= full.p95
    assert empty.empty_p95 is None


def test_bucket_index_edges(spark):
    vals = [None, 0, 99, 100, 249, 250, 59999, 60000, 2147483646, 2147483647]
    df = spark.createDataFrame([(v,) for v in vals], "ms int")
    got = [r.b for r in df.select(bucket_index("ms").alias("b")).collect()]
    assert got == [None, 1, 1, 2, 2, 3, 10, 11, 11, 11]


def _py_percentile(h, p):
    total = sum(h)
    if total == 0:
        return None
    target, cum = total * p, 0
    for i, c in enumerate(h, start=1):
        prev, cum = cum, cum + c
        if cum >= target:
            lower = 0 if i == 1 else LATENCY_BOUNDS[i - 2]
            upper = LATENCY_BOUNDS[i - 1]
            if i == len(LATENCY_BOUNDS) or c == 0:
                return float(lower)
            return lower + (upper - lower) * ((target - prev) / c)
    return float(LATENCY_BOUNDS[-2])


def test_percentile_matches_plain_loop(spark):
    rng = random.Random(7)
    hs = [[rng.choice([0, 0, 1, 5, 40]) for _ in range(11)] for _ in range(200)] + [[0] * 11, [0] * 10 + [3]]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "i int, h array<bigint>")
    ps = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    staged = with_percentiles(df, "h", ps).orderBy("i").collect()
    single = df.select("i", *[hist_percentile("h", p).alias(n) for n, p in ps.items()]).orderBy("i").collect()
    for row, row2, h in zip(staged, single, hs):
        for n, p in ps.items():
            exp = _py_percentile(h, p)
            assert (row[n] is None) == (exp is None)
            if exp is not None:
                assert row[n] == pytest.approx(exp) and row2[n] == pytest.approx(exp)


def test_merge_is_associative_and_counts_calls(spark):
    rng = random.Random(3)
    obs = spark.createDataFrame([(rng.randrange(3), rng.choice([None, rng.randrange(0, 90000)]))
                                 for _ in range(500)], "g int, ms int")
    one_hot = obs.select("g", histogram_of("ms").alias("h"))
    per_group = one_hot.groupBy("g").agg(hist_sum("h").alias("h"))
    merged = per_group.agg(hist_sum("h").alias("h")).first().h
    direct = one_hot.agg(hist_sum("h").alias("h")).first().h
    assert merged == direct
    assert sum(direct) == obs.filter("ms IS NOT NULL").count()
    a = spark.createDataFrame([([1, 2], [3, 4, 5])], "a array<bigint>, b array<bigint>")
    assert a.select(hist_add("a", "b").alias("s")).first().s == [4, 6, 5]


def test_sql_functions_match_column_builders(spark):
    from callgauge.functions import sql_functions
    sql_functions.register(spark)
    rng = random.Random(11)
    hs = [[rng.choice([0, 0, 2, 9]) for _ in range(11)] for _ in range(50)] + [[0] * 11]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "i int, h array<bigint>")
    df.createOrReplaceTempView("hs_test")
    rows = spark.sql("SELECT i, histogram_percentile(h, 0.95) AS a FROM hs_test ORDER BY i").collect()
    ref = df.select("i", hist_percentile("h", 0.95).alias("b")).orderBy("i").collect()
    for r1, r2 in zip(rows, ref):
        assert r1.a == r2.b
    got = spark.sql("SELECT latency_bucket_index(100) AS a, latency_bucket_index(NULL) AS b, "
                    "normalise_model('anthropic.claude-opus-5-20250101') AS m").first()
    assert (got.a, got.b, got.m) == (2, None, "claude-opus-5")
