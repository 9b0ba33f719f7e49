import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgauge.operators.queue import buffer_kept_rows
from callgauge.operators.running import running_sums


def _data(spark):
    rng = random.Random(5)
    # one hot group holding most rows, plus small ones
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), i, rng.randrange(0, 50)) for i in range(3000)]
    return spark.createDataFrame(rows, "g int, seq long, v int")


def test_bucketed_running_sums_equal_plain_window(spark):
    df = _data(spark)
    for desc in (False, True):
        got = running_sums(df, ["g"], "seq div 97", ["seq"], {"s": "v", "r": "1"}, descending=desc)
        o = F.desc("seq") if desc else F.asc("seq")
        w = Window.partitionBy("g").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ref = df.withColumn("s", F.sum("v").over(w)).withColumn("r", F.count(F.lit(1)).over(w))
        a = sorted(tuple(r) for r in got.select("g", "seq", "s", "r").collect())
        b = sorted(tuple(r) for r in ref.select("g", "seq", "s", "r").collect())
        assert a == b


def test_salted_top_k_is_exact(spark):
    df = _data(spark).withColumn("created_at", F.expr("timestamp_seconds(seq)")).withColumn(
        "event_id", F.col("seq").cast("string"))
    got = buffer_kept_rows(df, "g", ("created_at", "event_id"), max_queue=100, salts=8)
    w = Window.partitionBy("g").orderBy(F.desc("created_at"), F.desc("event_id"))
    ref = df.withColumn("_r", F.row_number().over(w)).filter("_r <= 100")
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in ref.collect())
