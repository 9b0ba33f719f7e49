"""Exact running sums / ranks inside a group without a single-task window
for hot groups.

A window partitioned only by the group key puts a hot group (say, a third of
all rows) into one task. Here rows are cut into ordered buckets inside each
group (e.g. seq div 1024, or the hour of a timestamp): per-(group, bucket)
totals are a partial aggregate; their prefix sums per group (one row per
bucket) give each bucket's offset; the running sum inside a bucket is a window
over that bucket only. Result = offset + in-bucket running sum, exactly equal
to the group-wide window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sums(df: DataFrame, group: list[str], bucket_sql: str, order: list[str],
                 values: dict[str, str], descending: bool = False) -> DataFrame:
    """Add one inclusive running-sum column per ``values`` entry (name -> SQL
    value), ordered by ``order`` inside ``group`` (descending if asked).

    ``bucket_sql`` must be monotone in the order (a coarser version of it)."""
    b = df.withColumn("_bk", F.expr(bucket_sql))
    b = b.withColumns({f"_v_{n}": F.expr(v) for n, v in values.items()})
    tot = b.groupBy(*group, "_bk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    bo = F.desc("_bk") if descending else F.asc("_bk")
    wo = Window.partitionBy(*group).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group, "_bk", *[F.coalesce(F.sum(f"_t_{n}").over(wo), F.lit(0)).alias(f"_o_{n}")
                                      for n in values])
    j = b.join(off, [*group, "_bk"])
    oc = [F.desc(c) if descending else F.asc(c) for c in order]
    wi = Window.partitionBy(*group, "_bk").orderBy(*oc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(wi) for n in values})
    return j.drop("_bk", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])
