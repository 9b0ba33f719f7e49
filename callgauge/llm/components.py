"""Connected components by contraction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm import common

#: Rounds that go by number.
BY_NUMBER = 4

def connected(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns u and v. Returns node and root (one node of its component, the
    same for all of them) for every node of an edge with u <> v.

    Each round merges every node into the first of its neighbours and itself; edges inside a merged
    node go. The first rounds go by number, which suits stars around their least node; the others by
    a random order of the round, by which the edges' number falls by a part in every round, also
    along paths. At the end the rounds' merges are followed. A hub's
    neighbours meet in no single task: its first neighbour is a partial aggregate, written as a table, so that
    both sides of the joins with it are plain shuffles, of which AQE splits a hub's."""
    left, merges = common.stored(_ordered(edges), "edges"), []
    for k in count():
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        place = (lambda c: F.col(c)) if k < BY_NUMBER else (lambda c: F.xxhash64(F.lit(k), c))
        first = (both.groupBy("u").agg(F.min(F.struct(place("v").alias("h"), "v")).alias("m"))
                 .select("u", F.when(place("u") < F.col("m.h"), F.col("u")).otherwise(F.col("m.v")).alias("m")))
        first = common.stored(first, "merges")
        merges.append(first)
        merged = left.join(first, "u").select("v", F.col("m").alias("a")).join(first.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
        before, left = left, common.stored(_ordered(merged.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
        common.discard(before)
    if not merges:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = merges[-1].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for k, merge in reversed(list(enumerate(merges[:-1]))):
        later = roots.select(F.col("node").alias("m"), "root")
        roots = merge.join(later, "m", "left").select(F.col("u").alias("node"), F.coalesce("root", "m").alias("root"))
        if k == 1:
            roots = common.stored(roots, "roots")
    return roots


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
