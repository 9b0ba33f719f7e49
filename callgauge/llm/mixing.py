"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` tokens. The sources, by code point with
null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at three times
its source's size, and the excess is shared again by weight until none is above.

A source whose target is r whole passes and a remaining budget takes each document r times, and
some of them once more. Documents are counted by exact size; from each size the budget's share of
its count is taken (which keeps the mix of sizes), and the rest of the budget is fitted by
bounded-knapsack dynamic programming over the counts that are left. A budget of up to
``exact_words`` words (in units of the sizes' greatest common divisor) is so fitted exactly: no
choice of documents comes nearer to it from below. Of a larger one, the longest documents are taken
first until the rest is below ``exact_words``; this is exact wherever documents can make up that rest, and
falls short by less than the least document that is left otherwise; then all sums are searched too, which is exact up
to ``SUMS`` different ones. Only the counts reach the fitting task, one row a source.

The documents of a size are chosen by lot, a seeded hash of the row: a histogram of ranges of lots
finds the range where the count is reached, and the counts of that range's lots the last one.
Rows of the last lot (rows equal in all columns) are numbered, so that exactly the count is taken.

Defined results: a null text has size 0 and takes no words; a null source is a source of its own,
the last; of equal rows any, but exactly as many as the fit says, are taken; with no words at all
every target is 0; an empty table gives no row. Reruns agree. Columns that can't be hashed (maps,
variants) are not part of the lot.
Columns named like a result column (size, source_size, target, times, taken) are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.llm import common

SEED = 20
MOST_PASSES = 3
#: Largest budget that the dynamic programme fits; what is above goes to the longest documents first.
KNAPSACK = 1 << 16
#: Largest budget that is always fitted exactly; a fitting task holds some 7 bytes a unit of it.
EXACT_WORDS = 1 << 24
#: Different sums that are kept one by one; of more, one is kept in each step of a SUMS-th of the budget.
SUMS = 1 << 16
RANGE_ROWS = 256
RESULTS = ("size", "source_size", "target", "times", "taken")


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.expr(r"regexp_count(cast(text as string), '[^\\x20\\x09-\\x0D]+')").cast("long"), F.lit(0).cast("long")))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target from source and size: one row a source."""
    by_code_point = Window.orderBy(F.col("source").isNull(), F.col("source"))  # a row a source
    sources = common.stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                            .withColumn("weight", (F.row_number().over(by_code_point) - 1) % 3 + 1), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share = 0.0
    while True:  # raising the share of a unit of weight only ever caps more sources
        capped = F.col("weight") * F.lit(share) > MOST_PASSES * F.col("source_size")
        rest, weight = sources.agg(F.lit(total) - F.coalesce(F.sum(F.when(capped, MOST_PASSES * F.col("source_size"))), F.lit(0)),
                                   F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        new = rest / weight if weight else share
        if new <= share:
            break
        share = new
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(share), (MOST_PASSES * F.col("source_size")).cast("double")).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, exact_words: int = EXACT_WORDS) -> np.ndarray:
    """How many documents of each size to take, for a sum of ``budget`` or the nearest sum below it
    (the nearest that is found, for more than ``exact_words`` units of the sizes' common divisor):
    first with each size's whole share, else with less of it, which leaves the dynamic programme
    more to choose from; at last without shares, by the dynamic programme alone."""
    sizes, counts = sizes.astype(object), counts.astype(object)  # exact for any corpus
    unit = math.gcd(*(int(x) for x in sizes)) or 1
    sizes, budget = sizes // unit, budget // unit
    total = sum(sizes * counts)
    most = min(budget, total)  # no sum is nearer
    none = counts * 0

    def share(eighths):
        return np.array([int(c) * budget * eighths // (8 * total) if s else 0 for s, c in zip(sizes, counts)], dtype=object) if total else none

    tries = [lambda e=e: _fitted(sizes, counts, budget, share(e), KNAPSACK) for e in (8, 7, 4, 0)]
    if budget > KNAPSACK:
        tries.append(lambda: _fitted(sizes, counts, budget, none.copy(), exact_words // 2))
    if budget > exact_words:
        tries += [lambda e=e: _fitted(sizes, counts, budget, _searched(sizes, counts, budget, share(e)), KNAPSACK) for e in (8, 4, 0)]
    best = none
    for attempt in tries:
        take = attempt()
        if sum(take * sizes) > sum(best * sizes):
            best = take
        if sum(best * sizes) == most:
            break
    return best


def _searched(sizes: np.ndarray, counts: np.ndarray, budget: int, take: np.ndarray) -> np.ndarray:
    """``take`` with more documents, for the largest sum found up to the budget, the longest documents first."""
    take = take.copy()
    left = int(budget - sum(take * sizes))
    sums, last, before = (np.full(1, x, dtype=np.int64) for x in (0, -1, -1))  # a sum, its last part and the sum it stands on
    parts: list[tuple[int, int]] = []
    width, full = 1, None  # from SUMS sums on: the width of a step, and the steps that have a sum
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        spare, k = min(int(counts[i] - take[i]), int(left // sizes[i])) if sizes[i] else 0, 1
        while spare > 0 and sums.max() < left and (full is None or not full[-1]):  # counts in binary parts; a taken last step ends it
            n = min(k, spare)
            under = np.flatnonzero(sums <= left - n * int(sizes[i]))
            new = sums[under] + n * int(sizes[i])
            fresh = ~np.isin(new, sums) if full is None else ~full[new // width]
            under, new = under[fresh], new[fresh]
            if full is not None:
                new, at = new[::-1], under[::-1]
                _, first = np.unique(new // width, return_index=True)
                new, under = new[first], at[first]
            sums, before = np.append(sums, new), np.append(before, under)
            last = np.append(last, np.full(len(new), len(parts)))
            parts.append((i, n))
            if full is None and len(sums) > SUMS:
                width = left // SUMS + 1
                full = np.zeros(left // width + 1, dtype=bool)
            if full is not None:
                full[sums // width] = True
            spare, k = spare - n, 2 * k
    at = int(sums.argmax())
    while at:
        i, n = parts[last[at]]
        take[i] += n
        at = int(before[at])
    return take


def _fitted(sizes: np.ndarray, counts: np.ndarray, budget: int, take: np.ndarray, window: int) -> np.ndarray:
    """``take`` with more documents, towards the budget: the longest until less than twice the
    window is left, and exactly from there."""
    take = take.copy()
    left = budget - sum(take * sizes)
    if left > 2 * window:
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if left <= window:
                break
            more = min(counts[i] - take[i], (left - window // 2) // sizes[i]) if sizes[i] else 0
            take[i] += max(0, more)
            left -= max(0, more) * sizes[i]
    if left <= 0:
        return take
    left = min(left, 2 * window)
    reached = np.zeros(int(left) + 1, dtype=bool)
    reached[0] = True
    by = np.full(int(left) + 1, -1, dtype=np.int32)
    parts: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        spare, k = min(int(counts[i] - take[i]), int(left // size)) if size else 0, 1
        while spare > 0 and not reached[-1]:  # counts in binary parts
            n = min(k, spare)
            step = n * int(size)
            if step <= left:
                new = np.zeros_like(reached)
                np.greater(reached[: len(reached) - step], reached[step:], out=new[step:])
                by[new] = len(parts)
                reached |= new
                parts.append((i, n))
            spare, k = spare - n, 2 * k
        if reached[-1]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:  # each sum was first reached by a part on top of parts before it
        i, n = parts[by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def plan(sizes: DataFrame, exact_words: int = EXACT_WORDS) -> DataFrame:
    """source, size, source_size, target, passes, n and pick: of the n documents of a source and
    size, ``pick`` are taken once more than ``passes`` times."""
    goal = targets(sizes)
    counted = (sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
               .groupBy("source").agg(F.collect_list(F.struct("size", "n")).alias("counts")))  # one entry a distinct size

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = sorted((c["size"], c["n"]) for c in row["counts"])
                size, n = (np.array(x, dtype=np.int64) for x in zip(*counts))
                goal, whole = round(row["target"]), row["source_size"]
                passes = goal // whole if whole else 0
                pick = fit_budget(size, n, goal - passes * whole, exact_words)
                k = len(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["source"]] * k, pa.string()), pa.array(size), pa.array([whole] * k, pa.int64()), pa.array([row["target"]] * k, pa.float64()),
                     pa.array([passes] * k, pa.int64()), pa.array(n), pa.array([int(x) for x in pick], pa.int64())],
                    names=["source", "size", "source_size", "target", "passes", "n", "pick"])

    rows = counted.join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return rows.mapInArrow(run, "source string, size long, source_size long, target double, passes long, n long, pick long")


def mix(docs: DataFrame, seed: int = SEED, exact_words: int = EXACT_WORDS) -> DataFrame:
    """Every document with its size, its source's size and target, how many times the mix takes it, and the words taken."""
    spark = docs.sparkSession
    common.prepare(spark)
    own = [c for c in docs.columns if c not in RESULTS]
    docs = with_size(docs.select(*own))
    hashed = [f.name for f in docs.schema if f.name in own and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *hashed), 1)  # 63 bits: ranges and the rule have one order
    slim = common.stored(docs.select(lot.alias("lot"), F.col("source").cast("string").alias("source"), "size"), "sizes")
    planned = common.stored(plan(slim.select("source", "size"), exact_words), "mix-plan")

    # Where only some documents of a size are taken: the last lot, and how many of its rows.
    some = planned.where("pick > 0 and pick < n").select(F.col("source").alias("__s"), F.col("size").alias("__z"), "n", "pick")
    drawn = (slim.join(some, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
             .withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS))
             .withColumn("range", F.floor(F.expr("shiftright(lot, 32) / 2147483648D") * F.col("ranges"))))
    group = ["source", "size"]

    def reached(counts: DataFrame, by: str, within: list[str], goal: str) -> DataFrame:
        """Of each group, the row of ``counts`` at which the running count c reaches the goal, and what the goal has left there."""
        so_far = Window.partitionBy(*within).orderBy(by)  # a row for each RANGE_ROWS documents, or a lot of one range
        return counts.withColumn("upto", F.sum("c").over(so_far)).where(f"upto >= {goal} and upto - c < {goal}").withColumn("left", F.expr(f"{goal} - upto + c"))

    edge = (reached(drawn.groupBy(*group, "range").agg(F.count("*").alias("c"), F.first("pick").alias("pick")), "range", group, "pick")
            .select(F.col("source").alias("__s2"), F.col("size").alias("__z2"), F.col("range").alias("__r"), F.col("left").alias("goal")))
    lots = (drawn.join(edge, F.col("source").eqNullSafe(F.col("__s2")) & (F.col("size") == F.col("__z2")) & (F.col("range") == F.col("__r")))
            .groupBy(*group, "goal", "lot").agg(F.count("*").alias("c")))
    last = reached(lots, "lot", group, "goal").select(F.col("source").alias("__s3"), F.col("size").alias("__z3"), F.col("lot").alias("last_lot"), "left", "c")
    rule = (planned.join(last, F.col("source").eqNullSafe(F.col("__s3")) & (F.col("size") == F.col("__z3")), "left")
            .select("source_size", "target", *(F.col(c).alias(f"__{c}") for c in ("source", "size", "passes", "n", "pick", "last_lot", "left", "c"))))
    rule = common.stored(rule, "mix-rule")
    ruled = docs.withColumn("__lot", lot).join(rule, F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")))
    numbered = F.coalesce((F.col("__lot") == F.col("__last_lot")) & (F.col("__left") < F.col("__c")), F.lit(False))
    once_more = (F.col("__pick") > 0) & ((F.col("__pick") == F.col("__n")) | (F.col("__lot") <= F.col("__last_lot")))

    def taken(rows: DataFrame, more) -> DataFrame:
        return (rows.withColumn("times", F.col("__passes") + F.coalesce(more, F.lit(False)).cast("long"))
                .select(*own, "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")))

    if rule.where("__left < __c").isEmpty():
        return taken(ruled, once_more)
    # Equal rows of a last lot that is taken in part: numbered part by part.
    ties = common.stored(ruled.where(numbered).withColumn("__row", F.monotonically_increasing_id()), "mix-ties").withColumn("__part", F.shiftright("__row", 33))
    keys = ["__source", "__size", "__part"]
    before = (ties.groupBy(*keys).agg(F.count("*").alias("c"))
              .withColumn("__before", F.sum("c").over(Window.partitionBy("__source", "__size").orderBy("__part")) - F.col("c"))  # a row a part
              .select(*(F.col(k).alias(f"{k}_") for k in keys), "__before"))
    ties = (ties.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__row")))
            .join(before, F.col("__source").eqNullSafe(F.col("__source_")) & (F.col("__size") == F.col("__size_")) & (F.col("__part") == F.col("__part_"))))
    return taken(ruled.where(~numbered), once_more).unionByName(taken(ties, F.col("__before") + F.col("__k") <= F.col("__left")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
