"""Mergeable fixed-bucket latency histograms as Spark SQL expressions.

A histogram is an ``array<bigint>`` of 11 counts over ``LATENCY_BOUNDS``.
Adding two histograms element-wise yields the histogram of the union, so they
aggregate with plain ``sum`` per slot (map-side partial aggregation applies)
and percentiles are read back from any merged range.

Builders return SQL text (``*_sql``) or a ``Column`` made with ``F.expr`` — one
JVM call per expression however large, and everything stays inside
whole-stage codegen (no lambdas, no UDFs). Arguments are SQL expressions,
usually column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.constants import LATENCY_BOUNDS

N_BUCKETS = len(LATENCY_BOUNDS)
SLOTS = range(1, N_BUCKETS + 1)


def bucket_index_sql(ms: str) -> str:
    """1-based index of the first bound strictly greater than ``ms``; NULL stays
    NULL; values at/above the last bound land in the last bucket."""
    whens = " ".join(f"WHEN {ms} < {b} THEN {i}" for i, b in enumerate(LATENCY_BOUNDS[:-1], start=1))
    return f"(CASE WHEN {ms} IS NULL THEN CAST(NULL AS INT) {whens} ELSE {N_BUCKETS} END)"


def bucket_index(ms: str) -> Column:
    return F.expr(bucket_index_sql(ms))


def histogram_of(ms: str) -> Column:
    """One-hot histogram of a single observation (all zeros for NULL)."""
    idx = bucket_index_sql(ms)
    return F.expr("array(" + ", ".join(f"IF({idx} = {i}, 1L, 0L)" for i in SLOTS) + ")")


def histogram_counts_of_index(idx: str) -> Column:
    """Aggregate: histogram as 11 ``count_if`` over a pre-computed bucket index
    (each slot is an ordinary partial aggregate; no collect_list, no UDAF)."""
    return F.expr("array(" + ", ".join(f"count_if({idx} = {i})" for i in SLOTS) + ")")


def histogram_counts(ms: str) -> Column:
    return histogram_counts_of_index(bucket_index_sql(ms))


def hist_add(a: str, b: str) -> Column:
    """Element-wise sum; the shorter (or NULL) side is padded with zeros."""
    return F.expr(f"zip_with(coalesce({a}, CAST(array() AS array<bigint>)), "
                  f"coalesce({b}, CAST(array() AS array<bigint>)), "
                  f"(x, y) -> coalesce(x, 0L) + coalesce(y, 0L))")


def slot_sql(h: str, i: int) -> str:
    return f"coalesce(CAST(try_element_at({h}, {i}) AS BIGINT), 0L)"


def hist_sum(h: str) -> Column:
    """Aggregate: element-wise sum of histograms in the group, one ``sum`` per
    slot. An empty group gives 11 zeros (whose percentile is NULL)."""
    return F.expr("array(" + ", ".join(f"coalesce(sum({slot_sql(h, i)}), 0L)" for i in SLOTS) + ")")


def hist_total_sql(h: str) -> str:
    return "(" + " + ".join(slot_sql(h, i) for i in SLOTS) + ")"


def percentile_from_slots_sql(slots: list[str], cums: list[str], p) -> str:
    """Percentile given per-slot and cumulative counts (SQL expressions).

    The first bucket i with cum[i] >= total*p holds the target; interpolate
    linearly between its lower and upper bound. The unbounded last bucket, or a
    bucket with zero count, returns its lower bound. NULL when total is 0.
    One CASE over literal bounds: no array indexing, no lambdas.
    """
    pv = repr(float(p)) if isinstance(p, (int, float)) else f"CAST({p} AS DOUBLE)"
    target = f"(CAST({cums[-1]} AS DOUBLE) * {pv})"
    parts = [f"WHEN {cums[-1]} = 0 THEN CAST(NULL AS DOUBLE)"]
    for i in SLOTS:
        lower = 0.0 if i == 1 else float(LATENCY_BOUNDS[i - 2])
        upper = float(LATENCY_BOUNDS[i - 1])
        reached = f"CAST({cums[i - 1]} AS DOUBLE) >= {target}"
        if i == N_BUCKETS:
            parts.append(f"WHEN {reached} THEN {lower!r}D")
            continue
        prev = "0.0D" if i == 1 else f"CAST({cums[i - 2]} AS DOUBLE)"
        cnt = slots[i - 1]
        parts.append(f"WHEN {reached} THEN IF({cnt} = 0, {lower!r}D, "
                     f"{lower!r}D + {upper - lower!r}D * (({target} - {prev}) / CAST({cnt} AS DOUBLE)))")
    return f"(CASE {' '.join(parts)} ELSE {float(LATENCY_BOUNDS[-2])!r}D END)"


def hist_percentile_sql(h: str, p) -> str:
    slots = [slot_sql(h, i) for i in SLOTS]
    cums = ["(" + " + ".join(slots[:i]) + ")" for i in SLOTS]
    return f"IF({h} IS NULL, CAST(NULL AS DOUBLE), {percentile_from_slots_sql(slots, cums, p)})"


def hist_percentile(h: str, p: float) -> Column:
    """Percentile read from one histogram column (self-contained expression).
    For several percentiles of one histogram prefer :func:`with_percentiles`."""
    return F.expr(hist_percentile_sql(h, p))


def with_percentiles(df: DataFrame, hist_col: str, outputs: dict[str, float],
                     round_to_int: bool = False) -> DataFrame:
    """Add one column per ``{name: p}`` read from ``hist_col``.

    Slot counts and cumulative counts are materialised as columns first; each
    percentile is then a CASE over those attributes (Catalyst does not collapse
    projections that would duplicate non-trivial expressions), so the generated
    code stays small however many percentiles are read.
    """
    sn = [f"_{hist_col}_s{i}" for i in SLOTS]
    cn = [f"_{hist_col}_c{i}" for i in SLOTS]
    staged = df.withColumns({n: F.expr(slot_sql(hist_col, i)) for i, n in zip(SLOTS, sn)})
    staged = staged.withColumns({cn[i - 1]: F.expr(" + ".join(sn[:i])) for i in SLOTS})
    cols = {}
    for name, p in outputs.items():
        v = f"IF({hist_col} IS NULL, CAST(NULL AS DOUBLE), {percentile_from_slots_sql(sn, cn, p)})"
        cols[name] = F.expr(f"round({v}, 0)" if round_to_int else v)
    return staged.withColumns(cols).drop(*sn, *cn)
