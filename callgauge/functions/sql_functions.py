"""The column builders as SQL-bodied temporary functions, for Spark SQL users.

``register(spark)`` creates (no Python involved at run time; the bodies are
SQL expressions that Catalyst inlines):

  latency_bucket_index(ms INT) -> INT
  latency_histogram_of(ms INT) -> ARRAY<BIGINT>
  histogram_percentile(h ARRAY<BIGINT>, p DOUBLE) -> DOUBLE
  normalise_model(m STRING) -> STRING
  llm_call_cost(model STRING, input INT, output INT, cache_write INT, cache_read INT) -> DECIMAL(14,8)

The histogram aggregate (element-wise sum) stays an expression over ``sum``
per slot, which SQL writes directly: see :data:`HIST_SUM_SQL`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from callgauge.constants import LATENCY_BOUNDS
from callgauge.functions.histogram import SLOTS, bucket_index_sql, slot_sql
from callgauge.functions.pricing import cost_from_rates_sql, normalise_model_sql, price_of_sql


def hist_sum_sql(col: str) -> str:
    return "array(" + ", ".join(f"coalesce(sum({slot_sql(col, i)}), 0L)" for i in SLOTS) + ")"


def percentile_fold_sql(h: str, p: str) -> str:
    """Percentile as one fold over (count, lower, upper) per bucket: stop at the
    first bucket whose cumulative count reaches total*p and interpolate; the
    unbounded last bucket (upper NULL) or an empty bucket returns its lower
    bound. Compact, so it inlines cheaply wherever the SQL function is used."""
    lowers = "array(" + ", ".join(["0D"] + [f"{float(b)!r}D" for b in LATENCY_BOUNDS[:-1]]) + ")"
    uppers = "array(" + ", ".join([f"{float(b)!r}D" for b in LATENCY_BOUNDS[:-1]] + ["CAST(NULL AS DOUBLE)"]) + ")"
    total = f"aggregate({h}, 0L, (a, x) -> a + coalesce(x, 0L))"
    tgt = f"(CAST({total} AS DOUBLE) * CAST({p} AS DOUBLE))"
    zipped = (f"zip_with({h}, zip_with({lowers}, {uppers}, (l, u) -> named_struct('l', l, 'u', u)), "
              f"(c, b) -> named_struct('c', c, 'l', b.l, 'u', b.u))")
    fold = (f"aggregate({zipped}, "
            f"named_struct('cum', 0L, 'res', CAST(NULL AS DOUBLE), 'done', false), "
            f"(acc, e) -> IF(acc.done, acc, IF(CAST(acc.cum + coalesce(e.c, 0L) AS DOUBLE) >= {tgt}, "
            f"named_struct('cum', acc.cum + coalesce(e.c, 0L), 'res', "
            f"IF(e.u IS NULL OR coalesce(e.c, 0L) = 0, e.l, "
            f"e.l + (e.u - e.l) * (({tgt} - CAST(acc.cum AS DOUBLE)) / CAST(e.c AS DOUBLE))), "
            f"'done', true), "
            f"named_struct('cum', acc.cum + coalesce(e.c, 0L), 'res', acc.res, 'done', false))), "
            f"acc -> IF(acc.done, acc.res, {float(LATENCY_BOUNDS[-2])!r}D))")
    return f"IF({h} IS NULL OR {total} = 0, CAST(NULL AS DOUBLE), {fold})"


def register(spark: SparkSession) -> None:
    stmts = [
        f"CREATE OR REPLACE TEMPORARY FUNCTION latency_bucket_index(ms INT) RETURNS INT "
        f"RETURN {bucket_index_sql('ms')}",
        "CREATE OR REPLACE TEMPORARY FUNCTION latency_histogram_of(ms INT) RETURNS ARRAY<BIGINT> RETURN "
        "array(" + ", ".join(f"IF({bucket_index_sql('ms')} = {i}, 1L, 0L)" for i in SLOTS) + ")",
        f"CREATE OR REPLACE TEMPORARY FUNCTION histogram_percentile(h ARRAY<BIGINT>, p DOUBLE) RETURNS DOUBLE "
        f"RETURN {percentile_fold_sql('h', 'p')}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION normalise_model(m STRING) RETURNS STRING "
        f"RETURN {normalise_model_sql('m')}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION llm_call_cost(model STRING, input_tokens INT, output_tokens INT, "
        f"cache_write_tokens INT, cache_read_tokens INT) RETURNS DECIMAL(14,8) RETURN "
        f"{cost_from_rates_sql(price_of_sql('model'))}",
    ]
    for s in stmts:
        spark.sql(s)
