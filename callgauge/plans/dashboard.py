"""The dashboard bundle (E11): every panel for one (range, model) request.

All panels are independent lazy DataFrames — the caller runs them concurrently
or one by one; nothing is kept in memory between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from callgauge.constants import DEFAULT_RANGE, RANGES
from callgauge.operators import metrics


def dashboard(rollup: DataFrame, events: DataFrame, dlq: DataFrame, range_key: str, as_of: str,
              model: str | None = None) -> dict[str, DataFrame]:
    """Panels: timeseries, totals, by_model, by_error_type, ingest_health,
    known_models, latency_percentiles_raw. An unknown range falls back to 1h;
    an empty model means no filter."""
    rk = range_key if range_key in RANGES else DEFAULT_RANGE
    m = model or None
    slice_ = metrics.in_range(rollup, "bucket", rk, as_of)
    return {
        "timeseries": metrics.timeseries(slice_, rk, as_of, m),
        "totals": metrics.totals(slice_, rk, as_of, m),
        "by_model": metrics.by_model(slice_, rk, as_of),
        "by_error_type": metrics.by_error_type(events, rk, as_of),
        "ingest_health": metrics.ingest_health(events, dlq, rk, as_of),
        "known_models": metrics.known_models(slice_, rk, as_of),
        "latency_percentiles_raw": metrics.latency_percentiles_raw(events, rk, as_of),
    }
