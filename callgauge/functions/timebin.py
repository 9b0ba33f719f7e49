"""Time helpers as SQL expressions: range predicates, date_bin with an
arbitrary origin, exact integer rounding and output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PLAIN = "yyyy-MM-dd HH:mm:ss"
PLAIN_US = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts_sql(ts: str) -> str:
    return f"TIMESTAMP '{ts}'"


def origin_sql(as_of: str, minutes: int) -> str:
    return f"({ts_sql(as_of)} - INTERVAL {int(minutes)} MINUTES)"


def since_sql(col: str, as_of: str, minutes: int) -> str:
    """``col >= as_of - interval``: the range predicate of every dashboard query
    (a literal bound, so it folds and is pushed down to the scan)."""
    return f"{col} >= {origin_sql(as_of, minutes)}"


def since(col: str, as_of: str, minutes: int) -> Column:
    return F.expr(since_sql(col, as_of, minutes))


def date_bin_sql(col: str, stride_minutes: int, origin: str) -> str:
    """Start of the ``stride``-wide bin containing ``col``, bins anchored at
    ``origin`` (not the epoch): floor arithmetic on microseconds."""
    st = int(stride_minutes) * 60_000_000
    o = f"unix_micros({origin})"
    return f"timestamp_micros({o} + floor((unix_micros({col}) - {o}) / {st}) * {st})"


def round_div_sql(num: str, den: str, scale: int = 0) -> str:
    """num/den rounded half-up to ``scale`` decimals, exact for integers
    (num >= 0, den > 0); a double."""
    f = 10 ** scale
    q = f"((({num}) * {2 * f} + ({den})) div (({den}) * 2))"
    return f"(CAST({q} AS DOUBLE) / {float(f)!r})" if scale else f"CAST({q} AS DOUBLE)"


def round_div(num: str, den: str, scale: int = 0) -> Column:
    return F.expr(round_div_sql(num, den, scale))


def fmt(col: str, pattern: str = PLAIN) -> Column:
    return F.date_format(col, pattern)
