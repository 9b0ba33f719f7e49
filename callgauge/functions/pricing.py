"""Model-name normalisation and per-call pricing as SQL expressions.

The price list is a handful of rows (one per model), so it is inlined as a map
literal: pricing is a per-row expression inside whole-stage codegen, with no
join and no shuffle. Money is DECIMAL end to end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.constants import (MODEL_DATE_SUFFIX_PATTERN, MODEL_PREFIX_PATTERN,
                                 PRICES, PRICING_VERSION)

RATE_TYPE = "decimal(18,12)"
COST_TYPE = "decimal(14,8)"


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def normalise_model_sql(model: str) -> str:
    """Strip one leading provider prefix, then a trailing 8-digit date suffix."""
    return (f"regexp_replace(regexp_replace({model}, {_sql_str(MODEL_PREFIX_PATTERN)}, ''), "
            f"{_sql_str(MODEL_DATE_SUFFIX_PATTERN)}, '')")


def normalise_model(model: str) -> Column:
    return F.expr(normalise_model_sql(model))


#: Largest rate (USD per token) that RATE_TYPE holds.
MOST_RATE = Decimal(10) ** 6


def per_token_rates(prices=PRICES, input_scale: Decimal = Decimal(1)):
    """(model, r_in, r_out, r_cache_write, r_cache_read) in USD per token, exact. A row whose
    figures aren't numbers from 0 up is an error here; :func:`checked_rates` tells it apart."""
    out = []
    for model, rates, error in checked_rates(prices, input_scale):
        if error is not None:
            raise ValueError(error)
        out.append((model, *rates))
    return out


def checked_rates(prices=PRICES, input_scale: Decimal = Decimal(1)):
    """(model, (r_in, r_out, r_cache_write, r_cache_read), None) of each price row, or
    (model, None, what is wrong with it)."""
    out = []
    mill = Decimal(1_000_000)
    for model, *figures in prices:
        try:
            pin, pout, mw, mr = (Decimal(str(x)) for x in figures)
            pin *= input_scale
            rates = (pin / mill, pout / mill, pin * mw / mill, pin * mr / mill)
            if not all(r.is_finite() and 0 <= r < MOST_RATE for r in rates):
                raise ValueError
            out.append((model, rates, None))
        except (ArithmeticError, ValueError):
            out.append((model, None, f"pricing: the price list has no valid rates for {model}"))
    return out


def rate_map_sql(prices=PRICES, input_scale: Decimal = Decimal(1), strict: bool = True) -> str:
    entries = []
    for model, found, error in checked_rates(prices, input_scale):
        if strict and error is not None:
            raise ValueError(error)
        rates = ", ".join(f"'{n}', CAST({_sql_str(str(r)) if r is not None else 'NULL'} AS {RATE_TYPE})"
                          for n, r in zip(("r_in", "r_out", "r_cw", "r_cr"), found or (None,) * 4))
        problem = "" if strict else f", 'error', CAST({_sql_str(error) if error is not None else 'NULL'} AS STRING)"
        entries.append(f"{_sql_str(model)}, named_struct({rates}{problem})")
    return f"map({', '.join(entries)})"


def price_of_sql(model: str, prices=PRICES, input_scale: Decimal = Decimal(1), strict: bool = True) -> str:
    """Rate struct: exact model name first, else the normalised name; NULL when
    neither is listed."""
    m = rate_map_sql(prices, input_scale, strict)
    return f"coalesce(try_element_at({m}, {model}), try_element_at({m}, {normalise_model_sql(model)}))"


def is_priced(model: str, prices=PRICES) -> Column:
    return F.expr(f"{price_of_sql(model, prices)} IS NOT NULL")


def cost_from_rates_sql(rates: str, input_tokens: str = "input_tokens",
                        output_tokens: str = "output_tokens",
                        cache_write_tokens: str = "cache_write_tokens",
                        cache_read_tokens: str = "cache_read_tokens") -> str:
    """in*r_in + out*r_out + cw*r_cw + cr*r_cr over a rate struct column, NULL
    usage counted as 0, rounded to 8 dp; NULL when the rate struct is NULL
    (unpriced model)."""
    def term(tokens: str, rate: str) -> str:
        return f"CAST(coalesce({tokens}, 0) AS DECIMAL(12,0)) * {rates}.{rate}"

    total = " + ".join([term(input_tokens, "r_in"), term(output_tokens, "r_out"),
                        term(cache_write_tokens, "r_cw"), term(cache_read_tokens, "r_cr")])
    return f"IF({rates} IS NULL, CAST(NULL AS {COST_TYPE}), try_cast(round({total}, 8) AS {COST_TYPE}))"


def with_cost(df: DataFrame, out_col: str = "cost_usd", model: str = "model", prices=PRICES,
              input_scale: Decimal = Decimal(1)) -> DataFrame:
    """Add ``out_col`` priced from the token columns. The rate struct is looked
    up once into a staged column, then referenced by the cost expression."""
    return (df.withColumn("_rates", F.expr(price_of_sql(model, prices, input_scale)))
            .withColumn(out_col, F.expr(cost_from_rates_sql("_rates")))
            .drop("_rates"))


def with_cost_or_error(df: DataFrame, out_col: str = "cost_usd", error_col: str = "enrich_error", model: str = "model", prices=PRICES) -> DataFrame:
    """Add ``out_col`` and, where a listed model has no valid rates or the cost doesn't fit its
    type, ``error_col``: one bad price row or count fails its own events only."""
    staged = (df.withColumn("_rates", F.expr(price_of_sql(model, prices, strict=False)))
              .withColumn(out_col, F.expr(cost_from_rates_sql("_rates"))))
    error = f"CASE WHEN _rates.error IS NOT NULL THEN _rates.error WHEN _rates IS NOT NULL AND {out_col} IS NULL THEN concat('pricing: the cost of this call is out of range for ', {model}) END"
    return staged.withColumn(error_col, F.expr(error)).drop("_rates")


def pricing_version_lit(version: str = PRICING_VERSION) -> Column:
    return F.lit(version)
