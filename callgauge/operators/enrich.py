"""Enrichment: pricing, pricing coverage, error classification."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import PRICES, PRICING_VERSION
from callgauge.functions.pricing import is_priced, normalise_model, with_cost, with_cost_or_error
from callgauge.functions.timebin import round_div


def price_events(events: DataFrame, prices=PRICES, version: str = PRICING_VERSION,
                 input_scale: Decimal = Decimal(1)) -> DataFrame:
    """Stamp ``cost_usd`` (DECIMAL(14,8), NULL when the model is unpriced) and
    ``pricing_version`` on every event. A pure projection: no join, no shuffle."""
    return with_cost(events, "cost_usd", "model", prices, input_scale).withColumn(
        "pricing_version", F.lit(version))


def try_price_events(events: DataFrame, prices=PRICES, version: str = PRICING_VERSION) -> DataFrame:
    """Like :func:`price_events`, with ``enrich_error`` for events that can't be priced: no price
    row or count ends the job. (Redaction has no input that it fails on.)"""
    return with_cost_or_error(events, "cost_usd", "enrich_error", "model", prices).withColumn("pricing_version", F.lit(version))


def pricing_coverage(events: DataFrame, prices=PRICES) -> DataFrame:
    """Models with no price: calls and share of all calls.

    Calls by model are a partial aggregate; their total and the unpriced models
    (a row each) are one more.
    """
    per_model = events.groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    both = per_model.agg(F.sum("calls").alias("total_calls"),
                         F.collect_list(F.when(~is_priced("model", prices), F.struct("model", "calls"))).alias("_m"))
    return (both.select("total_calls", F.inline("_m"))
            .select("model", normalise_model("model").alias("normalised_model"), "calls",
                    round_div("calls * 100", "total_calls", 2).alias("share_pct")))

