"""Redaction operators over text tables: redact, preview, audits, by-kind
counts and the ingest-side second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import DEFAULT_REDACTION_SALT
from callgauge.functions.redact import (DETECTORS, KINDS, TOKEN_PATTERN, luhn_sql, sql_str,
                                        ssn_valid_sql, with_preview, with_redaction)

PREVIEW_CHARS = 300  # default preview length


def redact_text(df: DataFrame, text_col: str = "text", keep=("doc_id",),
                salt: str = DEFAULT_REDACTION_SALT) -> DataFrame:
    """Redacted text, total hits and hits per detector kind."""
    r = with_redaction(df.select(*keep, text_col), text_col, "redacted", salt)
    return r.select(*keep, "redacted_text", "redacted_hits", *[f"redacted_{k.lower()}" for k in KINDS])


def preview_text(df: DataFrame, text_col: str = "text", max_chars: int = PREVIEW_CHARS,
                 keep=("doc_id",), salt: str = DEFAULT_REDACTION_SALT) -> DataFrame:
    """Short previews: the redacted text, cut to ``max_chars``. Detectors see the
    whole text, so the cut never hides part of a match from them."""
    r = with_preview(df.select(*keep, text_col), text_col, max_chars, "preview", salt)
    return r.select(*keep, "preview", "preview_hits")


def _audit(df: DataFrame, kind: str, check_sql: str, name: str, text_col: str) -> DataFrame:
    pat = sql_str(dict(DETECTORS)[kind])
    runs = df.select(
        "source", F.explode(F.expr(f"regexp_extract_all({text_col}, {pat}, 0)")).alias("m"))
    return (runs.groupBy("source", F.expr(check_sql).alias(name))
            .agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("m").alias("distinct_runs")))


def card_audit(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Card-shaped runs per source, split by Luhn pass/fail."""
    return _audit(df, "CARD", luhn_sql("m"), "luhn_ok", text_col)


def ssn_audit(df: DataFrame, text_col: str = "text") -> DataFrame:
    """SSN-shaped runs per source, split by issuable or not."""
    return _audit(df, "SSN", ssn_valid_sql("m"), "issuable", text_col)


def redaction_by_kind(redacted: DataFrame, text_col: str = "redacted_text") -> DataFrame:
    """Tokens per detector kind and distinct tokens per kind (a stable token
    stands for one underlying value, so distinct tokens count distinct values)."""
    toks = redacted.select(F.explode(F.expr(
        f"regexp_extract_all({text_col}, {sql_str(TOKEN_PATTERN)}, 0)")).alias("tok"))
    return (toks.groupBy(F.expr(f"regexp_extract(tok, {sql_str(r'^\[([A-Z]+):')}, 1)").alias("kind"))
            .agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("tok").alias("distinct_tokens")))


def redaction_second_pass(events: DataFrame, mode: str = "both", max_chars: int = PREVIEW_CHARS,
                          input_col: str = "input_text", output_col: str = "output_text",
                          hits_col: str = "redaction_hits", salt: str = DEFAULT_REDACTION_SALT) -> DataFrame:
    """Ingest-side pass: when ``mode`` is 'ingest' or 'both', re-preview both
    text fields and add their hits to the event's count; otherwise pass the
    fields through unchanged."""
    if mode not in ("ingest", "both"):
        return (events.withColumnRenamed(input_col, "input_preview")
                .withColumnRenamed(output_col, "output_preview"))
    a = with_preview(events, input_col, max_chars, "input_preview", salt)
    b = with_preview(a, output_col, max_chars, "output_preview", salt)
    return (b.withColumn(hits_col, F.expr(f"{hits_col} + input_preview_hits + output_preview_hits"))
            .drop("input_preview_hits", "output_preview_hits", input_col, output_col))
