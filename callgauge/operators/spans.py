"""Vendor payloads -> call facts: request/response flattening, stream-chunk
parsing and span assembly (one event per call).

Chunks of one call are grouped by ``call_id``; every aggregate is bounded by
one call (the assembled text is capped at 8,192 characters before any
collection happens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgauge.functions.timebin import round_div_sql
from callgauge.operators.errors import classify_error_sql


def _num(v: str, path: str) -> str:
    """A JSON number at ``path`` or NULL (strings and other types ignored)."""
    ty = f"schema_of_variant(variant_get({v}, '{path}', 'variant'))"
    return (f"IF({ty} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT') OR startswith({ty}, "
            f"'DECIMAL'), CAST(try_variant_get({v}, '{path}', 'double') AS BIGINT), NULL)")


def _str(v: str, path: str) -> str:
    ty = f"schema_of_variant(variant_get({v}, '{path}', 'variant'))"
    return f"IF({ty} = 'STRING', try_variant_get({v}, '{path}', 'string'), NULL)"


MESSAGES_TEXT = """array_join(flatten(transform(
      coalesce(try_variant_get({v}, '$.messages', 'array<variant>'), array()),
      m -> IF(schema_of_variant(variant_get(m, '$.content', 'variant')) = 'STRING',
              array(try_variant_get(m, '$.content', 'string')),
              filter(transform(coalesce(try_variant_get(m, '$.content', 'array<variant>'), array()),
                               b -> IF(try_variant_get(b, '$.type', 'string') = 'text'
                                       AND schema_of_variant(variant_get(b, '$.text', 'variant')) = 'STRING',
                                       try_variant_get(b, '$.text', 'string'), NULL)),
                     x -> x IS NOT NULL)))), '\\n')"""


def flatten_requests(log: DataFrame, json_col: str = "request", provider_col: str = "provider") -> DataFrame:
    """Request JSON -> model ('unknown' if absent), streamed, max_tokens
    (openai: max_completion_tokens before max_tokens), temperature,
    message_count and input_text (string contents and text blocks joined by
    newlines; an anthropic system prompt is prefixed with a blank line)."""
    v = "_req"
    df = log.withColumn(v, F.expr(f"try_parse_json({json_col})"))
    text = MESSAGES_TEXT.format(v=v)
    system = _str(v, "$.system")
    is_oa = f"{provider_col} <> 'anthropic'"
    return df.selectExpr(
        "*",
        f"coalesce({_str(v, '$.model')}, 'unknown') AS model",
        f"coalesce(try_variant_get({v}, '$.stream', 'boolean'), false) AS streamed",
        f"IF({is_oa}, coalesce({_num(v, '$.max_completion_tokens')}, {_num(v, '$.max_tokens')}), "
        f"{_num(v, '$.max_tokens')}) AS max_tokens",
        f"IF(startswith(schema_of_variant(variant_get({v}, '$.temperature', 'variant')), 'DECIMAL') OR "
        f"schema_of_variant(variant_get({v}, '$.temperature', 'variant')) IN ('DOUBLE', 'BIGINT'), "
        f"try_variant_get({v}, '$.temperature', 'double'), NULL) AS temperature",
        f"CAST(coalesce(json_array_length(to_json(variant_get({v}, '$.messages', 'variant'))), 0) AS INT) "
        f"AS message_count",
        f"IF(NOT {is_oa} AND {system} IS NOT NULL AND {system} <> '', concat({system}, '\\n\\n', {text}), {text}) "
        f"AS input_text",
    ).drop(v)


def flatten_responses(log: DataFrame, json_col: str = "response", provider_col: str = "provider") -> DataFrame:
    """Response JSON -> text, four usage fields and finish reason, for the
    anthropic message layout and the OpenAI choices layout."""
    v = "_res"
    df = log.withColumn(v, F.expr(f"try_parse_json({json_col})"))
    anth_text = (f"array_join(filter(transform(coalesce(try_variant_get({v}, '$.content', 'array<variant>'), "
                 f"array()), b -> IF(try_variant_get(b, '$.type', 'string') = 'text', "
                 f"try_variant_get(b, '$.text', 'string'), NULL)), x -> x IS NOT NULL), '')")
    is_a = f"{provider_col} = 'anthropic'"
    return df.selectExpr(
        "*",
        f"IF({is_a}, {anth_text}, coalesce({_str(v, '$.choices[0].message.content')}, '')) AS text",
        f"IF({is_a}, {_num(v, '$.usage.input_tokens')}, {_num(v, '$.usage.prompt_tokens')}) AS input_tokens",
        f"IF({is_a}, {_num(v, '$.usage.output_tokens')}, {_num(v, '$.usage.completion_tokens')}) AS output_tokens",
        f"IF({is_a}, {_num(v, '$.usage.cache_read_input_tokens')}, "
        f"{_num(v, '$.usage.prompt_tokens_details.cached_tokens')}) AS cache_read_tokens",
        f"IF({is_a}, {_num(v, '$.usage.cache_creation_input_tokens')}, NULL) AS cache_write_tokens",
        f"IF({is_a}, {_str(v, '$.stop_reason')}, {_str(v, '$.choices[0].finish_reason')}) AS finish_reason",
    ).drop(v)


def parse_chunks(chunks: DataFrame, provider_col: str = "provider") -> DataFrame:
    """Stream chunk JSON -> (text, input/output/cache usage, finish_reason).

    anthropic: message_start carries input and cache usage, content_block_delta
    text_delta carries text, message_delta carries output usage and the stop
    reason; OpenAI: choices[0].delta.content, choices[0].finish_reason and a
    usage object (no cache usage on streams). The payload of an 'error' marker
    may carry the error's name, code and message."""
    v = "_c"
    df = chunks.withColumn(v, F.expr("try_parse_json(payload)"))
    ty = f"try_variant_get({v}, '$.type', 'string')"
    is_a = f"{provider_col} = 'anthropic'"
    oa_text = _str(v, "$.choices[0].delta.content")
    return df.selectExpr(
        "*",
        f"IF({is_a}, IF({ty} = 'content_block_delta' AND try_variant_get({v}, '$.delta.type', 'string') = "
        f"'text_delta', {_str(v, '$.delta.text')}, NULL), IF({oa_text} = '', NULL, {oa_text})) AS text",
        f"IF({is_a}, IF({ty} = 'message_start', {_num(v, '$.message.usage.input_tokens')}, NULL), "
        f"{_num(v, '$.usage.prompt_tokens')}) AS input_tokens",
        f"IF({is_a}, IF({ty} = 'message_delta', {_num(v, '$.usage.output_tokens')}, NULL), "
        f"{_num(v, '$.usage.completion_tokens')}) AS output_tokens",
        f"IF({is_a} AND {ty} = 'message_start', {_num(v, '$.message.usage.cache_read_input_tokens')}, NULL) "
        f"AS cache_read_tokens",
        f"IF({is_a} AND {ty} = 'message_start', {_num(v, '$.message.usage.cache_creation_input_tokens')}, NULL) "
        f"AS cache_write_tokens",
        f"IF({is_a}, IF({ty} = 'message_delta', {_str(v, '$.delta.stop_reason')}, NULL), "
        f"{_str(v, '$.choices[0].finish_reason')}) AS finish_reason",
        *[f"IF(kind = 'error', try_variant_get({v}, '$.{k}', 'string'), NULL) AS error_{k}" for k in ("name", "code", "message")],
    ).drop(v)


TERMINALS = "('done', 'return', 'error')"


def assemble_spans(parsed: DataFrame, text_limit: int | None = None, count_as: str | None = None) -> DataFrame:
    """One call record per ``call_id`` from its parsed chunks and terminal
    marker (kind 'done' -> ok, 'return' -> cancelled, 'error' -> classified by
    the error's name, code, HTTP status and message; no marker -> cancelled).

    The first terminal marker (by seq) ends the call: chunks behind it count
    for nothing. TTFT = first text chunk - call start, capped at latency;
    latency = terminal time - start (last chunk if no marker); usage = last
    non-NULL number per field; finish reason = last non-empty one. Text is the
    chunks' text in seq order, whole unless ``text_limit`` is given: then it is
    appended only while its length is below the limit. Tokens/s has 2 dp. ``count_as``
    names a column for the number of the call's chunks, those behind the marker among them.
    """
    call = Window.partitionBy("call_id")  # the chunks of one call
    if count_as is not None:
        parsed = parsed.withColumn("_n", F.count(F.lit(1)).over(call))
    p = (parsed.withColumn("_end_seq", F.min(F.expr(f"IF(kind IN {TERMINALS}, seq, NULL)")).over(call))
         .filter("_end_seq IS NULL OR seq <= _end_seq"))
    keep = "text IS NOT NULL"
    if text_limit is not None:
        so_far = call.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        p = p.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(so_far), F.lit(0)))
        keep += f" AND _before < {int(text_limit)}"
    g = p.groupBy("call_id").agg(
        F.first("provider").alias("provider"),
        F.min("ts").alias("started_at"),
        F.min(F.when(F.col("text").isNotNull() & (F.col("text") != ""), F.col("ts"))).alias("_first_text"),
        F.expr(f"min_by(kind, seq) FILTER (WHERE kind IN {TERMINALS})").alias("terminal"),
        F.expr(f"min_by(ts, seq) FILTER (WHERE kind IN {TERMINALS})").alias("_end"),
        *[F.expr(f"min_by({c}, seq) FILTER (WHERE kind = 'error')").alias(c)
          for c in ("http_status", "error_name", "error_code", "error_message")],
        F.max("ts").alias("_last"),
        *[F.expr(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL)").alias(c)
          for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")],
        F.expr("max_by(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL AND finish_reason <> '')")
        .alias("finish_reason"),
        F.expr(f"array_join(transform(array_sort(collect_list(IF({keep}, named_struct('s', seq, 't', text), NULL))), "
               "x -> x.t), '')").alias("output_text"),
        *([] if count_as is None else [F.max("_n").alias(count_as)]),
    )
    return finish_spans(g, [] if count_as is None else [count_as])


def finish_spans(g: DataFrame, carried: list[str] = ()) -> DataFrame:
    """Status, error, latency, TTFT and throughput from per-call aggregates, and the columns ``carried``."""
    g = g.withColumn("ended_at", F.expr("coalesce(_end, _last)"))
    g = g.withColumn("latency_ms", F.expr("CAST((unix_micros(ended_at) - unix_micros(started_at)) / 1000 AS BIGINT)"))
    err_type = classify_error_sql("provider", "coalesce(error_name, '')", "error_code", "http_status", "coalesce(error_message, '')")
    return g.withColumn("_type", F.expr(f"IF(terminal = 'error', {err_type}, NULL)")).selectExpr(
        "call_id", "provider", "started_at", "ended_at",
        "CASE terminal WHEN 'done' THEN 'ok' WHEN 'error' THEN IF(_type = 'cancelled', 'cancelled', 'error') "
        "ELSE 'cancelled' END AS status",
        "nullif(_type, 'cancelled') AS error_type", "error_message",
        "latency_ms",
        "least(CAST((unix_micros(_first_text) - unix_micros(started_at)) / 1000 AS BIGINT), latency_ms) AS ttft_ms",
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "finish_reason",
        "output_text",
        f"IF(output_tokens > 0 AND latency_ms > 0, {round_div_sql('output_tokens * 1000', 'latency_ms', 2)}, NULL) "
        "AS tokens_per_sec", *carried,
    )
