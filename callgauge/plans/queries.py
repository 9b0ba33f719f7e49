"""Registered queries: ``name -> callable(spark, sf_dir) -> DataFrame``.

Each callable reads the shared tables through the adapters and runs one
library operator over the whole table. Output timestamps are rendered as text
(as the dashboard does) so results compare across engines without time-zone
ambiguity.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.constants import PRICES
from callgauge.functions.histogram import bucket_index, hist_sum, histogram_of, with_percentiles
from callgauge.functions.histogram import hist_add
from callgauge.functions.timebin import PLAIN, PLAIN_US, fmt
from callgauge.operators import audit, chat, enrich, errors, metrics, queue, redaction, rollup, spans, validate
from callgauge.operators import dlq as dlq_ops
from callgauge.plans import ingest
from callgauge.sources import adapters, eventlog
from callgauge.sources.tables import read_table

REGISTRY: dict = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def priced_events(spark: SparkSession, sf_dir: str, dense: bool, since: str | None = None) -> DataFrame:
    return enrich.price_events(adapters.inference_events(spark, sf_dir, dense, since))


def rollup_table(spark: SparkSession, sf_dir: str, dense: bool, since: str | None = None) -> DataFrame:
    """The minute rollup, or its buckets from the minute of ``since`` on."""
    return rollup.rollup_1m(priced_events(spark, sf_dir, dense, since))


def _rollup_out(r: DataFrame) -> DataFrame:
    """Rollup rows with text bucket and fixed-point text cost (as the wire does)."""
    return r.select(fmt("bucket", PLAIN).alias("bucket"),
                    *[F.col(c).cast("string").alias(c) if c == "cost_usd" else F.col(c)
                      for c in r.columns if c != "bucket"])


# --- D: rollup and histogram algebra ---------------------------------------

@register("rollup_1m")
def q_rollup_1m(spark, sf_dir):
    return _rollup_out(rollup_table(spark, sf_dir, dense=True))


@register("rollup_merge")
def q_rollup_merge(spark, sf_dir):
    """Rollup of each delivery batch (event_id div 50), merged: must equal the
    rollup of all events."""
    ev = priced_events(spark, sf_dir, dense=True)
    batch = F.floor(F.col("event_id").cast("bigint") / 50)
    deltas = [rollup.rollup_1m(ev.filter(batch % 3 == i)) for i in range(3)]
    return _rollup_out(rollup.rollup_merge(*deltas))


@register("latency_distribution")
def q_latency_distribution(spark, sf_dir):
    ev = adapters.inference_events(spark, sf_dir, dense=True)
    return ev.groupBy("model", bucket_index("latency_ms").alias("bucket")).agg(
        F.count(F.lit(1)).alias("calls"))


@register("first_event_histograms")
def q_first_event_histograms(spark, sf_dir):
    """Per-event one-hot histograms summed per minute: equals the rollup's."""
    ev = adapters.inference_events(spark, sf_dir, dense=True)
    one_hot = ev.select(F.date_trunc("minute", "created_at").alias("bucket"), "provider", "model",
                        histogram_of("latency_ms").alias("h_lat"), histogram_of("ttft_ms").alias("h_ttft"))
    g = one_hot.groupBy("bucket", "provider", "model").agg(
        hist_sum("h_lat").alias("hist_latency"), hist_sum("h_ttft").alias("hist_ttft"))
    return g.select(fmt("bucket", PLAIN).alias("bucket"), "provider", "model", "hist_latency", "hist_ttft")


@register("histogram_pairwise_add")
def q_histogram_pairwise_add(spark, sf_dir):
    """Two rollups (first and second half of the month) joined on the rollup key
    and added element-wise; keys present on one side keep that side."""
    ev = priced_events(spark, sf_dir, dense=False)
    first = ev.filter(F.col("created_at") < F.lit("2024-01-16").cast("timestamp"))
    second = ev.filter(F.col("created_at") >= F.lit("2024-01-16").cast("timestamp"))
    ra = rollup.rollup_1m(first).alias("a")
    rb = rollup.rollup_1m(second).alias("b")
    j = ra.join(rb, rollup.ROLLUP_KEY, "full_outer")
    return j.select(
        fmt("bucket", PLAIN).alias("bucket"), "provider", "model",
        (F.coalesce(F.col("a.calls"), F.lit(0)) + F.coalesce(F.col("b.calls"), F.lit(0))).alias("calls"),
        hist_add("a.hist_latency", "b.hist_latency").alias("hist_latency"),
        hist_add("a.hist_ttft", "b.hist_ttft").alias("hist_ttft"))


@register("histogram_sum_by_model")
def q_histogram_sum_by_model(spark, sf_dir):
    r = rollup_table(spark, sf_dir, dense=True)
    return r.groupBy("provider", "model").agg(hist_sum("hist_latency").alias("hist_latency"),
                                              hist_sum("hist_ttft").alias("hist_ttft"))


@register("histogram_percentiles_by_model")
def q_histogram_percentiles_by_model(spark, sf_dir):
    r = rollup_table(spark, sf_dir, dense=True)
    g = r.groupBy("provider", "model").agg(hist_sum("hist_latency").alias("_h"))
    g = with_percentiles(g, "_h", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return g.select("provider", "model", "p50", "p90", "p95", "p99")


# --- C: pricing -------------------------------------------------------------

@register("price_events")
def q_price_events(spark, sf_dir):
    ev = priced_events(spark, sf_dir, dense=False)
    return ev.select("event_id", "model", "input_tokens", "output_tokens", "cache_read_tokens",
                     F.col("cost_usd").cast("string").alias("cost_usd"), "pricing_version")


@register("pricing_coverage")
def q_pricing_coverage(spark, sf_dir):
    return enrich.pricing_coverage(adapters.inference_events(spark, sf_dir))


# --- E: dashboard -----------------------------------------------------------

def _rng(range_key):
    return adapters.dense_for(range_key), adapters.as_of_for(range_key)


def _since(range_key):
    """Start of the range: the panels read stored events from there on only."""
    minutes, _ = metrics.range_spec(range_key)
    return (datetime.fromisoformat(adapters.as_of_for(range_key)) - timedelta(minutes=minutes)).isoformat(sep=" ")


#: Stored logs of this application: (application, what, tables) -> folder.
_STORES: dict[tuple, str] = {}


def _stored(spark, sf_dir, what, fill) -> str:
    """A folder with the stored log ``what`` of these tables, filled by a load when it is first asked for."""
    from callgauge.streaming import jobs
    key = (spark.sparkContext.applicationId, what, sf_dir)
    if key not in _STORES:
        dst = jobs.scratch(spark, f"store-{what}")
        fill(dst)
        _STORES[key] = dst
    return _STORES[key]


def event_store(spark, sf_dir, dense: bool) -> str:
    """The stored event log and minute rollup of the events table."""
    from callgauge.streaming import jobs
    return _stored(spark, sf_dir, "dense" if dense else "raw",
                   lambda dst: jobs.store_events(spark, adapters.inference_events(spark, sf_dir, dense), dst))


def ingest_store(spark, sf_dir) -> str:
    """What the direct loader stored of the envelopes."""
    from callgauge.streaming import jobs
    return _stored(spark, sf_dir, "ingest", lambda dst: jobs.load_direct(spark, adapters.envelope_lines(spark, sf_dir, narrow=True), dst, 0, now=LOAD_TIME))


def _range_rollup(spark, sf_dir, range_key):
    """The range's buckets of the stored rollup; no event is read."""
    from callgauge.streaming import jobs
    return jobs.read_rollup(spark, event_store(spark, sf_dir, adapters.dense_for(range_key)), _since(range_key))


def _range_events(spark, sf_dir, range_key):
    return adapters.inference_events(spark, sf_dir, adapters.dense_for(range_key), _since(range_key))


def _ts(range_key, model=None):
    def run(spark, sf_dir):
        _, as_of = _rng(range_key)
        return metrics.timeseries(_range_rollup(spark, sf_dir, range_key), range_key, as_of, model)
    return run


for _r in ("15m", "1h", "6h", "24h", "7d"):
    REGISTRY[f"timeseries_{_r}"] = _ts(_r)
REGISTRY["timeseries"] = _ts("6h")
REGISTRY["timeseries_model"] = _ts("6h", "claude-opus-5")


def _tot(range_key, model=None):
    def run(spark, sf_dir):
        _, as_of = _rng(range_key)
        return metrics.totals(_range_rollup(spark, sf_dir, range_key), range_key, as_of, model)
    return run


REGISTRY["totals"] = _tot("6h")
REGISTRY["totals_24h"] = _tot("24h")
REGISTRY["totals_model"] = _tot("6h", "gpt-4.1")


@register("by_model")
def q_by_model(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.by_model(_range_rollup(spark, sf_dir, "6h"), "6h", as_of)


@register("by_error_type")
def q_by_error_type(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.by_error_type(_range_events(spark, sf_dir, "6h"), "6h", as_of)


@register("latency_percentiles_raw")
def q_latency_percentiles_raw(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.latency_percentiles_raw(_range_events(spark, sf_dir, "6h"), "6h", as_of)


@register("ingest_lag")
def q_ingest_lag(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.ingest_lag(_range_events(spark, sf_dir, "6h"), "6h", as_of)


@register("events_by_layer")
def q_events_by_layer(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.events_by_layer(_range_events(spark, sf_dir, "6h"), "6h", as_of)


@register("known_models")
def q_known_models(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.known_models(_range_rollup(spark, sf_dir, "6h"), "6h", as_of)


@register("rollup_vs_raw_gap")
def q_rollup_vs_raw_gap(spark, sf_dir):
    dense, as_of = _rng("6h")
    ev = priced_events(spark, sf_dir, dense, _since("6h"))
    return metrics.rollup_vs_raw_gap(_range_rollup(spark, sf_dir, "6h"), ev, "6h", as_of)


@register("mean_latency_ttft")
def q_mean_latency_ttft(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.mean_latency_ttft(_range_rollup(spark, sf_dir, "6h"), "6h", as_of)


@register("dashboard_bundle")
def q_dashboard_bundle(spark, sf_dir):
    """All panels of one request in long form: panel, item, calls and p95."""
    from callgauge.plans.dashboard import dashboard
    _, as_of = _rng("6h")
    p = dashboard(_range_rollup(spark, sf_dir, "6h"), _range_events(spark, sf_dir, "6h"), _dlq(spark, sf_dir), "6h", as_of)

    def long(name, item, calls="CAST(NULL AS BIGINT)", p95="CAST(NULL AS BIGINT)"):
        return p[name].selectExpr(f"'{name}' AS panel", f"{item} AS item", f"CAST({calls} AS BIGINT) AS calls", f"CAST({p95} AS BIGINT) AS p95")
    parts = [long("timeseries", "bucket", "calls", "p95"), long("totals", "'all'", "calls", "p95"),
             long("by_model", "concat(provider, ' ', model)", "calls", "p95"), long("by_error_type", "error_type", "count"),
             long("ingest_health", "'median lag'", "median_lag_ms"), long("ingest_health", "'dead letters'", "dlq_pending"),
             long("known_models", "model"), long("latency_percentiles_raw", "'all'", "samples", "floor(p95)")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# --- C: redaction -----------------------------------------------------------

@register("redact_text")
def q_redact_text(spark, sf_dir):
    return redaction.redact_text(adapters.redaction_input(spark, sf_dir))


@register("card_audit")
def q_card_audit(spark, sf_dir):
    return redaction.card_audit(adapters.redaction_input(spark, sf_dir))


@register("ssn_audit")
def q_ssn_audit(spark, sf_dir):
    return redaction.ssn_audit(adapters.redaction_input(spark, sf_dir))


@register("preview_text")
def q_preview_text(spark, sf_dir):
    return redaction.preview_text(adapters.redaction_input(spark, sf_dir))


@register("redaction_by_kind")
def q_redaction_by_kind(spark, sf_dir):
    return redaction.redaction_by_kind(redaction.redact_text(adapters.redaction_input(spark, sf_dir)))


@register("redaction_second_pass")
def q_redaction_second_pass(spark, sf_dir):
    """Each assistant turn as one call: the preceding user turn is its input,
    the assistant text its output."""
    conv = read_table(spark, sf_dir, "conversations")
    a = conv.filter("role = 'assistant'").alias("a")
    u = conv.select("conv_id", "turn", "text").alias("u")
    pairs = a.join(u, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("u.turn") == F.col("a.turn") - 1),
                   "left").select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
                                  F.col("u.text").alias("input_text"), F.col("a.text").alias("output_text"),
                                  F.lit(0).alias("redaction_hits"))
    return redaction.redaction_second_pass(pairs, "both").select(
        "conv_id", "turn", "input_preview", "output_preview", "redaction_hits")


# --- A/B: envelopes, validation, quarantine -----------------------------------

LOAD_TIME = "2024-02-01 00:00:00"


def _envelopes(spark, sf_dir):
    return validate.validate_envelopes(adapters.envelope_lines(spark, sf_dir))


def _checked(spark, sf_dir):
    return validate.validate_events(validate.explode_envelopes(_envelopes(spark, sf_dir)))


@register("envelope_explode")
def q_envelope_explode(spark, sf_dir):
    ev = validate.explode_envelopes(_envelopes(spark, sf_dir))
    return ev.selectExpr("batch_id", "position",
                         "try_variant_get(event, '$.eventId', 'string') AS event_id",
                         "sdk_name", "sdk_version", "sdk_runtime", "CAST(dropped AS BIGINT) AS dropped")


@register("validate_envelope")
def q_validate_envelope(spark, sf_dir):
    return _envelopes(spark, sf_dir).select(
        "batch_id", F.expr("size(envelope_reasons) = 0").alias("valid"),
        validate.reason_paths("envelope_reasons").alias("reason_paths"))


@register("validate_event_fields")
def q_validate_event_fields(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "batch_id", "position", "event_id", F.expr("size(reasons) = 0").alias("valid"),
        validate.reason_paths("reasons").alias("reason_paths"))


@register("strict_unknown_keys")
def q_strict_unknown_keys(spark, sf_dir):
    return validate.rows_where(_checked(spark, sf_dir), "size(unknown_keys) > 0").select(
        "batch_id", "position", "unknown_keys")


@register("cross_field_rules")
def q_cross_field_rules(spark, sf_dir):
    return validate.rows_where(_checked(spark, sf_dir), "size(cross_reasons) > 0").select(
        "batch_id", "position", validate.reason_paths("cross_reasons").alias("reason_paths"))


def _typed(spark, sf_dir):
    ok = validate.rows_where(_checked(spark, sf_dir), "size(reasons) = 0")
    return validate.typed_events(ok, ingested_at=LOAD_TIME)


@register("typed_event_scan")
def q_typed_event_scan(spark, sf_dir):
    t = _typed(spark, sf_dir)
    return t.selectExpr(
        "event_id", "date_format(created_at, 'yyyy-MM-dd HH:mm:ss.SSS') AS created_at", "session_id",
        "user_id", "provider", "model", "status", "error_type", "error_message", "latency_ms", "ttft_ms",
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "sdk_version")


@register("apply_defaults")
def q_apply_defaults(spark, sf_dir):
    t = _typed(spark, sf_dir)
    return t.select("event_id", "operation", "streamed", "captured_by", "redaction_hits", "schema_version")


@register("to_event_row")
def q_to_event_row(spark, sf_dir):
    t = enrich.price_events(_typed(spark, sf_dir))
    return t.selectExpr("event_id", "date_format(created_at, 'yyyy-MM-dd HH:mm:ss.SSS') AS created_at",
                        "created_at = client_ts AS client_ts_is_start", "model",
                        "CAST(cost_usd AS STRING) AS cost_usd", "pricing_version", "sdk_version")


def _lines_with_copies(spark, sf_dir):
    """The envelopes, those with batch_id % 5 = 0 delivered twice, verbatim."""
    lines = adapters.envelope_lines(spark, sf_dir)
    return lines.unionByName(lines.filter("batch_id % 5 = 0"))


def _dlq(spark, sf_dir):
    return validate.quarantine_all(validate.validate_events(validate.explode_all(_envelopes(spark, sf_dir))), now=LOAD_TIME)


@register("quarantine_split")
def q_quarantine_split(spark, sf_dir):
    return _dlq(spark, sf_dir).select("dlq_id", "stage", "event_id",
                                      validate.reason_paths("reasons").alias("reason_paths"))


@register("dlq_by_sdk")
def q_dlq_by_sdk(spark, sf_dir):
    d = _dlq(spark, sf_dir).select("sdk_version", "stage", F.explode(validate.reason_paths("reasons")).alias("path"))
    return d.groupBy("sdk_version", "stage", "path").agg(F.count(F.lit(1)).alias("rows"))


@register("client_loss")
def q_client_loss(spark, sf_dir):
    e = validate.rows_where(_envelopes(spark, sf_dir), "dropped > 0 AND NOT isnan(dropped)")
    return e.groupBy("sdk_name", "sdk_version").agg(
        F.expr("CAST(sum(dropped) AS BIGINT)").alias("dropped_events"), F.count(F.lit(1)).alias("batches"))


@register("ingest_ack")
def q_ingest_ack(spark, sf_dir):
    """Acknowledgements of a first load (no prior log) in which every fifth
    envelope comes twice; errors as text, once a delivery: event id and reason paths."""
    a = ingest.acks(_lines_with_copies(spark, sf_dir), now=LOAD_TIME, with_errors=True)
    return a.withColumn("errors", F.expr("flatten(transform(errors, e -> array_repeat(concat(coalesce(e.event_id, ''), ' ', array_join(e.paths, ',')), CAST(e.copies AS INT))))"))


# --- F: conversations -------------------------------------------------------

def _msgs(spark, sf_dir, placeholders=True):
    return adapters.messages(spark, sf_dir, placeholders)


def _convs(spark, sf_dir):
    return adapters.conversation_table(spark, sf_dir)


@register("assign_seq")
def q_assign_seq(spark, sf_dir):
    """Turns 0-3 are stored; later turns arrive in time order and get seq."""
    m = _msgs(spark, sf_dir, placeholders=False)
    existing = m.filter("seq <= 4")
    new = m.filter("seq > 4").withColumnRenamed("seq", "original_seq")
    return chat.assign_seq(existing, new, ("created_at", "original_seq")).select(
        "conversation_id", "original_seq", "seq")


@register("conversation_counters")
def q_conversation_counters(spark, sf_dir):
    c = chat.conversation_counters(_msgs(spark, sf_dir))
    return c.select("conversation_id", "message_count", fmt("last_message_at", PLAIN).alias("last_message_at"))


@register("list_conversations")
def q_list_conversations(spark, sf_dir):
    r = chat.list_conversations(_convs(spark, sf_dir), _msgs(spark, sf_dir))
    return r.select("id", "user_id", "status", "message_count",
                    fmt("last_message_at", PLAIN).alias("last_message_at"))


@register("list_conversations_user")
def q_list_conversations_user(spark, sf_dir):
    r = chat.list_conversations(_convs(spark, sf_dir), _msgs(spark, sf_dir), user_id="3",
                                before="2024-01-01 01:00:00", limit=500)
    return r.select("id", "user_id", "status", "message_count",
                    fmt("last_message_at", PLAIN).alias("last_message_at"))


@register("replay_messages")
def q_replay_messages(spark, sf_dir):
    r = chat.replay_messages(_msgs(spark, sf_dir))
    return r.select("conversation_id", "seq", "role", F.length("content").alias("chars"))


@register("context_window")
def q_context_window(spark, sf_dir):
    return chat.context_window_summary(chat.context_window(_msgs(spark, sf_dir), token_budget=400))


@register("context_window_rows")
def q_context_window_rows(spark, sf_dir):
    w = chat.context_window(_msgs(spark, sf_dir), token_budget=400)
    return w.filter("kept").select("conversation_id", "seq", "role")


@register("derive_title")
def q_derive_title(spark, sf_dir):
    return chat.derive_titles(_convs(spark, sf_dir), _msgs(spark, sf_dir)).select("id", "title")


def _completions(m):
    return m.filter("NOT is_complete").selectExpr(
        "conversation_id", "seq", "concat('reply to conversation ', CAST(conversation_id AS STRING)) AS content",
        "CAST(conversation_id % 50 + 1 AS INT) AS token_count")


@register("complete_messages")
def q_complete_messages(spark, sf_dir):
    m = _msgs(spark, sf_dir)
    r = chat.complete_messages(m, _completions(m))
    return r.select("conversation_id", "seq", "role", "is_complete", "token_count", F.length("content").alias("chars"))


@register("set_status")
def q_set_status(spark, sf_dir):
    c = _convs(spark, sf_dir)
    changes = c.filter("id % 5 = 0").selectExpr("id", "IF(status = 'active', 'archived', 'active') AS status")
    return chat.set_status(c, changes).select("id", "status")


@register("delete_conversations")
def q_delete_conversations(spark, sf_dir):
    c = _convs(spark, sf_dir)
    gone = c.filter("status = 'deleted'").select("id")
    kept, ev = chat.delete_conversations(_msgs(spark, sf_dir), adapters.inference_events(spark, sf_dir), gone)
    k = kept.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))
    e = ev.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("events"))
    return k.join(e, "conversation_id", "full_outer")


@register("erase_conversations")
def q_erase_conversations(spark, sf_dir):
    c = _convs(spark, sf_dir)
    ids = c.filter("status = 'deleted'").select("id")
    _, _, _, counts = chat.erase_conversations(c, _msgs(spark, sf_dir), adapters.inference_events(spark, sf_dir), ids)
    return counts


@register("conversation_summary")
def q_conversation_summary(spark, sf_dir):
    ev = priced_events(spark, sf_dir, dense=False)
    s = chat.conversation_summary(_convs(spark, sf_dir), ev)
    return s.select("id", "status", F.col("total_cost_usd").cast("decimal(24,8)").cast("string").alias("total_cost_usd"),
                    "total_tokens", "error_count")


@register("slow_call_drilldown")
def q_slow_call_drilldown(spark, sf_dir):
    d = chat.slow_call_drilldown(adapters.inference_events(spark, sf_dir), _msgs(spark, sf_dir), k=20)
    return d.select("event_id", "latency_ms", "conversation_id", "message_turn", "message_role",
                    F.length("message_content").alias("message_chars"), F.length("user_prompt").alias("prompt_chars"))


# --- D1 / G8: de-duplication and replay ------------------------------------

@register("dedup_events")
def q_dedup_events(spark, sf_dir):
    ev = adapters.inference_events(spark, sf_dir)
    batch = adapters.replay_input(ev)
    return rollup.dedup_new(batch).select("event_id", fmt("created_at", PLAIN_US).alias("created_at"))


@register("dedup_counts")
def q_dedup_counts(spark, sf_dir):
    ev = adapters.inference_events(spark, sf_dir)
    batch = adapters.replay_input(ev)
    return rollup.dedup_counts(batch, rollup.dedup_new(batch))


@register("replay_idempotence")
def q_replay_idempotence(spark, sf_dir):
    """First delivery, then a verbatim replay against the stored log: the replay
    inserts nothing, so the merged rollup equals the first one."""
    ev = priced_events(spark, sf_dir, dense=True)
    first = rollup.dedup_new(ev)
    replay = rollup.dedup_new(adapters.replay_input(ev), log=first)
    return _rollup_out(rollup.rollup_merge(rollup.rollup_1m(first), rollup.rollup_1m(replay)))


@register("ingest_health")
def q_ingest_health(spark, sf_dir):
    _, as_of = _rng("6h")
    return metrics.ingest_health(_range_events(spark, sf_dir, "6h"), _dlq(spark, sf_dir), "6h", as_of)


@register("dlq_pending")
def q_dlq_pending(spark, sf_dir):
    return dlq_ops.dlq_pending(_dlq(spark, sf_dir), 100).select("dlq_id", "stage", "event_id")


# --- C11-C17: errors, payload flattening, spans -------------------------------

@register("classify_error")
def q_classify_error(spark, sf_dir):
    return errors.classify_errors(adapters.error_log(spark, sf_dir)).select(
        "event_id", "provider", "error_name", "http_status", "error_type")


@register("normalise_provider_error")
def q_normalise_provider_error(spark, sf_dir):
    return errors.normalise_errors(adapters.error_log(spark, sf_dir)).select(
        "event_id", "provider", "error_type", "retryable")


@register("retryable_flag")
def q_retryable_flag(spark, sf_dir):
    ev = adapters.inference_events(spark, sf_dir).filter("status = 'error'")
    return errors.with_retryable(ev.withColumn("error_type", F.expr("coalesce(error_type, 'unknown')"))).select(
        "event_id", "error_type", "retryable")


@register("flatten_request")
def q_flatten_request(spark, sf_dir):
    r = spans.flatten_requests(adapters.request_log(spark, sf_dir))
    return r.select("call_id", "model", "streamed", "max_tokens", "temperature", "message_count",
                    F.length("input_text").alias("input_chars"),
                    F.sha2("input_text", 256).alias("input_sha256"))


@register("flatten_response")
def q_flatten_response(spark, sf_dir):
    r = spans.flatten_responses(adapters.response_log(spark, sf_dir))
    return r.select("call_id", F.length("text").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"),
                    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "finish_reason")


@register("parse_chunk")
def q_parse_chunk(spark, sf_dir):
    p = spans.parse_chunks(adapters.chunk_log(spark, sf_dir).filter("kind = 'chunk'"))
    return p.select("call_id", "seq", F.length("text").alias("text_chars"), "input_tokens", "output_tokens",
                    "cache_read_tokens", "finish_reason")


@register("assemble_spans")
def q_assemble_spans(spark, sf_dir):
    s = spans.assemble_spans(spans.parse_chunks(adapters.chunk_log(spark, sf_dir)))
    return s.select("call_id", "status", "error_type", "latency_ms", "ttft_ms", "input_tokens", "output_tokens",
                    "cache_read_tokens", "finish_reason", F.length("output_text").alias("text_chars"),
                    "tokens_per_sec")


# --- G: streaming -------------------------------------------------------------

@register("stream_rollup")
def q_stream_rollup(spark, sf_dir):
    """Minute rollup maintained by a stream, drained with availableNow; equals
    the batch rollup."""
    from callgauge.streaming import jobs
    ev = adapters.events_to_inference(jobs.events_stream(spark, sf_dir), dense=True)
    return _rollup_out(jobs.stream_rollup(ev))


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    """At-least-once delivery (every tenth event twice) arriving as many files
    in no order of time, several micro-batches: each event counts once, however
    late it comes."""
    from callgauge.streaming import jobs
    src = jobs.scratch(spark, "stream-dedup-src")
    ev = adapters.replay_input(adapters.inference_events(spark, sf_dir, dense=True))
    ev.repartition(12, F.xxhash64("event_id", "redaction_hits")).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(src)
    return _rollup_out(jobs.stream_rollup(stream, "stream-dedup"))


def _write_lines(spark, sf_dir, name, parts=24):
    """The lines as compressed files: each is read by one task, so a micro-batch takes several."""
    from callgauge.streaming import jobs
    src = jobs.scratch(spark, name)
    _lines_with_copies(spark, sf_dir).select("body").repartition(parts).write.option("compression", "gzip").text(src)
    return src


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Queue drain: envelope files (some envelopes twice) -> foreachBatch ingest
    (in four micro-batches); returns all that was stored: events, rollup
    buckets with their calls, and dead letters with their attempts."""
    from callgauge.streaming import jobs
    src = _write_lines(spark, sf_dir, "stream-ingest-src")
    dst = jobs.scratch(spark, "stream-ingest-dst")
    jobs.drained(jobs.start_ingest(spark, src, dst, f"{dst}/_checkpoint", max_files=6, now=LOAD_TIME))
    log = jobs.read_events(spark, dst).selectExpr(
        "'event' AS kind", "event_id AS key", "date_format(created_at, 'yyyy-MM-dd HH:mm:ss.SSS') AS detail", "1L AS n")
    roll = jobs.read_rollup(spark, dst).select(
        F.lit("rollup").alias("kind"), F.concat_ws(" ", "provider", "model").alias("key"), fmt("bucket", PLAIN).alias("detail"), F.col("calls").alias("n"))
    dlq = jobs.read_dlq(spark, dst).select(
        F.lit("dlq").alias("kind"), F.coalesce("event_id", F.lit("")).alias("key"),
        F.concat(F.col("stage"), F.lit(" "), F.array_join(validate.reason_paths("reasons"), ",")).alias("detail"), F.col("attempts").cast("bigint").alias("n"))
    return log.unionByName(roll).unionByName(dlq).groupBy("kind", "key", "detail").agg(F.sum("n").alias("n"))


@register("stream_spans")
def q_stream_spans(spark, sf_dir):
    """Span assembly on a live chunk stream: the chunks of a call come in several
    micro-batches and in no order."""
    from callgauge.streaming import jobs
    src = jobs.scratch(spark, "stream-spans-src")
    chunks = adapters.chunk_log(spark, sf_dir)
    chunks.repartition(36, F.xxhash64("call_id", "seq")).write.parquet(src)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 12).parquet(src)
    t = jobs.stream_spans(stream)
    return t.select("call_id", "status", "error_type", "latency_ms", "ttft_ms", "input_tokens", "output_tokens",
                    "cache_read_tokens", "finish_reason", F.length("output_text").alias("text_chars"),
                    "tokens_per_sec")


# --- A: event log sink and scans ----------------------------------------------

#: Events of one load in the log queries.
LOAD_EVENTS = 20_000


@register("event_log_sink")
def q_event_log_sink(spark, sf_dir):
    """Write the log partitioned by (event_month, load), read the layout back."""
    from callgauge.streaming import jobs
    path = jobs.scratch(spark, "event-log")
    ev = adapters.inference_events(spark, sf_dir).withColumn(
        "batch_id", F.expr(f"CAST(event_id AS BIGINT) div {LOAD_EVENTS}"))
    eventlog.write_event_log(ev, path)
    log = spark.read.parquet(path)
    return log.groupBy("event_month", "batch_id").agg(F.count(F.lit(1)).alias("rows"))


@register("overflow_routing")
def q_overflow_routing(spark, sf_dir):
    """Rows routed by the month of their own time against the provisioned
    partitions (Jan 2024 only): events of clients with far-off clocks land in
    'overflow'."""
    ev = adapters.with_far_clocks(adapters.inference_events(spark, sf_dir))
    r = eventlog.route_overflow(ev, ["2024-01"])
    return r.groupBy("event_month").agg(F.count(F.lit(1)).alias("rows"))


@register("retention_prune")
def q_retention_prune(spark, sf_dir):
    ev = priced_events(spark, sf_dir, dense=False)
    return eventlog.retention_plan(ev, rollup.rollup_1m(ev), _dlq(spark, sf_dir), "2024-04-20 00:00:00")


@register("time_range_scan")
def q_time_range_scan(spark, sf_dir):
    """Last 7 days before the raw as-of, read from the partitioned log."""
    from callgauge.streaming import jobs
    path = jobs.scratch(spark, "event-log-scan")
    ev = adapters.inference_events(spark, sf_dir).withColumn(
        "batch_id", F.expr(f"CAST(event_id AS BIGINT) div {LOAD_EVENTS}"))
    eventlog.write_event_log(ev, path)
    r = eventlog.scan_range(spark, path, adapters.RAW_AS_OF, 7 * 24 * 60)
    return r.selectExpr("event_id", "date_format(created_at, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS created_at")


@register("sink_select")
def q_sink_select(spark, sf_dir):
    """The same envelopes, some of them twice, through both real loaders: the
    direct sink (one load) and the deferred one (files drained by the stream);
    what each stored and answered."""
    from callgauge.streaming import jobs
    direct, queued = jobs.scratch(spark, "sink-direct"), jobs.scratch(spark, "sink-queue")
    jobs.load_direct(spark, _lines_with_copies(spark, sf_dir), direct, 0, now=LOAD_TIME)
    src = _write_lines(spark, sf_dir, "sink-queue-src")
    jobs.drained(jobs.start_ingest(spark, src, queued, f"{queued}/_checkpoint", max_files=12, now=LOAD_TIME))

    def answered(dst, sink):
        return jobs.read_acks(spark, dst).agg(
            F.lit(sink).alias("sink"), F.sum("accepted").alias("accepted"), F.sum("duplicates").alias("duplicates"),
            F.sum("rejected").alias("rejected"))
    return answered(direct, "direct").unionByName(answered(queued, "queue"))


# --- G4-G10: queue, arrival, batching -------------------------------------------

@register("poison_route")
def q_poison_route(spark, sf_dir):
    r = queue.route_poison(adapters.queue_log(spark, sf_dir))
    return r.select("msg_id", "read_ct", fmt("enqueued_at", PLAIN).alias("enqueued_at"), "events")


@register("queue_health")
def q_queue_health(spark, sf_dir):
    return queue.queue_health(adapters.queue_log(spark, sf_dir), adapters.DENSE_AS_OF)


@register("late_and_skewed")
def q_late_and_skewed(spark, sf_dir):
    return queue.late_and_skewed(adapters.inference_events(spark, sf_dir), ["2024-01"], watermark_ms=2000)


@register("micro_batches")
def q_micro_batches(spark, sf_dir):
    return queue.micro_batches(adapters.inference_events(spark, sf_dir))


@register("buffer_overflow_loss")
def q_buffer_overflow_loss(spark, sf_dir):
    return queue.buffer_loss(adapters.inference_events(spark, sf_dir))


# --- H: audits --------------------------------------------------------------------

@register("rollup_reconcile")
def q_rollup_reconcile(spark, sf_dir):
    """Stored rollup = what the ingest path stored (rejected events missing);
    raw = the event table; one day reconciled."""
    from callgauge.streaming import jobs
    stored = jobs.read_rollup(spark, ingest_store(spark, sf_dir), "2024-01-15 00:00:00")
    raw = priced_events(spark, sf_dir, dense=False, since="2024-01-15 00:00:00")
    r = audit.reconcile(stored, raw, "2024-01-15")
    return r.select(fmt("bucket", PLAIN).alias("bucket"), "provider", "model", "stored_calls", "raw_calls",
                    "stored_sum_latency_ms", "raw_sum_latency_ms", "max_rel_drift", "drifted")


@register("clock_skew")
def q_clock_skew(spark, sf_dir):
    r = audit.clock_skew(adapters.inference_events(spark, sf_dir))
    return r.select("event_id", "skew_ms", fmt("ingested_at", PLAIN_US).alias("ingested_at"))


@register("reprice_audit")
def q_reprice_audit(spark, sf_dir):
    from decimal import Decimal
    r = audit.reprice(adapters.inference_events(spark, sf_dir), input_scale_b=Decimal("1.1"))
    return r.selectExpr("model", "calls", "CAST(CAST(cost_a AS DECIMAL(24,8)) AS STRING) AS cost_a",
                        "CAST(CAST(cost_b AS DECIMAL(24,8)) AS STRING) AS cost_b",
                        "CAST(CAST(diff AS DECIMAL(24,8)) AS STRING) AS diff")


@register("id_order_check")
def q_id_order_check(spark, sf_dir):
    """Wire ids (zero-padded) must increase with the call start time."""
    ev = adapters.inference_events(spark, sf_dir).withColumn(
        "wire_id", F.expr("concat('00000000-0000-7000-8000-', lpad(event_id, 12, '0'))"))
    return audit.id_order_check(ev, "wire_id", ("created_at", "event_id"))


@register("keep_sample")
def q_keep_sample(spark, sf_dir):
    r = audit.keep_sample(adapters.inference_events(spark, sf_dir), n=10, slow_ms=5000)
    return r.select("event_id", "sampled", "forced")


@register("capture_layer_proof")
def q_capture_layer_proof(spark, sf_dir):
    gone = _convs(spark, sf_dir).filter("status = 'deleted'").select("id")
    _, ev = chat.delete_conversations(_msgs(spark, sf_dir), adapters.inference_events(spark, sf_dir), gone)
    return audit.capture_layers(ev)


# --- B9 / B10 ---------------------------------------------------------------------

def _item(dlq_id="dlq_id"):
    """A stored dead letter's name without its envelope's hash, as the fixture's oracle gives it."""
    return F.regexp_replace(dlq_id, "-[0-9a-f]{32}$", "")


@register("dlq_replay")
def q_dlq_replay(spark, sf_dir):
    """Re-drive all pending dead letters of the stored log; the outcome of each."""
    from callgauge.streaming import jobs
    dst = jobs.scratch(spark, "dlq-replay")
    jobs.load_direct(spark, adapters.envelope_lines(spark, sf_dir, narrow=True), dst, 0, now=LOAD_TIME)
    jobs.replay_dlq(spark, dst, 0, "2024-02-02 00:00:00")
    return jobs.read_acks(spark, dst).where("source = 'replay'").select(
        _item("batch_id").alias("dlq_id"), "accepted", "duplicates", (F.col("accepted") + F.col("duplicates") > 0).alias("replayed"))


#: The price list with one row that has no valid rates.
BAD_PRICES = [(m, "n/a", *rest) if m == "claude-haiku-4-5" else (m, i, *rest) for m, i, *rest in PRICES]


@register("quarantine_enrich")
def q_quarantine_enrich(spark, sf_dir):
    """A load with one bad row in the price list: what is parked, by stage. Only the events of
    that row's model are, besides the malformed ones."""
    from callgauge.streaming import jobs
    dst = jobs.scratch(spark, "quarantine-enrich")
    jobs.load_direct(spark, adapters.envelope_lines(spark, sf_dir, narrow=True), dst, 0, now=LOAD_TIME, prices=BAD_PRICES)
    return jobs.read_dlq(spark, dst).select(_item().alias("dlq_id"), "stage", "event_id", validate.reason_paths("reasons").alias("reason_paths"))


@register("dlq_replay_stored")
def q_dlq_replay_stored(spark, sf_dir):
    """The same load, then two replays through the store with the right price list: per stage the
    items and those still pending; and what the loads and replays inserted."""
    from callgauge.streaming import jobs
    dst = jobs.scratch(spark, "dlq-replay-stored")
    jobs.load_direct(spark, adapters.envelope_lines(spark, sf_dir, narrow=True), dst, 0, now=LOAD_TIME, prices=BAD_PRICES)
    for k, now in enumerate(("2024-02-02 00:00:00", "2024-02-03 00:00:00")):
        jobs.replay_dlq(spark, dst, k, now)
    items = jobs.read_dlq(spark, dst).groupBy(F.col("stage").alias("what")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("replayed_at").isNull()).alias("pending"))
    events = jobs.read_events(spark, dst).groupBy(F.concat_ws(" ", F.lit("events of"), "source", "epoch").alias("what")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("pending"))
    calls = jobs.read_rollup(spark, dst).agg(F.lit("rollup calls").alias("what"), F.sum("calls").alias("rows"), F.lit(0).cast("bigint").alias("pending"))
    return items.unionByName(events).unionByName(calls)


def _conversation_store(spark, sf_dir, name):
    """The events, with previews, stored as three loads by conversation."""
    from callgauge.streaming import jobs
    dst = jobs.scratch(spark, name)
    ev = adapters.inference_events(spark, sf_dir).withColumns({"input_preview": F.concat(F.lit("asked "), "event_id"), "output_preview": F.concat(F.lit("told "), "event_id"),
                                                               "message_id": F.concat_ws("-", "conversation_id", "message_turn")})
    for k in range(3):
        jobs.store_events(spark, ev.where(F.col("conversation_id") % 3 == k), dst, k)
    return dst


def _log_state(spark, dst):
    from callgauge.streaming import jobs
    log = jobs.read_events(spark, dst).groupBy("event_month").agg(
        F.count(F.lit(1)).alias("events"), F.count("input_preview").alias("previews"), F.count("user_id").alias("users"), F.count("conversation_id").alias("references"),
        F.sum("latency_ms").cast("bigint").alias("sum_latency_ms"))
    calls = jobs.read_rollup(spark, dst).groupBy(F.date_format("bucket", "yyyy-MM").alias("event_month")).agg(F.sum("calls").alias("rollup_calls"))
    return log.join(calls, "event_month", "full")


@register("erase_stored")
def q_erase_stored(spark, sf_dir):
    """Erasure in the stored log: what deleted conversations said is gone, numbers and rollup stay."""
    from callgauge.sources import loads
    dst = _conversation_store(spark, sf_dir, "erase-stored")
    loads.erase_conversations(spark, dst, _convs(spark, sf_dir).filter("status = 'deleted'").select("id"))
    return _log_state(spark, dst)


@register("delete_stored")
def q_delete_stored(spark, sf_dir):
    """Deletion in the stored log: events of deleted conversations keep everything but the reference."""
    from callgauge.sources import loads
    dst = _conversation_store(spark, sf_dir, "delete-stored")
    loads.delete_conversations(spark, dst, _convs(spark, sf_dir).filter("status = 'deleted'").select("id"))
    return _log_state(spark, dst)


@register("retention_drop")
def q_retention_drop(spark, sf_dir):
    """Retention on the stored log, run twice: the partitions that are left and their rows, as the
    manifest says and as the files hold."""
    from callgauge.sources import loads
    from callgauge.streaming import jobs
    dst = jobs.scratch(spark, "retention-drop")
    jobs.store_events(spark, adapters.with_far_clocks(adapters.inference_events(spark, sf_dir)), dst)
    jobs.load_direct(spark, adapters.envelope_lines(spark, sf_dir, narrow=True).where("batch_id % 53 = 1"), dst, 0, now=LOAD_TIME)  # rejected envelopes only
    for _ in range(2):
        loads.drop_expired(spark, dst, RETENTION_AS_OF)
    noted = loads.live_parts(spark, dst).where(F.col("table_name").isin(*loads.AGING)).groupBy("table_name", "part").agg(F.sum("rows").alias("rows"))
    held = None
    for table, column in loads.PARTS.items():
        rows = loads.read_table(spark, dst, table)
        if rows is not None:
            rows = rows.groupBy(F.col(column).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("held")).withColumn("table_name", F.lit(table))
            held = rows if held is None else held.unionByName(rows)
    return noted.join(held, ["table_name", "part"], "full").select("table_name", "part", "rows", "held")


#: By then January's events, and the dead letters of the load, are behind their retention; the rollup isn't.
RETENTION_AS_OF = "2024-05-02 00:00:00"


@register("orphan_refs")
def q_orphan_refs(spark, sf_dir):
    o = dlq_ops.orphan_refs(adapters.inference_events(spark, sf_dir), _convs(spark, sf_dir), _msgs(spark, sf_dir))
    return o.groupBy("orphan_conversation", "orphan_message").agg(F.count(F.lit(1)).alias("events"))


# --- SQL API ------------------------------------------------------------------

@register("sql_model_percentiles")
def q_sql_model_percentiles(spark, sf_dir):
    """The per-model latency percentiles written as plain Spark SQL with the
    SQL-bodied functions (same result as histogram_percentiles_by_model)."""
    from callgauge.functions import sql_functions
    sql_functions.register(spark)
    ev = adapters.inference_events(spark, sf_dir, dense=True)
    view = f"cg_events_{abs(hash(sf_dir)) % 10**8}"
    ev.createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH e AS (
          SELECT date_trunc('minute', created_at) AS bucket, provider, model,
                 latency_histogram_of(latency_ms) AS one_hot
          FROM {view}),
        r AS (
          SELECT bucket, provider, model, {sql_functions.hist_sum_sql('one_hot')} AS h
          FROM e GROUP BY 1, 2, 3),
        m AS (SELECT provider, model, {sql_functions.hist_sum_sql('h')} AS h FROM r GROUP BY provider, model)
        SELECT provider, model, histogram_percentile(h, 0.5) AS p50, histogram_percentile(h, 0.9) AS p90,
               histogram_percentile(h, 0.95) AS p95, histogram_percentile(h, 0.99) AS p99
        FROM m""")


@register("sql_call_cost")
def q_sql_call_cost(spark, sf_dir):
    """Per-model cost in plain Spark SQL with ``llm_call_cost`` and ``normalise_model``."""
    from callgauge.functions import sql_functions
    sql_functions.register(spark)
    view = f"cg_events_raw_{abs(hash(sf_dir)) % 10**8}"
    adapters.inference_events(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"""
        SELECT model, normalise_model(model) AS normalised_model, count(*) AS calls,
               CAST(CAST(coalesce(sum(llm_call_cost(model, input_tokens, output_tokens, cache_write_tokens,
                                                    cache_read_tokens)), 0) AS DECIMAL(24,8)) AS STRING) AS cost_usd
        FROM {view} GROUP BY model""")


@register("dlq_attempts")
def q_dlq_attempts(spark, sf_dir):
    """The same envelopes delivered twice: every parked item is counted once
    with attempts = 2 (first and last seen from the two loads)."""
    from callgauge.streaming import jobs
    dst = jobs.scratch(spark, "dlq-attempts")
    for k, now in enumerate((LOAD_TIME, "2024-02-01 00:10:00")):
        jobs.load_direct(spark, adapters.envelope_lines(spark, sf_dir, narrow=True), dst, k, now=now)
    return jobs.read_dlq(spark, dst).select(
        _item().alias("dlq_id"), "stage", "event_id", "attempts", fmt("first_seen_at", PLAIN).alias("first_seen_at"), fmt("last_seen_at", PLAIN).alias("last_seen_at"))
