"""Batch ingest: envelopes -> validated, priced, redacted, de-duplicated event
rows + rollup delta + per-batch acknowledgement + dead letters.

One pass produces a *flagged* row set — one row per event of an accepted
envelope plus one row per rejected envelope — carrying the envelope verdict,
the event verdict and whether the row is the first delivery of its
(event_id, created_at). Every output (ack, inserted rows, rollup delta, DLQ)
is a projection or aggregate of that row set, so validation runs once. A row has the text of its
envelope only if that was rejected, and its own JSON only if it is not valid. The
same function backs the batch loader and the streaming ``foreachBatch`` sink.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import PRICES
from callgauge.operators import enrich, redaction, rollup, validate
from callgauge.sources.eventlog import OVERFLOW

EVENT_LOG_COLUMNS = [
    "event_id", "created_at", "conversation_id", "message_id", "session_id", "user_id", "provider", "model",
    "operation", "streamed", "captured_by", "status", "finish_reason", "error_type", "error_message",
    "latency_ms", "ttft_ms", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "cost_usd", "pricing_version", "temperature", "max_tokens", "message_count", "input_preview",
    "output_preview", "redaction_hits", "client_ts", "ingested_at", "sdk_version", "schema_version",
    "attributes", "batch_id", "position",
]


@dataclass
class IngestResult:
    flagged: DataFrame       # one row per event / rejected envelope, with verdicts
    inserted: DataFrame      # new event rows (event-log schema)
    rollup_delta: DataFrame  # rollup rows of the inserted events only
    ack: DataFrame           # one row per batch
    dlq: DataFrame           # dead-lettered envelopes and events


def _checked(lines: DataFrame, now: str | None, prices=PRICES) -> DataFrame:
    """One row per event of an accepted envelope and one per rejected envelope, validated, typed
    and priced. An event that is well-formed but can't be priced has an ``enrich_error`` and is
    not ``valid``: it alone is parked, and the job goes on."""
    rows = validate.validate_events(validate.explode_all(validate.validate_envelopes(lines)))
    typed = validate.typed_events(rows, ingested_at=now, keep=True)
    typed = typed.withColumn("well_formed", F.expr("envelope_ok AND event IS NOT NULL AND size(reasons) = 0"))
    priced = enrich.try_price_events(typed, prices)
    priced = priced.withColumn("enrich_error", F.when(F.col("well_formed"), F.col("enrich_error")))
    priced = priced.withColumn("valid", F.col("well_formed") & F.col("enrich_error").isNull())
    return priced.withColumn("raw", F.expr("IF(valid, NULL, to_json(event))"))  # the JSON is for the dead letters only


DELIVERY = ["batch_id", "position", "_line"]


def _delivery():
    """DELIVERY as a struct of the same order; the hash as bytes, half as long as its text."""
    return F.struct("batch_id", "position", F.unhex("_line").alias("_line"))


def _log_keys(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of ``log``, read only from the months in which ``rows`` (valid events) fall: a
    semi-join on the partition column lets dynamic partition pruning skip the rest."""
    key = rollup.DEDUP_KEY
    if "event_month" not in log.columns:
        return log.select(*key)
    months = rows.select(F.date_format("created_at", "yyyy-MM").alias("event_month")).distinct()
    # rows of months without a partition of their own are stored under the overflow name
    months = months.unionByName(months.select(F.lit(OVERFLOW).alias("event_month")).distinct())
    return log.select(*key, "event_month").join(months, "event_month", "left_semi").select(*key)


def checked_rows(lines: DataFrame, now: str | None = None, prices=PRICES, text_ids: bool = False) -> DataFrame:
    """The validated rows of a load. Verbatim copies of an envelope become one,
    with their number in ``copies`` (a partial aggregate; nothing depends on
    the order or the partitioning of the lines). ``text_ids`` gives batch_id as text: behind the
    aggregate, so that lines which lie together by batch_id are not dealt again."""
    once = lines.groupBy("batch_id", "body").agg(F.count("*").alias("copies"))
    if text_ids:
        once = once.withColumn("batch_id", F.col("batch_id").cast("string"))
    rows = _checked(once.withColumn("_line", F.sha2("body", 256)), now, prices)
    return rows.drop("event", "field_reasons", "unknown_keys", "cross_reasons")  # ``reasons`` has them all


def flag_rows(lines: DataFrame, log: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Validate envelopes and events and flag first deliveries (see :func:`flag_new`). Nothing is run here."""
    return flag_new(checked_rows(lines, now), log)


def _first_deliveries(typed: DataFrame, log: DataFrame | None) -> DataFrame:
    """The earliest delivery of each valid event's key that is absent from ``log``."""
    key = rollup.DEDUP_KEY
    first = typed.filter("valid").groupBy(*key).agg(F.min(_delivery()).alias("_first"))
    if log is not None:
        first = first.join(_log_keys(log, typed.filter("valid")), key, "left_anti")
    return first


def repeated_keys(typed: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The keys of valid events that come more than once or are in ``log``, with the delivery that counts
    in ``_first``: the earliest, or NULL if ``log`` has the key."""
    key = rollup.DEDUP_KEY
    valid = typed.filter("valid")
    keys = valid.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(_delivery()).alias("_first"))
    if log is None:
        return keys.where("_n > 1").select(*key, "_first")
    known = _log_keys(log, valid).groupBy(*key).agg(F.lit(True).alias("_known"))
    return keys.join(known, key, "left").where("_n > 1 OR _known").select(*key, F.expr("IF(_known, NULL, _first)").alias("_first"))


def new_rows(typed: DataFrame, log: DataFrame | None = None, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows that :func:`flag_new` flags, and no other. Only the repeated keys are joined to the rows:
    where these are ``store``d first and few, the wide rows are not dealt out again by key."""
    seen = store(repeated_keys(typed, log)).withColumn("_seen", F.lit(True))
    joined = typed.filter("valid").join(seen, rollup.DEDUP_KEY, "left")
    return joined.where(F.col("_seen").isNull() | (_delivery() == F.col("_first"))).drop("_first", "_seen")


def flag_new(typed: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """``is_new`` holds for the earliest delivery (batch_id, position, then the
    envelope's hash) of a valid event's (event_id, created_at) in this load, if
    the key is absent from ``log``. The earliest delivery is found by a partial
    aggregate on the dedup key joined back, so a hot key never forms a
    single-task window. The rows are read more than once: a loader persists them.
    """
    typed = typed.join(_first_deliveries(typed, log), rollup.DEDUP_KEY, "left")
    return typed.withColumn("is_new", F.coalesce(F.col("valid") & (_delivery() == F.col("_first")), F.lit(False))).drop("_first")


def acks(lines: DataFrame, log: DataFrame | None = None, now: str | None = None, with_errors: bool = False, prices=PRICES) -> DataFrame:
    """The acknowledgements of a load of envelope lines, without its rows."""
    return ack_of(_checked(lines, now, prices).withColumn("copies", F.lit(1).cast("long")), log, with_errors)


def ack_of(checked: DataFrame, log: DataFrame | None = None, with_errors: bool = False) -> DataFrame:
    """Per batch: accepted (new rows), duplicates (valid but already seen),
    rejected and dead-lettered (events that are invalid or can't be priced, or 1 for a rejected envelope).

    Verdicts are counted by (key, envelope, error) in one shuffle of narrow rows; the first delivery of
    each key and the counts of each envelope are aggregates of that table.
    ``with_errors`` adds ``errors`` = [{event_id, reason, paths, copies}], an entry
    a different rejected event (event id when it is a string) or rejected envelope ({NULL,
    'invalid batch envelope'}) with the number of its deliveries, so that however often one
    comes, the list has no more entries than different bodies of the batch have events."""
    key = rollup.DEDUP_KEY
    error = F.expr(
        "CASE WHEN NOT envelope_ok THEN named_struct('position', -1, 'event_id', CAST(NULL AS STRING), 'reason', 'invalid batch envelope', 'paths', envelope_reasons) "
        "WHEN position IS NOT NULL AND NOT valid THEN named_struct('position', position, 'event_id', wire_event_id, "
        "'reason', coalesce(enrich_error, array_join(reasons, '; ')), 'paths', IF(enrich_error IS NULL, reasons, array(enrich_error))) END")
    rows = checked.select(
        "batch_id", F.when(F.col("valid"), F.col("event_id")).alias("event_id"), F.when(F.col("valid"), F.col("created_at")).alias("created_at"),
        "valid", "envelope_ok", "position", "copies", *([error.alias("_err")] if with_errors else []))
    by_key = rows.groupBy("batch_id", *key, *(["_err"] if with_errors else [])).agg(
        F.expr("sum(IF(valid, copies, 0L))").alias("_valid"), F.expr("sum(IF(envelope_ok, 0L, copies))").alias("_rej_env"),
        F.expr("sum(IF(envelope_ok AND position IS NOT NULL AND NOT valid, copies, 0L))").alias("_rej"))
    new = by_key.filter("_valid > 0").groupBy(*key).agg(F.min("batch_id").alias("batch_id"))
    if log is not None:
        new = new.join(_log_keys(log, by_key.filter("_valid > 0")), key, "left_anti")
    entry = F.expr("IF(_err IS NULL, NULL, named_struct('position', _err.position, 'event_id', _err.event_id, 'reason', _err.reason, 'paths', _err.paths, 'copies', _rej_env + _rej))")
    counts = by_key.select("batch_id", F.lit(0).alias("_new"), "_valid", "_rej_env", "_rej", *([entry.alias("_err")] if with_errors else []))
    u = counts.unionByName(new.select("batch_id", F.lit(1).alias("_new")), allowMissingColumns=True)
    g = u.groupBy("batch_id").agg(
        F.sum("_new").alias("accepted"), F.sum("_valid").alias("_valid"), F.sum("_rej_env").alias("_rej_env"), F.sum("_rej").alias("_rej"),
        *([F.expr("array_sort(collect_list(_err))").alias("_errs")] if with_errors else []))
    cols = ["batch_id", "CAST(accepted AS BIGINT) AS accepted",
            "CAST(_valid - accepted AS BIGINT) AS duplicates",
            "CAST(_rej_env + _rej AS BIGINT) AS rejected",
            "CAST(_rej_env + _rej AS BIGINT) AS dead_lettered"]
    if with_errors:
        cols.append("transform(_errs, e -> named_struct('event_id', e.event_id, 'reason', e.reason, "
                    "'paths', array_sort(array_distinct(transform(e.paths, r -> substring_index(r, ': ', 1)))), 'copies', e.copies)) AS errors")
    return g.selectExpr(*cols)


def ack_of_written(checked: DataFrame, events: DataFrame) -> DataFrame:
    """:func:`ack_of` of a load's checked rows, without errors, when its new ``events`` are stored: these are the
    accepted rows, so no key is counted again, and a batch is a row of numbers before anything is dealt."""
    counts = checked.select("batch_id", F.lit(0).cast("long").alias("_new"), F.expr("IF(valid, copies, 0L)").alias("_valid"),
                            F.expr("IF(NOT envelope_ok OR (position IS NOT NULL AND NOT valid), copies, 0L)").alias("_rejected"))
    new = events.select("batch_id", F.lit(1).cast("long").alias("_new"), F.lit(0).cast("long").alias("_valid"), F.lit(0).cast("long").alias("_rejected"))
    return counts.unionByName(new).groupBy("batch_id").agg(
        F.sum("_new").alias("accepted"), (F.sum("_valid") - F.sum("_new")).alias("duplicates"),
        F.sum("_rejected").alias("rejected"), F.sum("_rejected").alias("dead_lettered"))


def dlq_of(flagged: DataFrame, now: str | None = None) -> DataFrame:
    """Dead-letter rows: a rejected envelope keeps its whole body (stage
    'envelope'); a rejected event keeps its JSON and its id when that is a
    string (stage 'validate'), and so does a well-formed one that can't be
    priced (stage 'enrich'). The error text is whole; verbatim copies of an
    envelope park their rejects once, with the number of copies as attempts.
    ``dlq_id`` names the batch, the position and the envelope's hash: different
    bodies of one batch_id park their own. As a load's copies are one row (:func:`checked_rows`), each
    name comes once, and the payloads are not dealt again."""
    ts = f"TIMESTAMP '{now}'" if now else "current_timestamp()"
    bad = flagged.filter("NOT envelope_ok OR (position IS NOT NULL AND NOT valid)")
    return bad.withColumn(
        "_why", F.expr("CASE WHEN NOT envelope_ok THEN envelope_reasons WHEN well_formed THEN array(enrich_error) ELSE reasons END")).selectExpr(
        "concat_ws('-', concat('b', CAST(batch_id AS STRING)), IF(envelope_ok, CAST(position AS STRING), NULL), left(_line, 32)) AS dlq_id",
        "batch_id", "position",
        "IF(envelope_ok, raw, body) AS payload",
        "IF(envelope_ok, wire_event_id, NULL) AS event_id",
        "CASE WHEN NOT envelope_ok THEN 'envelope' WHEN well_formed THEN 'enrich' ELSE 'validate' END AS stage",
        "_why AS reasons",
        "sdk_version",
        "array_join(_why, '; ') AS error",
        "CAST(copies AS INT) AS attempts", f"{ts} AS first_seen_at", f"{ts} AS last_seen_at",
        "CAST(NULL AS TIMESTAMP) AS replayed_at")


def merge_dlq(*dlqs: DataFrame) -> DataFrame:
    """Accumulate dead letters across loads: one row per parked item
    (``dlq_id``), ``attempts`` = number of times it was parked, first/last
    seen times, replayed once any copy was replayed; payload and error of the
    latest parking."""
    u = dlqs[0]
    for d in dlqs[1:]:
        u = u.unionByName(d, allowMissingColumns=True)
    return u.groupBy("dlq_id").agg(
        F.expr("CAST(sum(attempts) AS INT)").alias("attempts"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.max("replayed_at").alias("replayed_at"),
        *[F.max_by(c, "last_seen_at").alias(c)
          for c in ("batch_id", "position", "payload", "event_id", "stage", "reasons", "sdk_version", "error")])


def ingest(lines: DataFrame, log: DataFrame | None = None, now: str | None = None,
           redaction_mode: str = "both", preview_chars: int = redaction.PREVIEW_CHARS, prices=PRICES) -> IngestResult:
    """Full write path for envelope lines (``batch_id``, ``body``)."""
    return ingest_checked(checked_rows(lines, now, prices), log, now, redaction_mode, preview_chars)


def ingest_checked(checked: DataFrame, log: DataFrame | None = None, now: str | None = None,
                   redaction_mode: str = "both", preview_chars: int = redaction.PREVIEW_CHARS,
                   store: Callable[[DataFrame], DataFrame] = lambda df: df) -> IngestResult:
    """The write path from checked rows on. ``store`` writes a small table and reads it again (:func:`new_rows`)."""
    new = new_rows(checked, log, store)
    if redaction_mode in ("ingest", "both"):
        new = redaction.redaction_second_pass(
            new.withColumnRenamed("input_preview", "_in").withColumnRenamed("output_preview", "_out"),
            redaction_mode, preview_chars, "_in", "_out")
    inserted = new.select(*EVENT_LOG_COLUMNS)
    return IngestResult(flag_new(checked, log), inserted, rollup.rollup_1m(inserted), ack_of(checked, log), dlq_of(checked, now))
