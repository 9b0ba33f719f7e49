"""Structured Streaming jobs.

* :func:`start_ingest` — G1/G2/G8: envelope files -> ``foreachBatch`` running
  the batch ingest function.
* :func:`start_rollup` — G2/G3: events -> stored keys and rollup deltas.
* :func:`start_spans` — G7: chunks -> chunk log and call records.

Each micro-batch is one commit of all its tables (:mod:`callgauge.sources.loads`),
so an epoch that is replayed after a crash is stored once, and readers see a
load whole or not at all. No job has a watermark that drops rows or a limit of time: late rows
are held against the stored log like all others, and a drained query that did
not end well raises.

Checkpoints and outputs live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.constants import PRICES
from callgauge.operators import dlq, enrich, rollup, spans
from callgauge.plans import ingest as ingest_plan
from callgauge.session import checkpoint_dir
from callgauge.sources import loads
from callgauge.sources.tables import SCHEMAS

EVENTS_SCHEMA = SCHEMAS["events"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The ``events`` table as a file stream (explicit schema, bounded intake)."""
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir.rstrip('/')}/events*.parquet"))


def drained(query):
    """Wait until an ``availableNow`` query has read all its input; raise what ended it early."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def _source_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: it survives restarts, and a new
    checkpoint (whose epochs begin at 0 again) has another one."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _with_month(events: DataFrame) -> DataFrame:
    return events.withColumn("event_month", rollup.month_key(F.col("created_at")))


def _with_day(delta: DataFrame) -> DataFrame:
    return delta.withColumn("bucket_day", F.date_format("bucket", "yyyy-MM-dd"))


def _delta_of_written(written: dict[str, DataFrame]) -> DataFrame:
    """The rollup delta of the events that a load has just written."""
    return _with_day(rollup.rollup_1m(written["events"]))


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that joins know its size."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def start_rollup(events: DataFrame, dst_dir: str, checkpoint: str):
    """Incremental one-minute rollup of an event stream in any order (G2, G3).

    Per micro-batch: events that are repeated in it or whose key an earlier
    load stored are dropped, then the new keys and the rollup delta of the new
    events are written under the batch's own epoch. There is no watermark, so a
    late event counts whenever it comes; the key table is read only in the
    months of the batch. Both are one commit. :func:`read_rollup` merges the deltas."""
    spark = events.sparkSession

    def handle(df: DataFrame, epoch: int) -> None:
        source = _source_id(spark, checkpoint)
        if loads.is_committed(spark, dst_dir, source, epoch):
            return
        new = rollup.dedup_new(df, loads.read_table(spark, dst_dir, "keys")).persist()
        try:
            loads.write_load(spark, dst_dir, source, epoch, {
                "keys": _with_month(new.select(*rollup.DEDUP_KEY)),
                "rollup_delta": _with_day(rollup.rollup_1m(enrich.price_events(new)))})
        finally:
            new.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_rollup(events: DataFrame, name: str = "stream-rollup") -> DataFrame:
    """Drain ``events`` through :func:`start_rollup` and read the rollup."""
    base = scratch(events.sparkSession, name)
    drained(start_rollup(events, base, f"{base}/_checkpoint"))
    return read_rollup(events.sparkSession, base)


def start_ingest(spark: SparkSession, src_dir: str, dst_dir: str, checkpoint: str,
                 max_files: int = 10, available_now: bool = True, now: str | None = None, prices=PRICES):
    """Queue-drain ingest: envelope JSON lines -> event log + rollup deltas +
    dead letters, exactly once per event.

    Each file line is one envelope; ``batch_id`` is the SHA-256 of the line,
    so a redelivered envelope gets the same id. Each micro-batch is a load of
    :func:`load_direct`, the source being the query's own id, so an epoch that comes
    again after a crash is stored once.
    """
    src = (spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files)
           .text(src_dir))

    def handle(df: DataFrame, epoch: int) -> None:
        load_direct(spark, df.selectExpr("sha2(value, 256) AS batch_id", "value AS body"), dst_dir, epoch, now,
                    source=_source_id(spark, checkpoint), prices=prices)

    w = src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="200 milliseconds")
    return w.start()


def load_direct(spark: SparkSession, lines: DataFrame, dst_dir: str, epoch: int, now: str | None = None,
                source: str = "batch", prices=PRICES) -> bool:
    """Batch (direct-sink) load of envelope lines (``batch_id``, ``body``) as
    load number ``epoch`` of ``source``: validated, priced, de-duplicated
    against all stored events; then the inserted events, the rollup delta, the
    dead letters and the acknowledgements are stored as one commit. Readers see
    all four tables of a load or none, and a load that is stored already is
    not run again (False). Every output is computed from the persisted rows, so
    validation runs once, and the rollup delta and the acknowledgements from the inserted events as they were written."""
    log = loads.stored(spark, f"{dst_dir}/events")  # raises on a log that can't be read
    if loads.is_committed(spark, dst_dir, source, epoch):
        return False
    log = None if log is None else loads.read_table(spark, dst_dir, "events")
    # ids of one type in the store, whatever the source's; validated once, read by every step below
    checked = ingest_plan.checked_rows(lines, now, prices, text_ids=True).persist()
    try:
        ins = ingest_plan.ingest_checked(checked, log, now, store=_kept)
        return loads.write_load(spark, dst_dir, source, epoch, {
            "events": _with_month(ins.inserted), "rollup_delta": _delta_of_written,
            "dlq": ins.dlq.withColumn("seen_day", F.date_format("first_seen_at", "yyyy-MM-dd")),
            "ack": lambda written: ingest_plan.ack_of_written(checked, written["events"])})
    finally:
        checked.unpersist()


def read_events(spark: SparkSession, dst_dir: str) -> DataFrame | None:
    """The stored event log as of the last commit."""
    return loads.read_table(spark, dst_dir, "events")


def read_acks(spark: SparkSession, dst_dir: str) -> DataFrame | None:
    return loads.read_table(spark, dst_dir, "ack")


def read_dlq(spark: SparkSession, dst_dir: str) -> DataFrame | None:
    """The stored dead letters: a row an item, from all its parkings, with ``replayed_at`` of its
    newest replay mark. An item that was parked again behind its mark is pending again. None
    where no dead letter is stored."""
    parked = loads.read_table(spark, dst_dir, "dlq")
    if parked is None:
        return None
    parked = ingest_plan.merge_dlq(parked.drop(*loads.LOAD, "seen_day"))
    marks = loads.read_table(spark, dst_dir, "dlq_marks")
    if marks is None:
        return parked
    newest = marks.groupBy("dlq_id").agg(F.max("replayed_at").alias("_marked"))
    known = F.greatest("replayed_at", F.when(F.col("_marked") >= F.col("last_seen_at"), F.col("_marked")))
    return parked.join(newest, "dlq_id", "left").withColumn("replayed_at", known).drop("_marked")


def replay_dlq(spark: SparkSession, dst_dir: str, replay: int, now: str, prices=PRICES,
               after: str | None = None, limit: int | None = None) -> bool:
    """Re-drive the pending dead letters of the store (or a page of them by dlq_id) as load
    ``replay`` of the source "replay". What is valid now is inserted like any load's
    events, and an item that gave an accepted or duplicate event gets a replay mark: events, rollup,
    marks and the outcome per item (the load's acknowledgements, by dlq_id) are one
    commit, so a replay happens whole or not at all. Items that fail again stay
    pending as they are; no second copy is parked."""
    parked = read_dlq(spark, dst_dir)
    if parked is None or loads.is_committed(spark, dst_dir, "replay", replay):
        return False
    lines = dlq.replay_candidates(parked, after, limit)
    checked = ingest_plan.checked_rows(lines, now, prices).persist()
    try:
        ins = ingest_plan.ingest_checked(checked, read_events(spark, dst_dir), now, store=_kept)

        def ack(written):
            return ingest_plan.ack_of_written(checked, written["events"])

        def marks(written):
            return ack(written).where("accepted + duplicates > 0").select(F.col("batch_id").alias("dlq_id"), F.lit(now).cast("timestamp").alias("replayed_at"))

        return loads.write_load(spark, dst_dir, "replay", replay, {
            "events": _with_month(ins.inserted), "rollup_delta": _delta_of_written, "dlq_marks": marks, "ack": ack})
    finally:
        checked.unpersist()


def read_rollup(spark: SparkSession, dst_dir: str, since: str | None = None) -> DataFrame:
    """Stored rollup: the deltas of all loads and compactions, merged (groupBy + sum). With
    ``since`` only the buckets from then on, read from the day partitions that hold them."""
    deltas = loads.read_table(spark, dst_dir, "rollup_delta")
    if since is not None:
        deltas = deltas.filter((F.col("bucket_day") >= F.lit(since[:10]).cast("date")) & (F.col("bucket") >= F.lit(since).cast("timestamp")))
    return rollup.rollup_merge(deltas.drop("bucket_day", *loads.LOAD))


def compact_rollup(spark: SparkSession, dst_dir: str) -> int:
    """Fold the deltas of each day into one, so that a read merges few rows however many
    micro-batches ran. Returns the number of the compaction."""
    return loads.compact(spark, dst_dir, "rollup_delta", lambda rows: _with_day(rollup.rollup_merge(rows.drop("bucket_day"))))


def compact_dlq(spark: SparkSession, dst_dir: str) -> int:
    """Fold the dead letters that several loads parked on one day."""
    return loads.compact(spark, dst_dir, "dlq", lambda rows: ingest_plan.merge_dlq(rows.drop("seen_day"))
                         .withColumn("seen_day", F.date_format("first_seen_at", "yyyy-MM-dd")))


def store_events(spark: SparkSession, events: DataFrame, dst_dir: str, epoch: int = 0, source: str = "events") -> bool:
    """Load event rows that are valid already: priced, de-duplicated, and stored with their rollup delta in one commit."""
    if loads.is_committed(spark, dst_dir, source, epoch):
        return False
    new = enrich.price_events(rollup.dedup_new(events, read_events(spark, dst_dir)))
    return loads.write_load(spark, dst_dir, source, epoch, {"events": _with_month(new), "rollup_delta": _delta_of_written})


def start_spans(chunks: DataFrame, dst_dir: str, checkpoint: str):
    """Live span assembly (G7) of a chunk stream in any order.

    Per micro-batch the chunks are appended to the chunk log (one epoch each),
    and the calls that the batch touched are assembled again from all of their
    logged chunks: late, repeated and reordered chunks give the record that the
    whole call gives, and a chunk behind the terminal marker changes nothing.
    A call without a marker shows as cancelled until one comes."""
    spark = chunks.sparkSession

    def handle(df: DataFrame, epoch: int) -> None:
        source = _source_id(spark, checkpoint)
        loads.write_load(spark, f"{dst_dir}/chunk_log", source, epoch, {"chunks": spans.parse_chunks(df).drop("payload")})
        log = loads.read_table(spark, f"{dst_dir}/chunk_log", "chunks")
        touched = log.filter((F.col("source").cast("string") == source) & (F.col("epoch") == epoch)).select("call_id").distinct()
        mine = log.join(touched, "call_id", "left_semi").dropDuplicates(["call_id", "seq"])
        loads.write_load(spark, dst_dir, source, epoch, {"spans": spans.assemble_spans(mine, count_as="logged")})

    return chunks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_spans(spark: SparkSession, dst_dir: str) -> DataFrame:
    """The newest record of every call: that of the most logged chunks (the log only grows,
    whichever checkpoint wrote it), the latest of its source's epochs among equals, which are the same record."""
    t = loads.read_table(spark, dst_dir, "spans")
    cols = [c for c in t.columns if c not in ("call_id", "logged", *loads.LOAD)]
    latest = t.groupBy("call_id").agg(F.max_by(F.struct(*cols), F.struct("logged", "epoch")).alias("_r"))
    return latest.select("call_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def stream_spans(chunks: DataFrame, name: str = "stream-spans") -> DataFrame:
    """Drain ``chunks`` through :func:`start_spans` and read the spans."""
    base = scratch(chunks.sparkSession, name)
    drained(start_spans(chunks, base, f"{base}/_checkpoint"))
    return read_spans(chunks.sparkSession, base)


def progress_health(query, lag_limit_s: int = 60) -> dict:
    """Live health of a running ingest from its last progress report (G5,
    live form): batch id, input vs processed rows/s, trigger duration, event
    time watermark, and ``degraded`` when processing falls behind the input
    rate or one trigger takes longer than the lag limit. No data is read."""
    p = query.lastProgress or {}
    inp = float(p.get("inputRowsPerSecond") or 0.0)
    proc = float(p.get("processedRowsPerSecond") or 0.0)
    trig_ms = int((p.get("durationMs") or {}).get("triggerExecution") or 0)
    return {
        "batch_id": p.get("batchId"),
        "input_rows_per_sec": inp,
        "processed_rows_per_sec": proc,
        "trigger_ms": trig_ms,
        "watermark": (p.get("eventTime") or {}).get("watermark"),
        "rows": int(p.get("numInputRows") or 0),
        "degraded": (inp > 0 and proc < inp) or trig_ms > lag_limit_s * 1000,
    }
