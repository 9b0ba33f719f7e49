"""Queue and transport semantics as table operators: poison routing, queue
health, late/skewed arrival accounting, micro-batching and bounded-buffer
loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from callgauge.operators.running import running_sums

from callgauge.constants import DEFAULT_BATCH_EVENTS, MAX_QUEUE, QUEUE_MAX_ATTEMPTS, READINESS_LAG_SECONDS


def route_poison(log: DataFrame, max_attempts: int = QUEUE_MAX_ATTEMPTS) -> DataFrame:
    """Unacknowledged messages read more than ``max_attempts`` times are
    archived (on the 6th read) instead of retried; payload kept, newest first."""
    return (log.filter(f"NOT acked AND read_ct > {int(max_attempts)}")
            .orderBy(F.desc("enqueued_at"), F.desc("msg_id")))


def queue_health(log: DataFrame, as_of: str, max_attempts: int = QUEUE_MAX_ATTEMPTS,
                 lag_limit_s: int = READINESS_LAG_SECONDS) -> DataFrame:
    """Queue length (unread = not acked, not archived), total messages, age in
    seconds of the oldest and newest unread message, archived count, and
    'degraded' when the oldest unread message is older than the lag limit.
    One aggregate over the message log."""
    unread = f"NOT acked AND read_ct <= {int(max_attempts)}"
    age = f"(unix_micros(TIMESTAMP '{as_of}') - unix_micros(enqueued_at)) / 1000000.0D"
    g = log.agg(
        F.expr(f"CAST(count_if({unread}) AS BIGINT)").alias("queue_length"),
        F.count(F.lit(1)).alias("total_messages"),
        F.expr(f"CAST(floor(max(IF({unread}, {age}, NULL))) AS BIGINT)").alias("oldest_age_sec"),
        F.expr(f"CAST(floor(min(IF({unread}, {age}, NULL))) AS BIGINT)").alias("newest_age_sec"),
        F.expr(f"CAST(count_if(NOT acked AND read_ct > {int(max_attempts)}) AS BIGINT)").alias("archived"))
    return g.withColumn("degraded", F.expr(f"coalesce(oldest_age_sec > {int(lag_limit_s)}, false)"))


def late_and_skewed(events: DataFrame, known_months: list[str], watermark_ms: int) -> DataFrame:
    """How arrival-time effects are handled, in one row: rows that arrive later
    than a streaming watermark would allow (kept by the log anti-join path,
    never dropped), rows with client clock ahead of the server, and rows whose
    event month is not a known partition (routed to overflow)."""
    lag = "unix_micros(ingested_at) - unix_micros(client_ts)"
    months = ", ".join(f"'{m}'" for m in known_months)
    return events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"count_if({lag} > {int(watermark_ms) * 1000})").alias("later_than_watermark"),
        F.expr("count_if(client_ts > ingested_at)").alias("client_clock_ahead"),
        F.expr(f"count_if(NOT date_format(created_at, 'yyyy-MM') IN ({months}))").alias("overflow_rows"),
        F.expr("count(DISTINCT date_trunc('minute', created_at))").alias("event_minutes"))


def micro_batches(events: DataFrame, producer: str = "session_id", order=("created_at", "event_id"),
                  size: int = DEFAULT_BATCH_EVENTS) -> DataFrame:
    """Envelopes of at most ``size`` events per producer in arrival order:
    batch_no = (rank - 1) div size. The per-producer rank is a bucketed
    running count (hour buckets), so a hot producer is spread over many
    tasks; each output group holds <= size ids."""
    r = running_sums(events, [producer], f"unix_micros({order[0]}) div 3600000000", list(order), {"_rank": "1"})
    e = r.withColumn("batch_no", F.expr(f"(_rank - 1) div {int(size)}"))
    return e.groupBy(producer, "batch_no").agg(
        F.count(F.lit(1)).alias("events"),
        F.min_by("event_id", F.struct(*order)).alias("first_event_id"),
        F.max_by("event_id", F.struct(*order)).alias("last_event_id"))


def buffer_loss(events: DataFrame, producer: str = "provider", max_queue: int = MAX_QUEUE,
                ts: str = "created_at") -> DataFrame:
    """How many events a client buffer of ``max_queue`` that is flushed every
    minute would keep and drop: per producer and minute, what exceeds the
    buffer is lost. Two partial aggregates — a hot producer costs nothing extra."""
    g = events.groupBy(producer, F.date_trunc("minute", ts).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy(producer).agg(
        F.expr(f"CAST(sum(least(_n, {int(max_queue)})) AS BIGINT)").alias("kept"),
        F.expr(f"CAST(sum(_n - least(_n, {int(max_queue)})) AS BIGINT)").alias("dropped"))


def buffer_kept_rows(events: DataFrame, producer: str = "provider", order=("created_at", "event_id"),
                     max_queue: int = MAX_QUEUE, salts: int = 64) -> DataFrame:
    """The newest ``max_queue`` events per producer, exactly, without putting a
    hot producer into one task: top-k inside ``salts`` hash sub-groups first
    (each keeps at most k candidates), then top-k over the <= salts*k
    candidates of each producer."""
    desc = ", ".join(f"{c} DESC" for c in order)
    salted = events.withColumn("_salt", F.expr(f"pmod(xxhash64({', '.join(order)}), {int(salts)})"))
    cand = salted.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {producer}, _salt ORDER BY {desc})"))
    cand = cand.filter(f"_r <= {int(max_queue)}").drop("_r", "_salt")
    fin = cand.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {producer} ORDER BY {desc})"))
    return fin.filter(f"_r <= {int(max_queue)}").drop("_r")
