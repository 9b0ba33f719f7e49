"""Dead-letter queue: pending list, replay, and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.operators import validate


def dlq_pending(dlq: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` unreplayed rows (a bounded top-k)."""
    return (dlq.filter("replayed_at IS NULL")
            .orderBy(F.desc("first_seen_at"), F.desc("dlq_id")).limit(int(limit)))


def dlq_pending_count(dlq: DataFrame) -> DataFrame:
    return dlq.filter("replayed_at IS NULL").agg(F.count(F.lit(1)).cast("int").alias("dlq_pending"))


def replay_candidates(dlq: DataFrame, after: str | None = None, limit: int | None = None) -> DataFrame:
    """All pending payloads, each wrapped as a one-event envelope from sdk
    'replay' / '0' (envelope-stage payloads are replayed as they are). For a
    paged replay, ``after`` and ``limit`` give the next page by dlq_id: rows
    that keep failing never hold back the others."""
    pend = dlq.filter("replayed_at IS NULL")
    if after is not None:
        pend = pend.filter(F.col("dlq_id") > after)
    if limit is not None:
        pend = pend.orderBy("dlq_id").limit(int(limit))
    return pend.selectExpr(
        "dlq_id AS batch_id",
        "IF(stage = 'envelope', payload, concat('{\"sdk\":{\"name\":\"replay\",\"version\":\"0\"},"
        "\"sentAt\":\"', date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), "
        "'\",\"events\":[', payload, ']}')) AS body")


def dlq_replay(dlq: DataFrame, log: DataFrame | None, now: str, after: str | None = None,
               limit: int | None = None):
    """Re-drive pending payloads through validation; a row is marked replayed
    when its payload now yields an accepted or duplicate event. A failing
    replay does not park a second copy. Returns (updated dlq, accepted rows,
    per-row outcome)."""
    from callgauge.operators import rollup
    cand = replay_candidates(dlq, after, limit)   # batch_id = dlq_id
    envs = validate.validate_envelopes(cand)
    checked = validate.validate_events(validate.explode_envelopes(envs))
    typed = validate.typed_events(validate.rows_where(checked, "size(reasons) = 0"), ingested_at=now)
    fresh = rollup.dedup_new(typed, log)
    per = (typed.selectExpr("batch_id AS dlq_id", "1 AS _valid", "0 AS _new")
           .unionByName(fresh.selectExpr("batch_id AS dlq_id", "0 AS _valid", "1 AS _new"))
           .groupBy("dlq_id").agg(F.sum("_valid").alias("_v"), F.sum("_new").alias("_n")))
    outcome = (cand.selectExpr("batch_id AS dlq_id").join(per, "dlq_id", "left")
               .selectExpr("dlq_id", "CAST(coalesce(_n, 0) AS BIGINT) AS accepted",
                           "CAST(coalesce(_v, 0) - coalesce(_n, 0) AS BIGINT) AS duplicates",
                           "coalesce(_v, 0) > 0 AS replayed"))
    done = outcome.filter("replayed").select("dlq_id", F.lit(True).alias("_done"))
    updated = (dlq.join(done, "dlq_id", "left")
               .withColumn("replayed_at", F.when(F.col("_done"), F.lit(now).cast("timestamp"))
                           .otherwise(F.col("replayed_at"))).drop("_done"))
    return updated, fresh, outcome


def orphan_refs(events: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Events whose conversation or message reference does not exist, flagged
    per row (one orphan never fails a whole batch)."""
    convs = conversations.select(F.col("id").alias("conversation_id")).distinct().withColumn("_c", F.lit(True))
    msgs = (messages.select("conversation_id", (F.col("seq") - 1).alias("message_turn")).distinct()
            .withColumn("_m", F.lit(True)))
    j = events.join(convs, "conversation_id", "left").join(msgs, ["conversation_id", "message_turn"], "left")
    return (j.withColumn("orphan_conversation", F.col("conversation_id").isNotNull() & F.col("_c").isNull())
            .withColumn("orphan_message", F.col("message_turn").isNotNull() & F.col("_m").isNull())
            .drop("_c", "_m"))
