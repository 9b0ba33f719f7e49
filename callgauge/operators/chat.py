"""Conversation tables: sequencing, counters, listing, replay, context window,
titles, completion, status changes, deletion, erasure, summaries, drill-down.

Per-conversation work is a window partitioned by conversation (bounded by one
thread's length) or a grouped aggregate; cross-table updates are joins of
change sets, never driver loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import (CONTEXT_CHARS_PER_TOKEN, CONTEXT_DEFAULT_TOKEN_BUDGET,
                                 CONTEXT_MIN_TURNS, LIST_CONVERSATIONS_DEFAULT,
                                 TITLE_CUT, TITLE_MAX)
from callgauge.functions.redact import JS_SPACE_CLASS, sql_str
from callgauge.operators.running import running_sums


def assign_seq(existing: DataFrame, new: DataFrame, arrival_cols=("created_at",)) -> DataFrame:
    """seq for appended rows = current max seq of the conversation + arrival rank.

    The per-conversation max is an aggregate (one row per conversation), joined
    back on the conversation key; the arrival rank is a bucketed running count
    ordered by ``arrival_cols`` (first one a timestamp), skew-safe.
    """
    mx = existing.groupBy("conversation_id").agg(F.max("seq").alias("_max"))
    first = arrival_cols[0]
    ranked = running_sums(new, ["conversation_id"], f"unix_micros({first}) div 60000000", list(arrival_cols),
                          {"_rank": "1"})
    out = ranked.join(mx, "conversation_id", "left").withColumn(
        "seq", F.coalesce(F.col("_max"), F.lit(0)) + F.col("_rank"))
    return out.drop("_max", "_rank")


def conversation_counters(messages: DataFrame) -> DataFrame:
    """message_count and last_message_at per conversation (derived, not
    maintained by trigger)."""
    return messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("last_message_at"))


def list_conversations(conversations: DataFrame, messages: DataFrame, user_id: str | None = None,
                       before: str | None = None, limit: int = LIST_CONVERSATIONS_DEFAULT) -> DataFrame:
    """Non-deleted conversations, optionally for one user and before a keyset
    timestamp, newest activity first (NULLs last): a page of ``limit`` rows."""
    c = conversations.filter("status <> 'deleted'")
    if user_id is not None:
        c = c.filter(F.col("user_id").eqNullSafe(F.lit(user_id)))
    c = c.join(conversation_counters(messages), c["id"] == F.col("conversation_id"), "left").drop("conversation_id")
    if before is not None:
        c = c.filter(F.col("last_message_at") < F.lit(before).cast("timestamp"))
    return c.orderBy(F.desc_nulls_last("last_message_at"), F.desc("created_at"), F.desc("id")).limit(int(limit))


def replay_messages(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """The messages of every conversation, or the first ``limit`` of each by seq
    (bucketed running count, so a very long conversation is not one task)."""
    if limit is None:
        return messages
    r = running_sums(messages, ["conversation_id"], "seq div 1024", ["seq"], {"_rn": "1"})
    return r.filter(F.col("_rn") <= limit).drop("_rn")


def context_window(messages: DataFrame, token_budget: int = CONTEXT_DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """Newest-first sliding window under a character budget (4 chars/token),
    never fewer than 4 turns; empty assistant placeholders are skipped.

    Equivalent to the newest-first loop: with cum = running chars over the
    non-empty rows newest first, a row is kept iff its rank <= 4 or cum <=
    budget (cum is monotone, so the loop's break is a prefix cut). The running
    sums are bucketed (see :mod:`callgauge.operators.running`), so one very
    long conversation does not become one task. Adds ``kept`` per row;
    summarise with :func:`context_window_summary`.
    """
    budget = int(token_budget) * CONTEXT_CHARS_PER_TOKEN
    usable = "NOT (role = 'assistant' AND length(content) = 0)"
    m = running_sums(messages, ["conversation_id"], "seq div 1024", ["seq"],
                     {"_cum": f"IF({usable}, length(content), 0)", "_rank": f"IF({usable}, 1, 0)"},
                     descending=True)
    kept = F.expr(f"{usable} AND (_rank <= {CONTEXT_MIN_TURNS} OR _cum <= {budget})")
    return m.withColumn("kept", kept).drop("_cum", "_rank")


def context_window_summary(windowed: DataFrame) -> DataFrame:
    """Per conversation: kept turns, dropped turns (history minus kept, so
    skipped placeholders count as dropped) and estimated tokens."""
    return windowed.groupBy("conversation_id").agg(
        F.count_if("kept").alias("kept_turns"),
        (F.count(F.lit(1)) - F.count_if("kept")).alias("dropped_turns"),
        F.expr(f"CAST(ceil(coalesce(sum(IF(kept, length(content), 0)), 0) / {CONTEXT_CHARS_PER_TOKEN}) AS BIGINT)")
        .alias("estimated_tokens"))


def title_of_sql(text: str) -> str:
    one = f"trim(regexp_replace({text}, {sql_str('[' + JS_SPACE_CLASS + ']+')}, ' '))"
    return (f"IF(length({one}) <= {TITLE_MAX}, {one}, concat(substring({one}, 1, {TITLE_CUT}), '…'))")


def derive_titles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Title from the first user message (whitespace collapsed, trimmed, <= 60
    chars else 57 + '…'); only set where the title is NULL or empty."""
    first = (messages.filter("role = 'user'").groupBy("conversation_id")
             .agg(F.min_by("content", "seq").alias("_first")))
    j = conversations.join(first, conversations["id"] == first["conversation_id"], "left")
    return j.select(*[c for c in conversations.columns if c != "title"],
                    F.expr(f"IF(title IS NULL OR title = '', substring({title_of_sql('_first')}, 1, 120), title)")
                    .alias("title"))


def complete_messages(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (conversation_id, seq, content, token_count) completions to
    placeholder rows: content replaced, is_complete set."""
    u = updates.select("conversation_id", "seq", F.col("content").alias("_c"), F.col("token_count").alias("_tc"))
    j = messages.join(u, ["conversation_id", "seq"], "left")
    return j.select(*[c for c in messages.columns if c not in ("content", "is_complete")],
                    F.coalesce("_c", "content").alias("content"),
                    (F.col("is_complete") | F.col("_c").isNotNull()).alias("is_complete"),
                    F.col("_tc").alias("token_count"))


def set_status(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Soft state change (active / archived / deleted) from a (id, status) set."""
    ch = changes.select("id", F.col("status").alias("_new"))
    j = conversations.join(ch, "id", "left")
    return j.select(*[c for c in conversations.columns if c != "status"],
                    F.coalesce("_new", "status").alias("status"))


def delete_conversations(messages: DataFrame, events: DataFrame, deleted_ids: DataFrame):
    """Messages of deleted conversations go (cascade); events survive with
    conversation reference set to NULL. ``deleted_ids`` has column ``id``."""
    ids = deleted_ids.select(F.col("id").alias("conversation_id")).distinct()
    kept = messages.join(ids, "conversation_id", "left_anti")
    flagged = ids.withColumn("_gone", F.lit(True))
    ev = events.join(flagged, "conversation_id", "left")
    ev = ev.select(*[c for c in events.columns if c not in ("conversation_id", "message_turn")],
                   F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("conversation_id")).alias("conversation_id"),
                   F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("message_turn")).alias("message_turn"))
    return kept, ev


def erase_conversations(conversations: DataFrame, messages: DataFrame, events: DataFrame,
                        erase_ids: DataFrame):
    """Content erasure that keeps metrics: message content '[redacted]', event
    previews / user / session NULL, title '[redacted]' and status 'deleted'.
    Returns (conversations, messages, events, counts)."""
    ids = erase_ids.select(F.col("id").alias("_eid")).distinct().withColumn("_hit", F.lit(True))
    m = messages.join(ids, messages["conversation_id"] == ids["_eid"], "left")
    m = m.withColumn("content", F.when(F.col("_hit"), F.lit("[redacted]")).otherwise(F.col("content")))
    e = events.join(ids, events["conversation_id"] == ids["_eid"], "left")
    for c in ("input_preview", "output_preview", "user_id", "session_id"):
        if c in events.columns:
            e = e.withColumn(c, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)))
    c = conversations.join(ids, conversations["id"] == ids["_eid"], "left")
    c = (c.withColumn("title", F.when(F.col("_hit"), F.lit("[redacted]")).otherwise(F.col("title")))
         .withColumn("status", F.when(F.col("_hit"), F.lit("deleted")).otherwise(F.col("status"))))
    counts = (m.selectExpr("IF(_hit, 1, 0) AS _m", "0 AS _e")
              .unionByName(e.selectExpr("0 AS _m", "IF(_hit, 1, 0) AS _e"))
              .agg(F.expr("CAST(coalesce(sum(_m), 0) AS BIGINT)").alias("messages_redacted"),
                   F.expr("CAST(coalesce(sum(_e), 0) AS BIGINT)").alias("events_redacted")))
    return (c.drop("_eid", "_hit"), m.drop("_eid", "_hit"), e.drop("_eid", "_hit"), counts)


def conversation_summary(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """Each conversation with total cost, total tokens and error count of its
    events (aggregate first, then join: one row per conversation)."""
    agg = events.groupBy("conversation_id").agg(
        F.expr("coalesce(sum(cost_usd), 0)").alias("total_cost_usd"),
        F.expr("CAST(coalesce(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)), 0) AS BIGINT)")
        .alias("total_tokens"),
        F.count_if(F.col("status") == "error").alias("error_count"))
    j = conversations.join(agg, conversations["id"] == agg["conversation_id"], "left").drop("conversation_id")
    return j.withColumns({
        "total_cost_usd": F.coalesce("total_cost_usd", F.lit(0).cast("decimal(24,8)")),
        "total_tokens": F.coalesce("total_tokens", F.lit(0).cast("bigint")),
        "error_count": F.coalesce("error_count", F.lit(0).cast("bigint"))})


def slow_call_drilldown(events: DataFrame, messages: DataFrame, k: int = 20) -> DataFrame:
    """The k slowest calls with the message they answered and the user turn
    before it ("this call was slow — what was the user asking?").

    Top-k first (a bounded TakeOrdered), then equi-joins to messages on
    (conversation, seq)."""
    top = events.orderBy(F.desc("latency_ms"), F.asc("event_id")).limit(int(k))
    top = top.withColumn("_seq", F.col("message_turn") + 1)
    msg = messages.select(F.col("conversation_id").alias("_c"), F.col("seq").alias("_s"),
                          F.col("role").alias("message_role"), F.col("content").alias("message_content"))
    prev = messages.filter("role = 'user'").select(
        F.col("conversation_id").alias("_pc"), F.col("seq").alias("_ps"), F.col("content").alias("user_prompt"))
    j = top.join(msg, (top["conversation_id"] == msg["_c"]) & (top["_seq"] == msg["_s"]), "left")
    j = j.join(prev, (j["conversation_id"] == prev["_pc"]) & (prev["_ps"] == j["_seq"] - 1), "left")
    return j.drop("_c", "_s", "_pc", "_ps", "_seq")
