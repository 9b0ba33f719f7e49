import math

from callgauge.operators import chat
from callgauge.sources import adapters

from conftest import SF_SMALL


def _loop(history, budget_tokens):
    budget = budget_tokens * 4
    kept, chars = [], 0
    for m in reversed(history):
        if m["role"] == "assistant" and len(m["content"]) == 0:
            continue
        if chars + len(m["content"]) > budget and len(kept) >= 4:
            break
        kept.append(m)
        chars += len(m["content"])
    return {m["seq"] for m in kept}, len(history) - len(kept), math.ceil(chars / 4)


def test_context_window_equals_reference_loop(spark):
    msgs = adapters.messages(spark, SF_SMALL)
    rows = msgs.collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r.conversation_id, []).append(r.asDict())
    for budget in (50, 400, 8000):
        w = chat.context_window(msgs, budget)
        kept = {}
        for r in w.filter("kept").select("conversation_id", "seq").collect():
            kept.setdefault(r.conversation_id, set()).add(r.seq)
        summ = {r.conversation_id: r for r in chat.context_window_summary(w).collect()}
        for cid, hist in by_conv.items():
            hist.sort(key=lambda m: m["seq"])
            exp_seqs, dropped, tokens = _loop(hist, budget)
            assert kept.get(cid, set()) == exp_seqs
            assert summ[cid].dropped_turns == dropped and summ[cid].estimated_tokens == tokens


def test_title_rules(spark):
    conv = spark.createDataFrame([(1, None), (2, "kept")], "id long, title string")
    msgs = spark.createDataFrame([(1, 1, "user", "  hello\n\t world  "), (2, 1, "user", "x")],
                                 "conversation_id long, seq long, role string, content string")
    long = spark.createDataFrame([(3, None)], "id long, title string")
    lmsg = spark.createDataFrame([(3, 1, "user", "a" * 80)], "conversation_id long, seq long, role string, content string")
    t = {r.id: r.title for r in chat.derive_titles(conv, msgs).collect()}
    assert t == {1: "hello world", 2: "kept"}
    assert chat.derive_titles(long, lmsg).first().title == "a" * 57 + "…"
