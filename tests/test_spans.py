import json

from callgauge.operators import spans

T0 = "2026-07-31 14:22:01"


def _chunks(spark, seqs, call_id=1):
    rows = []
    for i, (kind, payload, status) in enumerate(seqs):
        rows.append((call_id, i, f"2026-07-31 14:22:01.{i * 100:03d}", kind,
                     None if payload is None else json.dumps(payload), status, "anthropic"))
    return spark.createDataFrame(rows, "call_id long, seq long, ts string, kind string, payload string, "
                                       "http_status int, provider string").selectExpr(
        "call_id", "seq", "CAST(ts AS TIMESTAMP) AS ts", "kind", "payload", "http_status", "provider")


START = ("chunk", {"type": "message_start", "message": {"usage": {"input_tokens": 42, "cache_read_input_tokens": 7}}},
         None)
HELLO = ("chunk", {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "Hello"}}, None)
WORLD = ("chunk", {"type": "content_block_delta", "delta": {"type": "text_delta", "text": " world"}}, None)
DELTA = ("chunk", {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 5}}, None)


def _span(spark, seqs):
    return spans.assemble_spans(spans.parse_chunks(_chunks(spark, seqs))).first()


def test_drained_stream(spark):
    s = _span(spark, [START, HELLO, WORLD, DELTA, ("done", None, None)])
    assert (s.status, s.input_tokens, s.output_tokens, s.cache_read_tokens, s.finish_reason) == \
        ("ok", 42, 5, 7, "end_turn")
    assert s.output_text == "Hello world" and s.ttft_ms <= s.latency_ms and s.ttft_ms == 100


def test_number_of_chunks(spark):
    """All chunks of a call count, those behind its marker among them."""
    seqs = [START, HELLO, ("done", None, None), WORLD]
    both = spans.parse_chunks(_chunks(spark, seqs).unionByName(_chunks(spark, seqs[:2], 2)))
    got = spans.assemble_spans(both, count_as="logged").collect()
    assert {r.call_id: (r.logged, r.output_text) for r in got} == {1: (4, "Hello"), 2: (2, "Hello")}
    assert "logged" not in spans.assemble_spans(both).columns


def test_break_after_first_text_is_cancelled(spark):
    s = _span(spark, [START, HELLO, ("return", None, None)])
    assert (s.status, s.input_tokens, s.error_type, s.output_tokens) == ("cancelled", 42, None, None)


def test_rate_limited(spark):
    s = _span(spark, [START, ("error", None, 429)])
    assert (s.status, s.error_type, s.input_tokens) == ("error", "rate_limit", 42)


def test_abandoned_call_is_cancelled(spark):
    s = _span(spark, [START, HELLO])
    assert s.status == "cancelled"


def test_text_is_whole_unless_a_limit_is_given(spark):
    big = ("chunk", {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "x" * 5000}}, None)
    rows = [START, big, big, big, ("done", None, None)]
    assert len(_span(spark, rows).output_text) == 15000
    cut = spans.assemble_spans(spans.parse_chunks(_chunks(spark, rows)), text_limit=8192).first()
    assert len(cut.output_text) == 10000   # appended while accumulated < 8192


def test_chunks_behind_the_terminal_marker_count_for_nothing(spark):
    s = _span(spark, [START, HELLO, DELTA, ("done", None, None), WORLD,
                      ("chunk", {"type": "message_delta", "delta": {"stop_reason": "late"}, "usage": {"output_tokens": 99}}, None),
                      ("error", None, 500)])
    assert (s.status, s.output_text, s.output_tokens, s.finish_reason, s.latency_ms) == ("ok", "Hello", 5, "end_turn", 300)


def test_errors_are_classified_by_name_code_and_message(spark):
    def end(status, **facts):
        s = _span(spark, [START, HELLO, ("error", facts, status)])
        return s.status, s.error_type, s.error_message
    assert end(None, name="APIConnectionError", message="reset") == ("error", "network", "reset")
    assert end(None, name="APIConnectionTimeoutError") == ("error", "timeout", None)
    assert end(None, name="APIUserAbortError") == ("cancelled", None, None)
    assert end(400, name="APIError", message="prompt is too long") == ("error", "context_length", "prompt is too long")
    assert end(400, name="APIError", message="bad") == ("error", "invalid_request", "bad")
    assert end(None) == ("error", "unknown", None)
