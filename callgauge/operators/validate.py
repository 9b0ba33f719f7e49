"""Envelope and event validation over VARIANT, with quarantine (dead letter).

Bodies are parsed once with ``try_parse_json``. Every rule is a SQL predicate
that yields ``'path: message'`` or NULL; ``array_compact`` of the rule list is
the reason array, so one pass over the data validates every field of every
event, and one bad event never fails its batch. JSON types are read with
``schema_of_variant`` (a string "3100" is not a number; 3100.0 is an integer,
3100.5 is not; absent differs from null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import (CAPTURE_LAYERS, ERROR_TYPES, MAX_BATCH_EVENTS,
                                 MAX_ERROR_MESSAGE_CHARS, MAX_LATENCY_MS, MAX_PREVIEW_CHARS,
                                 OPERATIONS, STATUSES)

UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_OFFSET_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}(:?\d{2})?)$"
NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _s(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(values) -> str:
    return ", ".join(_s(v) for v in values)


#: An event's members (key -> variant), split once a row: each is then looked up in a short map
#: and not in the event's encoded keys again. NULL where the event is not an object.
MEMBERS = "_members"


def member(members: str, key: str, typ: str) -> str:
    """SQL of one member as ``typ``; NULL if it is absent or of another kind."""
    return f"try_variant_get({members}['{key}'], '$', '{typ}')"


def rows_where(df: DataFrame, condition: str) -> DataFrame:
    """The rows that meet ``condition`` on columns that are costly to make. A plain filter would be moved
    below the projections that make them, and parse and check every row once more for each mention."""
    return df.select("*", F.explode(F.expr(f"IF({condition}, array(true), CAST(array() AS array<boolean>))")).alias("_met")).drop("_met")


class Field:
    """One wire field: JSON key, kind and constraints."""

    def __init__(self, key, kind, required=False, nullable=False, default=None, **kw):
        self.key, self.kind, self.required, self.nullable, self.default = key, kind, required, nullable, default
        self.kw = kw

    staged = False  # when True, rule() reads the staged columns below

    @property
    def col(self) -> str:
        return self.key.replace(".", "_")

    def ty(self, v: str) -> str:
        if self.staged:
            return f"_ty_{self.col}"
        return f"schema_of_variant(variant_get({v}, '$.{self.key}', 'variant'))"

    def num(self, v: str) -> str:
        if self.staged:
            return f"_num_{self.col}"
        return f"try_variant_get({v}, '$.{self.key}', 'double')"

    def string(self, v: str) -> str:
        if self.staged:
            return f"_str_{self.col}"
        return f"try_variant_get({v}, '$.{self.key}', 'string')"

    def staging(self, members: str) -> dict:
        """Columns to evaluate once per row, from the object's members: JSON type name, and the value as
        double or string when the rule needs it."""
        out = {f"_ty_{self.col}": f"schema_of_variant({members}['{self.key}'])"}
        if self.kind in ("int", "number", "literal"):
            out[f"_num_{self.col}"] = member(members, self.key, "double")
        if self.kind in ("string", "enum"):
            out[f"_str_{self.col}"] = member(members, self.key, "string")
        return out

    def rule(self, v: str) -> str:
        """SQL yielding 'key: message' on violation, else NULL."""
        ty = self.ty(v)
        absent = f"({ty} IS NULL)"
        is_null = f"({ty} = 'VOID')"
        ok_type, ok_value, what = self._checks(v, ty)
        parts = []
        if self.required:
            parts.append(f"WHEN {absent} THEN 'missing'")
        else:
            parts.append(f"WHEN {absent} THEN NULL")
        if self.nullable:
            parts.append(f"WHEN {is_null} THEN NULL")
        parts.append(f"WHEN NOT ({ok_type}) THEN 'not a {what}'")
        if ok_value:
            parts.append(f"WHEN NOT ({ok_value}) THEN {_s(self._value_message())}")
        return f"(CASE {' '.join(parts)} ELSE NULL END)"

    def _checks(self, v, ty):
        k, kw = self.kind, self.kw
        s = self.string(v)
        n = self.num(v)
        is_num = f"({ty} IN ({_in(NUMERIC_TYPES)}) OR startswith({ty}, 'DECIMAL'))"
        if k == "string":
            conds = []
            if "min" in kw:
                conds.append(f"length({s}) >= {kw['min']}")
            if "max" in kw:
                conds.append(f"length({s}) <= {kw['max']}")
            if "pattern" in kw:
                conds.append(f"{s} RLIKE {_s(kw['pattern'])}")
            if kw.get("time"):  # the form alone would admit 30 February
                conds.append(f"try_cast({s} AS TIMESTAMP) IS NOT NULL")
            return f"{ty} = 'STRING'", " AND ".join(conds) or None, "string"
        if k == "enum":
            return f"{ty} = 'STRING'", f"{s} IN ({_in(kw['values'])})", "string"
        if k == "bool":
            return f"{ty} = 'BOOLEAN'", None, "boolean"
        if k == "int":
            conds = [f"{n} = floor({n})"]
            if "min" in kw:
                conds.append(f"{n} >= {kw['min']}")
            if "gt" in kw:
                conds.append(f"{n} > {kw['gt']}")
            if "max" in kw:
                conds.append(f"{n} <= {kw['max']}")
            return is_num, " AND ".join(conds), "number"
        if k == "number":
            return is_num, f"{n} >= {kw['min']} AND {n} <= {kw['max']}", "number"
        if k == "literal":
            return is_num, f"{n} = {kw['value']}", "number"
        if k == "object":
            return f"startswith({ty}, 'OBJECT')", None, "object"
        raise ValueError(k)

    def _value_message(self) -> str:
        k, kw = self.kind, self.kw
        if k == "enum":
            return "not one of the allowed values"
        if k == "string" and "pattern" in kw:
            return kw.get("pattern_message", "bad format")
        if k == "string":
            return "length out of range"
        if k == "int":
            return "not an integer in range"
        if k == "literal":
            return f"must be {kw['value']}"
        return "out of range"


UUID = dict(pattern=UUID_RE, pattern_message="not a uuid")
ISO = dict(pattern=ISO_OFFSET_RE, pattern_message="not an ISO-8601 time with offset", time=True)
INT_MAX = 2_147_483_647  # the event log stores these fields as 32-bit integers

# Field rules of one inference event (wire names, in declaration order).
EVENT_FIELDS = [
    Field("eventId", "string", required=True, **UUID),
    Field("schemaVersion", "literal", required=True, value=1),
    Field("conversationId", "string", nullable=True, **UUID),
    Field("messageId", "string", nullable=True, **UUID),
    Field("sessionId", "string", nullable=True, max=128),
    Field("userId", "string", nullable=True, max=128),
    Field("provider", "string", required=True, min=1, max=64),
    Field("model", "string", required=True, min=1, max=128),
    Field("operation", "enum", values=OPERATIONS, default="chat"),
    Field("streamed", "bool", default=False),
    Field("capturedBy", "enum", values=CAPTURE_LAYERS, default="proxy"),
    Field("status", "enum", required=True, values=STATUSES),
    Field("finishReason", "string", nullable=True, max=64),
    Field("errorType", "enum", nullable=True, values=ERROR_TYPES),
    Field("errorMessage", "string", nullable=True, max=MAX_ERROR_MESSAGE_CHARS),
    Field("startedAt", "string", required=True, **ISO),
    Field("endedAt", "string", required=True, **ISO),
    Field("latencyMs", "int", required=True, min=0, max=MAX_LATENCY_MS),
    Field("ttftMs", "int", nullable=True, min=0, max=MAX_LATENCY_MS),
    Field("inputTokens", "int", nullable=True, min=0, max=INT_MAX),
    Field("outputTokens", "int", nullable=True, min=0, max=INT_MAX),
    Field("cacheReadTokens", "int", nullable=True, min=0, max=INT_MAX),
    Field("cacheWriteTokens", "int", nullable=True, min=0, max=INT_MAX),
    Field("inputPreview", "string", nullable=True, max=MAX_PREVIEW_CHARS),
    Field("outputPreview", "string", nullable=True, max=MAX_PREVIEW_CHARS),
    Field("redactionHits", "int", default=0, min=0, max=INT_MAX),
    Field("temperature", "number", nullable=True, min=0, max=2),
    Field("maxTokens", "int", nullable=True, gt=0, max=INT_MAX),
    Field("messageCount", "int", nullable=True, min=0, max=INT_MAX),
    Field("attributes", "object", default="{}"),
]
EVENT_KEYS = [f.key for f in EVENT_FIELDS]


def _staged(fields):
    out = []
    for f in fields:
        g = Field(f.key, f.kind, f.required, f.nullable, f.default, **f.kw)
        g.staged = True
        out.append(g)
    return out


STAGED_EVENT_FIELDS = _staged(EVENT_FIELDS)

ENVELOPE_KEYS = ["sdk", "sentAt", "events", "droppedSinceLastBatch"]
SDK_FIELDS = [
    Field("sdk.name", "string", required=True, max=64),
    Field("sdk.version", "string", required=True, max=32),
    Field("sdk.runtime", "string", default="node", max=64),
]


def _reason(path: str, rule_sql: str) -> str:
    return f"concat({_s(path + ': ')}, {rule_sql})"


def unknown_keys_sql(raw_json: str, known) -> str:
    return f"array_except(json_object_keys({raw_json}), array({_in(known)}))"


def field_reasons_sql(v: str, fields) -> str:
    return "array(" + ", ".join(_reason(f.key, f.rule(v)) for f in fields) + ")"


def cross_field_reasons_sql() -> str:
    """From the staged columns of the fields."""
    status, etype, ttft, lat = "_str_status", "_str_errorType", "_num_ttftMs", "_num_latencyMs"
    started, ended = "try_cast(_str_startedAt AS TIMESTAMP)", "try_cast(_str_endedAt AS TIMESTAMP)"
    return ("array("
            f"IF({status} = 'error' AND {etype} IS NULL, 'errorType: missing for a failed call (send unknown "
            f"when the cause is not known)', NULL), "
            f"IF({status} = 'ok' AND {etype} IS NOT NULL, 'errorType: set on a successful call', NULL), "
            f"IF({ttft} IS NOT NULL AND {ttft} > {lat}, 'ttftMs: first token after the end of the call', NULL), "
            f"IF({ended} < {started}, 'endedAt: earlier than startedAt', NULL))")


def validate_envelopes(lines: DataFrame, body_col: str = "body") -> DataFrame:
    """Envelope-only check. Adds ``env`` (variant), ``envelope_reasons`` and the
    envelope fields (sdk name/version/runtime, sent_at, dropped)."""
    v = "env"
    df = lines.withColumn(v, F.expr(f"try_parse_json({body_col})"))
    # typed read of the events array once (NULL when absent or not an array);
    # the raw body text serves the key check, so nothing is re-serialised
    df = df.withColumns({
        "_ev_present": F.expr(f"variant_get({v}, '$.events', 'variant') IS NOT NULL"),
        "_ev_arr": F.expr(f"try_variant_get({v}, '$.events', 'array<variant>')"),
        "_is_obj": F.expr(f"startswith(ltrim({body_col}), '{{')"),
    })
    ty_sdk = f"schema_of_variant(variant_get({v}, '$.sdk', 'variant'))"
    dropped = Field("droppedSinceLastBatch", "int", default=0, min=0)
    rules = [
        f"IF({v} IS NULL OR NOT _is_obj, '<root>: not an object', NULL)",
        f"IF(_is_obj AND size({unknown_keys_sql(body_col, ENVELOPE_KEYS)}) > 0, concat('<root>: unknown keys: ', array_join({unknown_keys_sql(body_col, ENVELOPE_KEYS)}, ', ')), NULL)",
        f"IF({ty_sdk} IS NULL OR NOT startswith({ty_sdk}, 'OBJECT'), 'sdk: missing or not an object', NULL)",
        *[_reason(f.key, f.rule(v)) for f in SDK_FIELDS],
        _reason("sentAt", Field("sentAt", "string", required=True, **ISO).rule(v)),
        f"CASE WHEN NOT _ev_present THEN 'events: missing' "
        f"WHEN _ev_arr IS NULL THEN 'events: not an array' "
        f"WHEN size(_ev_arr) < 1 THEN 'events: empty' "
        f"WHEN size(_ev_arr) > {MAX_BATCH_EVENTS} THEN 'events: more than {MAX_BATCH_EVENTS}' END",
        _reason("droppedSinceLastBatch", dropped.rule(v)),
    ]
    df = df.withColumn("envelope_reasons", F.expr(
        f"IF({v} IS NULL, array('<root>: not JSON'), array_compact(array({', '.join(rules)})))"))
    return df.withColumns({
        "sdk_name": F.expr(f"try_variant_get({v}, '$.sdk.name', 'string')"),
        "sdk_version": F.expr(f"try_variant_get({v}, '$.sdk.version', 'string')"),
        "sdk_runtime": F.expr(f"coalesce(try_variant_get({v}, '$.sdk.runtime', 'string'), 'node')"),
        "sent_at": F.expr(f"try_cast(try_variant_get({v}, '$.sentAt', 'string') AS TIMESTAMP)"),
        "dropped": F.expr(f"IF(schema_of_variant(variant_get({v}, '$.droppedSinceLastBatch', 'variant')) "
                          f"IN ({_in(NUMERIC_TYPES)}) OR startswith(schema_of_variant(variant_get({v}, "
                          f"'$.droppedSinceLastBatch', 'variant')), 'DECIMAL'), "
                          f"try_variant_get({v}, '$.droppedSinceLastBatch', 'double'), NULL)"),
    })


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row per event of every valid envelope, with its 0-based position and
    the envelope fields. The events array is bounded (<= 500 per envelope)."""
    return envelopes.select(
        "batch_id", "sdk_name", "sdk_version", "sdk_runtime", "sent_at",
        F.expr("coalesce(dropped, 0D)").alias("dropped"),
        F.expr("posexplode(IF(size(envelope_reasons) = 0, _ev_arr, NULL))").alias("position", "event"))  # none of a rejected one


def explode_all(envelopes: DataFrame) -> DataFrame:
    """Like :func:`explode_envelopes` but keeps every envelope: a rejected
    envelope yields exactly one row with NULL position and event, so a single
    pass carries both envelope and event verdicts. The columns that a load adds
    to its lines (``copies``, ``_line``) are kept; ``body`` only of rejected envelopes, so that no
    event carries the text of all of its batch."""
    return envelopes.select(
        *[c for c in envelopes.columns if c in ("copies", "_line")], "batch_id",
        F.expr("IF(size(envelope_reasons) = 0, NULL, body)").alias("body"), "sdk_name", "sdk_version", "sdk_runtime", "sent_at", "envelope_reasons",
        F.expr("coalesce(dropped, 0D)").alias("dropped"),
        F.expr("size(envelope_reasons) = 0").alias("envelope_ok"),
        F.expr("posexplode_outer(IF(size(envelope_reasons) = 0, _ev_arr, NULL))").alias("position", "event"))


def validate_events(events: DataFrame, v: str = "event") -> DataFrame:
    """Add ``raw`` (event JSON), ``event_id`` (if a string), ``field_reasons``,
    ``unknown_keys`` and ``reasons`` (field + strict-key + cross-field rules;
    cross-field rules apply only when every field is well-typed)."""
    df = events.withColumns({"raw": F.expr(f"to_json({v})"), MEMBERS: F.expr(f"try_variant_get({v}, '$', 'map<string, variant>')")})
    stage = {"_is_obj": f"{MEMBERS} IS NOT NULL"}
    for f in EVENT_FIELDS:
        stage.update(f.staging(MEMBERS))
    df = df.withColumns({k: F.expr(e) for k, e in stage.items()})
    df = df.withColumn("event_id", F.expr("IF(_ty_eventId = 'STRING', _str_eventId, NULL)"))
    df = df.withColumn("field_reasons", F.expr(
        f"IF(_is_obj, array_compact({field_reasons_sql(v, STAGED_EVENT_FIELDS)}), "
        "array('<root>: not an object'))"))
    df = df.withColumn("unknown_keys", F.expr(
        f"IF(_is_obj, array_except(map_keys({MEMBERS}), array({_in(EVENT_KEYS)})), CAST(array() AS array<string>))"))
    df = df.withColumn("cross_reasons", F.expr(
        f"IF(_is_obj AND size(field_reasons) = 0, array_compact({cross_field_reasons_sql()}), "
        "CAST(array() AS array<string>))"))
    df = df.withColumn("reasons", F.expr(
        "concat(field_reasons, IF(size(unknown_keys) > 0, array(concat('<root>: unknown keys: ', "
        "array_join(unknown_keys, ', '))), CAST(array() AS array<string>)), cross_reasons)"))
    return df.drop(*stage.keys())


def reason_paths(col: str = "reasons"):
    """Sorted distinct paths of a reason array ('path: message' -> 'path')."""
    return F.expr(f"array_sort(array_distinct(transform({col}, r -> substring_index(r, ': ', 1))))")


def typed_events(valid: DataFrame, v: str = "event", ingested_at: str | None = None,
                 keep: bool = False) -> DataFrame:
    """Validated wire events -> snake_case event rows (A2 + B5 + C10).

    Absent optional fields take their defaults; ``created_at`` and ``client_ts``
    are both the call's own ``startedAt``; ``sdk_version`` comes from the
    envelope; ``ingested_at`` is the load time (``ingested_at`` literal or
    current_timestamp()).
    """
    if MEMBERS not in valid.columns:
        valid = valid.withColumn(MEMBERS, F.expr(f"try_variant_get({v}, '$', 'map<string, variant>')"))

    def g(key, typ):
        return member(MEMBERS, key, typ)
    started = f"try_cast({g('startedAt', 'string')} AS TIMESTAMP)"
    ing = f"TIMESTAMP '{ingested_at}'" if ingested_at else "current_timestamp()"
    carried = (["*", f"{g('eventId', 'string')} AS wire_event_id"] if keep else ["batch_id", "position"])
    if keep:
        valid = valid.withColumnRenamed("event_id", "_wire_id")
        carried = ["*", "_wire_id AS wire_event_id"]
    out = valid.selectExpr(
        *carried,
        f"{g('eventId', 'string')} AS event_id",
        f"{started} AS created_at",
        f"{g('conversationId', 'string')} AS conversation_id",
        f"{g('messageId', 'string')} AS message_id",
        f"{g('sessionId', 'string')} AS session_id",
        f"{g('userId', 'string')} AS user_id",
        f"{g('provider', 'string')} AS provider",
        f"{g('model', 'string')} AS model",
        f"coalesce({g('operation', 'string')}, 'chat') AS operation",
        f"coalesce({g('streamed', 'boolean')}, false) AS streamed",
        f"coalesce({g('capturedBy', 'string')}, 'proxy') AS captured_by",
        f"{g('status', 'string')} AS status",
        f"{g('finishReason', 'string')} AS finish_reason",
        f"{g('errorType', 'string')} AS error_type",
        f"{g('errorMessage', 'string')} AS error_message",
        f"try_cast({g('latencyMs', 'double')} AS INT) AS latency_ms",
        f"try_cast({g('ttftMs', 'double')} AS INT) AS ttft_ms",
        f"try_cast({g('inputTokens', 'double')} AS INT) AS input_tokens",
        f"try_cast({g('outputTokens', 'double')} AS INT) AS output_tokens",
        f"try_cast({g('cacheReadTokens', 'double')} AS INT) AS cache_read_tokens",
        f"try_cast({g('cacheWriteTokens', 'double')} AS INT) AS cache_write_tokens",
        f"try_cast({g('temperature', 'double')} AS FLOAT) AS temperature",
        f"try_cast({g('maxTokens', 'double')} AS INT) AS max_tokens",
        f"try_cast({g('messageCount', 'double')} AS INT) AS message_count",
        f"{g('inputPreview', 'string')} AS input_preview",
        f"{g('outputPreview', 'string')} AS output_preview",
        f"try_cast(coalesce({g('redactionHits', 'double')}, 0) AS INT) AS redaction_hits",
        f"{started} AS client_ts",
        f"{ing} AS ingested_at",
        "sdk_version",
        "1 AS schema_version",
        f"coalesce(to_json({MEMBERS}['attributes']), '{{}}') AS attributes",
    )
    return out.drop("_wire_id", MEMBERS) if keep else out


def quarantine(envelopes: DataFrame, checked: DataFrame, now: str | None = None) -> DataFrame:
    """Dead-letter rows: one per rejected envelope (stage 'envelope', whole body
    kept) and one per rejected event (stage 'validate', event JSON kept; the
    event id is kept whenever it is a string, even a malformed one). The error
    text is kept whole."""
    ts = f"TIMESTAMP '{now}'" if now else "current_timestamp()"
    env = rows_where(envelopes, "size(envelope_reasons) > 0").selectExpr(
        "concat('b', CAST(batch_id AS STRING)) AS dlq_id", "batch_id", "CAST(NULL AS INT) AS position",
        "body AS payload", "CAST(NULL AS STRING) AS event_id", "'envelope' AS stage",
        "envelope_reasons AS reasons", "sdk_version")
    ev = rows_where(checked, "size(reasons) > 0").selectExpr(
        "concat('b', CAST(batch_id AS STRING), '-', CAST(position AS STRING)) AS dlq_id", "batch_id",
        "position", "to_json(event) AS payload", "event_id", "'validate' AS stage", "reasons", "sdk_version")
    return _parked(env.unionByName(ev), ts)


def quarantine_all(rows: DataFrame, now: str | None = None) -> DataFrame:
    """The dead letters of :func:`quarantine` from one row set (:func:`explode_all`, validated), so that each
    envelope is parsed and checked once. Only what is parked is written as JSON."""
    ts = f"TIMESTAMP '{now}'" if now else "current_timestamp()"
    return _parked(rows_where(rows, "NOT envelope_ok OR size(reasons) > 0").selectExpr(
        "concat('b', CAST(batch_id AS STRING), IF(envelope_ok, concat('-', CAST(position AS STRING)), '')) AS dlq_id",
        "batch_id", "position", "IF(envelope_ok, to_json(event), body) AS payload", "IF(envelope_ok, event_id, NULL) AS event_id",
        "IF(envelope_ok, 'validate', 'envelope') AS stage", "IF(envelope_ok, reasons, envelope_reasons) AS reasons", "sdk_version"), ts)


def _parked(rejects: DataFrame, ts: str) -> DataFrame:
    return rejects.selectExpr(
        "*", "array_join(reasons, '; ') AS error",
        "1 AS attempts", f"{ts} AS first_seen_at", f"{ts} AS last_seen_at",
        "CAST(NULL AS TIMESTAMP) AS replayed_at")
