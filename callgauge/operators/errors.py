"""Error classification over an error log (one row per failed call):
shim-side classification (C11), app-side normalisation (C12) and the
retryable flag (C13). Each is one CASE chain over columns — no joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.constants import RETRYABLE_ERROR_TYPES


def _has(msg: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains(lower({msg}), '{n}')" for n in needles) + ")"


def classify_error_sql(provider="provider", name="error_name", code="error_code", status="http_status",
                       msg="message") -> str:
    """Instrumentation-side taxonomy, first match wins. Anthropic calls use the
    anthropic rules; every other provider the OpenAI-compatible ones (which
    have no 408 rule and add content_filter)."""
    anth = f"{provider} = 'anthropic'"
    return f"""(CASE
      WHEN {name} = 'APIUserAbortError' THEN 'cancelled'
      WHEN {name} = 'APIConnectionTimeoutError' OR (NOT {anth} AND {code} = 'ETIMEDOUT') THEN 'timeout'
      WHEN {name} = 'APIConnectionError' THEN 'network'
      WHEN {status} IN (401, 403) THEN 'auth'
      WHEN {anth} AND {status} = 408 THEN 'timeout'
      WHEN {status} = 429 THEN 'rate_limit'
      WHEN {status} >= 500 THEN 'server_error'
      WHEN {status} = 400 AND {anth} AND {_has(msg, 'context', 'too long')} THEN 'context_length'
      WHEN {status} = 400 AND NOT {anth} AND {_has(msg, 'context', 'maximum context')} THEN 'context_length'
      WHEN {status} = 400 AND NOT {anth} AND {_has(msg, 'content')} THEN 'content_filter'
      WHEN {status} = 400 THEN 'invalid_request'
      ELSE 'unknown' END)"""


def status_type_sql(status: str) -> str:
    return (f"(CASE WHEN {status} IS NULL THEN 'unknown' WHEN {status} IN (401, 403) THEN 'auth' "
            f"WHEN {status} = 408 THEN 'timeout' WHEN {status} = 429 THEN 'rate_limit' "
            f"WHEN {status} >= 500 THEN 'server_error' WHEN {status} >= 400 THEN 'invalid_request' "
            f"ELSE 'unknown' END)")


API_ERRORS = ("'APIError', 'APIUserAbortError', 'APIConnectionError', 'APIConnectionTimeoutError'")


def normalise_error_sql(provider="provider", name="error_name", status="http_status", msg="message") -> str:
    """Application-side taxonomy: a user abort becomes 'unknown' (and is not
    retryable); otherwise status mapping refined by the 400 message; 529 is an
    overloaded server."""
    anth = f"{provider} = 'anthropic'"
    return f"""(CASE
      WHEN {name} = 'APIUserAbortError' THEN 'unknown'
      WHEN {name} = 'APIConnectionTimeoutError' THEN 'timeout'
      WHEN {name} = 'APIConnectionError' THEN 'network'
      WHEN {name} NOT IN ({API_ERRORS}) THEN 'unknown'
      WHEN {status} = 400 AND {anth} AND {_has(msg, 'context', 'too long', 'max_tokens')} THEN 'context_length'
      WHEN {status} = 400 AND NOT {anth} AND {_has(msg, 'context', 'maximum context')} THEN 'context_length'
      WHEN {status} = 400 AND NOT {anth} AND {_has(msg, 'content', 'policy')} THEN 'content_filter'
      WHEN {anth} AND {status} = 529 THEN 'server_error'
      ELSE {status_type_sql(status)} END)"""


def retryable_sql(error_type: str) -> str:
    vals = ", ".join(f"'{t}'" for t in RETRYABLE_ERROR_TYPES)
    return f"coalesce({error_type} IN ({vals}), false)"


def classify_errors(log: DataFrame) -> DataFrame:
    return log.withColumn("error_type", F.expr(classify_error_sql()))


def normalise_errors(log: DataFrame) -> DataFrame:
    n = log.withColumn("error_type", F.expr(normalise_error_sql()))
    not_retryable = "error_name = 'APIUserAbortError' OR error_name NOT IN (" + API_ERRORS + ")"
    return n.withColumn("retryable", F.expr(f"IF({not_retryable}, false, {retryable_sql('error_type')})"))


def with_retryable(df: DataFrame, error_type: str = "error_type") -> DataFrame:
    return df.withColumn("retryable", F.expr(retryable_sql(error_type)))
