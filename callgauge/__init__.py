"""callgauge — LLM-call telemetry analytics expressed as Spark DataFrame / SQL /
Structured Streaming jobs.

Layout:
  sources/    readers, adapters from the shared test tables, event-log sink
  functions/  Column builders (histograms, redaction, pricing, time bins)
  operators/  DataFrame -> DataFrame transforms (validate, enrich, rollup,
              metrics, conversations, spans, audits)
  plans/      composed jobs (batch ingest, dashboard bundle) and the query
              registry used by ``__spark_entry__``
  streaming/  Structured Streaming ingest and rollup
"""

from callgauge.session import get_spark

__all__ = ["get_spark"]
