"""Structured Streaming jobs: queue-drain ingest with exactly-once rollup
deltas, native watermarked de-duplication and minute rollup, and live span
assembly."""
