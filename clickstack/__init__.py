"""clickstack: search-performance analytics as Spark DataFrame jobs.

Layout:
  sources/    tables: derived fixtures, the partitioned warehouse, native exports, ingest
  functions/  Column builders: filters, dates, keys, text, status classifiers
  operators/  aggregations, top-k, reports, grouping, ledger and ops jobs
  plans/      multi-step jobs: precompute for every target, materialized groups, daily run
  streaming/  Structured Streaming jobs: slice ingest and attempt-log alerts
"""

from clickstack.session import build_session, checkpoint_root  # noqa: F401
