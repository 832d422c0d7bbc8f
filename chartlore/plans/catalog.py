"""All registered queries: name -> (callable(spark, sf_dir), oracle SQL)."""
from chartlore.plans import history_queries, ingest_queries, report_queries

QUERIES = {**ingest_queries.QUERIES, **history_queries.QUERIES, **report_queries.QUERIES}
