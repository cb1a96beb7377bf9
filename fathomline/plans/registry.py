"""All queries of the engine and the SQL that states the same results."""

from . import bytes_queries, event_queries, model_queries, stream_queries

QUERIES = bytes_queries.QUERIES | event_queries.QUERIES | model_queries.QUERIES | stream_queries.QUERIES
ORACLES = bytes_queries.ORACLES | event_queries.ORACLES | model_queries.ORACLES | stream_queries.ORACLES
