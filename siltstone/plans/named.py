"""All named queries with their SQL."""

from . import queries, stage_queries, whole_queries

QUERIES = queries.QUERIES | whole_queries.QUERIES | stage_queries.QUERIES
ORACLES = queries.ORACLES | whole_queries.ORACLES | stage_queries.ORACLES
