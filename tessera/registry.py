"""All registered queries and their SQL equivalents."""

from .plans import cluster_queries, file_queries, model_queries, more_queries, queries

assert file_queries and model_queries and more_queries  # they register their queries

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
