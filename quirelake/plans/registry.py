"""All registered queries: importing a module of queries registers them."""

from quirelake.plans import queries, state, texts

QUERIES, SQL = queries.QUERIES, queries.SQL

__all__ = ["QUERIES", "SQL", "queries", "state", "texts"]
