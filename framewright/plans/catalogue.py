"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from framewright.plans import object_queries, pipeline_queries

QUERIES = {**object_queries.QUERIES, **pipeline_queries.QUERIES}
SQL = {**object_queries.SQL, **pipeline_queries.SQL}
