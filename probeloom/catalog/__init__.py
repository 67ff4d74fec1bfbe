"""Registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations


def queries() -> dict:
    from probeloom.catalog import cohort_queries, plan_queries, vector_queries

    return {**cohort_queries.QUERIES, **vector_queries.QUERIES, **plan_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    from probeloom.catalog import cohort_sql, plan_queries, vector_sql

    return {**cohort_sql.SQL, **vector_sql.SQL, **plan_queries.SQL}
