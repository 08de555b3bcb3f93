"""The registered opN queries and their oracle SQL."""

from __future__ import annotations

from tidemark.llm import queries as Q


def queries():
    return dict(Q.QUERIES)


def oracle_sql():
    return dict(Q.ORACLES)
