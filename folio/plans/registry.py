"""Registered queries of the core."""

from __future__ import annotations

from folio.plans import extension_queries, score_queries, text_queries  # noqa: F401
from folio.plans.catalog import QUERIES, SQL


def entry(spark, sf_dir):
    """The flagship: score history to the winner of each category."""
    return QUERIES["entry_consensus"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
