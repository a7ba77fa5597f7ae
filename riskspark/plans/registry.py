"""All registered queries of the analytics library."""

from __future__ import annotations

from riskspark.plans import market, q_basics, q_market, q_more, q_serving, q_sinks, q_views
from riskspark.plans.query import ALL

MODULES = (q_basics, q_market, q_serving, q_more, q_sinks, q_views)


def queries():
    return {name: q.run for name, q in ALL.items()}


def oracle_sql():
    return {name: text for name, q in ALL.items() if (text := q.text(market.CTES)) is not None}


def flagship(spark, sf):
    """Top managers by exposure with VaR usage under every scenario."""
    return ALL["Q02_top_managers"].run(spark, sf)
