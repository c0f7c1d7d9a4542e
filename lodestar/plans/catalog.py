"""All queries of the library by name, each with its SQL counterpart where there is one.

Names begin with the operators they show.  Every query takes (spark, sf_dir) and works on
whole tables; limits occur only where the operator is a top-k or a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of `Views` under `name`, with its SQL."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from lodestar.plans import branches, evaluation, metering, more, relational, retrieval, streams, telemetry, text, understanding  # noqa: E402, F401
