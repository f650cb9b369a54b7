"""All queries over the star-schema tables by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lodeloom import binding

FLAGSHIP = "biz1_proximity"
#: Modules that register queries.
MODULES = ("functions.scalars", "operators.filters", "operators.aggregates", "operators.windows", "operators.joins", "plans.jobs", "plans.text_search", "plans.dataset", "plans.calendar", "plans.extras", "sources.places", "streaming.machines", "sinks.writes")

for _m in MODULES:
    import_module(f"lodeloom.{_m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(binding.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(binding.SQL)
