"""Named queries over a data folder, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailfleet.plans.session import tune
from mailfleet.sources.fixtures import Views, with_views
from mailfleet.sources.schema import conform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def query(name: str, oracle: str | None = None):
    """Registers a function of the views under a name."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Views(tune(spark), folder))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run.__name__ = run.__qualname__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return build

    return register


def directory(views: Views) -> dict[str, DataFrame]:
    """The directory tables the views describe, in the schema's shape."""
    alias = views("fx_alias").withColumnRenamed("goto_list", "goto")
    return {
        "domain": conform(views("fx_domain"), "domain"),
        "alias_domain": conform(views("fx_alias_domain"), "alias_domain"),
        "alias": conform(alias, "alias"),
        "mailbox": conform(views("fx_mailbox"), "mailbox"),
    }
