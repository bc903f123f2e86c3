"""Input views over the given tables, as Spark DataFrames and as SQL text.

The same text serves both sides of a comparison: Spark resolves it against the
parquet files, and ``with_views`` puts it in front of an oracle statement.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mailfleet.plans.sizes import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables whose rows are rendered to log lines or cut into words.
TEXT_TABLES = ("events", "documents")

_WORD = re.compile(r"[a-z_0-9]+")


@lru_cache(maxsize=1)
def view_sql() -> dict[str, str]:
    text = (Path(__file__).parent / "views.sql").read_text()
    parts = re.split(r"^-- view: (\w+)$", text, flags=re.M)
    return {name: body.strip() for name, body in zip(parts[1::2], parts[2::2])}


def needed_views(sql: str) -> list[str]:
    """Views used by ``sql``, dependencies first."""
    views, out = view_sql(), []

    def visit(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text.lower())):
            if word in views and word not in out:
                visit(views[word])
                out.append(word)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """``sql`` for the oracle: one statement, with the views it uses as common table expressions."""
    return _combined(sql).replace("explode(array(", "unnest(list_value(")


def _combined(sql: str) -> str:
    ctes = ",\n".join(f"{v} as (\n{view_sql()[v]}\n)" for v in needed_views(sql))
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):].strip()}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:].strip()}"
    return f"with {ctes}\n{body}"


class Views:
    """Reads a data folder: ``views("orders")`` is a table, ``views("fx_msg")`` a view."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            if name not in self._tables:
                table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self._tables[name] = spread(table) if name in TEXT_TABLES else table
            return self._tables[name]
        return self.sql(view_sql()[name])

    def sql(self, text: str) -> DataFrame:
        full = _combined(text)
        words = set(_WORD.findall(full.lower()))
        for table in TABLES:
            if table in words:
                self(table).createOrReplaceTempView(table)
        return self.spark.sql(full)
