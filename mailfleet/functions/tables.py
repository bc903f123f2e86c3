"""Table functions for SQL text: one row per item of a list, per mechanism of a sender policy.

They are SQL themselves, so a lateral join with one is planned as a plain generator, without Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    # Trimmed, non-empty items; positions count what is left, from 1.
    "list_items": """
        (items string) returns table (position int, value string) return
        select pos + 1, item from posexplode(
            filter(transform(split(list_items.items, ','), x -> trim(x)), x -> x <> '')) as t(pos, item)""",
    # Mechanisms after the version, positions from 1; no row for another record.
    "spf_mechanisms": """
        (record string) returns table (position int, mechanism string) return
        select pos, item from posexplode(
            case when startswith(trim(spf_mechanisms.record), 'v=spf1')
                 then split(trim(spf_mechanisms.record), '\\\\s+') end) as t(pos, item) where pos > 0""",
}


def register(spark: SparkSession) -> None:
    """Makes ``list_items`` and ``spf_mechanisms`` known to the session's SQL.

    A null or empty argument gives no row. ``select … from alias a, lateral list_items(a.goto) t``
    gives one row per target of each alias.
    """
    for name, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name} {body.strip()}")
