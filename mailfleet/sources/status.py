"""Status dumps of the replica and the replicator as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The keys the replica status is read for.
STATUS_KEYS = (
    "Slave_IO_Running", "Slave_SQL_Running", "Seconds_Behind_Master", "Last_Errno", "Last_Error",
    "Last_IO_Error", "Gtid_IO_Pos",
)


def parse_status_dump(
    df: DataFrame, keys: Sequence[str] = STATUS_KEYS, col: str = "dump", keep: Sequence[str] = ()
) -> DataFrame:
    """``Key: value`` lines as one wide row per sample. A dump is one value, so its keys are
    taken out in place: no pivot and no shuffle. An absent key is null, an empty value ''."""
    cells = []
    for key in keys:
        line = rf"(?m)^[ \t]*{key}:[ \t]*(.*)$"
        there = F.contains(F.col(col), F.lit(f"{key}:"))
        cells.append(F.when(there, F.regexp_extract(col, line, 1)).alias(key))
    return df.select(*keep, *cells)


def parse_queue_status(df: DataFrame, col: str = "dump", keep: Sequence[str] = ()) -> DataFrame:
    """One row per counter line: state (queued, waiting), class and count; no number means 0."""
    line = r"^(Queued|Waiting) '[^']+' requests\s+\S+\s*$"
    quoted = F.split("__line", "'")
    return (
        df.select(*keep, F.explode(F.split(col, "\n")).alias("__line"))
        .where(F.col("__line").rlike(line))
        .select(
            *keep,
            F.lower(F.trim(quoted[0])).alias("state"),
            quoted[1].alias("class"),
            F.coalesce(
                F.substring_index(F.trim(quoted[2]), " ", -1).try_cast("bigint"), F.lit(0)
            ).alias("requests"),
        )
    )
