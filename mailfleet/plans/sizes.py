"""Broadcasting a derived table only after its size has been looked at.

Spark knows the size of a stored table and broadcasts small ones by itself. Of a table that comes
out of joins, aggregates or selective filters it only has a crude estimate, mostly far too high.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 200_000
MAX_BYTES = 32 * 1024 * 1024


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``df`` with a broadcast hint when it is within both bounds, else unchanged.

    Looks at no more than ``max_rows + 1`` rows. Unchanged, a join is shuffled and its hot keys
    are split by the adaptive planner.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    return F.broadcast(df) if seen.n <= max_rows and seen.bytes <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of an input with fewer splits than cores out to all cores.

    A small table in one file is one task, however costly its rows are to parse. A large input
    has more splits than that and is left as it is: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
