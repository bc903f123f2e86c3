"""Tables that outlive an executor, and bounded filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; it goes when Spark ends.

    Where the setting is absent a temporary folder is used, on a local master only (tests).
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="mailfleet-llm-")
        spark.conf.set(SETTING, base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, purpose: str, row_group_bytes: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` stored once in the shared folder and read back: computed once, short lineage.

    A writer holds a row group in memory; ``row_group_bytes`` bounds it for tables of whole texts. Rows are stored
    apart by the columns ``by``, so that a part is read alone.
    """
    path = folder(df.sparkSession, purpose)
    writer = df.write if row_group_bytes is None else df.write.option("parquet.block.size", row_group_bytes)
    writer.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_rows(docs: DataFrame, id_col: str, digest: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and digest are in no row of ``gone`` (``_gone, _gone_sha``); null ids are equal.

    The digest stands beside the whole row, so no column of ``docs`` can clash with it.
    """
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), digest.alias("_sha"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha"))
    return rows.join(gone, same, "left_anti").select("_doc.*")


def some_of(keys: DataFrame, key: Column, rows: DataFrame, row_key: Column, bits: int = 1 << 20) -> DataFrame:
    """``rows`` with a boolean ``candidate``: false only where the key is not among ``keys``.

    The keys are folded into a bitmap of ``bits`` bits, at most ``bits / 64`` rows, which is small
    at any number of keys and may therefore be broadcast; more keys only mean more false candidates.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(slot.alias("_b")).groupBy(F.shiftright("_b", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("_bits"))
    probe = F.pmod(F.xxhash64(row_key), F.lit(bits))
    joined = rows.withColumn("_b", probe).withColumn("_word", F.shiftright("_b", 6)).join(
        F.broadcast(words), "_word", "left")
    hit = F.expr("coalesce(shiftright(_bits, cast(_b & 63 as int)) & 1L, 0L) = 1L")
    return joined.withColumn("candidate", hit).drop("_b", "_word", "_bits")
