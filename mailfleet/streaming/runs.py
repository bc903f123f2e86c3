"""Starting streams and keeping their results."""

from __future__ import annotations

import datetime
import functools
import math
import re
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailfleet.plans.session import shared_folder
from mailfleet.sources.fixtures import TABLES, view_sql, with_views

BATCH = "batch_id"

# Files of one trigger: a backlog is worked off in pieces, which bounds what a key can hold.
FILES_PER_BATCH = 1000

# Rows of one trigger of a backlog that is replayed in the order of time, and the files they lie in.
REPLAYED_ROWS = 1_000_000
REPLAYED_FILES = 8


class StreamViews:
    """The views of ``fixtures.Views`` over streams: listed tables are read as streams, the
    others as they are."""

    def __init__(
        self, spark: SparkSession, folder: str, streams: Sequence[str],
        files_per_batch: int = FILES_PER_BATCH,
    ) -> None:
        self.spark, self.folder, self.streams = spark, folder, tuple(streams)
        self.files_per_batch = files_per_batch

    def __call__(self, name: str) -> DataFrame:
        if name not in TABLES:
            return self.sql(view_sql()[name])
        path = f"{self.folder}/{name}.parquet"
        if name not in self.streams:
            return self.spark.read.parquet(path)
        reader = self.spark.readStream.schema(self.spark.read.parquet(path).schema)
        reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
        # A pattern, because the source takes a plain path for a folder, and this may be a file.
        return reader.parquet(f"{self.folder}/{name}.parque[t]")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for table in TABLES:
            if re.search(rf"\b{table}\b", full):
                self(table).createOrReplaceTempView(table)
        return self.spark.sql(full)


def replayed(inputs: Sequence[DataFrame], at: str, name: str) -> list[DataFrame]:
    """Stored inputs, of the same columns, as streams that bring their rows in the order of ``at``.

    A table that is read as it lies brings all times at once, so nothing can leave the state of a job
    before the state has held every row. Here the watermark moves from trigger to trigger, and a state holds
    what its deadline spans and one trigger. All inputs lie in one folder of files that follow each
    other in time and are read at one pace, so none runs ahead of another and no row comes late. Rows
    without a time come first.
    """
    spark = inputs[0].sparkSession
    numbered = [df.withColumn("__input", F.lit(i)) for i, df in enumerate(inputs)]
    rows = functools.reduce(DataFrame.unionByName, numbered)
    triggers = max(1, math.ceil(rows.count() / REPLAYED_ROWS))
    path = shared_folder(spark, f"{name}-backlog")
    # Rows of one time may be many: they are split by the other columns.
    by = [at, *(c for c in rows.columns if c != at)]
    rows.repartitionByRange(triggers * REPLAYED_FILES, *by).write.parquet(path)
    at_once = math.ceil(_date_in_order(spark, path) / triggers)
    reader = spark.readStream.schema(_nullable(rows)).option("maxFilesPerTrigger", max(1, at_once))
    stream = reader.parquet(path)
    return [stream.where(F.col("__input") == i).drop("__input") for i in range(len(inputs))]


def _date_in_order(spark: SparkSession, path: str) -> int:
    """Dates the files of a folder by their numbers, as a stream reads the oldest first; returns how many."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = {s.getPath().getName(): s.getPath() for s in fs.listStatus(place)}
    order = sorted((n for n in files if n.startswith("part-")), key=lambda n: (int(n.split("-")[1]), n))
    begin = (int(time.time()) - len(order)) * 1000
    dates = [begin + 1000 * i for i in range(len(order))]
    for n, date in zip(order, dates, strict=True):
        fs.setTimes(files[n], date, -1)
    kept = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(place)}
    if [kept[n] for n in order] != dates:
        raise RuntimeError(f"{path}: this file system does not keep the dates that files are given")
    return len(order)


def few_partitions(spark: SparkSession) -> dict[str, str]:
    """Settings of a stream of many small triggers: two partitions a core, if the session has more.

    Every trigger writes files for each partition of a state, also where few rows come, and the
    adaptive planner does not merge them.
    """
    key = "spark.sql.shuffle.partitions"
    return {key: str(min(int(spark.conf.get(key)), 2 * spark.sparkContext.defaultParallelism))}


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps each batch in its own folder; a batch that is run again replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    return write


def run_available(
    stream: DataFrame, name: str, mode: str = "append",
    write: Callable[[DataFrame, int], None] | None = None, path: str | None = None,
    checkpoint: str | None = None, settings: Mapping[str, str] | None = None,
) -> DataFrame:
    """Processes what there is and returns all written rows, with their ``batch_id``.

    ``settings`` hold for this query alone: a query takes the session's when it starts.
    """
    spark = stream.sparkSession
    out = path or shared_folder(spark, name)
    before = {key: spark.conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        spark.conf.set(key, value)
    try:
        query = _started(stream, name, mode, write or write_batches(out), checkpoint)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    fields = T.StructType([*stream.schema.fields, T.StructField(BATCH, T.IntegerType())])
    return spark.read.schema(fields).option("basePath", out).parquet(f"{out}/{BATCH}=*")


def _started(stream: DataFrame, name: str, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str | None):
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint or shared_folder(stream.sparkSession, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )


# Later than any deadline of any input.
CLOSING = datetime.datetime(2200, 1, 1)


def _nullable(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])


def run_closed(
    job: Callable[..., DataFrame], inputs: Sequence[DataFrame], closing: Sequence[dict], name: str,
    **run,
) -> DataFrame:
    """All rows of ``job(*inputs)``, also those that wait for time to pass.

    After the inputs are worked off, each gets one closing row whose time lies past every
    deadline (``closing``, by column), in a second run over the same progress folder. That moves
    the watermark, so all state is written out. The caller filters what the closing rows cause.
    ``run`` is passed to ``run_available``.
    """
    spark = inputs[0].sparkSession
    folders, united = [], []
    for stream in inputs:
        folders.append(shared_folder(spark, f"{name}-closing"))
        shape = _nullable(stream)
        spark.createDataFrame([], shape).write.parquet(folders[-1])
        united.append(stream.unionByName(spark.readStream.schema(shape).parquet(folders[-1])))
    rows = job(*united)
    place = {"path": shared_folder(spark, name), "checkpoint": shared_folder(spark, f"{name}-progress"), **run}
    run_available(rows, name, **place)
    for stream, folder, row in zip(inputs, folders, closing, strict=True):
        cells = tuple(row.get(c) for c in stream.columns)
        spark.createDataFrame([cells], _nullable(stream)).write.mode("append").parquet(folder)
    return run_available(rows, name, **place)


def last_update(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of rows written in update mode, the newest of each key."""
    rest = [c for c in rows.columns if c not in key and c != BATCH]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), BATCH).alias("__r"))
    return newest.select(*key, *[F.col(f"__r.{c}") for c in rest])
