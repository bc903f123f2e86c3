"""Message state kept by a change stream, and alerts sent once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailfleet.operators.messages import merge_stores
from mailfleet.streaming.runs import BATCH, run_available

KEY = ("username", "guid")

# Triggers that a reader merges over the base at most.
COMPACT_EVERY = 50


def _newest(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """State of each message: the highest modification wins and a tombstone stays. It does not
    depend on the order of the changes, and applying a change twice changes nothing."""
    return changes.groupBy(*key).agg(
        F.max(F.struct("modseq", "flags", "folder")).alias("top"),
        F.max("expunged").alias("expunged"),
    ).select(
        *key, F.col("top.modseq").alias("modseq"), F.col("top.flags").alias("flags"),
        F.col("top.folder").alias("folder"), "expunged",
    )


def message_state_stream(
    changes: DataFrame, path: str, compact_every: int = COMPACT_EVERY, **run: str
) -> DataFrame:
    """Follows a change stream and keeps the state of every message below ``path``.

    Each trigger adds its own newest state per message in its own folder, so a trigger that is
    repeated replaces itself and no trigger rewrites older state. Every ``compact_every`` triggers
    they are merged into the base (``compact``), so reading never costs more than the base and that many
    triggers.
    """

    def write(df: DataFrame, batch: int) -> None:
        _newest(df).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")
        if compact_every and (batch + 1) % compact_every == 0:
            compact(df.sparkSession, path)

    run_available(changes, "messages", write=write, path=path, **run)
    return message_state(changes.sparkSession, path)


class _Place:
    """A state folder: numbered triggers, bases, and pointers to bases.

    A pointer is a small file named after the last trigger that its base holds, with the base's folder
    as content. It is written aside and renamed once, so a reader sees the base before or the one after;
    bases and pointers are never changed. The pointer with the highest number counts.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        place = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def triggers(self) -> list[int]:
        """Triggers that were written to their end."""
        numbers = [int(n.partition("=")[2]) for n in self._names(self.path) if n.startswith(f"{BATCH}=")]
        return sorted(n for n in numbers if self._fs.exists(self._at(f"{self.path}/{BATCH}={n}/_SUCCESS")))

    def pointers(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/pointer") if n.isdigit())

    def base(self, version: int) -> str:
        stream = self._fs.open(self._at(f"{self.path}/pointer/{version:012}"))
        try:
            return f"{self.path}/base/{stream.readUTF()}"
        finally:
            stream.close()

    def point(self, version: int, base: str) -> None:
        """Makes ``base`` the one that counts, at once; a version has one base for ever."""
        aside = self._at(f"{self.path}/pointer/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        stream.writeUTF(base)
        stream.close()
        if not self._fs.rename(aside, self._at(f"{self.path}/pointer/{version:012}")):
            self._fs.delete(aside, False)

    def drop(self, keep_from: int, bases: set[str]) -> None:
        """Removes triggers up to ``keep_from`` and bases and pointers that are not in use."""
        for n in self.triggers():
            if n <= keep_from:
                self._fs.delete(self._at(f"{self.path}/{BATCH}={n}"), True)
        for v in self.pointers():
            if v < keep_from:
                self._fs.delete(self._at(f"{self.path}/pointer/{v:012}"), False)
        for name in self._names(f"{self.path}/base"):
            if f"{self.path}/base/{name}" not in bases:
                self._fs.delete(self._at(f"{self.path}/base/{name}"), True)


def message_state(spark: SparkSession, path: str) -> DataFrame:
    """State of every message: the base with the triggers after it merged over it.

    Only messages that the newer triggers touch are merged; the rest of the base is passed on as it
    lies, and where the touched keys are few enough for Spark to send them around, it is not shuffled.
    """
    place = _Place(spark, path)
    version = max(place.pointers(), default=-1)
    return _merged(spark, place, version, [n for n in place.triggers() if n > version])


def _merged(spark: SparkSession, place: _Place, version: int, newer: Sequence[int]) -> DataFrame:
    """The base of ``version`` (-1: none) with the triggers ``newer``."""
    if version < 0 and not newer:
        raise FileNotFoundError(f"no state below {place.path}")
    base = spark.read.parquet(place.base(version)) if version >= 0 else None
    if not newer:
        return base
    changes = spark.read.parquet(*[f"{place.path}/{BATCH}={n}" for n in newer])
    if base is None:
        return _newest(changes)
    touched = _newest(changes)
    keys = touched.select(*[F.col(k).alias(f"__{k}") for k in KEY])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
    merged = _newest(base.join(keys, same, "left_semi").unionByName(touched))
    return base.join(keys, same, "left_anti").unionByName(merged)


def compact(spark: SparkSession, path: str) -> int:
    """Merges all finished triggers into a new base and points to it; returns its version.

    The new base is written beside the old one and counts from the moment the pointer is renamed. Ended
    before that, it is a folder that nobody reads; ended after it, old triggers are ignored.
    Either way the next run puts it right. A generation before the present one is kept for readers that
    have begun with it, older folders go.
    """
    place = _Place(spark, path)
    known = place.pointers()
    version = max(known, default=-1)
    newer = [n for n in place.triggers() if n > version]
    if newer:
        name = f"{newer[-1]:012}-{uuid.uuid4().hex[:8]}"
        _merged(spark, place, version, newer).write.parquet(f"{place.path}/base/{name}")
        place.point(newer[-1], name)
        before, version = version, newer[-1]
    else:
        before = known[-2] if len(known) > 1 else -1
    place.drop(before, {place.base(v) for v in place.pointers() if v >= before})
    return version


def reconcile(a: DataFrame, b: DataFrame, state: DataFrame) -> DataFrame:
    """Full reconciliation: messages whose streamed state differs from the merge of both stores,
    with what has to be put right. Repairs notifications that were lost; a state that neither
    store holds is to be removed and has no wanted values."""
    merged = merge_stores(a, b).select(
        *KEY, F.struct("modseq", "flags", "folder", "expunged").alias("want")
    )
    held = state.select(*KEY, F.struct("modseq", "flags", "folder", "expunged").alias("have"))
    rows = merged.join(held, list(KEY), "full")
    repair = F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "remove").when(
        F.col("have") != F.col("want"), "update"
    )
    return rows.select(*KEY, repair.alias("repair"), "want.*").where("repair is not null")


def alert_writer(
    path: str, send: Callable[[DataFrame, int], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """Sink of ``alert_stream``: keeps one row per state change below ``path`` and hands each trigger's
    rows to ``send``.

    Alerts are changes already, so a steady state sends nothing; the batch number lets the
    receiver drop a trigger that is repeated.
    """

    def write(df: DataFrame, batch: int) -> None:
        kept = f"{path}/{BATCH}={batch}"
        df.write.mode("overwrite").parquet(kept)
        if send is not None:
            send(df.sparkSession.read.schema(df.schema).parquet(kept), batch)

    return write
