"""Health samples: problems, severities, trends, transitions, reports and traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.rules import findings
from mailfleet.functions.scalars import band, epoch_s
from mailfleet.plans.scan import balanced, growth, previous, time_chunk

# Thresholds of the checks and the ports that must be open or closed.
MAX_HANDSHAKE_S = 300
ID_RING = 2
MAX_LAG_S = 300
MAX_QUEUED = 500
QUEUE_BAND = (100, 500)
DISK_BAND = (85, 92)
RAM_BAND_MB = (1800, 3800)
MIN_DISK_GB = 10
TESTED_OS = "24.04"
DUPLICATE_KEY = 1062
OPEN_PORTS = (22, 25, 80, 143, 443, 465, 587, 4190)
CLOSED_PORTS = (110, 995, 3306, 11334, 12345)


# -- checks ----------------------------------------------------------------------------------


def host_preflight(hosts: DataFrame) -> DataFrame:
    """Findings per host before it may join a cluster, with their severity."""
    def rule(condition: Column, severity: str, text: str):
        return condition, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("finding"))

    ram, floor_mb = F.col("ram_mb"), RAM_BAND_MB[0]
    rules = [
        rule(ram < floor_mb, "error", "too little memory"),
        rule((ram >= floor_mb) & (ram < RAM_BAND_MB[1]), "warn", "little memory"),
        rule(F.col("disk_gb") < MIN_DISK_GB, "error", "too little disk"),
        rule(F.col("os_version") != TESTED_OS, "warn", "untested system version"),
    ]
    if "ntp_synced" in hosts.columns:
        rules.append(rule(F.col("ntp_synced") == 0, "warn", "clock not synchronised"))
    return hosts.select("host_no", F.inline(findings(rules)))


def severity_bands(samples: DataFrame) -> DataFrame:
    """Queue and disk severity of each sample."""
    return samples.withColumn("queue_state", band("queued", *QUEUE_BAND)).withColumn(
        "disk_state", band("disk_pct", *DISK_BAND)
    )


def problem_list(columns: Sequence[str] = ()) -> Column:
    """Problems of a replica sample with the columns of its status dump and its queue.

    An empty status is one problem: nothing is replicated at all. ``columns`` are those that samples have; where
    ``handshake_age_s`` (0 or null: never), ``id_increment``, ``id_offset`` and ``own_offset`` are among them, an old handshake of
    the tunnel and wrong id settings are problems too.
    """
    io, sql = F.col("Slave_IO_Running"), F.col("Slave_SQL_Running")
    running_both = (io == "Yes") & (sql == "Yes")
    errno = F.coalesce(F.col("Last_Errno").try_cast("int"), F.lit(0))
    lag_text = F.col("Seconds_Behind_Master")
    lag = lag_text.try_cast("bigint")
    empty = io.isNull() & sql.isNull() & lag_text.isNull() & F.col("Last_Errno").isNull()
    more = []
    if "handshake_age_s" in columns:
        age = F.col("handshake_age_s")
        more.append((age > MAX_HANDSHAKE_S, F.concat(F.lit("no tunnel handshake for "), age.cast("string"), F.lit("s"))))
    if "id_increment" in columns:
        step, offset = F.col("id_increment"), F.col("id_offset")
        shown = [F.coalesce(c.cast("string"), F.lit("?")) for c in (step, offset)]
        more += [
            (~step.eqNullSafe(F.lit(ID_RING)), F.concat(F.lit("id increment is "), shown[0])),
            (~offset.eqNullSafe(F.col("own_offset")), F.concat(F.lit("id offset is "), shown[1])),
        ]
    return findings([
        (empty, "status is empty: nothing is replicated"),
        (~empty & ~io.eqNullSafe(F.lit("Yes")), "io thread stopped"),
        (~empty & ~sql.eqNullSafe(F.lit("Yes")), "sql thread stopped"),
        (errno == DUPLICATE_KEY, "duplicate key: both nodes wrote the same row"),
        ((errno != 0) & (errno != DUPLICATE_KEY),
         F.concat(F.lit("replica error "), errno.cast("string"))),
        ((lag_text == "NULL") & running_both, "lag unknown while running"),
        (lag > MAX_LAG_S, F.concat(F.lit("lag "), lag.cast("string"), F.lit("s"))),
        (F.col("queued") > MAX_QUEUED, F.concat(F.lit("queue "), F.col("queued").cast("string"))),
        (F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" failed requests"))),
        *more,
    ])


def replica_problems(samples: DataFrame, keep: Sequence[str] = ("sample_id", "node")) -> DataFrame:
    return samples.select(*keep, F.explode(problem_list(samples.columns)).alias("problem"))


def port_findings(scan: DataFrame) -> DataFrame:
    """Closed ports that answer on the public address, and open ones that do not."""
    port, up = F.col("port"), F.col("reachable_public") == 1
    state = F.when(port.isin(*CLOSED_PORTS) & up, "exposed").when(
        port.isin(*OPEN_PORTS) & ~up, "unreachable"
    )
    return scan.select("host_no", "port", state.alias("finding")).where("finding is not null")


def sample_checks(samples: DataFrame) -> DataFrame:
    """Check rows (node, sample, check, status) of the health samples, several rule packs; a
    sample is read once and its checks are taken from its columns."""
    lag = F.when(F.col("lag_s") > MAX_LAG_S, "error").otherwise("ok")
    errno = F.when(F.col("errno") != 0, "error").otherwise("ok")
    packs = {
        "queue": band("queued", *QUEUE_BAND), "disk": band("disk_pct", *DISK_BAND),
        "lag": lag, "errno": errno,
    }
    checks = F.array(*[
        F.struct(F.lit(name).alias("check"), status.alias("status")) for name, status in packs.items()
    ])
    return samples.select("node", "sample_id", F.inline(checks))


def health_rollup(checks: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Checks by result; status 0 healthy, 1 degraded, 2 failed."""
    counts = checks.groupBy(*by).agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "warn").alias("warn"),
        F.count_if(F.col("status") == "error").alias("error"),
    )
    return counts.withColumn(
        "exit_code", F.when(F.col("error") > 0, 2).when(F.col("warn") > 0, 1).otherwise(0)
    )


def health_report(samples: DataFrame) -> DataFrame:
    """One JSON report per sample, errors before warnings, with the ``hostname`` where samples have
    one. The checks of a sample are columns of its row, so the report is built in place."""
    checks = {
        "queue": band("queued", *QUEUE_BAND),
        "disk": band("disk_pct", *DISK_BAND),
        "lag": F.when(F.col("lag_s") > MAX_LAG_S, "error").otherwise("ok"),
        "errno": F.when(F.col("errno") != 0, "error").otherwise("ok"),
    }
    states = F.array(*[
        F.struct(F.lit(name).alias("check"), state.alias("status"))
        for name, state in checks.items()
    ])
    rows = samples.withColumn("__s", states)

    def having(status: str) -> Column:
        return F.filter("__s", lambda x: x["status"] == status)

    texts = F.transform(
        F.concat(having("error"), having("warn")),
        lambda x: F.concat(x["check"], F.lit(": "), x["status"]),
    )
    report = F.struct(
        F.col("node").alias("node"),
        *([F.col("hostname").alias("hostname")] if "hostname" in samples.columns else []),
        F.size(having("ok")).alias("ok"),
        F.size(having("warn")).alias("warn"),
        F.size(having("error")).alias("error"),
        texts.alias("problems"),
    )
    return rows.select("sample_id", F.to_json(report).alias("report"))


# -- over time -------------------------------------------------------------------------------


def transitions(
    samples: DataFrame, key: str = "node", order: Sequence[str] = ("ts", "sample_id"),
    chunk_s: int = 3600, ts: str = "ts",
) -> DataFrame:
    """Samples at which the state of a node changes; the first is compared with ``ok``.

    A fleet has few nodes and many samples, so the look back runs per hour and is carried over.
    """
    cut = balanced(samples, [key], order, time_chunk(ts, chunk_s), "chunk")
    rows = previous(cut, [key], order, F.col("chunk"), F.col("state"), "before").drop("chunk")
    rows = rows.withColumn("before", F.coalesce("before", F.lit("ok")))
    return rows.where(F.col("state") != F.col("before"))


def queue_totals(queue: DataFrame, keep: Sequence[str] = ("sample_id", "node")) -> DataFrame:
    """Requests per class and in total, per sample; waiting ones are not queued ones."""
    queued = F.col("state") == "queued"
    return queue.groupBy(*keep).agg(
        F.sum(F.when(queued, F.col("requests")).otherwise(0)).alias("queued"),
        F.sum(F.when(queued & (F.col("class") == "sync"), F.col("requests")).otherwise(0))
        .alias("sync"),
        F.sum(F.when(F.col("state") == "waiting", F.col("requests")).otherwise(0)).alias("failed"),
    )


def queue_trend(
    samples: DataFrame, k: int, key: str = "node", order: Sequence[str] = ("ts", "sample_id"),
    chunk_s: int = 3600, ts: str = "ts",
) -> DataFrame:
    """How many samples in a row the queue has grown, and whether that is at least ``k``."""
    cut = balanced(samples, [key], order, time_chunk(ts, chunk_s), "__part")
    rows = growth(cut, [key], order, F.col("__part"), F.col("queued"), "__before", "streak")
    trend = (
        F.when(F.col("streak") >= k, "growing")
        .when(F.col("queued") < F.col("__before"), "draining").otherwise("steady")
    )
    return rows.withColumn("trend", trend).drop("__before", "__part")


def watchdog_windows(samples: DataFrame, width: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Worst values per node and tumbling window."""
    return samples.groupBy(F.window(ts, width).alias("w"), "node").agg(
        F.count(F.lit(1)).alias("samples"), F.max("lag_s").alias("max_lag"),
        F.max("queued").alias("max_queued"),
        F.max((F.col("errno") != 0).cast("int")).alias("any_error"),
    ).select(epoch_s("w.start").alias("start"), "node", "samples", "max_lag", "max_queued",
             "any_error")


def node_traffic(access: DataFrame, unit_s: int = 60) -> DataFrame:
    """Requests per minute, node and status with the 95th percentile of the request time.

    Times carry milliseconds: equal ones are counted first, on the map side, and the exact
    percentile is taken over these weighted values.
    """
    minute = (F.floor(epoch_s("ts") / unit_s) * unit_s).alias("minute")
    weighted = access.groupBy(minute, "node", "status", "rt").agg(F.count(F.lit(1)).alias("n"))
    return weighted.groupBy("minute", "node", "status").agg(
        F.sum("n").alias("requests"),
        F.round(F.percentile("rt", 0.95, F.col("n")), 6).alias("p95_rt"),
    )


# -- sets ------------------------------------------------------------------------------------


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted rows that are not present."""
    return wanted.distinct().join(present.distinct(), wanted.columns, "left_anti")


def forbidden_present(forbidden: DataFrame, present: DataFrame) -> DataFrame:
    return forbidden.select(*present.columns).intersect(present)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def per_host(hosts: DataFrame, values: Sequence[int], name: str) -> DataFrame:
    """Every host with each of a short literal list."""
    return hosts.select(
        "host_no", F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    ).distinct()
