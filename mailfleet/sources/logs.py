"""Log lines as columns. One projection each; a line that does not fit gives nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.rules import compile_filter, filter_named
from mailfleet.functions.scalars import parse_log_ts

# The access log layout, the mail events and their fields.
ACCESS_PATTERN = (
    r'^(\S+) - (\S+) \[([^\]]*)\] "([^"]*)" ([0-9]{3}) ([0-9]+|-) "([^"]*)" "([^"]*)" '
    r"rt=([0-9.]+) node=(\S+)"
)
MAIL_EVENTS = (
    "delete", "undelete", "expunge", "copy", "mailbox_delete", "mailbox_rename", "flag_change",
)
MAIL_FIELDS = ("uid", "box", "msgid", "size", "from", "subject", "flags")


def parse_access_log(df: DataFrame, col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of each access line. The layout is checked once; the fields are then cut at its
    quotes and blanks instead of by one regular expression each."""
    fits = F.col(col).rlike(ACCESS_PATTERN)
    quoted = F.split(F.when(fits, F.col(col)), '"')
    head, sizes, tail = quoted[0], F.trim(quoted[2]), quoted[6]
    clock = F.substring_index(F.substring_index(head, "[", -1), "]", 1)
    request = quoted[1]
    return df.select(
        *keep,
        F.substring_index(head, " ", 1).alias("ip"),
        F.split_part(head, F.lit(" "), F.lit(3)).alias("remote_user"),
        parse_log_ts(clock, "access").alias("ts"),
        request.alias("request"),
        F.substring_index(request, " ", 1).alias("method"),
        F.split_part(request, F.lit(" "), F.lit(2)).alias("path"),
        F.substring_index(sizes, " ", 1).cast("int").alias("status"),
        F.substring_index(sizes, " ", -1).try_cast("bigint").alias("bytes"),
        quoted[3].alias("referer"),
        quoted[5].alias("agent"),
        F.substring_index(F.substring_index(tail, "rt=", -1), " ", 1).try_cast("double").alias("rt"),
        F.split_part(F.substring_index(tail, "node=", -1), F.lit(" "), F.lit(1)).alias("node"),
    )


def _auth_lines(df: DataFrame, jail: str, col: str, keep: tuple[str, ...]) -> DataFrame:
    parsed = compile_filter(filter_named(jail), col)
    return df.select(
        *keep,
        F.lit(jail).alias("jail"),
        parsed.ts.alias("ts"),
        parsed.ip.alias("ip"),
        parsed.shape.alias("shape"),
        parsed.is_failure.alias("is_failure"),
        F.col(col).alias("line"),
    )


def parse_webmail_auth(
    df: DataFrame, col: str = "line", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Failures only: three shapes count, a successful login does not."""
    user = F.regexp_extract("line", r"ogin failed for (\S+)|ailed login for (\S+)", 0)
    rows = _auth_lines(df, "webmail", col, keep).where("is_failure")
    return rows.withColumn("user", F.substring_index(user, " ", -1)).drop("is_failure", "line")


def parse_imap_auth(df: DataFrame, col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Failures only: four shapes, with the user and session where the line names them."""
    rows = _auth_lines(df, "imap-ext", col, keep).where("is_failure")
    return rows.select(
        *keep, "jail", "ts", "ip", "shape",
        F.nullif(F.regexp_extract("line", r"user=<([^>]*)>", 1), F.lit("")).alias("user"),
        F.nullif(F.regexp_extract("line", r"session=<([^>]*)>", 1), F.lit("")).alias("session"),
    )


def parse_admin_auth(df: DataFrame, col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Failures of the admin portal, read from its access log."""
    return _auth_lines(df, "admin", col, keep).where("is_failure").drop("is_failure", "line")


def parse_mail_events(df: DataFrame, col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """The seven audited events with their seven fields. A field ends where the next known field
    begins, so a subject may hold commas."""
    event = F.regexp_extract(col, r": ([a-z_]+): ", 1)
    stop = "|".join(MAIL_FIELDS)

    def field(name: str):
        value = F.regexp_extract(col, rf"(?:: |, ){name}=(.*?)(?:, (?:{stop})=|$)", 1)
        return F.nullif(value, F.lit(""))

    flags = F.regexp_extract(col, r", flags=\(([^)]*)\)", 1)
    return df.select(
        *keep,
        F.regexp_extract(col, r"^\w+\(([^)]*)\)", 1).alias("username"),
        F.regexp_extract(col, r"> (\S+): [a-z_]+: ", 1).alias("node"),
        event.alias("event"),
        field("uid").try_cast("bigint").alias("uid"),
        field("box").alias("box"),
        field("msgid").alias("msgid"),
        field("size").try_cast("bigint").alias("size"),
        field("from").alias("from_addr"),
        field("subject").alias("subject"),
        flags.alias("flags"),
    ).where(F.col("event").isin(*MAIL_EVENTS))
