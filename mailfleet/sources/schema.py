"""The relational tables of a mail directory, with explicit types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailfleet.functions.scalars import norm_addr

# Table and column names, types and keys of the schema.
_COLUMNS = {
    "admin": "username string, password string, superadmin int, phone string, email_other string, "
    "token string, token_validity timestamp, created timestamp, modified timestamp, active int",
    "domain": "domain string, description string, aliases int, mailboxes int, maxquota bigint, "
    "quota bigint, transport string, backupmx int, created timestamp, modified timestamp, "
    "active int",
    "domain_admins": "username string, domain string, created timestamp, active int",
    "alias": "address string, goto string, domain string, created timestamp, modified timestamp, "
    "active int",
    "alias_domain": "alias_domain string, target_domain string, created timestamp, "
    "modified timestamp, active int",
    "mailbox": "username string, password string, name string, maildir string, quota bigint, "
    "local_part string, domain string, created timestamp, modified timestamp, active int, "
    "phone string, email_other string, token string, token_validity timestamp, "
    "password_expiry timestamp",
    "log": "id bigint, timestamp timestamp, username string, domain string, action string, "
    "data string",
    "vacation": "email string, subject string, body string, cache string, domain string, "
    "created timestamp, activefrom timestamp, activeuntil timestamp, active int, "
    "interval_time int",
    "vacation_notification": "on_vacation string, notified string, notified_at timestamp",
    "quota": "username string, path string, current bigint",
    "quota2": "username string, bytes bigint, messages int",
    "fetchmail": "id int, mailbox string, src_server string, src_auth string, src_user string, "
    "src_password string, src_folder string, poll_time int, fetchall int, keep int, "
    "protocol string, usessl int, extra_options string, returned_text string, mda string, "
    "date timestamp, sslcertck int, sslcertpath string, sslfingerprint string, domain string, "
    "active int",
    "tls_policy": "domain string, policy string, params string, active int",
    "config": "id int, name string, value string",
}
KEYS = {
    "admin": ["username"],
    "domain": ["domain"],
    "domain_admins": ["username", "domain"],
    "alias": ["address"],
    "alias_domain": ["alias_domain"],
    "mailbox": ["username"],
    "log": ["id"],
    "vacation": ["email"],
    "vacation_notification": ["on_vacation", "notified"],
    "quota": ["username", "path"],
    "quota2": ["username"],
    "fetchmail": ["id"],
    "tls_policy": ["domain"],
    "config": ["id"],
}
# Counters each node keeps for itself: never compared between replicas.
NODE_LOCAL = ("quota", "quota2", "session", "cache", "cache_shared", "cache_index",
              "cache_messages", "cache_thread")


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_COLUMNS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Gives ``df`` the columns and types of a table; key text is lower-cased.

    Columns the input does not have are null, so an export with fewer columns still loads.
    """
    cells = []
    for field in table_schema(name):
        value = F.col(f"`{field.name}`") if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in KEYS[name] and isinstance(field.dataType, T.StringType):
            if field.name != "path":
                value = F.when(value == "ALL", value).otherwise(norm_addr(value))
        cells.append(value.alias(field.name))
    return df.select(*cells)


def load_mail_schema(
    spark: SparkSession, path: str, tables: list[str] | None = None
) -> dict[str, DataFrame]:
    """Reads ``<path>/<table>`` parquet folders; only the columns a query uses are scanned."""
    out = {}
    for name in tables or list(_COLUMNS):
        raw = spark.read.schema(table_schema(name)).parquet(f"{path}/{name}")
        out[name] = conform(raw, name)
    return out


def load_mail_schema_jdbc(
    spark: SparkSession,
    url: str,
    bounds: dict[str, tuple[str, int, int, int]] | None = None,
    tables: list[str] | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """Reads the tables over JDBC. ``bounds`` maps a table to (column, low, high, partitions)
    so that a large table is read by many tasks; the driver jar comes with the session."""
    out = {}
    for name in tables or list(_COLUMNS):
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if bounds and name in bounds:
            column, low, high, parts = bounds[name]
            reader = reader.options(
                partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts
            )
        out[name] = conform(reader.load(), name)
    return out
