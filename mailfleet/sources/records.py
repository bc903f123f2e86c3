"""DNS listings, certificate inventories and message headers as rows and maps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.scalars import from_api_json, norm_host, to_list


def dns_from_api(df: DataFrame, col: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Records of an API listing; the empty name is the apex ``@``."""
    return df.select(*keep, F.explode(from_api_json(col)).alias("r")).select(
        *keep,
        F.col("r.id").alias("id"),
        F.col("r.type").alias("type"),
        F.when(F.col("r.name") == "", "@").otherwise(F.col("r.name")).alias("name"),
        norm_host("r.target").alias("target"),
        F.col("r.ttl_sec").alias("ttl"),
    )


def cert_names(df: DataFrame, col: str = "sans", keep: Sequence[str] = ("lineage",)) -> DataFrame:
    """One row per subject alternative name, in the text form ``DNS:a, DNS:b`` or ``a, b``."""
    names = F.transform(to_list(col), lambda n: norm_host(F.regexp_replace(n, "^DNS:", "")))
    return df.select(*keep, F.explode(F.array_distinct(names)).alias("san"))


def header_block(raw: Column | str) -> Column:
    """The header text before the first empty line, folded lines joined to their header."""
    text = F.col(raw) if isinstance(raw, str) else raw
    block = F.split_part(F.regexp_replace(text, "\r\n", "\n"), F.lit("\n\n"), F.lit(1))
    return F.regexp_replace(block, r"\n[ \t]+", " ")


def header_list(raw: Column | str) -> Column:
    """Headers in order as structs (name, value)."""
    lines = F.split(header_block(raw), "\n")
    return F.transform(
        F.filter(lines, lambda x: x.rlike(r"^[!-9;-~]+:")),
        lambda x: F.struct(
            F.substring_index(x, ":", 1).alias("name"),
            F.trim(F.substring(x, F.instr(x, ":") + F.lit(1), F.length(x))).alias("value"),
        ),
    )


def header_map(raw: Column | str) -> Column:
    """Header values by lower-case name; a header may repeat, so values are a list."""

    def grouped(headers: Column) -> Column:
        names = F.array_distinct(F.transform(headers, lambda h: F.lower(h["name"])))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(
            n.alias("key"),
            F.transform(
                F.filter(headers, lambda h: F.lower(h["name"]) == n), lambda h: h["value"]
            ).alias("value"),
        )))

    # As the item of a one-item list the headers are parsed once, not once per name.
    return F.transform(F.array(header_list(raw)), lambda headers: grouped(headers))[0]


def parse_headers(df: DataFrame, col: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, header_map(col).alias("headers"))


def header_contains(block: Column, name: str, needle: str) -> Column:
    """Whether a header of that name contains the text, in a block of unfolded headers."""
    return block.rlike(rf"(?im)^{re.escape(name)}:.*{re.escape(needle)}")


def header_is(block: Column, name: str, value: str) -> Column:
    return block.rlike(rf"(?im)^{re.escape(name)}:[ \t]*{re.escape(value)}[ \t]*$")
