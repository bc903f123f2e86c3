"""Exact duplicates by progressive refinement: length, then a prefix's hash, then the whole text's.

Only DataFrame functions. The first scan keeps 24 bytes a row: id, length of the normalised text and
hash of its first characters. Lengths that occur once are settled; of the others, prefixes that
occur once are settled. The second scan reads the text again and computes the whole hash of the
rows that are left. All groupings combine before they shuffle and no text is ever shuffled, so a
group of copies of any size costs no more than as many single rows; the last join, of rows to
groups, is a plain join whose hot groups the adaptive planner splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.llm.shared import some_of, without_rows, written

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Each run of spaces, tabs and line ends as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, all_digests: bool = False,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``text_sha256`` is null for rows that length and prefix settle, unless ``all_digests``.
    Null texts equal empty ones. A row with a null id never hides one with an id; in a group
    without any id, ``keep_id`` is null and every row is kept. Rows that repeat an id are
    counted each, and each is kept if that id is. Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text"))
    keyed = texts.select(
        "doc_id", "_text", F.octet_length("_text").alias("_bytes"),
        F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("_prefix"))
    facts = written(keyed.select("_bytes", "_prefix"), "exact-lengths")
    repeated = facts.groupBy("_bytes", "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    lengths = repeated.groupBy("_bytes").agg(F.sum("_rows").alias("_of_length")).where("_of_length > 1")
    open_ = repeated.where("_rows > 1").join(lengths, "_bytes", "left_semi")
    key = F.struct("_bytes", "_prefix")
    probed = some_of(open_, key, keyed, key)
    whole = F.unhex(F.sha2("_text", 256))
    hashed = written(probed.select(
        "doc_id", "_bytes", "_prefix", "candidate",
        (whole if all_digests else F.when(F.col("candidate"), whole)).alias("_sha")), "exact-hashes")
    groups = hashed.where("candidate").groupBy("_bytes", "_prefix", "_sha").agg(
        F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    # Settled rows meet no group, whether or not their digest is asked for; they are spread by their prefix.
    sha = F.when(F.col("candidate"), F.col("_sha")).otherwise(F.col("_prefix").cast("string").cast("binary"))
    joined = hashed.withColumn("_match", sha).join(
        groups.withColumnRenamed("_sha", "_match"), ["_bytes", "_prefix", "_match"], "left")
    size = F.coalesce("_size", F.lit(1).cast("long"))
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, all columns unchanged.

    A row goes by its id and its text together: what goes for one text of an id (null is one) does
    not take other texts of that id along.
    """
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(
        F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    return without_rows(docs, id_col, F.sha2(normalised(F.col(text_col)), 256), gone)
