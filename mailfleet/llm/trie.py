"""A prefix trie of conversations, built from whole sequences.

Identical conversations collapse into one weighted sequence with the list of those that end there, so
copies cost one sequence each, however many there are. A sequence that is a proper prefix of another is
no leaf, which an anti-join tells. Prefixes of the sequences that are left, each with its weight, are then summed to nodes.

A turn is known by 128 bits of its role and text, and so is a prefix: the exclusive or of its turns' hashes, each
hashed with its depth. So prefixes of a conversation of any length are a running aggregate, cut into chunks,
and neither a long conversation nor a group of copies is one task. Texts are never shuffled.

Sums over subtrees need no walk: the smallest member of a node names one sequence, and the nodes that
name a sequence are the lower end of its path. Each sequence adds up what it owns from below; a node's subtree is what the
sequences through it have added up to its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailfleet.llm.shared import written
from mailfleet.plans.scan import running

#: Turns of one conversation that a task scans, and conversation numbers in one piece of an end list.
CHUNK, PIECE_BITS = 4096, 12
FIRST_TURNS = 8
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "h1", "h2"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and each row's number within its conversation there, for sorted rows."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        begins = np.concatenate([[True], conv[1:] != conv[:-1]])
        at = np.arange(len(conv))
        local = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
        if conv[0] == last:
            same = len(conv) if begins.sum() == 1 else int(np.flatnonzero(begins)[1])
            local[:same] += seen
        last, seen = conv[-1], int(local[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(local)],
            [*batch.schema.names, "part", "local"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_hash, bytes``: the turns of each conversation from 1, by ``turn`` (null first).

    Turns with the same number come in the order of their hashes; repeated rows all count. A null role or text is
    empty. Rows without ``conv_id`` belong to no conversation and are left out. Rows are cut into ranges of about equal size,
    so a conversation may lie in many tasks; ranges know how many of its turns lie before them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text))).alias("turn_hash"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    order = ["conv_id", "turn", "turn_hash"]
    placed = written(
        slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn").mapInArrow(
            _numbered, "conv_id bigint, turn_hash binary, bytes bigint, part int, local bigint"), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = placed.groupBy("conv_id", "part").agg(F.max("local").alias("_n")).withColumn(
        "_before", F.sum("_n").over(before)).where("_before > 0").select("conv_id", "part", "_before")
    # Only the first conversation of a range can have begun in another: at most one row for each range.
    return placed.join(F.broadcast(earlier), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("_before", F.lit(0))).alias("pos"), "turn_hash", "bytes")


def rebuilt(numbered: DataFrame, block: int = 5, folds: int = FIRST_TURNS + 1) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their turns after the exchange of beginnings: ``conv_id, depth, turn_hash, bytes``.

    The first ``h = crc32(conv_id as text) mod folds`` turns are those of the conversation ``conv_id - conv_id % block`` (all if it has
    fewer, none if it is absent), then come the own turns after the first ``h``.
    """
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds
    convs = numbered.where("pos = 1").select("conv_id").withColumn("h", own).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % block)
    begin = numbered.where(F.col("pos") < folds).where(F.col("conv_id") % block == 0).withColumnRenamed("conv_id", "base")
    # At most folds - 1 turns for each of block conversations meet in one key.
    heads = convs.join(begin, "base").where("pos <= h").select(
        "conv_id", F.col("pos").alias("depth"), "turn_hash", "bytes")
    taken = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_taken"))
    short = convs.join(taken, "conv_id", "left").select(
        "conv_id", (F.col("h") - F.coalesce("_taken", F.lit(0))).alias("_short")).where("_short > 0")
    tails = numbered.where(F.col("pos") > own).join(short, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("_short", F.lit(0))).alias("depth"), "turn_hash", "bytes")
    return convs.select("conv_id"), heads.unionByName(tails)


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, h1, h2, p1, p2, bytes``: each turn with the hash of the prefix it ends and of the one before."""
    terms = turns.select(
        "conv_id", "depth", "bytes", F.floor((F.col("depth") - 1) / CHUNK).alias("_chunk"),
        *[F.xxhash64(F.lit(k), F.col("depth"), F.col("turn_hash")).alias(f"_t{k}") for k in (1, 2)])
    unit = ["conv_id", "_chunk"]
    upto = Window.partitionBy(*unit).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = terms.select("*", *[F.bit_xor(f"_t{k}").over(upto).alias(f"_x{k}") for k in (1, 2)])
    long = terms.where("_chunk = 1").select("conv_id").distinct()
    whole = terms.join(long, "conv_id", "left_semi").groupBy(*unit).agg(
        F.bit_xor("_t1").alias("_w1"), F.bit_xor("_t2").alias("_w2"))
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*unit, *[F.bit_xor(f"_w{k}").over(before).alias(f"_c{k}") for k in (1, 2)]).where("_c1 is not null")
    full = inside.join(carry, unit, "left").select(
        "conv_id", "depth", "bytes", "_t1", "_t2",
        *[F.col(f"_x{k}").bitwiseXOR(F.coalesce(f"_c{k}", F.lit(0))).alias(f"h{k}") for k in (1, 2)])
    return full.select(
        "conv_id", "depth", "h1", "h2", *[F.col(f"h{k}").bitwiseXOR(F.col(f"_t{k}")).alias(f"p{k}") for k in (1, 2)], "bytes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each key of rows sorted by key and piece; holds one piece."""
    key, state, out = None, None, []
    for batch in batches:
        for *now, piece in zip(*[c.to_pylist() for c in batch.columns]):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if key is not None:
        out.append((*key, state.hexdigest()))
    for first in range(0, len(out), 10_000):
        depth, h1, h2, sha = zip(*out[first:first + 10_000])
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sha)], [*KEY, "ends"])


def _end_digests(ends: DataFrame, sequences: DataFrame) -> DataFrame:
    """``depth, h1, h2, ends``: the digest of the numbers of the conversations that are that sequence.

    A number alone is digested where it lies. Longer lists are cut into pieces of neighbouring numbers, each of a bounded size; a digest has
    to read them in order, so one task streams the pieces of a list.
    """
    alone = sequences.where("weight = 1").select(*KEY, F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends"))
    shared = sequences.where("weight > 1").select(*KEY)
    # Pieces are made before lists meet their key, so a long list is spread over tasks until it is short.
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", PIECE_BITS).alias("_piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("_ids"))
    return alone.unionByName(
        pieces.join(shared, KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "_piece").select(*KEY, "_ids").mapInArrow(
            _digests, "depth bigint, h1 bigint, h2 bigint, ends string"))


def _saved_below(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``depth, h1, h2, saved`` for the nodes that several conversations share; others save nothing."""
    shared = nodes.where("n_convs > 1").select(*KEY, F.col("conv_id").alias("_owner"), "own")
    owned = paths.select("rep", *KEY).join(shared, KEY).select(
        "rep", *KEY, (-F.col("depth")).alias("_up"), F.when(F.col("_owner") == F.col("rep"), F.col("own")).otherwise(0).alias("_own"))
    summed = running(owned, ["rep"], ["_up"], F.floor(F.col("_up") / CHUNK), F.col("_own"), "_below")
    return summed.groupBy(*KEY).agg(F.sum("_below").alias("saved"))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs`` names each conversation once (``conv_id``), also those without turns; ``turns`` has ``conv_id, depth`` (from 1, without gaps)``,
    turn_hash, bytes``. ``conv_id`` of a node is its smallest member. No conversation, no rows; conversations without turns are members of the root.
    """
    prefixes = written(_prefixes(turns), "trie-prefixes")
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("_end"))
    ends = written(convs.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col("_end")[k], F.lit(0)).cast("bigint").alias(k) for k in KEY]), "trie-ends")
    sequences = written(ends.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("rep")), "trie-sequences")

    # Prefixes of one conversation of each sequence, with the sequence's weight.
    paths = written(prefixes.join(
        sequences.select("rep", "weight", F.col("depth").alias("length")), F.col("conv_id") == F.col("rep")).drop("conv_id"), "trie-paths")
    proper = paths.where("depth < length").select(*KEY).union(
        paths.where("depth = 1").select(*[F.lit(0).cast("bigint").alias(k) for k in KEY])).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("rep", F.lit(1).alias("_leaf"))

    weighted = paths.join(leaves, "rep", "left").withColumn("_leaf", F.coalesce("_leaf", F.lit(0)))
    nodes = written(weighted.groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("_leaf").alias("n_leaves"),
        F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    ).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")
    digests = _end_digests(ends, sequences)

    # The root is one row, put together from whole-table sums.
    top = sequences.join(leaves, "rep", "left").agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("_leaf").alias("n_leaves"))
    under = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.sum("own").alias("saved"))
    root = top.unionByName(under, True).unionByName(digests.where("depth = 0").select("ends"), True).agg(
        *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_leaves", "n_children", "saved", "ends")]).where("n_convs > 0").withColumns(
        {"depth": F.lit(0).cast("bigint"), "parent_conv_id": F.lit(None).cast("bigint")})
    least = sequences.agg(F.min("rep")).first()[0]

    # Nodes of depth 1 hang on the root, which is one row; deeper ones find their parent by its hash.
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")]
    deep = nodes.where("depth > 1")
    children = deep.select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"))
    below = deep.join(parents, (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_h1")) & (F.col("p2") == F.col("_h2"))).drop(
        "_depth", "_h1", "_h2")
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("bigint"))
    found = below.unionByName(first).join(children, KEY, "left").join(_saved_below(paths, nodes), KEY, "left").join(digests, KEY, "left")
    out = found.select(*root.columns).unionByName(root)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("n_leaves").cast("bigint").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = 5, folds: int = FIRST_TURNS + 1) -> DataFrame:
    """The trie of rebuilt conversations (see ``numbered_turns``, ``rebuilt`` and ``trie``); other columns are ignored."""
    convs, turns = rebuilt(numbered_turns(conversations), block, folds)
    return trie(convs, turns)
