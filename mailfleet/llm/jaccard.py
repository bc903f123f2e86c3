"""Set similarity join of documents by token-combination prefixes.

A document's tokens are the distinct hashes of its word shingles. Documents with equal sets are one
class and one of them stands for all. With sizes n and a threshold t, two sets can only be similar if
they share at least ceil(t n) tokens; so in any common order of tokens, their first shared token lies
in the first p = n - ceil(t n) + 1 tokens of both, and their first two in the first p + 1.

The order is: tokens that few documents hold (rare) before frequent ones, then by hash. Rare tokens of
the first p are index keys by themselves. If a pair's first shared token is frequent, all its shared
tokens are. Only sets that consist almost entirely of frequent tokens can be in such a pair, and they
have combinations of two frequent tokens as keys:

* Small sets, up to ``SMALL`` tokens: every two of the frequent tokens in the first p + 1.
* Larger ones: two that follow one another among the set's frequent tokens, in an extended prefix. Where
  differing tokens are fewer than shared ones by two or more, somewhere two shared tokens follow one another
  among the frequent tokens of both sets. Before the first such place, with a and b frequent tokens that only
  the one or only the other set has, come at most a + b + 1 shared ones; so it ends at or before place
  2a + b + 2 of the first set, and the sizes bound 2a + b. Keys grow with the set's size, not its square.

Sets from t * ``SMALL`` to ``SMALL`` have keys of both kinds, so that any two similar sets have one kind in
common. Up to a half (t <= 0.5) shared tokens need not follow one another, and all sets count as small: only
there do keys of a set of frequent tokens grow with the square of its prefix. No key, candidate or partner is capped.

Candidates of a key are first verified against one member of it. Verified links are contracted to
components; keys whose members are all in one component are done, keys with the same members count once,
and of the rest every pair from different components is verified, if the places of the key leave enough
tokens behind it in both (a pair's first shared key does). Before a pair's first shared neighbours, at places i and j
among the frequent tokens, any two shared tokens have a differing one between them; so of the first set's tokens
before them all rare ones and at least (2i - j) / 3 of the frequent ones differ. Members of a key that would lose too much
even against its smallest set are left out before pairs are made. Documents that have many near copies
are thereby joined by a star, and many changed copies that are too far from one another make few pairs. Every
verification compares whole token sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.llm import words as W
from mailfleet.llm.bloom import Filter, filter_of
from mailfleet.llm.graph import components
from mailfleet.llm.shared import written

#: Documents that hold a token, from which on it is frequent.
FREQUENT = 32
#: Tokens of a set up to which all combinations in its prefix are keys: about where they are as many as pairs of neighbours.
SMALL = 64
_SET = ["_n", "_s1", "_s2"]
#: Bytes of text whose shingles a task holds at a time: about thirty times as many bytes of tables stand beside them.
_PIECE = 1 << 18


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hash) of the distinct shingles of each text, by text and hash; and the number of texts.

    A text with fewer words than a shingle has its whole word sequence as its only shingle.
    """
    found = W.words_of(texts)
    n = len(found.hash)
    length = np.bincount(found.text, minlength=found.texts)
    h = np.full(max(0, n - size + 1), size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + found.hash[j:n - size + 1 + j]
    inside = found.text[:len(h)] == found.text[size - 1:] if len(h) else np.zeros(0, bool)
    text, h = [found.text[:len(h)][inside]], [h[inside]]
    begin = np.cumsum(length) - length
    for short in range(1, size):
        those = np.flatnonzero(length == short)
        whole = np.full(len(those), short, np.uint64)
        for j in range(short):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + found.hash[begin[those] + j]
        text.append(those)
        h.append(whole)
    text, h = np.concatenate(text), W.mix(np.concatenate(h))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new], found.texts


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.in_pieces(batch, "_text", _PIECE):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *_signature(*shingles(part.column("_text"), size))], names=["doc_id", *_SET])
    return run


def _signature(text: np.ndarray, h: np.ndarray, texts: int) -> list[pa.Array]:
    """Size of each set and two sums over it that tell sets apart like a 128-bit hash."""
    n = np.bincount(text, minlength=texts)
    ends = np.cumsum(n)
    out = [pa.array(n.astype(np.int64))]
    for values in (h, W.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out.append(pa.array(W.mix(sums[ends] - sums[ends - n]).view(np.int64)))
    return out


#: Bytes of token halves that a task holds before it counts them.
_BLOCK_BYTES = 16 << 20


def _blocks(size: int, blocks: int):
    """Upper halves of all tokens, counted and dealt to blocks by value, a row per block and share of texts."""

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        starts = (np.arange(blocks, dtype=np.uint64) << np.uint64(32)) // np.uint64(blocks)
        cut = np.r_[np.searchsorted(values, starts.astype(np.uint32)), len(values)]
        used = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([
            pa.array(used.astype(np.int32)),
            pa.array([_squeezed(values[cut[b]:cut[b + 1]]) for b in used.tolist()], pa.binary()),
            pa.array([zlib.compress(counts[cut[b]:cut[b + 1]].astype(np.uint32).tobytes(), 1) for b in used.tolist()], pa.binary())],
            names=["block", "tokens", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in W.in_pieces(batch, "_text", _PIECE):
                _, h, _ = shingles(part.column("_text"), size)
                parts.append((h >> np.uint64(32)).astype(np.uint32))
                held += parts[-1].nbytes
                if held > _BLOCK_BYTES:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return run


def _squeezed(values: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as differences, bytes of one weight together, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint32)


def _frequent_in_block(table: pa.Table, least: int) -> pa.Table:
    tokens = np.concatenate([_unsqueezed(x.as_py()) for x in table["tokens"]])
    counts = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), np.uint32) for x in table["counts"]])
    order = np.argsort(tokens)
    tokens = tokens[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    total = np.add.reduceat(counts[order], first, dtype=np.int64)
    return pa.table({"token": pa.array(tokens[first[total >= least]].astype(np.int64))})


def blocks_of(tokens: int) -> int:
    """In how many blocks so many tokens are counted: about a million in each."""
    return max(16, tokens >> 20)


def frequent_tokens(texts: DataFrame, tokens: int, size: int, least: int, bits: int) -> Filter:
    """A filter of the tokens that at least ``least`` documents hold, counted over all documents.

    Tokens are counted by their upper halves, in blocks that one worker counts at a time; a count is never too
    low. A false yes only makes a rare token count as frequent, in all documents alike.
    """
    counted = texts.mapInArrow(_blocks(size, blocks_of(tokens)), "block int, tokens binary, counts binary").groupBy("block").applyInArrow(
        lambda table: _frequent_in_block(table, least), "token bigint")
    # The filter reads bits at both ends of a key; half a hash is put at both.
    return filter_of(counted.withColumn("k", F.shiftleft("token", 32).bitwiseOR(F.col("token"))), "k", bits)


def _is_frequent(h: np.ndarray, seen: Filter) -> np.ndarray:
    half = h >> np.uint64(32)
    return seen.has((half << np.uint64(32)) | half)


def small_sets(percent: int) -> float:
    """Sizes up to which two similar sets may both rely on all combinations.

    Beyond, the union u of two similar sets is larger, and they share at least percent u / 100 tokens and differ in the
    others, fewer by (2 percent - 100) u / 100, which must be two or more.
    """
    return max(SMALL, -(-200 // (2 * percent - 100))) if percent > 50 else float("inf")


def neighbour_starts(text: np.ndarray, frequent: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Where the first of two neighbouring frequent tokens stands, in the extended prefixes of the larger sets.

    Tokens are sorted by text, rare ones first, then by hash; ``n`` is the size of each text's set.
    """
    rare = np.bincount(text[~frequent], minlength=len(n))
    # No rare token is shared. What sizes leave for differing frequent ones: 100 a + percent b <= spare.
    spare = (100 - percent) * n - 100 * rare
    extended = np.maximum(2 * spare // 100, spare // percent) + 2
    used = (spare >= 0) & (100 * n >= percent * small_sets(percent))
    begin = np.cumsum(n) - n
    place = np.arange(len(text)) - begin[text] - rare[text]
    return np.flatnonzero(used[text[:-1]] & frequent[:-1] & (text[1:] == text[:-1]) & (place[:-1] + 2 <= extended[text[:-1]]))


def neighbour_keys(
    text: np.ndarray, h: np.ndarray, frequent: np.ndarray, n: np.ndarray, percent: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the neighbours at ``neighbour_starts``."""
    first = neighbour_starts(text, frequent, n, percent)
    return text[first], W.mix((h[first] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15) + h[first + 1])


def _places(place: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Place of a key's first token, and how many tokens before it a pair that meets there surely doesn't share, as one number."""
    return (place.astype(np.int64) << 32) | lead.astype(np.int64)


def unshared(at: Column, other: Column) -> Column:
    """How many tokens of a set a pair can't share whose first shared key stands at these places of it and the other."""
    i, j = (F.shiftright(x, 32) - x.bitwiseAND(0xFFFFFFFF) for x in (at, other))
    return at.bitwiseAND(0xFFFFFFFF) + F.greatest(F.floor((2 * i - j + 2) / 3), F.lit(0))


def _keys(size: int, percent: int, sent):
    """Index keys of each document with their places, and its first p tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.in_pieces(batch, "_text", _PIECE):
                text, h, texts = shingles(part.column("_text"), size)
                signature = _signature(text, h, texts)
                n = np.bincount(text, minlength=texts)
                begin = np.cumsum(n) - n
                frequent = _is_frequent(h, sent.value)
                order = np.lexsort((h, frequent, text))
                h, frequent = h[order], frequent[order]
                prefix = n - -(-percent * n // 100) + 1
                place = np.arange(len(h)) - begin[text]
                within = place < prefix[text]
                first = np.zeros(texts + 1, np.int64)
                np.cumsum(np.bincount(text[within], minlength=texts), out=first[1:])
                alone = within & ~frequent
                near, pairs = neighbour_keys(text, h, frequent, n, percent)
                rare = np.bincount(text[~frequent], minlength=texts)
                owner, keys = [text[alone], near], [h[alone], pairs]
                places = [_places(place[alone], place[alone]), _places(place[neighbour_starts(text, frequent, n, percent)], rare[near])]
                # All combinations: only small sets with a frequent token among the first p.
                for i in np.unique(text[within & frequent & (n <= small_sets(percent))[text]]).tolist():
                    tokens = h[begin[i]:begin[i] + min(n[i], prefix[i] + 1)]
                    own = np.flatnonzero(frequent[begin[i]:begin[i] + len(tokens)])
                    x, y = np.triu_indices(len(own), 1)
                    owner.append(np.full(len(x), i))
                    keys.append(W.mix(tokens[own[x]] * np.uint64(0x9E3779B97F4A7C15) + tokens[own[y]]))
                    places.append(_places(own[x], own[x]))
                owner = np.concatenate(owner)
                order = np.argsort(owner, kind="stable")
                bounds = np.zeros(texts + 1, np.int64)
                np.cumsum(np.bincount(owner, minlength=texts), out=bounds[1:])
                yield _rows(part, signature, np.arange(texts), _lists(np.concatenate(keys)[order], bounds),
                            _lists(np.concatenate(places)[order], bounds), _lists(h[within], first))

    return run


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _rows(part: pa.RecordBatch, signature: list[pa.Array], which: np.ndarray, *lists: pa.Array) -> pa.RecordBatch:
    which = pa.array(which)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").take(which), *(s.take(which) for s in signature), *lists],
        names=["doc_id", *_SET, "_keys", "_at", "_prefix"])


def _sets(size: int, sent):
    """Whole token sets of the documents whose signature passes a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.in_pieces(batch, "_text", _PIECE):
                text, h, texts = shingles(part.column("_text"), size)
                signature = _signature(text, h, texts)
                wanted = np.flatnonzero(sent.value.has(signature[1].to_numpy().view(np.uint64)))
                if not len(wanted):
                    continue
                bounds = np.searchsorted(text, np.arange(texts + 1))
                parts = [h[bounds[i]:bounds[i + 1]].view(np.int64) for i in wanted.tolist()]
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(wanted)), *(s.take(pa.array(wanted)) for s in signature),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))],
                    names=["doc_id", *_SET, "_set"])

    return run


class _Join:
    """The steps of one join; see the module's description."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int,
                 frequent: int, filter_bits: int) -> None:
        self.texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
        self.id_type = self.texts.schema["doc_id"].dataType.simpleString()
        self.size, self.percent, self.frequent, self.bits = size, percent, frequent, filter_bits
        self.fields = f"doc_id {self.id_type}, _n bigint, _s1 bigint, _s2 bigint"
        self.rows = written(self.texts.mapInArrow(_signatures(size), self.fields), "signatures")
        self.classes = written(self.rows.where("_n > 0").groupBy(*_SET).agg(
            F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_copies")).where("node is not null"), "classes")

    def one_per_class(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` that belong to the document which stands for its class."""
        mine = self.classes.select(F.col("node").alias("doc_id"), *_SET)
        return df.join(mine, ["doc_id", *_SET], "left_semi")

    def compatible(self, a: str, b: str):
        """Whether two sizes allow the similarity."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def index(self) -> DataFrame:
        """``key, node, n, at, pivot, pivot_n, pivot_at`` of each key that several classes have; sets
        ``self.prefixes``. ``at`` has the ``_places`` of the key among the node's tokens."""
        spark = self.texts.sparkSession
        total = self.rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        seen = frequent_tokens(self.texts, total, self.size, self.frequent, self.bits)
        sent = spark.sparkContext.broadcast(seen)
        keyed = written(self.one_per_class(self.texts.mapInArrow(
            _keys(self.size, self.percent, sent), f"{self.fields}, _keys array<bigint>, _at array<bigint>, _prefix array<bigint>")), "keys")
        self.prefixes = keyed.select(F.col("doc_id").alias("node"), "_s1", "_n", "_prefix")
        entries = keyed.select(
            F.explode(F.arrays_zip("_keys", "_at")).alias("k"), F.col("doc_id").alias("node"), F.col("_n").alias("n")).select(
            F.col("k._keys").alias("key"), "node", "n", F.col("k._at").alias("at"))
        shared = entries.groupBy("key").agg(
            F.min("node").alias("pivot"), F.max("node").alias("_last"), F.min_by("n", "node").alias("pivot_n"),
            F.min_by("at", "node").alias("pivot_at")).where("pivot <> _last").drop("_last")
        return written(entries.join(shared, "key"), "index")

    def reaches(self, n: str, lost: Column, other: str | Column):
        """Whether a set of ``n`` tokens, ``lost`` of them not shared, has enough for one of ``other`` tokens."""
        total = F.col(n) + (F.col(other) if isinstance(other, str) else other)
        return (100 + self.percent) * (F.col(n) - lost) >= self.percent * total

    def joined(self, pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        """``a, b`` with ``_x`` and ``_y``: what ``sets`` (``node`` and more) has of either."""
        left = sets.select(F.col("node").alias("_a"), F.col("_n").alias("_nx"), F.col("_s1").alias("_sx"), F.col(column).alias("_x"))
        right = sets.select(F.col("node").alias("_b"), F.col("_n").alias("_ny"), F.col("_s1").alias("_sy"), F.col(column).alias("_y"))
        return pairs.join(left, pairs["a"] == left["_a"]).join(right, F.col("b") == F.col("_b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct ``a, b``.

        First by the tokens of both prefixes: those after a prefix are known in number, so they and the
        shared ones of the prefixes bound what a pair can share. What is left is compared by whole sets.
        """
        n, other = F.col("_nx"), F.col("_ny")
        shared = F.size(F.array_intersect("_x", "_y"))
        rest = F.greatest(n - F.size("_x"), other - F.size("_y"))
        near = written(self.joined(pairs, self.prefixes, "_prefix").where(
            self.compatible("_nx", "_ny") & ((100 + self.percent) * (shared + rest) >= self.percent * (n + other))).select(
            "a", "b", "_sx", "_sy"), "near")
        wanted = near.select(F.col("_sx").alias("s")).union(near.select("_sy")).distinct()
        sent = self.texts.sparkSession.sparkContext.broadcast(filter_of(wanted, "s", self.bits))
        sets = written(self.one_per_class(self.texts.mapInArrow(
            _sets(self.size, sent), f"{self.fields}, _set array<bigint>")).withColumnRenamed("doc_id", "node"), "sets")
        return written(self.joined(near.select("a", "b"), sets, "_set").where(
            100 * shared >= self.percent * (n + other - shared)).select("a", "b"), "links")

    def links(self) -> DataFrame:
        """Links that connect whatever is connected; ``a, b`` are classes' documents."""
        index = self.index()
        lead = lambda at: F.col(at).bitwiseAND(0xFFFFFFFF)
        star = written(index.where(
            (F.col("node") != F.col("pivot")) & self.compatible("n", "pivot_n")
            & self.reaches("n", lead("at"), "pivot_n") & self.reaches("pivot_n", lead("pivot_at"), "n")).select(
            F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        first = self.verified(star)
        groups = components(first)
        placed = written(index.drop("pivot", "pivot_n", "pivot_at").join(groups, "node", "left").withColumn(
            "component", F.coalesce("component", "node")), "placed")
        member = F.xxhash64("node")
        unsettled = placed.groupBy("key").agg(
            F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"),
            F.bit_xor(member).alias("h1"), F.sum(F.shiftright(member, 24)).alias("h2"),
            F.sum(F.shiftright("at", 32)).alias("at"), F.min("n").alias("low")).where("x <> y")
        # Of keys with the same members the first in the order of tokens: it may be a pair's first shared one.
        chosen = unsettled.groupBy("m", "h1", "h2").agg(F.min(F.struct("at", "key", "low")).alias("k")).select("k.key", "k.low")
        least = F.greatest(F.col("low"), F.ceil(F.col("n") * self.percent / 100))
        rest = written(placed.join(chosen, "key").where(self.reaches("n", lead("at"), least)).drop("low"), "unsettled")
        open_keys = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        rest = written(rest.join(open_keys, "key", "left_semi"), "open")
        a = rest.select("key", F.col("component").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
        b = rest.select("key", F.col("component").alias("cb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
        pairs = a.join(b, "key").where(
            (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & self.compatible("na", "nb")
            & self.reaches("na", unshared(F.col("pa"), F.col("pb")), "nb")
            & self.reaches("nb", unshared(F.col("pb"), F.col("pa")), "na")).select("a", "b").distinct()
        pairs = written(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
        return first.union(self.verified(pairs))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, percent: int = 90,
    frequent: int = FREQUENT, filter_bits: int = 24,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Two documents link when ``100 * shared >= percent * union`` of their distinct shingles of ``size``
    words; ``component_id`` is the least id that links reach. Texts without words, null ones too, have
    no shingles and link with nothing. Rows that repeat an id are one node. A row without an id
    belongs to the documents with the same set, or to none (null) if they have no id either. Other
    columns are ignored, whatever their names.
    """
    join = _Join(docs, id_col, text_col, size, percent, frequent, filter_bits)
    groups = components(join.links())
    classes = join.classes.join(groups, "node", "left").select(
        *_SET, F.coalesce("component", "node").alias("component_id"))
    # Rows without words have one signature and match no class.
    return join.rows.withColumn("_n", F.when(F.col("_n") > 0, F.col("_n"))).withColumn(
        "_s1", F.when(F.col("_n").isNull(), F.xxhash64("doc_id")).otherwise(F.col("_s1"))).join(
        classes, _SET, "left").select(
        "doc_id", F.coalesce("_n", F.lit(0).cast("long")).alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text``) that come first in their group, all columns unchanged.

    A row goes by its id and text together. Where an id has several texts, each has a place of its own, after all plain
    ids (numbers from 2**62 on, from a hash of both); so what goes for one text of an id leaves its other texts. Rows
    with the same id and text stay or go together. Rows without an id stay: there is nothing to name them by.
    So do texts without words, null ones too. An empty table stays empty; columns of any name are passed on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    several = written(docs.where("doc_id is not null").select(F.col("doc_id").alias("_several"), F.xxhash64(text).alias("_t")).groupBy(
        "_several").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).where("_lo <> _hi").select("_several"), "several-texts")
    own = F.xxhash64("_id", text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), "text").join(
        several, F.col("_id") == F.col("_several"), "left").select(
        "_doc", "text", F.when(F.col("_several").isNotNull(), own).otherwise(F.col("_id")).alias("_row"))
    gone = similar_groups(rows, "_row", size=size, percent=percent).where("component_id <> doc_id").select(
        F.col("doc_id").alias("_gone")).distinct()
    return rows.join(gone, rows["_row"] == gone["_gone"], "left_anti").select("_doc.*")
