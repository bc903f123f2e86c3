"""Byte-level BPE: ranked merges folded over the bytes of distinct words by higher-order functions.

A text is cut by the tokenizer's pattern. Each batch of documents is one row that holds its distinct
words as arrays of byte ids; Spark's ``aggregate`` folds merges over each array, always the leftmost
pair of lowest rank, with the ranks in a table of one row; then the batch's documents are put together
from the codes of their words. A word that is a piece of the vocabulary as a whole is that piece.
There is no shuffle: rows stay in their partition, and a batch holds a bounded number of bytes or
one longer document. Frequent words, found in a bounded sample, are encoded once beforehand; that
saves time only and changes no result.

The rank table has a row per left id, rows laid over one another without a clash: the slot at
``start[left] + right`` holds the left id and the id of the merged piece, so a look-up is two array reads.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailfleet.llm import words as W
from mailfleet.llm.shared import written

#: Rank of a pair that does not merge; no vocabulary here has that many pieces.
NEVER = 65535
_WIDTH = 65536


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def mergeable(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) as one number -> id of the merged piece."""
    out = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                out[left * _WIDTH + right] = rank
    return out


def displaced(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Start of each left id's row, and ``left id * 65536 + merged id`` at ``start + right id`` (None: free).

    Rows overlap but share no used slot, so a slot that names the left id belongs to the pair. Long rows
    hardly fit between others: the table grows whenever no place was found, so this ends for any pairs.
    """
    keys = np.array(sorted(pairs), np.int64)
    left, right = keys // _WIDTH, keys % _WIDTH
    own = np.flatnonzero(np.diff(left)) + 1
    rows = np.split(np.arange(len(keys)), own) if len(keys) else []
    spread = 2 * len(keys) + 1
    table = np.full(spread + _WIDTH, -1, np.int64)
    starts = np.zeros(int(left.max()) + 1 if len(keys) else 1, np.int64)
    rng = np.random.default_rng(7)
    for row in sorted(rows, key=len, reverse=True):
        while True:
            tried = rng.integers(0, spread, 64)
            free = np.flatnonzero((table[tried[:, None] + right[row]] < 0).all(1))
            if len(free):
                break
            more = spread // 32 + 1
            spread += more
            table = np.r_[table, np.full(more, -1, np.int64)]
        start = starts[left[row[0]]] = tried[free[0]]
        table[start + right[row]] = left[row] * _WIDTH + [pairs[k] for k in keys[row].tolist()]
    last = int(np.flatnonzero(table >= 0)[-1]) + 1 if len(keys) else 1
    return starts.tolist(), [v if v >= 0 else None for v in table[:last].tolist()]


class Vocabulary:
    """A rank file and what is derived from it."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.ranks = ranks_of(path)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        if len(self.ranks) >= NEVER:
            raise ValueError("ids must fit in 16 bits")

    @property
    def table(self) -> tuple[list[int], list[int]]:
        if not hasattr(self, "_table"):
            self._table = displaced(mergeable(self.ranks))
        return self._table


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _tables(spark: SparkSession, vocab: Vocabulary) -> Column:
    """Both rank tables, as a subquery of one row. As literals they would be printed in every plan of every
    query that has them, which fills the driver with megabytes of text that Spark keeps."""
    kinds = pa.list_(pa.int64())
    row = pa.table({name: pa.array([part], kinds) for name, part in zip(("starts", "slots"), vocab.table, strict=True)})
    return spark.createDataFrame(row).select(F.struct("starts", "slots")).scalar()


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_ids(rows: DataFrame, name: str, vocab: Vocabulary) -> DataFrame:
    """``rows`` with the ids of each word in place of the ids of its bytes in column ``name``, array<array<int>>.

    The state of the fold is one number per piece: the rank of the pair that it forms with the next
    piece, above the place of its first byte, above its own id. So the least number is the leftmost pair
    of lowest rank.
    """
    # A copy of both tables is made once a row, as objects; every look-up refers to it.
    own = lambda t: F.struct(*(F.transform(t[name], lambda x: x).alias(name) for name in ("starts", "slots")))
    ids = _bound(F.col("_tables"), lambda given: _bound(own(given), lambda t: F.transform(
        name, lambda word: _folded(word, t["starts"], t["slots"]))))
    # A subquery may not stand in the functions themselves.
    return rows.withColumn("_tables", _tables(rows.sparkSession, vocab)).withColumn(name, ids).drop("_tables")


#: Where the rank starts in a number of the state; 31 bits of place are below it, then 16 of the id.
_RANK = 47


def _folded(byte_ids: Column, starts: Column, slots: Column) -> Column:
    def piece(left: Column, right: Column, place: Column) -> Column:
        """The number of a piece (id and place) before another one, if any: then null ends in no rank."""
        slot = F.get(slots, F.get(starts, left) + right)
        # The merged id if the slot names the left one; else a higher bit differs. Null is passed over.
        rank = F.least(slot.bitwiseXOR(F.shiftleft(left, 16)), F.lit(NEVER).cast("long"))
        return F.shiftleft(rank, _RANK).bitwiseOR(place).bitwiseOR(left)

    def merge(state: Column, _) -> Column:
        """The leftmost pair of lowest rank becomes one piece; its neighbours get new ranks."""
        own, where = (lambda x: x.bitwiseAND(NEVER)), (lambda x: x.bitwiseAND(((1 << 31) - 1) << 16))

        def at(found: Column) -> Column:
            best, pos = found["best"], found["pos"]
            # ``pos`` counts from one: the piece after the pair is at ``pos + 1`` counted from zero.
            merged_id, before = F.shiftright(best, _RANK), F.get(state, pos - 2)
            whole = piece(merged_id, own(F.get(state, pos + 1)), where(best))
            return F.when(pos > 1, F.concat(
                F.slice(state, 1, pos - 2), F.array(piece(own(before), merged_id, where(before)), whole),
                F.slice(state, pos + 2, n))).otherwise(F.concat(F.array(whole), F.slice(state, 3, n)))

        return _bound(F.array_min(state), lambda best: F.when(best >= NEVER << _RANK, state).otherwise(
            _bound(F.struct(best.alias("best"), F.array_position(state, best).cast("int").alias("pos")), at)))

    n = F.size(byte_ids)
    ids = byte_ids.cast("array<bigint>")
    start = F.transform(ids, lambda x, i: piece(x, F.get(ids, i + 1), F.shiftleft(i.cast("bigint"), 16)))
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.aggregate(steps, start, merge), lambda x: x.bitwiseAND(NEVER).cast("int"))


#: The pattern of the given vocabularies, for which ``_finder`` has a faster equal.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _finder(pattern: str):
    """The words of a text by ``pattern``, as its library finds them.

    ``WORDS`` is matched by the standard library, with the other library's classes spelled out, where a text
    has no characters beyond 16 bits: tables of those are looked up at once, and it takes half the time.
    """
    import regex

    slow = regex.compile(pattern).findall
    if pattern != WORDS:
        return slow
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))

    def spelled(members: str) -> str:
        runs = (m.group() for m in regex.finditer(f"{members}+", every))
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)

    space, letter, number = map(spelled, (r"\s", r"\p{L}", r"\p{N}"))
    fast = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def find(text: str) -> list[str]:
        return fast(text) if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else slow(text)

    return find


class _Codes(dict):
    """Code of each word, given out as words come; new ones wait to be sent."""

    def __init__(self, known: list[str]) -> None:
        super().__init__(zip(known, range(len(known))))
        self.known, self.new = len(known), []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


def _byte_ids(words: list[str], vocab: Vocabulary) -> pa.ListArray:
    """Of each word the ids of its bytes, or the one id of a word that is a piece."""
    raw = [word.encode() for word in words]
    parts = [vocab.byte_ids[np.frombuffer(b, np.uint8)] if (whole := vocab.ranks.get(b)) is None
             else np.array([whole], np.int32) for b in raw]
    bounds = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


_CUT = "_ids array<{id}>, _pieces binary, _codes binary, _words array<array<int>>, _fresh boolean"
#: Words of a partition that are remembered at a time.
REMEMBERED = 1 << 19


def _cut(path: str, pattern: str, known: list[str], size: int):
    """Batches of documents to one row each: ids, words per text, codes of words, new words' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, find = vocabulary(path), _finder(pattern)
        codes = _Codes(known)
        fresh = True
        for batch in batches:
            for part in W.in_pieces(batch, "_text", size):
                if len(codes) > len(known) + REMEMBERED:
                    codes, fresh = _Codes(known), True
                out, counts = [], []
                for text in part.column("_text").to_pylist():
                    words = find(text) if text else []
                    counts.append(len(words))
                    out.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                new = _byte_ids(codes.new, vocab)
                codes.new = []
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([np.array(counts, np.int32).tobytes()], pa.binary()),
                    pa.array([np.concatenate(out).tobytes() if out else b""], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new),
                    pa.array([fresh]),
                ], names=["_ids", "_pieces", "_codes", "_words", "_fresh"])
                fresh = False

    return run


def _put_together(first: np.ndarray, first_sizes: np.ndarray):
    """The rows of ``_cut`` with encoded words to ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes, starts = first, first_sizes, np.cumsum(first_sizes) - first_sizes
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("_fresh")[0].as_py():
                    flat, sizes, starts = first, first_sizes, np.cumsum(first_sizes) - first_sizes
                words = row.column("_words").flatten()
                more = np.diff(words.offsets.to_numpy()).astype(np.int64)
                flat = np.concatenate([flat, words.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
                sizes = np.concatenate([sizes, more])
                starts = np.cumsum(sizes) - sizes
                codes = np.frombuffer(row.column("_codes")[0].as_py(), np.int32)
                counts = np.frombuffer(row.column("_pieces")[0].as_py(), np.int32)
                n = sizes[codes]
                ends = np.cumsum(n)
                ids = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    row.column("_ids").flatten(), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)),
                ], names=["doc_id", "ids"])

    return run


def frequent_words(docs: DataFrame, pattern: str, sample_docs: int, words: int) -> DataFrame:
    """``word``: at most ``words`` words that come at least twice in about ``sample_docs`` documents."""
    sample = docs.select("_text").sample(min(1.0, sample_docs / max(1, docs.count())), seed=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(pattern)
        for batch in batches:
            for part in W.in_pieces(batch, "_text"):
                seen: Counter = Counter()
                for text in part.column("_text").to_pylist():
                    seen.update(find(text) if text else [])
                seen = Counter({w: n for w, n in seen.items() if len(w) <= 32})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    found = sample.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where("n > 1").orderBy(F.desc("n"), "word").limit(words).select("word")


def encode_words(words: DataFrame, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of a bounded number of words: the words, their ids one after the other, and how many each has."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word")
            all_of = pa.array([0, len(word)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(all_of, part) for part in (word, _byte_ids(word.to_pylist(), vocabulary(path)))],
                names=["words", "ids"])

    spread = written(words, "words").repartition(2 * words.sparkSession.sparkContext.defaultParallelism)
    got = with_ids(spread.mapInArrow(spelled, "words array<string>, ids array<array<int>>"), "ids", vocabulary(path)).toArrow()
    ids = got["ids"].combine_chunks().flatten()
    sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    return got["words"].combine_chunks().flatten().to_pylist(), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), sizes


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *,
    sample_docs: int = 30_000, known_words: int = 1 << 17, batch_bytes: int = 4 << 20, with_round_trip: bool = False,
    with_digests: bool = False,
) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs``; ``ids`` as the tokenizer's own library gives them.

    ``with_round_trip`` adds what ``round_trip`` does, in the same Python worker; ``with_digests`` gives what
    ``digests`` does instead, so no ids leave that worker.

    ``path`` is a rank file that every machine has. Null and empty texts have no ids. ``doc_id``
    passes unchanged, null and repeated values too; other columns are ignored. ``sample_docs`` and
    ``known_words`` bound the dictionary that is made beforehand and sent to the tasks.
    """
    vocab = vocabulary(path)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    known, flat, sizes = encode_words(frequent_words(source, pattern, sample_docs, known_words), path)
    # Either worker takes only what it needs.
    sent_words, sent_ids = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast((flat, sizes))
    more = (_DIGESTS, _digests) if with_digests else (_ROUND_TRIP, _round_trip) if with_round_trip else None

    def cut(batches):
        yield from _cut(path, pattern, sent_words.value, batch_bytes)(batches)

    def put_together(batches):
        whole = _put_together(*sent_ids.value)(batches)
        yield from more[1](path)(whole) if more else whole

    rows = with_ids(source.mapInArrow(cut, _CUT.format(id=id_type)), "_words", vocab)
    return rows.mapInArrow(put_together, f"doc_id {id_type}, {more[0] if more else 'ids array<int>'}")


@lru_cache(maxsize=2)
def pieces_of(path: str) -> list[bytes]:
    """Bytes of each id."""
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decoded(ids: list[int], path: str) -> bytes:
    """The pieces of a list of ids, one after the other."""
    return b"".join(map(pieces_of(path).__getitem__, ids))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` (binary) for rows of ``doc_id, ids``; null ids as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([decoded(ids or [], path) for ids in batch.column("ids").to_pylist()], pa.binary())],
                names=["doc_id", "decoded"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, decoded binary")


_DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array([*pieces_of(path), None], object)[:-1]  # objects: bytes may end in zeros
        shown = np.array(list(map(str, range(len(pieces)))), object)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy()
                listed = ",".join(shown.take(ids).tolist()).encode()
                raw = b"".join(pieces.take(ids).tolist())
                rows.append((len(ids), sha256(listed).hexdigest(), sha256(raw).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for rows of ``doc_id, ids``."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_digests(path), f"doc_id {id_type}, {_DIGESTS}")


_ROUND_TRIP = "n_tokens bigint, ids array<int>, decoded_sha256 string"


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = [sha256(decoded(batch.column("ids")[i].as_py() or [], path)).hexdigest() for i in range(batch.num_rows)]
            sizes = batch.column("ids").value_lengths().fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, batch.column("ids"), pa.array(shas, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return run


def round_trip(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` for rows of ``doc_id, ids``; the digest is of the bytes that the ids decode to.

    Null ids count as none. Each row is decoded by itself: repeated and null ``doc_id`` pass unchanged.
    """
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_round_trip(path), f"doc_id {id_type}, {_ROUND_TRIP}")
