"""Scoring texts by a causal self-attention model over subword ids, and by word frequencies.

Every part of the model learns from all windows of every training text, in rounds that each take
another share of the texts. In a round each task starts from the same attention and shares, takes
gradient steps through its whole texts, and adds up the expected counts of the distributions that the
model mixes; Spark sums the moves, weighted by the ids behind them, and the counts. A last pass counts
over all texts with the final attention. Input of fewer windows than the least number of steps takes
is gone through repeatedly, all of it, on the driver. Texts are cut to ids once; the ids are stored
apart by round, and training, the last pass and scoring read them. Scoring cuts each whole text into overlapping
windows, so every id is scored once, with context.

The word model needs the count of every word in all training texts. The most frequent words, a bounded
number, are sent to the tasks; the others are looked up by a join of (word, text) pairs with the table
of counts. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.llm import attention as A
from mailfleet.llm import words as W
from mailfleet.llm.bpe import ranks_of
from mailfleet.llm.labelled import fold_of
from mailfleet.llm.shared import written

HELD_OUT = 1
#: Most frequent words that are sent to the tasks.
SENT_WORDS = 1 << 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_REMEMBERED = 1 << 19
_BLOCK = 64
#: How many 64ths of the texts each round of training takes; rounds are short while weights move most.
ROUNDS = (1, 1, 2, 4, 8, 8, 8, 8, 12, 12)
_RATE, _MANY = 0.02, 128
#: Bytes of text, and ids, taken at a time in training, which keeps its tables beside them.
_PIECE, _PIECE_IDS = 1 << 20, 1 << 18
#: Bytes of stored ids that a writer holds.
_ROW_GROUP = 16 << 20


class Subwords:
    """Ids of words, each with a space before it; remembers the words it met last."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        ranks = ranks_of(path)
        self.end = max(ranks.values()) + 1
        self.encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[int, bytes] = {}

    def sequences(self, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, an end mark after each, and how many each text has."""
        codes, keys, first = W.distinct(found.hash)
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        known, raw = self.known, found.data.tobytes()
        ids = [known.get(k) for k in keys.tolist()]
        for j, own in enumerate(ids):
            if own is None:
                word = raw[found.start[first[j]]:found.end[first[j]]].translate(_LOWER)
                ids[j] = known[int(keys[j])] = array("i", self.encode(" " + word.decode())).tobytes()
        ids.append(array("i", [self.end]).tobytes())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        starts = np.cumsum(sizes) - sizes
        words = np.bincount(found.text, minlength=found.texts)
        codes = np.insert(codes, np.cumsum(words), len(ids) - 1)
        n = sizes[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        text = np.repeat(np.arange(found.texts), words + 1)
        return out, np.bincount(text, n, found.texts).astype(np.int64)


@lru_cache(maxsize=2)
def subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


def _kind(end: int) -> type:
    """Stored ids take two bytes where they fit."""
    return np.uint16 if end < 1 << 16 else np.int32


def _sequences(batches: Iterator[pa.RecordBatch], path: str, pattern: str, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and lengths of some texts at a time: of texts (``_text``), or of ``ids`` cut before."""
    for batch in batches:
        if "_text" in batch.schema.names:
            for part in W.in_pieces(batch, "_text", _PIECE):
                yield subwords(path, pattern).sequences(W.words_of(part.column("_text")))
        else:
            subwords.cache_clear()  # words remembered by this worker are not needed any more
            yield from (found for found, _ in _stored(batch, end))


def _stored(batch: pa.RecordBatch, end: int) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], pa.RecordBatch]]:
    """Ids and lengths of some rows of ``ids`` at a time, and these rows; a longer text is taken by itself."""
    kind = np.dtype(_kind(end))
    lengths = np.array([len(x.as_buffer()) // kind.itemsize for x in batch.column("ids")], np.int64)
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        most = ends[first] - lengths[first] + _PIECE_IDS
        last = max(first + 1, int(np.searchsorted(ends, most, side="right")))
        part = batch.slice(first, last - first)
        raw = b"".join(x.as_buffer() for x in part.column("ids"))
        yield (np.frombuffer(raw, kind).astype(np.int32), lengths[first:last]), part
        first = last


def round_of(key: Column) -> Column:
    """The round of training that takes a text, by a hash of it."""
    slot = F.pmod(key, F.lit(sum(ROUNDS)))
    return sum((slot >= sum(ROUNDS[:i])).cast("int") for i in range(1, len(ROUNDS)))


def word_counts(texts: DataFrame) -> DataFrame:
    """``h, c``: how often each word comes in all rows of ``_text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in W.in_pieces(batch, "_text"):
                codes, keys, _ = W.distinct(W.words_of(part.column("_text")).hash)
                held.append((keys, np.bincount(codes, minlength=len(keys))))
                size += len(keys)
                if size > 2_000_000:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    def summed(held: list) -> pa.RecordBatch:
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(place, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "c"])

    return texts.mapInArrow(counted, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _parts(**tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of some tables, without those that are zero."""
    for name, table in tables.items():
        for at in range(0, len(table), _BLOCK):
            block = table[at:at + _BLOCK].astype(np.float32)
            if block.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([at], pa.int32()), pa.array([block.tobytes()])], names=["name", "at", "n"])


def _sums(texts: DataFrame, run, **shapes: tuple[int, int]) -> dict[str, np.ndarray]:
    """Sums over all tasks of the tables that ``run`` gives in ``_parts``."""

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["n"])
        return pa.table({"name": table["name"].slice(0, 1), "at": table["at"].slice(0, 1), "n": pa.array([total.tobytes()])})

    # At most one row per block of each table comes back.
    fields = "name string, at int, n binary"
    blocks = texts.mapInArrow(run, fields).groupBy("name", "at").applyInArrow(added, fields).toArrow()
    out = {name: np.zeros(shape) for name, shape in shapes.items()}
    for name, at, n in zip(*(blocks[c].to_pylist() for c in ("name", "at", "n")), strict=True):
        out[name][at:at + _BLOCK] = np.frombuffer(n, np.float64).reshape(-1, out[name].shape[1])
    return out


def id_counts(texts: DataFrame, path: str, pattern: str) -> np.ndarray:
    """How often each id comes in all rows of ``_text`` or ``ids``."""
    vocabulary = subwords(path, pattern).end + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary)
        for ids, _ in _sequences(batches, path, pattern, vocabulary - 1):
            counts += np.bincount(ids, minlength=vocabulary)
        yield from _parts(n=counts[:, None])

    return _sums(texts, counted, n=(vocabulary, 1))["n"][:, 0]


def _whole(path: str, pattern: str, end: int):
    """Ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths in _sequences(batches, path, pattern, end):
            own = np.split(ids, np.cumsum(lengths)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in own], pa.binary())], names=["ids"])

    return run


def _followed(path: str, pattern: str, end: int, sent, rate: float):
    """Moves of the weights over the texts of a task, times the ids behind them; these; and expected counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, chance = sent.value
        trainer = A.Trainer(end + 1, TaskContext.get().partitionId())
        trainer.w, trainer.chance = {name: w.copy() for name, w in weights.items()}, chance
        counts, came = np.zeros(chance.shape), np.zeros(len(chance))
        for ids, lengths in _sequences(batches, path, pattern, end):
            trainer.follow(ids, lengths, end, counts, rate=rate, many=_MANY)
            came += np.bincount(ids, minlength=len(came))
        n = came.sum()
        if n:
            tables = {name: np.c_[(w - weights[name]).reshape(1, -1) * n, n] for name, w in trainer.w.items() if name != "emb"}
            emb = trainer.w["emb"] - weights["emb"]
            yield from _parts(counts=counts, emb=np.c_[emb * came[:, None], came], **tables)

    return run


def train_shares(texts: DataFrame, path: str, pattern: str, *, steps: int) -> A.Model:
    """Trains attention and shares on all rows, in at least ``steps`` steps: of ``_text``, or of ``ids`` and ``_round``."""
    end, spark = subwords(path, pattern).end, texts.sparkSession
    seen = id_counts(texts, path, pattern)
    total = int(seen.sum())
    trainer = A.Trainer(end + 1)
    if total <= steps * _MANY * A.STEP:
        got = sorted(texts.drop("_round").mapInArrow(_whole(path, pattern, end), "ids binary").toArrow()["ids"].to_pylist())
        ids = [np.frombuffer(x, np.int32) for x in got] or [np.array([end], np.int32)]
        trainer.train(np.concatenate(ids), np.array([len(x) for x in ids]), end, steps=steps, many=_MANY, rate=_RATE)
    else:
        trainer.start(np.repeat(np.arange(end + 1), np.ceil(seen * min(1.0, 1e7 / total)).astype(np.int64)))
        held = trainer.chance * (total / A.SHARES)
        shapes = {name: (1, w.size + 1) for name, w in trainer.w.items() if name != "emb"}
        shapes |= {"counts": held.shape, "emb": (end + 1, A.DIM + 1)}
        turn, done = round_of(F.xxhash64("_text")) if "_text" in texts.columns else F.col("_round"), 0
        for number, size in enumerate(ROUNDS):
            sent = spark.sparkContext.broadcast((trainer.w, trainer.chance))
            sums = _sums(texts.where(turn == number).drop("_round"), _followed(
                path, pattern, end, sent, _RATE * (1 - 0.95 * done / sum(ROUNDS))), **shapes)
            done += size
            sent.unpersist()
            for name, w in trainer.w.items():
                moves, n = sums[name][:, :-1], sums[name][:, -1:]
                trainer.w[name] = w + (moves / np.maximum(n, 1)).reshape(w.shape).astype(np.float32)
            n = sums["counts"].sum()
            if n:
                held = (held + sums["counts"] * (total / n)) / 2
                trainer.chance = A.chances(held)
    trainer.neutral(seen)
    return trainer.model()


def with_all_counts(model: A.Model, texts: DataFrame, path: str, pattern: str) -> A.Model:
    """``model`` with its distributions estimated from every row of ``_text`` or ``ids``."""
    end, sent = subwords(path, pattern).end, texts.sparkSession.sparkContext.broadcast(model)

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(sent.value.chance.shape)
        for ids, lengths in _sequences(batches, path, pattern, end):
            A.expected_counts(sent.value, ids, lengths, end, counts)
        yield from _parts(counts=counts)

    counts = _sums(texts, expected, counts=model.chance.shape)["counts"]
    return model._replace(chance=A.chances(counts)) if counts.any() else model


def _cut(path: str, pattern: str, sent):
    """Per text: key of the row, tokens, sums over sent words, its other words with counts, and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logs = sent.value
        cut, key = subwords(path, pattern), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in W.in_pieces(batch, "_text", _PIECE):
                found = W.words_of(part.column("_text"))
                ids, lengths = cut.sequences(found)
                own = np.split(ids.astype(_kind(cut.end)), np.cumsum(lengths)[:-1])
                place = np.minimum(np.searchsorted(hashes, found.hash), max(0, len(hashes) - 1))
                known = hashes[place] == found.hash if len(hashes) else np.zeros(len(found.hash), bool)
                text = found.text[known]
                # The other words: distinct pairs of text and word, with counts.
                other, word = found.text[~known], found.hash[~known]
                order = np.lexsort((word, other))
                other, word = other[order], word[order]
                new = np.flatnonzero(np.r_[True, (other[1:] != other[:-1]) | (word[1:] != word[:-1])]) if len(word) else np.zeros(0, np.int64)
                counts = np.diff(np.r_[new, len(word)])
                bounds = np.searchsorted(other[new], np.arange(found.texts + 1)).astype(np.int32)
                n = found.texts
                yield pa.RecordBatch.from_arrays([
                    pa.array(key + np.arange(n)), part.column("doc_id"),
                    pa.array(np.bincount(found.text, minlength=n) + 1),
                    pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(text, logs[place[known]], n) if len(text) else np.zeros(n)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(word[new].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.astype(np.int64))),
                    pa.array([x.tobytes() for x in own], pa.binary())],
                    names=["_row", "doc_id", "n_tokens", "_known", "_base", "_h", "_n", "ids"])
                key += n

    return run


def _scored(end: int, sent):
    """Rows of ``ids`` with the score of the text in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids, lengths), part in _stored(batch, end):
                rest = [name for name in part.schema.names if name != "ids"]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, rest), pa.array(A.log_chances(sent.value, ids, lengths, end))], names=[*rest, "score"])

    return run


def scored(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *,
    held_out: int = HELD_OUT, steps: int = 900,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Learns from the rows whose fold is not ``held_out`` and scores all. Tokens are lower-cased words and
    one end per text; a null text is empty. Rows without an id are learned from. Rows that repeat an id
    are scored each; other columns are ignored, whatever their names. ``path`` is a rank file that every
    machine has.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    out = F.coalesce(fold_of(F.col("doc_id")) == held_out, F.lit(False))
    train = source.where(~out)
    counts = written(word_counts(train), "word-counts")
    ends = train.count()
    words = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, kinds = words[1] + ends, words[0] + (ends > 0)
    under = total + 0.5 * (kinds + 1)
    frequent = counts.orderBy(F.desc("c"), "h").limit(SENT_WORDS).toArrow()
    hashes = frequent["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    logs = np.log10((frequent["c"].to_numpy()[order] + 0.5) / under)
    spark, end_id = source.sparkSession, subwords(path, pattern).end
    words = spark.sparkContext.broadcast((hashes[order], logs))
    rows = source.mapInArrow(_cut(path, pattern, words), (
        f"_row bigint, doc_id {id_type}, n_tokens bigint, _known bigint, _base double, _h array<bigint>, _n array<bigint>, ids binary"))
    # Held out rows are in no round.
    rows = written(rows.withColumn("_round", F.when(out, -1).otherwise(round_of(F.xxhash64("ids")))), "cut", _ROW_GROUP, by=("_round",))
    learned = rows.where("_round >= 0").select("ids", "_round")
    model = train_shares(learned, path, pattern, steps=steps)
    model = spark.sparkContext.broadcast(with_all_counts(model, learned.select("ids"), path, pattern))
    whole = rows.select("_row", "doc_id", "n_tokens", "_known", "_base", "ids").mapInArrow(
        _scored(end_id, model), f"_row bigint, doc_id {id_type}, n_tokens bigint, _known bigint, _base double, score double")
    pairs = rows.select("_row", F.explode(F.arrays_zip("_h", "_n")).alias("p")).select(
        "_row", F.col("p._h").alias("h"), F.col("p._n").alias("n"))
    seen = F.coalesce("c", F.lit(0))
    others = pairs.join(counts, "h", "left").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10((seen + 0.5) / F.lit(float(under)))).alias("_sum"),
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("_more"))
    end = float(np.log10((ends + 0.5) / under))
    zero = F.lit(0)
    return whole.join(others, "_row", "left").select(
        "doc_id", out.alias("held_out"), "n_tokens",
        (F.col("_known") + F.coalesce("_more", zero) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_sum", F.lit(0.0)) + end).alias("base_score"), "score")
