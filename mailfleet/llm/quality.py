"""Quality classifier: supervised subword embeddings.

Features of a text are its words, the byte 3- to 5-grams of each word with marked ends, and pairs of
neighbouring words; each is hashed to one of a fixed number of learned vectors. A text is the mean of
its features' vectors, and a softmax layer on top gives the classes. Training is stochastic gradient
descent in numpy, one text a step, on a bounded sample of labelled texts. A word directly after
itself is one feature for all words, so repetition is learned as such.

For scoring, mean and output layer are linear, so every vector is first projected to one number; a
text then costs one sum per distinct word and per pair. Whole texts are read, in batches of bounded
size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.llm import words as W
from mailfleet.llm.labelled import training_rows

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
_REPEATED = np.uint64(0x5DEECE66D1234567)


class Model(NamedTuple):
    projected: np.ndarray  # per bucket: contribution to the log odds of class 1
    bias: float


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (W.mix(hashes) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _word_features(found: W.Words, first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every word and n-gram of the distinct words."""
    size = (found.end - found.start)[first]
    ends = np.cumsum(size + 2)
    starts = ends - size - 2
    total = int(ends[-1]) if len(ends) else 0
    data = np.empty(total, np.uint64)
    word = np.repeat(np.arange(len(first)), size + 2)
    inside = np.arange(total) - starts[word]
    letters = (inside > 0) & (inside <= size[word])
    data[letters] = found.data[(found.start[first][word] + inside - 1)[letters]].astype(np.uint64) + np.uint64(1)
    data[starts] = np.uint64(300)
    data[ends - 1] = np.uint64(301)
    who, where = [np.arange(len(first))], [_buckets(keys)]
    for n in GRAMS:
        if total < n:
            continue
        fits = np.flatnonzero(inside[: total - n + 1] + n <= size[word[: total - n + 1]] + 2)
        h = np.full(len(fits), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + data[fits + j]
        who.append(word[fits])
        where.append(_buckets(h))
    return np.concatenate(who), np.concatenate(where)


def _pairs(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each two neighbouring words."""
    a, b = found.hash[:-1], found.hash[1:]
    same = found.text[:-1] == found.text[1:]
    h = np.where(a == b, _REPEATED, a * np.uint64(3) + W.mix(b))
    return found.text[:-1][same], _buckets(h)[same]


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their share of all its features."""
    found = W.words_of(pa.array([text]), lower=False)
    codes, keys, first = W.distinct(found.hash)
    who, where = _word_features(found, first, keys)
    times = np.bincount(codes, minlength=len(keys))[who] if len(who) else np.zeros(0)
    counts = np.bincount(where, times, BUCKETS) if len(where) else np.zeros(BUCKETS)
    _, pairs = _pairs(found)
    counts += np.bincount(pairs, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used.astype(np.int32), (counts[used] / max(1.0, counts.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, dim: int = 8, epochs: int = 8,
          rate: float = 2.0, seed: int = 1) -> Model:
    """Learns vectors and output layer; with one class only, a constant model of that class."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = epochs * max(1, len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            used, share = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[used]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[int(y[i])] -= 1
            back = out @ error
            out -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            vectors[used] -= (now * 10) * share[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", *, max_rows: int = 2000) -> Model:
    """A model from at most ``max_rows`` labelled texts; their features are made in tasks.

    Without any labelled text the model says 1 for every text, so that nothing is rejected.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                used, share = _bag(batch.column("_text")[i].as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([used.tobytes()]), pa.array([share.tobytes()]), batch.column("y").slice(i, 1)],
                    names=["used", "share", "y"])

    rows = training_rows(docs, labels, label, max_rows).mapInArrow(
        bags, "used binary, share binary, y int").toArrow()
    # The order of training must not depend on the order of tasks.
    rows = sorted(zip(rows["used"].to_pylist(), rows["share"].to_pylist(), rows["y"].to_pylist(), strict=True))
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 5.0)
    return train([(np.frombuffer(u, np.int32), np.frombuffer(s, np.float32)) for u, s, _ in rows],
                 np.array([y for *_, y in rows]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row of ``docs``: the chance of class 1, from the whole text.

    Null texts count as empty ones; a text without words gets what the output layer's bias says.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    sent = source.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projected, bias = sent.value
        for batch in batches:
            for part in W.in_pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(_scores(part.column("_text"), projected, bias))],
                    names=["doc_id", "score"])

    return source.mapInArrow(scored, f"doc_id {id_type}, score double")


#: Text scored at a time where whole rows pass through.
PIECE_BYTES = 1 << 20


def accepted(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns unchanged; nothing is shuffled.

    Each row is judged by its own text: ids may be null or repeated, null texts count as empty, a score equal to the threshold
    passes. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.in_pieces(batch, text_col, PIECE_BYTES):
                yield part.filter(pa.array(_scores(part.column(text_col), *sent.value) >= threshold))

    return docs.mapInArrow(passed, docs.schema)


def _scores(texts: pa.Array, projected: np.ndarray, bias: float) -> np.ndarray:
    found = W.words_of(texts, lower=False)
    codes, keys, first = W.distinct(found.hash)
    who, where = _word_features(found, first, keys)
    by_word = np.bincount(who, projected[where], len(keys))
    features = np.bincount(who, minlength=len(keys))
    text, pairs = _pairs(found)
    total = W.sums_by_text(by_word[codes], found) + np.bincount(text, projected[pairs], found.texts)
    n = W.sums_by_text(features[codes], found) + np.bincount(text, minlength=found.texts)
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))


def classified(docs: DataFrame, labels: DataFrame, *, max_rows: int = 2000) -> DataFrame:
    """Learns from ``labels`` and scores every row of ``docs`` (columns ``doc_id, text``)."""
    slim = docs.select("doc_id", F.col("text").alias("_text"))
    return scores(docs, learn(slim, labels, max_rows=max_rows))
