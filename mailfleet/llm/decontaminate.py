"""Documents that hold benchmark items, found by spaced seeds.

A mask is a row of word positions of which some do not count. Every place of every item, and of every
document, gets one hash per mask over the words that count, so a hit survives changed words at the
other positions. The hashes of both sides are joined; each hit gives a document, an item and a shift,
and the words are compared along that shift: an overlap is a run of ``WINDOW`` words of which at least
``EQUAL`` are the same (more than 0.8), extended while that holds. The masks are such that each overlap
has a hit. Items shorter than a window must occur whole, with as many changed words in proportion:
one of seven to twelve, for which two masks share out the item's words, and none of fewer. Words end
at white space, so an item in a script without spaces is one word, found where it stands alone.

The text side is filtered in the scan by a bit table of fixed size over the items' hashes, so only
places that may hit are shuffled, and word lists only of documents that have such a place, once a
document: what is compared is cut from them beside the item. Nothing
grows with the number of items or documents but the joins, whose hot keys are split at run time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.llm import words as W
from mailfleet.llm.bloom import filter_of
from mailfleet.llm.shared import without_rows, written

WINDOW, EQUAL = 13, 11
#: Items of fewer words occur by chance; they are found, but no document goes for them.
LEAST = 5
#: One mask of five words in eight is enough: no two changed words of thirteen spoil all its places.
MASKS = ("11010011",)


def needed(window: int) -> int:
    """Equal words that an overlap of so many words has."""
    return window - window * (WINDOW - EQUAL) // WINDOW


def _masks(short: list[int]) -> list[tuple[np.ndarray, int]]:
    """Positions that count: of the fixed masks, with 0, and of masks for whole items, with the item's length."""
    masks = [(np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49), 0) for m in MASKS]
    for n in short:
        # A changed word spoils one of two masks that have no position in common.
        parts = n - needed(n) + 1
        masks += [(np.arange(first, n, parts), n) for first in range(parts)]
    return masks


def seed_hashes(hashes: np.ndarray, text: np.ndarray, mask: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) for each place where the mask fits into one text."""
    n = len(hashes) - int(mask[-1])
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, 2 * number + 1, np.uint64)
    for at in mask.tolist():
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[at:at + n]
    fits = np.flatnonzero(text[:n] == text[int(mask[-1]):])
    return fits, W.mix(h[fits])


def _seeds(short: list[int]):
    """Rows of items to one row per hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.in_pieces(batch, "_text"):
                found = W.words_of(part.column("_text"))
                length = np.bincount(found.text, minlength=found.texts)
                begin = np.cumsum(length) - length
                ids = part.column("item_id")
                for number, (mask, whole) in enumerate(_masks(short)):
                    place, h = seed_hashes(found.hash, found.text, mask, number)
                    size = length[found.text[place]]
                    use = (size == whole) & (place == begin[found.text[place]]) if whole else size >= WINDOW
                    place, h, size = place[use], h[use], size[use]
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(found.text[place])), pa.array(place - begin[found.text[place]], pa.int32()),
                        pa.array(h.view(np.int64)), pa.array(size, pa.int32())], names=["item_id", "at", "seed", "size"])

    return run


def _places(short: list[int], sent):
    """Rows of documents to those with a possible hit: id, digest of the text, words, and their places and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(short)
        for batch in batches:
            for part in W.in_pieces(batch, "_text"):
                found = W.words_of(part.column("_text"))
                length = np.bincount(found.text, minlength=found.texts)
                begin = np.cumsum(length) - length
                hits = []
                for number, (mask, _) in enumerate(masks):
                    place, h = seed_hashes(found.hash, found.text, mask, number)
                    use = sent.value.has(h)
                    hits.append((place[use], h[use]))
                place, h = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(place, kind="stable")
                place, h = place[order], h[order]
                text = found.text[place]
                chosen = np.unique(text)
                if not len(chosen):
                    continue
                bounds = np.r_[np.searchsorted(text, chosen), len(text)].astype(np.int32)
                raw = part.column("_text").take(pa.array(chosen)).cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(chosen)),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in raw], pa.string()),
                    pa.array([found.hash[begin[i]:begin[i] + length[i]].tobytes() for i in chosen.tolist()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(place - begin[text], pa.int32())),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64))),
                ], names=["doc_id", "_sha", "_words", "_at", "_seed"])

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first word in the document, word after the last, equal words) of the longest overlap on a shift."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    window = min(WINDOW, len(item))
    if high - low < window:
        return None
    same = doc[low + shift:high + shift] == item[low:high]
    sums = np.r_[0, np.cumsum(same)]
    good = sums[window:] - sums[:-window] >= needed(window)
    if not good.any():
        return None
    covered = np.convolve(good, np.ones(window, int)) > 0
    edge = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    begin, end = max(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True), key=lambda x: x[1] - x[0])
    while not same[begin]:
        begin += 1
    while not same[end - 1]:
        end -= 1
    return begin + low + shift, end + low + shift, int(sums[end] - sums[begin])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            doc = np.frombuffer(batch.column("_words")[i].as_buffer(), np.uint64)
            item = np.frombuffer(batch.column("_item")[i].as_buffer(), np.uint64)
            begin = batch.column("_begin")[i].as_py()
            found = overlap(doc, item, batch.column("_shift")[i].as_py() - begin)
            rows.append(found and (found[0] + begin, found[1] + begin, found[2]))
        keep = pa.array([r is not None for r in rows], pa.bool_())
        rows = [r for r in rows if r]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").filter(keep), batch.column("_sha").filter(keep), batch.column("item_id").filter(keep),
            *(pa.array([r[j] for r in rows], pa.int64()) for j in range(3))],
            names=["doc_id", "_sha", "item_id", "first_word", "end_word", "equal_words"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.in_pieces(batch, "_text"):
            found = W.words_of(part.column("_text"))
            cut = np.searchsorted(found.text, np.arange(found.texts + 1))
            yield pa.RecordBatch.from_arrays([
                part.column("item_id"),
                pa.array([found.hash[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["item_id", "_item"])


def _hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, filter_bits: int,
    least: int,
) -> DataFrame:
    """``doc_id, _sha, item_id, first_word, end_word, equal_words``: the longest overlap of each shift of each row;
    ``_sha`` is the digest of the row's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("_text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    stored = written(items.mapInArrow(_item_words, f"item_id {item_type}, _item binary").distinct(), "items")
    length = F.octet_length("_item") / 8
    short = sorted(int(r[0]) for r in stored.where((length >= max(1, least)) & (length < WINDOW)).select(length).distinct().collect())
    seeds = written(items.mapInArrow(_seeds(short), f"item_id {item_type}, at int, seed bigint, size int").distinct(), "seeds")
    sent = spark.sparkContext.broadcast(filter_of(seeds, "seed", filter_bits))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    found = written(source.mapInArrow(
        _places(short, sent), f"doc_id {id_type}, _sha string, _words binary, _at array<int>, _seed array<bigint>"), "places")
    # A row is known by its id and text: equal rows hit alike.
    own = F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit("-"))
    found = found.withColumn("_row", F.sha2(F.concat("_sha", own), 256))
    hits = found.select("_row", F.explode(F.arrays_zip("_at", "_seed")).alias("_hit")).select(
        "_row", F.col("_hit._at").alias("_at"), F.col("_hit._seed").alias("seed"))
    shifts = hits.join(seeds, "seed").select(
        "_row", "item_id", "size", (F.col("_at") - F.col("at")).alias("_shift")).distinct()
    texts = found.select("_row", "doc_id", "_sha", "_words").groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("_sha").alias("_sha"), F.first("_words").alias("_words"))
    # Eight bytes a word: those beside the item, not the whole text, go on to meet it.
    cut = F.expr("substring(_words, _begin * 8 + 1, (_shift + size - _begin) * 8)")
    beside = shifts.withColumn("_begin", F.greatest("_shift", F.lit(0))).join(texts, "_row").select(
        "doc_id", "_sha", F.col("item_id").alias("_of"), cut.alias("_words"), "_begin", "_shift")
    pairs = beside.join(stored, F.col("_of").eqNullSafe(F.col("item_id"))).select(
        "doc_id", "_sha", "item_id", "_words", "_item", "_begin", "_shift")
    return pairs.mapInArrow(
        _verified, f"doc_id {id_type}, _sha string, item_id {item_type}, first_word bigint, end_word bigint, equal_words bigint")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", *, filter_bits: int = 24,
    least: int = 1,
) -> DataFrame:
    """``doc_id, item_id, first_word, end_word, equal_words``: the longest overlap of each pair.

    Words are compared without regard to A-Z capitals, in whole texts. Null and empty texts overlap
    nothing. Items of fewer than ``least`` words are left out. Rows without an id are compared as well and have a null id in the result; rows that repeat
    an id count as one document here. Other columns are ignored, whatever their names.
    """
    verified = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, filter_bits, least)
    longest = F.struct("equal_words", (-F.col("first_word")).alias("a"), (-F.col("end_word")).alias("b"))
    return verified.groupBy("doc_id", "item_id").agg(F.max(longest).alias("m")).select(
        "doc_id", "item_id", (-F.col("m.a")).alias("first_word"), (-F.col("m.b")).alias("end_word"),
        F.col("m.equal_words").alias("equal_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, filter_bits: int = 24, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` whose own text overlaps no item of ``least`` words or more, all columns unchanged.

    A row goes by its id and its text together: rows that share an id, or have none, are decided each.
    """
    gone = _hits(docs, benchmark, "doc_id", "text", "item_id", "text", filter_bits, least).select(
        F.col("doc_id").alias("_gone"), F.col("_sha").alias("_gone_sha")).distinct()
    return without_rows(docs, "doc_id", F.sha2("text", 256), gone)
