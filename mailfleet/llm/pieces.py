"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie over code points. Each node gets a failure link (where to go on when
no edge fits) and the number of whole pieces popped on the way, both found breadth first, so a word
is measured in one walk without backing up and without building its pieces. Words are cut at white
space, get the vocabulary's word mark in front, and each distinct word of a batch is walked once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.llm import words as W

WORD_MARK = "▁"
#: Distinct words whose counts a worker remembers; forgotten ones are walked again.
REMEMBERED = 1 << 20


class Automaton:
    """Counts the pieces of a word as if the longest fitting piece were cut off again and again.

    Where no piece fits, one character is cut off and counts as its UTF-8 bytes (byte fallback). A
    character of any piece therefore has a node below the root, so every node has a failure link.
    """

    def __init__(self, pieces) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.cost: list[int] = [0]  # tokens of the text read at a node, 0 where it is no piece
        for char in sorted({char for piece in pieces for char in piece}):
            self.cost[self._node(char)] = len(char.encode())
        for piece in pieces:
            if piece:
                self.cost[self._node(piece)] = 1
        self._link()

    def _node(self, text: str) -> int:
        at = 0
        for char in text:
            nxt = self.edges[at].get(char)
            if nxt is None:
                nxt = self.edges[at][char] = len(self.edges)
                self.edges.append({})
                self.cost.append(0)
            at = nxt
        return at

    def _link(self) -> None:
        """Failure links and popped tokens, parents before children."""
        self.fail = [0] * len(self.edges)
        self.pops = list(self.cost)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for char, node in self.edges[parent].items():
                queue.append(node)
                if self.cost[node]:
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while char not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                self.fail[node], self.pops[node] = self.edges[at][char], popped

    def count(self, word: str) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        at = tokens = 0
        for char in word:
            nxt = edges[at].get(char)
            while nxt is None and at:
                tokens += pops[at]
                at = fail[at]
                nxt = edges[at].get(char)
            if nxt is None:
                tokens += len(char.encode())
            else:
                at = nxt
        while at:
            tokens += pops[at]
            at = fail[at]
        return tokens


def vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Automaton, dict[int, int]]:
    return Automaton(vocabulary(path)), {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_tokens``.

    ``path`` is a sentencepiece model that every machine has. Null and empty texts have no words
    and no tokens. Ids pass unchanged, null and repeated ones too; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _loaded(path)
        for batch in batches:
            for piece in W.in_pieces(batch, "_text"):
                found = W.words_of(piece.column("_text"), lower=False)
                codes, keys, first = W.distinct(found.hash)
                if len(known) + len(keys) > REMEMBERED:
                    known.clear()
                counts = [known.get(k) for k in keys.tolist()]
                raw = found.data.tobytes()
                for j, count in enumerate(counts):
                    if count is None:
                        at = first[j]
                        word = raw[found.start[at]:found.end[at]].decode()
                        counts[j] = known[int(keys[j])] = automaton.count(WORD_MARK + word)
                per_word = np.array(counts, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"),
                    pa.array(np.bincount(found.text, minlength=found.texts).astype(np.int64)),
                    pa.array(W.sums_by_text(per_word, found).astype(np.int64)),
                ], names=["doc_id", "n_words", "n_tokens"])

    return source.mapInArrow(counted, f"doc_id {id_type}, n_words bigint, n_tokens bigint")
