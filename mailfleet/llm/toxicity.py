"""Toxicity by a weighted grammar over clauses.

Words become tags: insult (with a weight), threat, target, negation, reporting verb. The lexicon is a
letter machine: whole words and stems, some given, most learned from labelled texts by how much more
often toxic texts hold them. Five weighted transducers read the tags of a clause, each the output of
the one before. Each is a table of arcs (next state, symbol put out, weight) and final weights:

* insult: turns an insult into a match;
* threat: turns a target within a few words of a violent verb into a match;
* negation: discounts the matches in the few words after it;
* reported speech: discounts the matches after a reporting verb;
* target: multiplies what a clause has matched when it addresses somebody.

``compose`` makes one table of them, which is run over all clauses of a batch at once. A clause's score
is the sum of its matches' weights times the final weight. Clauses with a match are scored, not words;
a text's features are the sum, the largest and the number of its clause scores, and a logistic layer
trained in numpy on the same bounded sample of labelled texts turns them into a chance. Whole texts
are read, in batches of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.llm import words as W
from mailfleet.llm.labelled import training_rows
from mailfleet.llm.shared import written

INSULTS = "idiot moron stupid dumb fool loser trash scum worthless pathetic disgusting clown jerk bastard".split()
THREATS = "kill hurt destroy beat shoot stab strangle murder crush".split()
TARGETS = "you your yours yourself u he him his she her they them their these those".split()
NEGATIONS = "not never nobody isn't aren't wasn't don't didn't nicht kein keine jamais ningún".split()
REPORTS = "said says told called wrote quoted claimed sagte schrieb disait dijo".split()
GIVEN_WEIGHT = 2.0
NEGATION_SPAN, THREAT_SPAN = 3, 4
TARGETED, NEGATED, REPORTED, THREAT_WEIGHT = 1.25, 0.4, 0.6, 3.0

NONE, TARGET, NEGATION, REPORT, THREAT, INSULT, MATCH, THREAT_MATCH = range(8)
SYMBOLS = 8
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".!?;:,|")] = True
STEM_LENGTHS = range(3, 13)


class Lexicon(NamedTuple):
    words: dict[str, float]  # a weight of 0 exempts a common word from the stems
    stems: dict[str, float]


class Model(NamedTuple):
    lexicon: Lexicon
    layer: np.ndarray  # bias, then a weight per feature


class Tagger:
    """Tag and weight of a word, by one walk of a machine over its letters.

    A state has arcs by letter, the weight of the best stem that leads to it, and, where a whole word
    ends, that word's tag and weight. A whole word goes before stems.
    """

    FIXED = {**dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION),
             **dict.fromkeys(REPORTS, REPORT), **dict.fromkeys(THREATS, THREAT)}

    def __init__(self, lexicon: Lexicon) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.stem: dict[int, float] = {}
        self.weight: dict[int, float] = {}
        self.fixed: dict[int, int] = {}
        for word, tag in self.FIXED.items():
            self.fixed[self._state(word)] = tag
        for word, weight in lexicon.words.items():
            self.weight[self._state(word)] = weight
        for stem, weight in lexicon.stems.items():
            self.stem[self._state(stem)] = weight
        self.known: dict[int, tuple[int, float]] = {}

    def _state(self, letters: str) -> int:
        state = 0
        for letter in letters:
            if letter not in self.arcs[state]:
                self.arcs[state][letter] = len(self.arcs)
                self.arcs.append({})
            state = self.arcs[state][letter]
        return state

    def _read(self, word: str) -> tuple[int, float]:
        state, best = 0, 0.0
        for letter in word:
            state = self.arcs[state].get(letter, -1)
            if state < 0:
                return (INSULT, best) if best else (NONE, 0.0)
            best = max(best, self.stem.get(state, 0.0))
        weight = self.weight.get(state, best)
        return (INSULT, weight) if weight else (self.fixed.get(state, NONE), 0.0)

    def tag(self, raw: str) -> tuple[int, float]:
        """The heaviest insult among the letter runs of ``raw``, else the first other tag."""
        best = (NONE, 0.0)
        for word in _LETTERS.findall(raw.lower()):
            found = self._read(word)
            if found[1] > best[1] or best[0] == NONE:
                best = found
        return best


class Transducer(NamedTuple):
    """Arcs of a deterministic machine by (state, symbol), and what a clause that ends in a state is multiplied by.

    It starts in state 0, puts out one symbol per symbol read and multiplies the weight that comes with it.
    """

    next: np.ndarray
    out: np.ndarray
    weight: np.ndarray
    final: np.ndarray


def _machine(states: int) -> Transducer:
    """All arcs stay where they are and pass their symbol on unchanged."""
    return Transducer(np.tile(np.arange(states)[:, None], (1, SYMBOLS)), np.tile(np.arange(SYMBOLS), (states, 1)),
                      np.ones((states, SYMBOLS)), np.ones(states))


def insult_machine() -> Transducer:
    machine = _machine(1)
    machine.out[:, INSULT] = MATCH
    return machine


def threat_machine(span: int = THREAT_SPAN) -> Transducer:
    """The state is the number of words in which a target still completes the threat."""
    machine = _machine(span + 1)
    machine.next[1:] -= 1
    machine.next[:, THREAT] = span
    machine.next[1:, TARGET] = 0
    machine.out[1:, TARGET] = THREAT_MATCH
    machine.weight[1:, TARGET] = THREAT_WEIGHT
    return machine


def negation_machine(span: int = NEGATION_SPAN) -> Transducer:
    """The state is the number of words that are still negated."""
    machine = _machine(span + 1)
    machine.next[1:] -= 1
    machine.next[:, NEGATION] = span
    machine.weight[1:, [MATCH, THREAT_MATCH]] = NEGATED
    return machine


def report_machine() -> Transducer:
    machine = _machine(2)
    machine.next[:, REPORT] = 1
    machine.weight[1, [MATCH, THREAT_MATCH]] = REPORTED
    return machine


def target_machine() -> Transducer:
    """A target that completed a threat is a target too."""
    machine = _machine(2)
    machine.next[:, [TARGET, THREAT_MATCH]] = 1
    machine.final[1] = TARGETED
    return machine


MACHINES = (insult_machine(), threat_machine(), negation_machine(), report_machine(), target_machine())


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that does what ``second`` does to the output of ``first``; only states that can be reached."""
    pairs, number, rows = [(0, 0)], {(0, 0): 0}, []
    for a, b in pairs:
        row = []
        for symbol in range(SYMBOLS):
            middle = int(first.out[a, symbol])
            to = (int(first.next[a, symbol]), int(second.next[b, middle]))
            if to not in number:
                number[to] = len(pairs)
                pairs.append(to)
            row.append((number[to], int(second.out[b, middle]), first.weight[a, symbol] * second.weight[b, middle]))
        rows.append(row)
    table = np.array(rows)
    return Transducer(table[..., 0].astype(int), table[..., 1].astype(int), table[..., 2],
                      np.array([first.final[a] * second.final[b] for a, b in pairs]))


def composed(machines: Sequence[Transducer] = MACHINES) -> Transducer:
    whole = machines[0]
    for machine in machines[1:]:
        whole = compose(whole, machine)
    return whole


def _gains(machine: Transducer) -> np.ndarray:
    """What an arc adds to a clause: its weight if it puts out a match."""
    return np.where(machine.out >= MATCH, machine.weight, 0.0)


GRAMMAR = composed()
_GAINS = _gains(GRAMMAR)
#: State after a number of untagged words; more of them than the longest span change nothing.
_IDLE = [np.arange(len(GRAMMAR.final))]
for _ in range(max(NEGATION_SPAN, THREAT_SPAN)):
    _IDLE.append(GRAMMAR.next[_IDLE[-1], NONE])
_IDLE = np.array(_IDLE)
#: Clauses still being read, from which on a step over all of them is cheaper than one after another.
_TOGETHER = 16


def clause_scores(kind: np.ndarray, weight: np.ndarray, gap: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Score of each clause by the composed machine.

    A clause is ``length`` tagged words, one clause after another in the other arrays: tag, weight, and
    how many untagged words stand before it in its clause. All clauses step together; the few longest
    are read to their ends one by one.
    """
    begin = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    gap = np.minimum(gap, len(_IDLE) - 1)
    state, total = np.zeros(len(order), int), np.zeros(len(order))
    active, step = len(order), 0
    while active := int(np.searchsorted(-length[:active], -step)):
        if active < _TOGETHER:
            break
        at = begin[:active] + step
        now = _IDLE[gap[at], state[:active]]
        total[:active] += _GAINS[now, kind[at]] * weight[at]
        state[:active] = GRAMMAR.next[now, kind[at]]
        step += 1
    if active:
        idle, gains, following = _IDLE.tolist(), _GAINS.tolist(), GRAMMAR.next.tolist()
        for i in range(active):
            now, added = int(state[i]), float(total[i])
            own = slice(begin[i] + step, begin[i] + length[i])
            for k, w, g in zip(kind[own].tolist(), weight[own].tolist(), gap[own].tolist(), strict=True):
                now = idle[g][now]
                added += gains[now][k] * w
                now = following[now][k]
            state[i], total[i] = now, added
    out = np.empty(len(order))
    out[order] = total * GRAMMAR.final[state]
    return out


FEATURES = 3


def features_of(texts: pa.Array, tagger: Tagger) -> np.ndarray:
    """Per text: summed clause scores, largest clause score, number of clauses with a match."""
    found = W.words_of(texts)
    out = np.zeros((found.texts, FEATURES))
    codes, keys, first = W.distinct(found.hash)
    if len(tagger.known) > 1 << 20:
        tagger.known.clear()
    known, raw = tagger.known, found.data.tobytes()
    tags = [known.get(k) for k in keys.tolist()]
    for j, tag in enumerate(tags):
        if tag is None:
            at = first[j]
            tags[j] = known[int(keys[j])] = tagger.tag(raw[found.start[at]:found.end[at]].decode())
    kinds = np.array([t[0] for t in tags], np.int8)
    # Words without a weight of their own have 1, which a machine's arcs multiply.
    weights = np.array([t[1] if t[0] == INSULT else 1.0 for t in tags])
    if not len(codes):
        return out
    kind = kinds[codes]
    # Only clauses with an insult or a threat have anything to score.
    if not (kind >= THREAT).any():
        return out
    lines = np.r_[0, np.cumsum(found.data == 10)]
    ends = _BREAKS[found.data[found.end - 1]]
    newline = np.r_[True, lines[found.start[1:]] != lines[found.end[:-1]]]
    begins = newline | np.r_[True, ends[:-1]] | np.r_[True, found.text[1:] != found.text[:-1]]
    clause = np.cumsum(begins) - 1
    wanted = np.zeros(clause[-1] + 1, bool)
    wanted[clause[kind >= THREAT]] = True
    # A clause of any length is read as its tagged words and the gaps between them.
    at = np.flatnonzero(wanted[clause] & (kind != NONE))
    opens = np.r_[True, clause[at[1:]] != clause[at[:-1]]]
    gap = np.where(opens, 0, np.r_[0, np.diff(at) - 1])
    start = np.flatnonzero(opens)
    score = clause_scores(kind[at], weights[codes[at]], gap, np.diff(np.r_[start, len(at)]))
    text = found.text[at[start]][score > 0]
    score = score[score > 0]
    out[:, 0] = np.bincount(text, score, minlength=found.texts)
    np.maximum.at(out[:, 1], text, score)
    out[:, 2] = np.bincount(text, minlength=found.texts)
    return out


def _inputs(x: np.ndarray) -> np.ndarray:
    """What the layer sees of the features: logarithms of the sum and the number, the largest, and whether there is just one."""
    return np.column_stack([np.log1p(x[:, 0]), x[:, 1], np.log1p(x[:, 2]), x[:, 2] == 1])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts hold a word, or two different words with a stem."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, y in zip(batch.column("_text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = set(_LETTERS.findall((text or "").lower()))
            stems = Counter(w[:k] for w in words for k in STEM_LENGTHS if len(w) > k)
            held = ["=" + w for w in words] + ["^" + s for s, n in stems.items() if n > 1]
            for key in held:
                counts.setdefault(key, [0, 0])[1 if y else 0] += 1
        yield pa.RecordBatch.from_arrays([
            pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
            pa.array([c[0] for c in counts.values()], pa.int64())], names=["key", "toxic", "other"])


def _evidence(toxic, other, n_toxic: int, n_other: int):
    """Log likelihood ratio of a key's presence, 0 where it speaks for no toxicity."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n = n_toxic + n_other
    both = toxic + other
    g = 2 * (part(toxic, both * n_toxic / n) + part(other, both * n_other / n)
             + part(n_toxic - toxic, (n - both) * n_toxic / n + 1e-9)
             + part(n_other - other, (n - both) * n_other / n + 1e-9))
    return F.when(toxic * n_other > other * n_toxic, g).otherwise(0.0)


def learn_lexicon(rows: DataFrame, *, least_evidence: float = 18.0, candidates: int = 4000) -> Lexicon:
    """Insulting words and stems of labelled texts (``_text, y``).

    Of patterns that contain one another the one with most evidence stays, the longest on a tie.
    Words that come often in texts that are not toxic are exempt from the stems.
    """
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    words = dict.fromkeys(INSULTS, GIVEN_WEIGHT)
    stems: dict[str, float] = {}
    if not n_toxic or not n_other:
        return Lexicon(words, stems)
    counts = written(rows.mapInArrow(_statistics, "key string, toxic bigint, other bigint").groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic + other > 2"), "stems")
    scored = counts.withColumn("g", _evidence(F.col("toxic"), F.col("other"), n_toxic, n_other))
    best = scored.where(F.col("g") >= least_evidence).orderBy(
        F.desc("g"), F.desc(F.length("key")), "key").limit(candidates).collect()
    for r in best:
        text = r.key[1:]
        if any(text.startswith(s) or (r.key[0] == "^" and s.startswith(text)) for s in stems):
            continue
        weight = math.log((r.toxic + 0.5) / (n_toxic + 1) * (n_other + 1) / (r.other + 0.5))
        if r.key[0] == "^":
            stems[text] = weight
        else:
            words[text] = max(weight, words.get(text, 0.0))
    common = max(4, n_other // 1000)
    if stems:
        own = F.lit(False)
        for stem in stems:
            own |= F.col("key").startswith("=" + stem)
        for r in counts.where(own & (F.col("other") >= common) & (F.col("other") * n_toxic >= F.col("toxic") * n_other / 4)).collect():
            words[r.key[1:]] = 0.0
    return Lexicon(words, stems)


def train_layer(x: np.ndarray, y: np.ndarray, *, ridge: float = 0.01, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    if not len(y):
        return np.array([-4.0, 2.0, 0.2, 0.5, -0.5])
    keep = np.eye(x.shape[1]) * ridge
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, max_rows: int = 8000) -> Model:
    """Lexicon and output layer from at most ``max_rows`` labelled texts.

    Without labels the given words and a fixed layer are used.
    """
    rows = written(training_rows(docs, labels, label, max_rows), "labelled")
    lexicon = learn_lexicon(rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(lexicon)
        for batch in batches:
            for part in W.in_pieces(batch, "_text"):
                x = features_of(part.column("_text"), tagger)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[:, j]) for j in range(FEATURES)), part.column("y")],
                    names=[*(f"x{j}" for j in range(FEATURES)), "y"])

    names = [f"x{j}" for j in range(FEATURES)]
    seen = rows.mapInArrow(measured, ", ".join(f"{n} double" for n in names) + ", y int").groupBy(
        *names, "y").agg(F.count(F.lit(1)).alias("n")).orderBy(*names, "y").toPandas()
    x = np.repeat(seen[names].to_numpy(float), seen["n"].to_numpy(), 0)
    return Model(lexicon, train_layer(_inputs(x), np.repeat(seen["y"].to_numpy(float), seen["n"].to_numpy())))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, clause_score, clauses`` for each row of ``docs``, from whole texts; ``clauses`` counts
    all clauses with a match.

    Null and empty texts match nothing and get the layer's bias. Ids pass unchanged, null and
    repeated ones too; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    sent = source.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, layer = sent.value
        tagger = Tagger(lexicon)
        for batch in batches:
            for part in W.in_pieces(batch, "_text"):
                x = features_of(part.column("_text"), tagger)
                chance = 1 / (1 + np.exp(-np.clip(layer[0] + _inputs(x) @ layer[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(chance), pa.array(x[:, 0]), pa.array(x[:, 2].astype(np.int64))],
                    names=["doc_id", "score", "clause_score", "clauses"])

    return source.mapInArrow(scored, f"doc_id {id_type}, score double, clause_score double, clauses bigint")


def classified(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000) -> DataFrame:
    """Learns from ``labels`` and scores every row of ``docs`` (columns ``doc_id, text``)."""
    return scores(docs, learn(docs.select("doc_id", F.col("text").alias("_text")), labels, max_rows=max_rows))
