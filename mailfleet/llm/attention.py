"""A small causal self-attention language model over subword ids, in numpy.

The sequence of a text is an end mark, then the ids of its words, then an end mark again, which is
what is predicted last. A position attends to itself and the positions before it in its window; what
it gathers, together with its own id, sets the shares of ``K`` distributions over ids, and the next id
is drawn from their mixture. So the chance of every id is exact and costs ``K`` numbers, not a softmax
over the vocabulary.

Windows overlap: each has ``CONTEXT`` positions that are only looked at and ``STEP`` whose next ids are
scored, so every id is scored once, with at least ``CONTEXT`` positions before it where the text has
them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

CONTEXT, STEP = 8, 24
LENGTH = CONTEXT + STEP
DIM, SHARES = 16, 64


class Model(NamedTuple):
    """Tables by id: query, key and value side by side, own share logits, chance in each distribution."""

    looks: np.ndarray
    own: np.ndarray
    chance: np.ndarray
    out: np.ndarray  # gathered values to share logits
    near: np.ndarray  # logit by distance


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First scored position and text of each window, for texts of ``lengths`` ids one after another."""
    many = -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths)), many)
    number = np.arange(len(text)) - (np.cumsum(many) - many)[text]
    return (np.cumsum(lengths) - lengths)[text] + number * STEP, text


class Batch(NamedTuple):
    inputs: np.ndarray  # windows x LENGTH ids
    targets: np.ndarray  # windows x STEP ids
    seen: np.ndarray  # inputs that belong to the text
    scored: np.ndarray  # targets that do


def batch_of(ids: np.ndarray, lengths: np.ndarray, at: np.ndarray, text: np.ndarray, end_id: int) -> Batch:
    """Some windows of texts whose ids (end marks included) lie one after another in ``ids``."""
    first = (np.cumsum(lengths) - lengths)[text][:, None]
    last = first + lengths[text][:, None]
    # Input p is the id before target p: the mark before a text's first id.
    place = at[:, None] + np.arange(-CONTEXT, STEP)
    seen = (place >= first) & (place < last)
    inputs = np.where(place > first, ids[np.clip(place - 1, 0, len(ids) - 1)], end_id)
    target = at[:, None] + np.arange(STEP)
    scored = target < last
    return Batch(inputs, ids[np.minimum(target, len(ids) - 1)], seen, scored)


def _near_mask(near: np.ndarray) -> np.ndarray:
    """Logits by distance, very low for what comes later."""
    back = (np.arange(CONTEXT, LENGTH)[:, None] - np.arange(LENGTH)[None, :])
    return np.where(back >= 0, near[np.clip(back, 0, LENGTH - 1)], -60.0).astype(np.float32)


def shares(model: Model, batch: Batch, near: np.ndarray) -> np.ndarray:
    """Unnormalised shares of the distributions at each scored position."""
    looks = model.looks.take(batch.inputs, axis=0)
    query, key, value = looks[:, CONTEXT:, :DIM], looks[:, :, DIM:2 * DIM], looks[:, :, 2 * DIM:]
    scores = query @ key.transpose(0, 2, 1)
    scores += near
    np.minimum(scores, 30, out=scores)
    np.exp(scores, out=scores)
    if not batch.seen.all():
        scores *= batch.seen[:, None, :]
    # Positions after a text's end attend to nothing; they are not scored.
    total = np.maximum(_row_sums(scores), 1e-20)
    gathered = (scores @ value) / total
    z = (gathered.reshape(-1, DIM) @ model.out).reshape(*gathered.shape[:2], -1)
    z += model.own.take(batch.inputs[:, CONTEXT:], axis=0)
    np.minimum(z, 60, out=z)
    return np.exp(z, out=z)


def log_chances(model: Model, ids: np.ndarray, lengths: np.ndarray, end_id: int, many: int = 256) -> np.ndarray:
    """log10 of the chance of each text."""
    out = np.zeros(len(lengths))
    near = _near_mask(model.near)
    at, text = windows(lengths)
    for i in range(0, len(at), many):
        batch = batch_of(ids, lengths, at[i:i + many], text[i:i + many], end_id)
        g = shares(model, batch, near)
        p = np.einsum("wsk,wsk->ws", g, model.chance.take(batch.targets, axis=0)) / _row_sums(g)[..., 0]
        logs = np.where(batch.scored, np.log10(np.maximum(p, 1e-30)), 0.0).sum(1)
        out += np.bincount(text[i:i + many], logs, len(lengths))
    return out


def expected_counts(model: Model, ids: np.ndarray, lengths: np.ndarray, end_id: int, counts: np.ndarray, many: int = 128) -> None:
    """Adds to ``counts`` (ids x K) how often each distribution is expected to have given each id."""
    near = _near_mask(model.near)
    at, text = windows(lengths)
    for i in range(0, len(at), many):
        batch = batch_of(ids, lengths, at[i:i + many], text[i:i + many], end_id)
        r = shares(model, batch, near)
        r *= model.chance.take(batch.targets, axis=0)
        r /= np.maximum(_row_sums(r), 1e-30)
        scored = np.flatnonzero(batch.scored)
        rows, sums = _sums_by(batch.targets.ravel()[scored], r.reshape(-1, r.shape[2]), scored)
        counts[rows] += sums


def chances(counts: np.ndarray, prior: float = 30.0) -> np.ndarray:
    """Distributions from expected counts, each drawn towards the frequencies of ids overall."""
    overall = counts.sum(1) + 0.05
    overall = overall / overall.sum()
    smooth = counts + prior * overall[:, None]
    return (smooth / smooth.sum(0)).astype(np.float32)


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays, by a product; quicker than summing short rows."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


def _sums_by(keys: np.ndarray, values: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the rows of ``values`` (those at ``at``, if given) of each."""
    # Numbers of two bytes are sorted by their digits.
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    keys = keys[order]
    order = order if at is None else at[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values.take(order, axis=0), starts, axis=0) if len(keys) else values[:0]


class Trainer:
    """Gradient steps for attention and shares, and expected counts for the distributions."""

    def __init__(self, vocabulary: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.w = {
            "emb": f(vocabulary, DIM), "q": f(DIM, DIM), "k": f(DIM, DIM), "v": f(DIM, DIM), "out": f(DIM, SHARES),
            "own": f(DIM, SHARES), "bias": np.zeros(SHARES, np.float32), "near": -0.05 * np.arange(LENGTH, dtype=np.float32)}
        self.slope = {n: np.zeros_like(x) for n, x in self.w.items()}
        self.square = {n: np.zeros_like(x) for n, x in self.w.items()}
        self.rng, self.step = rng, 0
        self.chance = None

    def model(self) -> Model:
        w = self.w
        looks = [w["emb"] @ w["q"] / np.float32(DIM**0.5), w["emb"] @ w["k"], w["emb"] @ w["v"]]
        return Model(np.hstack(looks), w["emb"] @ w["own"] + w["bias"], self.chance, w["out"], w["near"])

    def start(self, targets: np.ndarray) -> None:
        """Distributions near the overall frequencies, each bent at random."""
        counts = np.bincount(targets, minlength=len(self.w["emb"])).astype(np.float64)
        bent = counts[:, None] * self.rng.gamma(1.0, 1.0, (len(counts), SHARES)) / SHARES
        self.chance = chances(bent)

    def gradients(self, batch: Batch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
        """Gradients of the mean loss, responsibilities and targets of scored places, and the loss."""
        w, x = self.w, batch.inputs
        scale = np.float32(DIM**-0.5)
        e = w["emb"].take(x, axis=0)
        own = np.ascontiguousarray(e[:, CONTEXT:])
        flat = lambda y: y.reshape(-1, y.shape[-1])
        # One product of all windows' rows, not one for each window.
        times = lambda y, m: (flat(y) @ m).reshape(*y.shape[:2], -1)
        q, k, v = times(own, w["q"]), times(e, w["k"]), times(e, w["v"])
        q *= scale
        s = q @ k.transpose(0, 2, 1)
        s += _near_mask(w["near"])
        if not batch.seen.all():
            s = np.where(batch.seen[:, None, :], s, -60.0)
        s -= s.max(2, keepdims=True)
        a = np.exp(s, out=s)
        a /= _row_sums(a)
        o = a @ v
        z = times(o, w["out"])
        z += times(own, w["own"])
        z += w["bias"]
        z -= z.max(2, keepdims=True)
        g = np.exp(z, out=z)
        g /= _row_sums(g)
        r = self.chance.take(batch.targets, axis=0)
        r = np.multiply(r, g, out=r if r.dtype == g.dtype else None)
        p = _row_sums(r)
        r /= p
        n = max(1, int(batch.scored.sum()))
        dz = np.subtract(g, r, out=g)
        dz *= batch.scored[:, :, None] / np.float32(n)
        do = times(dz, w["out"].T)
        da = do @ v.transpose(0, 2, 1)
        da -= _row_sums(a * da)
        ds = np.multiply(da, a, out=da)
        dq, dk, dv = ds @ (k * scale), ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do
        de = times(dk, w["k"].T)
        de += times(dv, w["v"].T)
        de[:, CONTEXT:] += times(dq, w["q"].T) + times(dz, w["own"].T)
        grads = {
            "q": flat(own).T @ flat(dq), "k": flat(e).T @ flat(dk), "v": flat(e).T @ flat(dv),
            "out": flat(o).T @ flat(dz), "own": flat(own).T @ flat(dz), "bias": flat(dz).sum(0)}
        back = np.arange(CONTEXT, LENGTH)[:, None] - np.arange(LENGTH)[None, :]
        grads["near"] = np.bincount(np.maximum(back, 0).ravel(), (ds.sum(0) * (back >= 0)).ravel(), LENGTH).astype(np.float32)
        # Only the rows of ids that came have a gradient.
        rows, sums = _sums_by(x.ravel(), flat(de))
        grads["emb"] = sums
        self.rows = rows
        if n == batch.scored.size:
            return grads, flat(r), batch.targets.ravel(), -float(np.log(p).sum()) / n
        return grads, r[batch.scored], batch.targets[batch.scored], -float(np.log(p[..., 0][batch.scored]).sum()) / n

    def descend(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        for name, grad in grads.items():
            some = self.rows if name == "emb" else ...
            m, s = self.slope[name][some], self.square[name][some]
            m = m + 0.1 * (grad - m)
            s = s + 0.01 * (grad * grad - s)
            self.slope[name][some], self.square[name][some] = m, s
            self.w[name][some] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-7)

    def follow(self, ids: np.ndarray, lengths: np.ndarray, end_id: int, counts: np.ndarray, *, rate: float, many: int = 128) -> None:
        """Steps through all windows of whole texts, once. The distributions stay; what they are expected
        to have given is added to ``counts``."""
        at, text = windows(lengths)
        order = self.rng.permutation(len(at))
        for i in range(0, len(order), many):
            some = order[i:i + many]
            grads, r, targets, _ = self.gradients(batch_of(ids, lengths, at[some], text[some], end_id))
            self.descend(grads, rate)
            rows, sums = _sums_by(targets, r)
            counts[rows] += sums

    def neutral(self, seen: np.ndarray, rare: float = 3.0) -> None:
        """Draws embeddings of ids that came ``seen`` times towards the mean one; ids never seen have just that."""
        emb = self.w["emb"]
        mean = (seen @ emb / max(1.0, float(seen.sum()))).astype(np.float32)
        self.w["emb"] = mean + (emb - mean) * (seen / (seen + rare)).astype(np.float32)[:, None]

    def train(self, ids: np.ndarray, lengths: np.ndarray, end_id: int, *, steps: int, many: int = 128,
              rate: float = 0.02, together: int = 4) -> list[float]:
        """Losses per step. Distributions follow the expected counts, each ``together`` steps."""
        at, text = windows(lengths)
        self.start(ids)
        held = self.chance.astype(np.float64) * len(ids) / SHARES
        losses, order, waiting = [], np.zeros(0, np.int64), []
        for n in range(steps):
            if not len(order):
                order = self.rng.permutation(len(at))
            some, order = order[:many], order[many:]
            batch = batch_of(ids, lengths, at[some], text[some], end_id)
            grads, r, targets, loss = self.gradients(batch)
            self.descend(grads, rate * (1 - 0.95 * n / steps))
            losses.append(loss)
            waiting.append((targets, r))
            if len(waiting) == together:
                targets, r = (np.concatenate(x) for x in zip(*waiting, strict=True))
                rows, sums = _sums_by(targets, r)
                weight = max(0.05, 0.5 / (1 + 0.2 * n / together))
                held *= 1 - weight
                held[rows] += sums * (weight * len(ids) / len(targets))
                self.chance = chances(held)
                waiting = []
        return losses
