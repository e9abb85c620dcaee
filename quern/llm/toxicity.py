"""Operator 8: toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.fitting import Batch, batches, evidence, sigmoid
from quern.llm.labelled import give_back, sample, scored
from quern.llm.spans import SPACE, blocks, hash_runs, lean, mix, portions, text_bytes, words_of

BITS = 28
"""Terms are hashed into 2 ** BITS bins."""
PREFIXES = (4, 5)
"""Besides whole words, the first so many bytes of longer words are terms, for inflected forms."""
DECAYS = (0.001, 0.01)
"""Of which fit() takes that with the smaller loss on a fifth of the sample."""
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
assert not (_INSIDE & SPACE).any()


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each term and the text it is in, with repeats; words are runs of letters, digits and non-ASCII, A-Z as a-z."""
    bins, texts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo, hi in blocks(data, offs, inside=_INSIDE):
        block = data[lo:hi]
        starts, ends = words_of(block, offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo, _INSIDE)
        text = np.searchsorted(offs, starts + lo, "right") - 1
        for n in (0, *PREFIXES):
            keep = slice(None) if not n else np.flatnonzero(ends - starts > n)
            s, e = starts[keep], ends[keep]
            bins.append((mix(hash_runs(block, s, s + n if n else e) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
            texts.append(text[keep])
    return np.concatenate(bins), np.concatenate(texts)


def distinct(bins: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term of a text once, by text."""
    both = np.unique(texts.astype(np.int64) << BITS | bins)
    return (both & ((1 << BITS) - 1)).astype(np.int32), both >> BITS


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the inner products of their factors), over a text's terms."""

    bins: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, bins: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """For n texts, from all their terms with repeats."""
        if not len(self.bins):
            return np.full(n, sigmoid(np.array(self.bias)))
        at = np.minimum(np.searchsorted(self.bins, bins), len(self.bins) - 1)
        hit = self.bins[at] == bins
        columns, texts = distinct(at[hit].astype(np.int32), texts[hit])
        raw = self.bias + np.bincount(texts, self.weights[columns], n)
        for f in range(self.factors.shape[1] if self.factors.any() else 0):
            v = self.factors[columns, f].astype(float)
            raw += (np.bincount(texts, v, n) ** 2 - np.bincount(texts, v * v, n)) / 2
        return sigmoid(raw)


def directions(parts: list[Batch], residual: np.ndarray, width: int, k: int, rng: np.random.Generator, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, and their vectors, of how pairs of columns go with the residuals of their rows.

    The matrix has, for two columns, the sum of the residuals of the rows that have both, each for the square of its size
    so that long rows don't rule; its diagonal is 0. It is never built: by power iteration, shifted so that negative
    eigenvalues don't win.
    """
    gains = [residual[p.rows] / np.maximum(np.bincount(p.at, minlength=len(p.rows)), 1) for p in parts]

    def times(u: np.ndarray) -> np.ndarray:
        out = np.zeros_like(u)
        for p, g in zip(parts, gains, strict=True):
            own, diagonal = u[p.columns], p.by_column(g)
            for f in range(k):
                out[p.columns, f] += p.by_column(g * p.by_row(own[:, f])) - diagonal * own[:, f]
        return out

    u, shift = np.linalg.qr(rng.normal(size=(width, k)).astype(np.float32))[0], np.float32(0)
    for step in range(steps):
        y = times(u)
        if step == 2:
            shift = np.float32(max(0.0, -float(np.linalg.eigvalsh(u.T @ y + y.T @ u).min() / 2)))
        u = np.linalg.qr(y + shift * u)[0]
    y = times(u)
    values, turn = np.linalg.eigh((u.T @ y + y.T @ u) / 2)
    return values, u @ turn


def fit(
    bins: np.ndarray, ends: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None, *, factors: int = 2, alone: int = 30, joint: int = 10, rate: float = 4.0, pair_rate: float = 0.07, spread: float = 0.01, size: int = 256, pair_rows: int = 4096, seed: int = 0
) -> Machine:
    """Logistic loss, both labels of equal weight, by gradient steps over batches of texts; each step moves only the columns of its batch.

    Text i has the distinct bins [ends[i], ends[i + 1]); rows: all texts, in a fixed order. All bins are trained. First the weights
    alone, each at the speed of its evidence. Then every bin has small random factors, and to these come the directions in
    which what is left over goes with pairs of columns (directions(), of up to pair_rows texts), where they are stronger than
    with residuals dealt to the texts at random. Weights and factors are trained together: a factor's step is the smaller the more it was asked to move before, and its decay is that of DECAYS which
    does best on a fifth of the sample that is left out for the choice. Terms that go with a label only together gain by
    each other's factors.
    """
    rng, n, positives = np.random.default_rng(seed), len(labels), int(labels.sum())
    prior = np.clip(positives / (n + 1), 1e-6, 1 - 1e-6)
    if not len(bins) or positives in (0, n):
        return Machine(np.zeros(0, np.int32), float(np.log(prior / (1 - prior))), np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    order = (np.arange(n) if rows is None else rows)[rng.permutation(n)]
    parts = batches(bins, ends, order, size)
    bins = np.unique(np.concatenate([p.columns for p in parts]))
    for p in parts:
        p.columns = np.searchsorted(bins, p.columns).astype(np.int32)
    width = len(bins)
    factors = min(factors, width)
    weight = np.where(labels == 1, 0.5 / positives, 0.5 / (n - positives)) * n
    counts = np.zeros((2, width))
    for p in parts:
        for label in (0, 1):
            counts[label, p.columns] += p.by_column((labels[p.rows] == label).astype(float))
    p, q = ((counts[label] + 0.5) / (m + 1) for label, m in ((1, positives), (0, n - positives)))
    speed = evidence(np.abs(p - q) / np.sqrt(p * (1 - p) / positives + q * (1 - q) / (n - positives)))
    bias, w, v, pair_speed = -1.0, np.zeros(width), np.zeros((width, factors)), np.sqrt(speed)

    def raw(b: Batch, pairs: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sum before the sigmoid, and each text's sum of each factor."""
        total, sums = bias + b.by_row(w[b.columns]), []
        for f in range(factors if pairs else 0):
            x = v[b.columns, f]
            sums.append(b.by_row(x))
            total = total + (sums[-1] ** 2 - b.by_row(x * x)) / 2
        return total, sums

    def loss(b: Batch) -> float:
        p = np.clip(sigmoid(raw(b, True)[0]), 1e-9, 1 - 1e-9)
        return float(-(weight[b.rows] * np.where(labels[b.rows] == 1, np.log(p), np.log(1 - p))).sum())

    def epoch(some: list[Batch], step: float, pair_step: float, decay: float) -> None:
        nonlocal bias
        for i in rng.permutation(len(some)):
            b = some[i]
            total, sums = raw(b, pair_step > 0)
            g = weight[b.rows] * (sigmoid(total) - labels[b.rows]) / len(b.rows)
            every = b.by_column(g) if sums else None
            for f, s in enumerate(sums):
                x = v[b.columns, f]
                pull = b.by_column(g * s) - every * x + decay * x * np.abs(every)
                pulled[b.columns, f] += pull * pull
                v[b.columns, f] -= pair_step * pair_speed[b.columns] * pull / np.sqrt(pulled[b.columns, f] + 1e-12)
            w[b.columns] -= step * speed[b.columns] * b.by_column(g)
            bias -= step / 10 * g.sum()

    for t in range(alone):
        epoch(parts, rate / (1 + t / 5), 0.0, 0.0)
    some = parts[: max(pair_rows // size, 1)]
    residual = np.zeros(n)
    for b in some:
        residual[b.rows] = weight[b.rows] * (labels[b.rows] - sigmoid(raw(b, False)[0]))
    dealt, of_some = residual.copy(), np.concatenate([b.rows for b in some])
    dealt[of_some] = rng.permutation(residual[of_some])
    values, u = directions(some, residual, width, factors, rng)
    u = u * (values > max(directions(some, dealt, width, factors, rng)[0].max(), 0))
    u = np.where(np.abs(u) < np.abs(u).max(0) / 50, 0.0, u)
    if u.any():
        found = (np.abs(u) / np.maximum(np.abs(u).max(0), 1e-12)).max(1)
        pair_speed = np.maximum(pair_speed / 20, found**2)  # these lead, the others follow
        speed = np.maximum(speed, found**2 / 4)  # what tells in pairs needs a weight beside them
        spans = np.concatenate([np.stack([b.by_row(u[b.columns, f]) ** 2 - b.by_row(u[b.columns, f] ** 2) for f in range(factors)], 1) for b in some]).std(0) / 2
        u = u * np.sqrt(0.25 / (spans + 1e-12))
    start = bias, w.copy(), u + rng.normal(scale=spread, size=(width, factors))
    pulled = np.zeros((width, factors))  # squares of the steps that each factor has been asked for
    own, apart = parts[: -max(len(parts) // 5, 1)], parts[-max(len(parts) // 5, 1) :]

    def jointly(some: list[Batch], decay: float) -> None:
        nonlocal bias, w, v
        bias, w, v = start[0], start[1].copy(), start[2].copy()
        pulled[:] = 0
        for t in range(joint * (2 if u.any() else 1)):  # pairs that words alone do not tell take longer
            epoch(some, rate / (1 + t / 5), pair_rate / (1 + t / 5), decay)

    losses = []
    for decay in DECAYS if own else ():
        jointly(own, decay)
        losses.append(sum(loss(b) for b in apart))
    jointly(parts, DECAYS[int(np.argmin(losses))] if losses else DECAYS[-1])
    return Machine(bins, float(bias), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = 6_000, key: str = "doc_id", text: str = "text") -> Machine:
    """A machine from at most `rows` labelled rows outside the held-out fold.

    All bins that these texts have are trained, none is chosen beforehand. What comes to the driver is the sample's
    labels and distinct bins (4 bytes for each distinct term of a text), sorted, so that reruns agree. The fit takes about
    12 bytes for each of these, and 100 for each bin; rows bounds that.
    """

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in portions(*text_bytes(batch.column("text"))):
                bins, texts = distinct(*terms(data, offs))
                ends = np.searchsorted(texts, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi], batch.column("label")[lo:hi], pa.ListArray.from_arrays(pa.array(ends), pa.array(bins))], ["key", "label", "bins"])

    chosen = sample(docs, labels, label, rows, key, text)
    used = chosen.mapInArrow(spread, f"key {chosen.schema['key'].dataType.simpleString()}, label int, bins array<int>")
    found = used.groupBy("key").agg(F.max("label").alias("label"), F.min("bins").alias("bins")).select(F.xxhash64("key").alias("k"), "label", "bins").toArrow()
    k, own = found.column("k").to_numpy(), found.column("label").to_numpy().astype(float)
    lists = found.column("bins").combine_chunks() if len(found) else pa.array([], pa.list_(pa.int32()))
    ends = lists.offsets.to_numpy().astype(np.int64) if len(found) else np.zeros(1, np.int64)
    machine = fit(lists.flatten().to_numpy(), ends - ends[0], own, np.lexsort((own, k)))
    del found, lists
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: key, held_out, score, predicted (1 if score >= threshold), and the columns in keep.

    Only the text is an input. Every text is read whole, in portions. Null or empty text has no terms; its score is that
    of the bias. Repeated rows and null keys: a row each. Empty table: no rows. No labels, or labels of one kind: every
    score is that label's share. The machine has a weight and factors for each bin of the sample that it was trained on.
    """

    return scored(docs, lambda data, offs: machine.scores(*terms(data, offs), len(offs) - 1), key, text, threshold, keep)
