"""Operator 3: text quality by Bradley-Terry ranking: pairs of a better and a worse text, logistic loss on feature differences.

Preferences come from the labels (a text of label 1 before one of label 0), and from the texts themselves: some of label 1
are preferred to copies whose letters are shuffled inside of words, or drawn at random, so that gibberish ranks below prose
also where no labelled text is gibberish. The cut is taken from the labelled texts alone.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.fitting import Batch, batches, evidence, sigmoid
from quern.llm.labelled import give_back, sample, scored
from quern.llm.spans import LOWER, SPACE, blocks, hash_runs, lean, mix, portions, text_bytes, words_of

BITS = 16
"""Words, and runs of three characters, are hashed into 2 ** BITS bins each."""
SHAPES = ("all capitals", "two symbols", "a bar", "two exclamation marks", "same as the word before", "in a pair of words seen before")
"""Shares of the words; square roots, so that small shares count."""
RARE = 2 << BITS
"""The column of how unusual a text's runs of three characters are among texts of label 1, on average: 0 to 1."""
COLUMNS = RARE + 1 + len(SHAPES)
FEW = 3
EVERY = 4
"""One of so many texts of label 1 gets a spoilt copy."""

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LOWER[[*range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_BANG[33] = True
_BAR[124] = True
_SYMBOL[list(b"#$%&*^~")] = True
_FOLD = np.where(SPACE, 32, LOWER).astype(np.uint32)
_PAIR = np.uint64((1 << 20) - 1)


def grams(block: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte that is not white space, where it is and the bin of it with its neighbours (white space at a text's ends)."""
    low = _FOLD[block]
    before, after = np.append(np.uint32(32), low[:-1]), np.append(low[1:], np.uint32(32))
    first = first[(first > 0) & (first < len(block))]
    before[first], after[first - 1] = 32, 32
    at = np.flatnonzero(low != 32)
    code = (before[at] | low[at] << np.uint32(8) | after[at] << np.uint32(16)) * np.uint32(0x9E3779B1)
    return at, (code >> np.uint32(32 - BITS)).astype(np.int32)


def read(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block: the text and bin of each word, the text and bin of each run of three, and shapes by word (pairs apart)."""
    last, last_text = np.uint64(0), -1
    for lo, hi in blocks(data, offs):
        block = data[lo:hi]
        first = offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo
        starts, ends = words_of(block, first, ~SPACE)
        if not len(starts):
            continue
        text = np.searchsorted(offs, starts + lo, "right") - 1
        upper, lower, digit, symbol, bar, bang = ((lambda s: s[ends] - s[starts])(np.append(np.int32(0), np.cumsum(kind[block], dtype=np.int32))) for kind in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _BAR, _BANG))
        hashes = hash_runs(block, starts, ends)
        before = np.append(last, hashes[:-1])
        inner = text == np.append(last_text, text[:-1])
        flags = ((upper >= 2) & (lower == 0) & (digit == 0), symbol >= 2, bar > 0, bang >= 2, inner & (hashes == before))
        pairs = mix((hashes ^ (before * np.uint64(0x9E3779B97F4A7C15)))[inner]) & ~_PAIR | text[inner].astype(np.uint64) & _PAIR
        at, bins = grams(block, first)
        # runs of three go on from word to word, so their text is that of the word they are in
        yield text, (hashes >> np.uint64(64 - BITS)).astype(np.int32), text[np.searchsorted(starts, at, "right") - 1], bins, flags, pairs
        last, last_text = hashes[-1], text[-1]


def shapes(words: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """A row of SHAPES for each text, from its words, the counts of the first five shapes, and all pairs of words with their text."""
    n = len(words)
    seen = (np.unique(pairs) & _PAIR).astype(np.int64)
    again = np.bincount((pairs & _PAIR).astype(np.int64), minlength=n) - np.bincount(seen, minlength=n)
    return np.sqrt(np.column_stack([counts, again]) / np.maximum(words, 1)[:, None])


@dataclass
class Ranking:
    """score = sigmoid(scale * (weights . features - cut)), shifted so that the cut gets `at`.

    weights: 2 ** BITS of words, as many of runs of three characters, one of unusual runs, and one for each of SHAPES.
    unusual: of each bin of runs, 0 to 1.
    """

    weights: np.ndarray
    unusual: np.ndarray
    cut: float
    scale: float
    at: float

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        words, runs, of_words, of_runs, counts, pairs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, len(SHAPES) - 1)), [np.zeros(0, np.uint64)]
        by_run = self.weights[1 << BITS : RARE] + self.weights[RARE] * self.unusual
        for text, bins, run_text, run_bins, flags, both in read(data, offs):
            words += np.bincount(text, minlength=n)
            runs += np.bincount(run_text, minlength=n)
            of_words += np.bincount(text, self.weights[bins], n)
            of_runs += np.bincount(run_text, by_run[run_bins], n)
            for k, flag in enumerate(flags):
                counts[:, k] += np.bincount(text, flag, n)
            pairs.append(both)
        # a text without runs is as unusual as can be
        total = of_words / np.maximum(words, 1) + of_runs / np.maximum(runs, 1) + self.weights[RARE] * (runs == 0) + shapes(words, counts, np.concatenate(pairs)) @ self.weights[RARE + 1 :]
        return sigmoid(self.scale * (total - self.cut) + np.log(self.at / (1 - self.at)))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: columns, values (shares) and len + 1 offsets into them. RARE is in each text, for fit() to fill in."""
    n = len(offs) - 1
    words, runs, counts, pairs, keys = np.zeros(n), np.zeros(n), np.zeros((n, len(SHAPES) - 1)), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for text, bins, run_text, run_bins, flags, both in read(data, offs):
        words += np.bincount(text, minlength=n)
        runs += np.bincount(run_text, minlength=n)
        for k, flag in enumerate(flags):
            counts[:, k] += np.bincount(text, flag, n)
        pairs.append(both)
        keys += [text.astype(np.int64) << 20 | bins, run_text.astype(np.int64) << 20 | run_bins + (1 << BITS)]
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    text, column = key >> 20, key & ((1 << 20) - 1)
    value = times / np.where(column < 1 << BITS, words[text], runs[text])
    shape = shapes(words, counts, np.concatenate(pairs))
    own, k = np.nonzero(shape)
    text, column, value = np.concatenate([text, np.arange(n), own]), np.concatenate([column, np.full(n, RARE), RARE + 1 + k]), np.concatenate([value, np.zeros(n), shape[own, k]])
    order = np.argsort(text, kind="stable")
    return column[order].astype(np.int32), value[order].astype(np.float32), np.append(0, np.cumsum(np.bincount(text, minlength=n)))


def unusual(counts: np.ndarray, n: int) -> np.ndarray:
    """How unusual bins are that so many of n texts have: 1 for one that none has, 0 from FEW texts or FEW in a thousand on.

    Not graded beyond that, as a language that few texts have is not worse.
    """
    return np.clip(1 - np.maximum(counts, 0) / max(FEW, FEW * n / 1000), 0, 1)


def fit(columns: np.ndarray, values: np.ndarray, ends: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None, *, at: float, seed: int = 0, made: np.ndarray | None = None) -> Ranking:
    """Bradley-Terry weights of the sample, and the cut: the quantile of its scores at the share of label 0.

    So as many texts of the sample are cut as are marked. rows: all texts, in a fixed order. made: which are spoilt copies.
    """
    real = np.ones(len(labels), bool) if made is None else ~made
    n, bad, good = int(real.sum()), int((labels[real] == 0).sum()), int((labels == 1).sum())
    run = (columns >= 1 << BITS) & (columns < RARE)
    of = np.repeat(np.arange(len(labels)), np.diff(ends))
    own = columns[run] - (1 << BITS)
    counts = np.bincount(own[labels[of[run]] == 1], minlength=1 << BITS)
    if bad in (0, n):
        share = np.clip((n - bad) / (n + 1), 1e-6, 1 - 1e-6)
        return Ranking(np.zeros(COLUMNS), unusual(counts, good), 0.0, 1.0, float(share))
    # a text of label 1 is measured by the others
    found = np.where(labels[of[run]] == 1, unusual(counts - 1, good)[own], unusual(counts, good)[own])
    share = np.bincount(of[run], found * values[run], len(labels))
    values[columns == RARE] = np.where(np.bincount(of[run], minlength=len(labels)) > 0, share, 1.0)
    del share, found, run, own, of
    rng = np.random.default_rng(seed)
    parts = batches(columns, ends, (np.arange(len(labels)) if rows is None else rows)[rng.permutation(len(labels))], 512, values)
    w, scores = weights(parts, labels, ~real, rng), np.zeros(len(labels))
    for b in parts:
        scores[b.rows] = b.by_row(w[b.columns])
    scores = scores[real]
    return Ranking(w, unusual(counts, good), float(np.quantile(scores, bad / n)), float(4 / (scores.std() + 1e-6)), at)


def spoilt(text: str) -> str:
    """A text with the letters of each word shuffled or, for every other text, drawn at random; the same for each run."""
    rng = random.Random(zlib.crc32(text.encode()))
    drawn = rng.random() < 0.5
    letters = lambda w: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=len(w)) if drawn else rng.sample(w, len(w)))
    return re.sub(r"[^\W\d_]+", lambda m: letters(m[0]), text)


def weights(parts: list[Batch], labels: np.ndarray, made: np.ndarray, rng: np.random.Generator, *, epochs: int = 15, pairs: int = 8, rate: float = 2.0) -> np.ndarray:
    """From batches of texts, in each of which drawn pairs of a text of either label, `pairs` for each text, are compared.

    A pair's loss is -log sigmoid(weights . (features of the better - features of the worse)). A column moves at the
    square of the speed of its evidence, so few columns do much, and the others what these leave. The evidence of hashed
    columns, and that of the others, is measured by what the best of as many would reach by chance. Spoilt copies take part
    in pairs of their own, from which only the weight of unusual runs learns: the others are what labels say.
    """
    w, n = np.zeros(COLUMNS), int((~made).sum())
    moments = np.zeros((2, 2, COLUMNS))  # sums of values and of their squares, by label
    for b in parts:
        for label in (0, 1):
            own = ((labels[b.rows] == label) & ~made[b.rows])[b.at] * b.values
            moments[label, 0, b.columns] += np.bincount(b.of, own, len(b.columns))
            moments[label, 1, b.columns] += np.bincount(b.of, own * b.values, len(b.columns))
    counts = np.array([np.sum((labels == 0) & ~made), np.sum((labels == 1) & ~made)])[:, None]
    means = moments[:, 0] / np.maximum(counts, 1)
    spread = np.maximum(moments[:, 1] / np.maximum(counts, 1) - means**2, 0)
    width = np.maximum(moments[:, 1].sum(0) / n - (moments[:, 0].sum(0) / n) ** 2, 1e-12)
    z = np.abs(means[1] - means[0]) / np.sqrt(np.maximum((spread / np.maximum(counts, 1)).sum(0), 1e-12))
    few = np.arange(COLUMNS) >= RARE
    for group in (few, ~few):  # what the best of so many columns is expected to reach by chance
        z[group] /= np.sqrt(2 * np.log(max(np.count_nonzero(moments[:, 0, group].any(0)), 2)))
    speed = evidence(z, 1.0) ** 2 / width
    strange = np.where(np.arange(COLUMNS) == RARE, 4.0, 0.0)
    for t in range(epochs):
        for i in rng.permutation(len(parts)):
            b = parts[i]
            up, copies = np.flatnonzero(labels[b.rows] == 1), np.flatnonzero(made[b.rows])
            for down, pace in ((np.flatnonzero((labels[b.rows] == 0) & ~made[b.rows]), speed), (copies, strange)):
                if len(up) and len(down):
                    s = b.by_row(w[b.columns])
                    i, j = (rng.choice(x, pairs * len(b.rows)) for x in (up, down))
                    g = sigmoid(s[j] - s[i]) / len(i)
                    w[b.columns] += rate / (1 + t / 5) * pace[b.columns] * b.by_column(np.bincount(i, g, len(s)) - np.bincount(j, g, len(s)))
    return w


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = 6_000, at: float = 0.3, key: str = "doc_id", text: str = "text") -> Ranking:
    """A ranking from at most `rows` labelled rows outside the held-out fold, and spoilt copies of some of them.

    Only their features come to the driver, sorted, so that reruns agree.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [k for k, (x, t) in enumerate(zip(batch.column("label").to_pylist(), batch.column("text"), strict=True)) if x == 1 and t.is_valid and zlib.crc32(t.as_buffer()) % EVERY == 0]
            copies = pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(more, pa.int64())), pa.array([spoilt(batch.column("text")[k].as_py()) for k in more], pa.string()), pa.array([0] * len(more), pa.int32())], ["key", "text", "label"])
            for of, kind in ((batch, False), (copies, True)):
                for lo, hi, data, offs in portions(*text_bytes(of.column("text"))):
                    columns, values, ends = features(data, offs)
                    bounds = pa.array(ends.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([of.column("key")[lo:hi], pa.array([kind] * (hi - lo), pa.bool_()), of.column("label")[lo:hi], pa.ListArray.from_arrays(bounds, pa.array(columns)), pa.ListArray.from_arrays(bounds, pa.array(values.astype(np.float32)))], ["key", "made", "label", "columns", "values"])

    chosen = sample(docs, labels, label, rows, key, text)
    used = chosen.mapInArrow(run, f"key {chosen.schema['key'].dataType.simpleString()}, made boolean, label int, columns array<int>, values array<float>")
    found = used.groupBy("key", "made").agg(F.max("label").alias("label"), F.min(F.struct("columns", "values")).alias("x")).select(F.xxhash64("key").alias("k"), "made", "label", "x.columns", "x.values").toArrow()
    if not len(found):
        return fit(np.zeros(0, np.int32), np.zeros(0), np.zeros(1, np.int64), np.zeros(0), at=at)
    columns, values = (found.column(c).combine_chunks() for c in ("columns", "values"))
    ends = columns.offsets.to_numpy().astype(np.int64)
    k, made, own = (found.column(c).to_numpy() for c in ("k", "made", "label"))
    ranking = fit(columns.flatten().to_numpy(), values.flatten().to_numpy().copy(), ends - ends[0], own, np.lexsort((own, made, k)), at=at, made=made)
    del found, columns, values
    give_back()
    return ranking


def score(docs: DataFrame, ranking: Ranking, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: key, held_out, score, predicted (1 if score >= threshold), and the columns in keep.

    Only the text is an input. Every text is read whole, in portions. Null or empty text has no words, and counts as
    wholly unusual. Repeated rows and null keys: a row each. Empty table: no rows. No labels, or labels of one kind:
    every score is the share of label 1.
    """

    return scored(docs, ranking.scores, key, text, threshold, keep)
