"""Operator 12 against plain Python, with few and many ranges, hot words and pairs, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import collocations as c

DOCS = "doc_id long, text string, lang string, n int, words string"


def brute(rows, least, percent=80, first=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        many = {p: x for p, x in own.items() if x >= least}
        held = defaultdict(int)
        for p, x in many.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    held[p[i : i + size]] = max(held[p[i : i + size]], x)
        best = []
        for p, a in many.items():
            if len(p) > 1 and not (p in held and 100 * held[p] >= percent * a):
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)
    return sorted((tuple(r) for r in c.collocations(docs, **more).collect()), key=repr)


def texts(n, seed=1):
    """Zipf words, a hot word, a hot pair and a hot passage, separators of all kinds."""
    rng = random.Random(seed)
    words = [f"w{k}é" if k % 3 else f"W{k}" for k in range(60)]
    for k in range(n):
        own = rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))
        own = [x for w in own for x in ((w, "hot") if rng.random() < 0.4 else (w, "of", "the") if rng.random() < 0.3 else (w,))]
        yield k, "".join(w + rng.choice([" ", " ", " ", " \t", ". ", "\n", ","]) for w in own) + ("the very same passage here" if k % 3 == 0 else ""), rng.choice(["en", "en", "fr", None, "und"])


@pytest.mark.parametrize(("in_range", "fan", "shard"), [(1 << 20, 256, 8 << 20), (300, 256, 2000), (300, 4, 2000)])
def test_equals_brute_force(spark, monkeypatch, in_range, fan, shard):
    monkeypatch.setattr(c, "IN_RANGE", in_range)
    monkeypatch.setattr(c, "FAN", fan)
    monkeypatch.setattr(c, "SHARD", shard)
    monkeypatch.setattr(c, "STEP", 16)
    rows = list(texts(300))
    assert found(spark, rows, least=5, first=100) == brute(rows, 5, first=100)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "a b " * 10, None), (4, "A b.a b", "und"), (4, "A b.a b", "und"), (5, " \t.,;", "x"), (6, "q" * 100_000 + " z " + "q" * 100_000 + " z", "en"), (7, "x y \x00 x y \x00", "fr"), (8, "b a " * 5000, "long")]
    assert found(spark, rows, least=2) == brute(rows, 2)
    assert found(spark, [], least=2) == []
    assert found(spark, rows[:2], least=1) == []


def test_ties_go_to_the_phrase_and_cuts_to_the_first(spark):
    rows = [(k, f"b{k} c{k}. a{k} d{k}. p q p q", "en") for k in range(3) for _ in range(4)]
    for first in (3, 2000):
        assert found(spark, rows, least=4, first=first) == brute(rows, 4, first=first)


def test_automata_hold_their_paths():
    rng = np.random.default_rng(3)
    alphabet = np.unique(np.append(rng.integers(-(2**63), 2**63 - 1, 400), 0))
    for size in (1, 7, 5000):
        paths, weights = c.ordered(rng.integers(0, len(alphabet), (size, c.DEPTH)) // rng.integers(1, 200, (size, c.DEPTH)), np.ones(size, np.int64), len(alphabet))
        assert weights.sum() == size and len({*map(tuple, paths.tolist())}) == len(paths) and paths.tolist() == sorted(paths.tolist())
        batch = c.cut(alphabet, paths, weights, [tuple(alphabet[paths[size // 3]].tolist())] if size > 6 else [], 0, 0)
        back = c.union(pa.Table.from_batches([batch]))
        assert (back[0][back[1]] == alphabet[paths]).all() and (back[2] == weights).all()
        assert batch.num_rows == (2 if size > 6 else 1)


def test_words_with_one_hash_start_the_job_anew(spark, monkeypatch):
    real, calls = c.vocabulary, []

    def vocabulary(rows, seeds):
        calls.append(seeds.tolist())
        found = real(rows, seeds)
        return found if len(calls) > 1 else found.union(found.where("kind = 0").limit(1).replace("a", "other", "word").replace("b", "other", "word").replace("c", "other", "word"))

    monkeypatch.setattr(c, "vocabulary", vocabulary)
    rows = [(1, "a b a b c", "en")]
    assert found(spark, rows, least=2) == brute(rows, 2) and len(calls) == 2 and calls[0] != calls[1]


def test_words_that_end_with_their_text(spark):
    rows = [(k, x, "en") for k, x in enumerate(["end", "endless a", "end", "", "a end", "a end", "less"] * 2)]
    assert found(spark, rows, least=2) == brute(rows, 2)
