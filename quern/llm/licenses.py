"""Operator 10: license scans. Templates with optional and replaceable regions become one token automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.license_templates import NOTICES, PHRASES, TEMPLATES
from quern.llm.pieces import alike
from quern.llm.spans import LONG, SPACE, hash_runs, lean, lowered, portions, text_bytes, word_hashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
assert not (_INSIDE & SPACE).any()
KNOWN = 1 << 17
"""Moves of the deterministic automaton that are remembered; beyond that they are found anew."""
OTHER = 0
"""The class of every word that no template or phrase has."""


def words_in(text: str) -> list[str]:
    return [w.decode() for w in WORD.findall(text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))]


def parsed(markup: str) -> Iterator[tuple[str, object]]:
    """A template's parts: ("word", w), ("begin", None), ("end", None), ("any", lists of words), ("words", (least, most))."""
    for part in re.split(r"(<<.*?>>)", markup, flags=re.S):
        if not part.startswith("<<"):
            yield from (("word", w) for w in words_in(part))
        elif part.startswith("<<beginOptional"):
            yield "begin", None
        elif part.startswith("<<endOptional"):
            yield "end", None
        elif m := re.fullmatch(r"<<var;.*?match=(.*)>>", part, flags=re.S):
            n = re.fullmatch(r"\.\{(\d+),(\d+)\}", m[1])
            yield ("words", (int(n[1]), int(n[2]))) if n else ("any", [words_in(x) for x in m[1].split("|")])
        else:
            raise ValueError(f"unknown markup {part}")


class Automaton:
    """All templates as one automaton over word classes, made deterministic state by state as texts need it."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: dict[str, str]) -> None:
        self.classes: dict[str, int] = {}
        self.free: list[list[int]] = [[]]  # moves that take no word
        self.words: list[dict[int | None, list[int]]] = [{}]  # moves by word class; None: any word
        self.accepts: dict[int, str] = {}
        self.reach: dict[int, int] = {}  # for a word that every match of some template has: how far such a match can reach
        for label, markup in templates:
            self._add(label, markup)
        self.phrases = [([self._word(w) for w in phrase.split()], label) for phrase, label in phrases.items()]
        self.vocabulary = np.array([*self.classes.values()], np.int32)
        raw = [w.encode() for w in self.classes]
        ends = np.cumsum([len(x) for x in raw])
        hashes = hash_runs(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]), ends)
        order = np.argsort(hashes)
        self.hashes, self.of = hashes[order], self.vocabulary[order]
        self.sizes = np.array([len(x) for x in raw], np.int64)[order]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw) + bytes(LONG), np.uint8), (ends[order] - self.sizes)
        self.start = self._closed({0})
        self.moves: dict[tuple[frozenset, int], frozenset] = {}
        classes = np.arange(len(self.classes) + 1)
        self.first = np.array([bool(self.move(self.start, int(c))) for c in classes])
        self.reach_of = np.array([self.reach.get(int(c), 0) for c in classes])

    def _word(self, word: str) -> int:
        return self.classes.setdefault(word.lower(), len(self.classes) + 1)

    def _node(self) -> int:
        self.free.append([])
        self.words.append({})
        return len(self.free) - 1

    def _add(self, label: str, markup: str) -> None:
        at, opened, longest, mandatory = self._node(), [], 0, []
        self.free[0].append(at)

        def move(word: int | None) -> None:
            nonlocal at, longest
            to = self._node()
            self.words[at].setdefault(word, []).append(to)
            at, longest = to, longest + 1

        for kind, value in parsed(markup):
            if kind == "begin":
                opened.append(at)
            elif kind == "end":
                to = self._node()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            elif kind == "any":
                to, start, before = self._node(), at, longest
                for words in value:
                    at, longest = start, before
                    for word in words:
                        move(self._word(word))
                    self.free[at].append(to)
                at, longest = to, before + max(map(len, value))
            elif kind == "words":
                to = self._node()
                for k in range(value[1]):
                    if k >= value[0]:
                        self.free[at].append(to)
                    move(None)
                self.free[at].append(to)
                at = to
            else:
                move(self._word(value))
                if not opened:
                    mandatory.append(value)
        self.accepts[at] = label
        anchor = self.classes[max(mandatory, key=len)]
        self.reach[anchor] = max(self.reach.get(anchor, 0), longest)

    def _closed(self, nodes: set[int]) -> frozenset[int]:
        todo, seen = [*nodes], {*nodes}
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def move(self, state: frozenset[int], word: int) -> frozenset[int]:
        found = self.moves.get((state, word))
        if found is None:
            if len(self.moves) >= KNOWN:
                self.moves.clear()
            to = {t for s in state for w in (word, None) for t in self.words[s].get(w, ())}
            found = self.moves[state, word] = self._closed(to)
        return found

    def windows(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that any match lies in; word i's text is [low[i], high[i])."""
        at = np.flatnonzero(self.reach_of[words])
        reach = self.reach_of[words[at]]
        lo, hi = np.maximum(at - reach, low[at]), np.minimum(at + reach, high[at])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        new = np.flatnonzero(np.append(True, lo[1:] >= hi[:-1])[: len(lo)])
        yield from zip(lo[new].tolist(), np.append(hi[new[1:] - 1], hi[-1:]).tolist(), strict=True)

    def accepted(self, classes: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """Label, first and last word of each template found (for one start and label, the longest)."""
        words = classes.tolist()
        for i in np.flatnonzero(self.first[classes]).tolist():
            state, found = self.move(self.start, words[i]), {}
            j = i
            while state:
                found |= {self.accepts[s]: j for s in state if s in self.accepts}
                j += 1
                if j == len(words):
                    break
                state = self.move(state, words[j])
            yield from ((label, i, last) for label, last in sorted(found.items()))

    def classify(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Classes of words that start there, in texts that end at stops; a word found by hash is compared byte for byte."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == hashes)
        at, ends = at[rows], starts[rows] + self.sizes[at[rows]]
        same = ends <= stops[rows]
        rows, at, ends = rows[same], at[same], ends[same]
        same = alike(lowered(data), starts[rows], self.raw, self.raw_at[at], self.sizes[at])
        same &= (ends == stops[rows]) | ~_INSIDE[data[np.minimum(ends, len(data) - 1)]]
        classes = np.full(len(hashes), OTHER, self.of.dtype)
        classes[rows[same]] = self.of[at[same]]
        return classes


def licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words are runs of ASCII letters and digits (A-Z as a-z) and of characters outside ASCII. n_base counts the places
    where a phrase stands, first_word and last_word are the least and greatest place, from 0. A template matches where
    its mandatory words stand in order with nothing between but its optional and replaceable regions. labels: those of
    phrases, templates and notices, distinct, sorted, joined by commas; matches: label, first and last word of each
    template and notice. score: 1 if a template (a whole licence) matches, 0.75 if a notice (a sentence that names one)
    does, 0.5 if only a phrase, else 0. Altered wording is no match: a licence with a word more, less or other outside
    its optional and replaceable regions gets no template's label.

    Every text is read whole, in portions; automata run only where a word all matches of some template need is near.
    Null or empty text: 0 words, null places, empty labels. Repeated rows and null keys: a row each. Empty table: no
    rows. Other columns are not read. No shuffle.
    """
    phrases = PHRASES if phrases is None else phrases

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, whole = Automaton((*templates, *notices), phrases), {label for label, _ in templates}
        for batch in batches:
            found: list[list] = []
            for _, _, data, offs in portions(*text_bytes(batch.column(1))):
                hashes, text_of, starts = word_hashes(data, offs, _INSIDE)
                words = automaton.classify(hashes, data, starts, offs[text_of + 1])
                n = np.bincount(text_of, minlength=len(offs) - 1)
                first = np.cumsum(n) - n
                base: list[list[tuple[int, str]]] = [[] for _ in n]
                for phrase, label in automaton.phrases:
                    at = np.ones(max(len(words) - len(phrase) + 1, 0), bool)
                    for k, w in enumerate(phrase):
                        at &= words[k : k + len(at)] == w
                    for i in np.flatnonzero(at):
                        if text_of[i] == text_of[i + len(phrase) - 1]:
                            base[text_of[i]].append((int(i - first[text_of[i]]), label))
                near: dict[int, list[tuple[str, int, int]]] = {}
                for lo, hi in automaton.windows(words, first[text_of], (first + n)[text_of]):
                    t = int(text_of[lo])
                    near.setdefault(t, []).extend((label, a + lo - int(first[t]), b + lo - int(first[t])) for label, a, b in automaton.accepted(words[lo:hi]))
                for t in range(len(n)):
                    places, matches = [p for p, _ in base[t]], sorted(near.get(t, ()), key=lambda m: (m[1], m[2], m[0]))
                    own = {label for _, label in base[t]}
                    found.append([int(n[t]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {m[0] for m in matches})), 1.0 if any(m[0] in whole for m in matches) else 0.75 if matches else 0.5 if places else 0.0, [dict(zip(("label", "first", "last"), m, strict=True)) for m in matches]])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", *NAMES])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,last:long>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
