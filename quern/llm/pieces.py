"""Token ids of whole texts, each distinct piece of text encoded by the library once.

The tokenizers this is for drop white space and pre-tokenize letters, digits and other characters apart, so a text's
ids are those of its pieces one after another, if texts are cut only at safe boundaries: at ASCII white space, and
between two ASCII characters of different kind (letter, digit, other) unless the first is an apostrophe, which may
join the letters after it. A run that holds the first character of an added token is not cut inside, so added tokens
are found as in the whole text. Nothing is cut beside a character outside ASCII.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np

from quern.llm.spans import LONG, SPACE, blocks, chain, lowered, parts, runs

_LETTER, _DIGIT, _OTHER, _APOSTROPHE, _WIDE = range(1, 6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
_KIND[128:] = _WIDE
_CUT = np.zeros((6, 6), bool)
_CUT[_LETTER, [_DIGIT, _OTHER, _APOSTROPHE]] = True
_CUT[_DIGIT, [_LETTER, _DIGIT, _OTHER, _APOSTROPHE]] = True
_CUT[_OTHER, [_LETTER, _DIGIT]] = True
_CUT[_APOSTROPHE, _DIGIT] = True
_CUT = _CUT.ravel()

BLOCK = 1 << 20
"""Bytes whose pieces are looked up at once."""
KNOWN = 3 << 18
"""Distinct pieces a worker keeps; beyond that it starts anew, which costs time only."""
BATCH = 1 << 20
"""Bytes of pieces in one call of the library."""


def cuts_by_character_kind(path: str) -> bool:
    """Whether a tokenizer's file describes one whose pieces are independent in the sense above."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = lambda x, key: x[key] if x and x["type"] == "Sequence" else [x] if x else []
    split = [x for x in parts(spec["pre_tokenizer"], "pretokenizers") if x["type"] == "Split"]
    return (
        any(x["type"] == "Lowercase" for x in parts(spec["normalizer"], "normalizers"))
        and len(split) == 1
        and split[0]["behavior"] == "Removed"
        and split[0]["invert"]
        and split[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not any(SPACE[list(x["content"].encode())].any() or x["content"][0].isalnum() for x in spec["added_tokens"])
    )


def cut(block: np.ndarray, first: np.ndarray, guards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a block's pieces, and which of them may hold an added token (guards: first bytes of these)."""
    kind = _KIND[block]
    inside = kind > 0
    starts, ends = runs(inside, first)
    at = np.zeros(len(block) + 1, bool)
    at[starts] = True
    inner = np.zeros(len(block) + 1, bool)
    inner[1:-1] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
    guarded = np.zeros(0, np.int64)
    if (hits := np.flatnonzero(np.isin(block, guards))).size:
        guarded = np.unique(np.searchsorted(starts, hits, "right") - 1)
        for k in guarded:
            inner[starts[k] + 1 : ends[k]] = False
        guarded = starts[guarded]
    at[:-1] |= inner[:-1] & inside
    starts = np.flatnonzero(at)
    ends = np.minimum(np.append(starts[1:], len(block)), ends[np.searchsorted(ends, starts, "right")]) if len(starts) else starts
    return starts, ends, np.isin(starts, guarded)


def alike(one: np.ndarray, at: np.ndarray, other: np.ndarray, where: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the first sizes bytes (LONG at most) are the same from at on in one and from where on in other."""
    same, one, other = np.ones(len(at), bool), parts(one), parts(other)
    rows = np.arange(len(at))
    for k in range(0, LONG, 8):
        rows = rows[sizes[rows] > k]
        if not len(rows):
            break
        odd = one[at[rows] + k] ^ other[where[rows] + k]
        left = np.minimum(sizes[rows] - k, 8).astype(np.uint64) * np.uint64(8)
        same[rows] &= (odd << (np.uint64(64) - left)) == 0
    return same


class Encoder:
    """Ids of pieces, by hash; one for each worker process and file."""

    _all: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.guards = np.unique([x.content.encode()[0] for x in self.library.get_added_tokens_decoder().values()]).astype(np.uint8)
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._all:
            cls._all[path] = cls(path)
        return cls._all[path]

    def _clear(self) -> None:
        self.hashes, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lengths, self.ends, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)
        self.raw, self.raw_at, self.sizes = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The library's ids of some pieces, in batches balanced by bytes, not by number."""
        found: list[np.ndarray] = []
        size = np.cumsum(ends - starts)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH, "right")))
            texts = [block[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            found += [np.array(x.ids, self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            lo = hi
        return found

    def _learn(self, block: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        new, sizes = self._encode(block, starts, ends), ends - starts
        entries = np.arange(len(self.lengths), len(self.lengths) + len(new))
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), np.int64, len(new))])
        self.ids = np.concatenate([self.ids, *new])
        self.ends = np.cumsum(self.lengths)
        own = np.cumsum(sizes) - sizes  # the pieces themselves, to compare with
        self.raw_at, self.sizes = np.concatenate([self.raw_at, len(self.raw) - 8 + own]), np.concatenate([self.sizes, sizes])
        self.raw = np.concatenate([self.raw[:-8], low[np.repeat(starts - own, sizes) + np.arange(sizes.sum())], np.zeros(8, np.uint8)])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.entries = np.insert(self.entries, at, entries[order])

    def look_up(self, block: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each piece of a block starts, its entry, and of all entries: lengths, ends, ids.

        Pieces are found by hash, and then compared byte for byte with the one that is known; what differs, and long
        pieces and those that may hold an added token, are encoded for this block alone.
        """
        starts, ends, odd = cut(block, first, self.guards)
        entries, sizes = np.zeros(len(starts), np.int64), ends - starts
        odd |= sizes > LONG
        if len(self.hashes) > KNOWN:
            self._clear()
        if len(plain := np.flatnonzero(~odd)):
            low = lowered(block)
            hashes = chain(parts(low), starts[plain], sizes[plain])
            distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
            new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
            if new.any():
                self._learn(block, low, starts[plain[where[new]]], ends[plain[where[new]]], distinct[new])
            own = self.entries[np.searchsorted(self.hashes, distinct)][back]
            same = (self.sizes[own] == sizes[plain]) & alike(low, starts[plain], self.raw, self.raw_at[own], np.minimum(sizes[plain], self.sizes[own]))
            entries[plain] = own
            odd[plain[~same]] = True
        if not odd.any():
            return starts, entries, self.lengths, self.ends, self.ids
        others = np.flatnonzero(odd)
        texts: dict[bytes, int] = {}
        number = [texts.setdefault(hashlib.blake2b(block[starts[k] : ends[k]], digest_size=16).digest(), len(texts)) for k in others.tolist()]
        once = others[np.unique(number, return_index=True)[1]]
        ids = self._encode(block, starts[once], ends[once])
        entries[others] = len(self.lengths) + np.array(number)
        lengths = np.concatenate([self.lengths, np.fromiter(map(len, ids), np.int64, len(ids))])
        return starts, entries, lengths, np.cumsum(lengths), np.concatenate([self.ids, *ids])

    def _parts(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For each block: the text of each piece, the piece's entry, and the entries."""
        for lo, hi in blocks(data, offs, BLOCK):
            first = offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo
            starts, *found = self.look_up(data[lo:hi], first)
            yield np.searchsorted(offs, starts + lo, "right") - 1, *found

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        n = np.zeros(len(offs) - 1, np.int64)
        for texts, entries, known, _, _ in self._parts(data, offs):
            n += np.bincount(texts, known[entries], len(n)).astype(np.int64)
        return n

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and len + 1 offsets into them."""
        n, ids = np.zeros(len(offs) - 1, np.int64), [np.zeros(0, self.dtype)]
        for texts, entries, known, stops, every in self._parts(data, offs):
            lengths = known[entries]
            ends = np.cumsum(lengths)
            n += np.bincount(texts, lengths, len(n)).astype(np.int64)
            ids.append(every[np.repeat(stops[entries] - ends, lengths) + np.arange(ends[-1] if len(ends) else 0)])
        return np.concatenate(ids), np.append(0, np.cumsum(n))


class WholeEncoder:
    """For other tokenizers, whose ids may depend on what stands around: each text is encoded whole."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: library.encode(texts, num_threads=1)
            size = library.vocab_size()
        else:
            library = Encoder.of(path).library
            self._ids = lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            size = library.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32

    def _batches(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, list[list[int]]]]:
        lo = 0
        while lo < len(offs) - 1:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BATCH, "right")) - 1)
            yield lo, self._ids([data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(offs[lo:hi], offs[lo + 1 : hi + 1], strict=True)])
            lo = hi

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.array([len(x) for _, ids in self._batches(data, offs) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x, self.dtype) for _, batch in self._batches(data, offs) for x in batch]
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64))


_WHOLE: dict[str, WholeEncoder] = {}


def encoder(path: str) -> Encoder | WholeEncoder:
    """The encoder of this worker process for a tokenizer's file."""
    if path in _WHOLE:
        return _WHOLE[path]
    if path.endswith(".json") and cuts_by_character_kind(path):
        return Encoder.of(path)
    return _WHOLE.setdefault(path, WholeEncoder(path))
