"""Words of many texts at once: numpy over the byte buffer of an Arrow column.

A word is a run of bytes that are not ASCII white space. Its hash is a chain over its 8-byte parts, each step a
bijection of 64 bits, for all words of a block together; a run of more than LONG bytes is hashed by itself with BLAKE2.
No short word becomes a Python object, and what a block needs is a few bytes for each of its own.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
"""Bytes that are hashed at once; a block ends with a text, or between words of a longer text."""
LONG = 64
"""Bytes of a run that the chain takes; 8 steps."""

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
"""Bytes with A-Z as a-z."""
LOWER[65:91] = np.arange(97, 123)
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, LONG + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
"""One for each length."""
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives the memory of its batches back when a task ends; workers live on."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(low: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of low on, little-endian; low has 8 bytes more than the block."""
    return np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))


def lowered(block: np.ndarray) -> np.ndarray:
    """The block with A-Z as a-z, and 8 bytes more."""
    low = np.zeros(len(block) + 8, np.uint8)
    np.take(LOWER, block, out=low[: len(block)])
    return low


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and len + 1 offsets into them. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK, inside: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Byte ranges of about limit bytes: whole texts, or parts of a longer text cut after a byte that no word has.

    A range of more than limit bytes is one word, all of it (inside: which byte values words have).
    """
    gap = SPACE if inside is None else ~inside
    lo, end = 0, int(offs[-1])
    while lo < end:
        hi = int(offs[np.searchsorted(offs, lo + limit, "right") - 1])
        if hi <= lo:  # one text is longer than the limit
            stop = int(offs[np.searchsorted(offs, lo, "right")])
            hi = _cut(data, gap, lo, min(lo + limit, stop), stop)
        yield lo, hi
        lo = hi


def _cut(data: np.ndarray, gap: np.ndarray, lo: int, hi: int, stop: int) -> int:
    """After the last gap before hi; if there is none, at the first one from hi on."""
    if hi == stop:
        return hi
    for at in range(hi, lo, -65536):
        if len(found := np.flatnonzero(gap[data[max(at - 65536, lo) : at]])):
            return max(at - 65536, lo) + int(found[-1]) + 1
    for at in range(hi, stop, 65536):
        if len(found := np.flatnonzero(gap[data[at : at + 65536]])):
            return min(at + int(found[0]), stop)
    return stop


def fresh_seeds() -> np.ndarray:
    """Seeds that nobody knows before a job, for all its tasks: texts can't be written so that their hashes meet."""
    return np.random.default_rng(secrets.randbits(128)).integers(0, 2**64, LONG + 1, dtype=np.uint64)


def digest(run: np.ndarray, seeds: np.ndarray | None = None) -> int:
    """64 bits of BLAKE2 of a run, with A-Z as a-z."""
    state = hashlib.blake2b(digest_size=8, key=b"" if seeds is None else seeds.tobytes()[:64])
    for at in range(0, len(run), BLOCK):
        state.update(LOWER[run[at : at + BLOCK]])
    return int.from_bytes(state.digest(), "little")


def chain(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """A hash for each run of up to LONG bytes; words: parts() of the block."""
    hashes = (_SEEDS if seeds is None else seeds)[sizes]
    rows = np.arange(len(starts))
    for k in range(0, LONG, 8):
        rows = rows[sizes[rows] > k]
        if not len(rows):
            break
        part = hashes[rows] ^ (words[starts[rows] + k] & _MASKS[np.minimum(sizes[rows] - k, 8)])
        if seeds is not None:  # each step has a factor of its own, so no difference of parts has a known effect
            part = (part ^ (part >> np.uint64(32))) * (seeds[k // 8] | np.uint64(1))
        hashes[rows] = mix(part)
    return hashes


def hash_runs(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash for each run [start, end) of a block, with A-Z as a-z."""
    sizes = ends - starts
    long = np.flatnonzero(sizes > LONG)
    if len(long) < len(sizes):
        hashes = chain(parts(lowered(block)), starts, np.where(sizes > LONG, 0, sizes), seeds)
    else:
        hashes = np.zeros(len(sizes), np.uint64)
    for k in long.tolist():
        hashes[k] = digest(block[starts[k] : ends[k]], seeds)
    return hashes


def words_of(block: np.ndarray, first: np.ndarray, inside: np.ndarray, limit: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a block's words; a block from blocks() that is longer than the limit is one."""
    if len(block) > limit and not len(first[(first > 0) & (first < len(block))]):
        return np.zeros(1, np.int64), np.full(1, len(block))
    return runs(inside[block], first)


def runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run also ends where first (sorted positions) begins a new text."""
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = first[(first > 0) & (first < len(inside))]
    start[first] |= inside[first]
    starts = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[first - 1] |= inside[first - 1]
    return starts, np.flatnonzero(stop) + 1


def word_hashes(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, in order: word hashes with A-Z as a-z, the text each word is in, and where it starts.

    inside[b] says which byte values belong to words; by default all but ASCII white space. seeds: of fresh_seeds(), else
    the hashes are the same in every job.
    """
    inside = ~SPACE if inside is None else inside
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in blocks(data, offs, inside=inside):
        block = data[lo:hi]
        first = offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo
        starts, ends = words_of(block, first, inside)
        found.append((hash_runs(block, starts, ends, seeds), np.searchsorted(offs, starts + lo, "right") - 1, starts + lo))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def portions(data: np.ndarray, offs: np.ndarray, limit: int = 2 * BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A batch in portions of whole texts of about limit bytes and 2 ** 19 texts at most (one longer text is its own): lo, hi, bytes, offsets."""
    lo = 0
    while lo < len(offs) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1), lo + (1 << 19))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def shingles(data: np.ndarray, offs: np.ndarray, width: int, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes of each text's runs of width words, and len + 1 offsets; of fewer words, all as one run."""
    words, text, _ = word_hashes(data, offs, seeds=seeds)
    ends = np.cumsum(np.bincount(text, minlength=len(offs) - 1))
    total = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        total = (total + words[k : k + len(total)]) * np.uint64(0xD6E8FEB86659FD93)
    total = mix(total)
    found, lo = [], 0
    for hi in ends.tolist():
        n = hi - lo
        if n >= width:
            one = np.sort(total[lo : hi - width + 1])
            keep = np.ones(len(one), bool)
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            found.append(one[keep])
        else:
            few = np.full(min(n, 1), n, np.uint64)
            for k in range(lo, hi):
                few = mix((few + words[k : k + 1]) * np.uint64(0xD6E8FEB86659FD93))
            found.append(few)
        lo = hi
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))


def set_digests(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit digests (a row each) for each set of hashes, whatever their order."""
    lanes = []
    for salt, step in ((0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        sums = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64))
        lanes.append(mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64) * np.uint64(step)).view(np.int64))
    return np.stack(lanes)
