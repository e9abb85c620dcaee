"""Operator 13: which tokens of two tokenizers cover the same bytes of a text.

1. Each text is tokenised whole by both: A is a byte-level BPE over a space and the text, B a BPE that adds that space.
   Neither merges over a single space between two other characters, so a text's tokens are those of its pieces, each
   piece a space and what follows, and the libraries see each distinct piece once for each worker.
2. The bytes of all tokens are compared with the text's. So a piece ends where a token of A and one of B ends (verified),
   before tokens that are marked with a space: these ends cut the text into windows of token ids. A window's alignment
   is kept by its id tuples: groups between shared byte ends, links (all A-B pairs of a group), and the text of groups.
3. Distinct id pairs of each document go to a table in blocks of documents, by pair. In how many documents a pair is
   linked is summed over the blocks; the counts then meet the blocks again, by ranges of pairs and groups of blocks, and
   what comes back is a sum for each document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pieces import alike
from quern.llm.shared import kept
from quern.llm.spans import LONG, chain, lean, parts, portions, text_bytes

KNOWN, KNOWN_BYTES = 1 << 17, 1 << 25
"""Distinct windows that a worker keeps, and bytes of their text; beyond these it starts anew, which costs time only."""
PORTION = 1 << 20
"""Bytes of text aligned at once."""
BLOCK_PAIRS, BLOCK_DOCS = 3 << 19, 60_000
"""Pairs of documents in a block, about, and documents."""
RANGES = 16
"""Ranges of pairs."""
GROUP_PAIRS = 2 << 20
"""Pairs of documents, about, that one task looks up."""

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0x80:] = True
_AFTER = _SOLID.copy()
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False
"""Bytes after a space where a text may be cut before it; characters that begin with the others can be white space."""


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Alignments of windows; one for each worker process and pair of files."""

    _all: dict[tuple[str, str], Aligner] = {}

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        if (a, b) not in cls._all:
            cls._all[a, b] = cls(a, b)
        return cls._all[a, b]

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = byte_level()
        words = {i: w for w, i in self.a.get_vocab(with_added_tokens=True).items()}
        special = self.a.get_added_tokens_decoder()
        raw_a = [b"" if i in special else bytes(back[c] for c in words.get(i, "")) for i in range(max(words) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        raw_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        if max(len(raw_a), len(raw_b)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.whole = any("▁" in x.lstrip("▁") for x in names)  # then tokens may cross a space, and texts stay whole
        self.raw_a, self.raw_b = pa.array(raw_a, pa.large_binary()), pa.array(raw_b, pa.large_binary())
        self.size_a, self.size_b = (np.array([len(x) for x in raw], np.int64) for raw in (raw_a, raw_b))
        self.spelt = pa.array([f"{k >> 2}{',|;'[k & 3]}" if k & 3 < 3 else "" for k in range(4 << 16)], pa.large_string())
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.raw_at, self.sizes = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slots = np.zeros(0, np.int64)  # entry of each piece
        self.known: dict[bytes, int] = {}  # by the tuples of ids
        self.texts: list[bytes] = []
        self.text_bytes = 0
        self.numbers = np.zeros((5, 0), np.int64)  # of each window: valid, tokens of A, of B, groups, links
        self.pairs, self.times, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _align(self, ids: list[np.ndarray], counts: list[np.ndarray], valid: np.ndarray) -> None:
        """Appends windows: ids of A and of B, one window after another; the number of ids of each; whose bytes are right."""
        n = len(valid)
        own = [np.repeat(valid, k) for k in counts]
        (a, b), of = [x[keep].astype(np.int64) for x, keep in zip(ids, own, strict=True)], [np.repeat(np.arange(n), k)[keep] for k, keep in zip(counts, own, strict=True)]
        stops = [np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])]
        last = [np.isin(x, y, assume_unique=True) for x, y in (stops, stops[::-1])]
        group = [np.cumsum(x) - x for x in last]
        groups = int(last[0].sum())
        size_a, size_b = (np.bincount(g, minlength=groups) for g in group)
        before_a, before_b = (np.append(0, np.cumsum(x)) for x in (size_a, size_b))
        window = of[0][last[0]]
        # every id of A in a group with every id of B in it; ids that a group holds several times stand there once
        (own_a, times_a), (own_b, times_b) = (np.unique(g << 16 | x, return_counts=True) for g, x in zip(group, (a, b), strict=True))
        first = np.append(0, np.cumsum(np.bincount(own_b >> 16, minlength=groups)))
        many = np.diff(first)[own_a >> 16]
        at = np.repeat(first[own_a >> 16] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        code = np.repeat(window[own_a >> 16] << 32 | (own_a & 0xFFFF) << 16, many) | own_b[at] & 0xFFFF
        times = np.repeat(times_a, many) * times_b[at]
        order = np.argsort(code)
        code, times = code[order].astype(np.uint64), times[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        code, times = code[first], np.add.reduceat(times, first) if len(first) else times
        # the text of groups: A's ids, |, B's ids, ;
        spelt = np.zeros(len(a) + len(b), np.int64)
        spelt[np.arange(len(a)) + before_b[group[0]]] = a << 2 | last[0]
        spelt[np.arange(len(b)) + before_a[group[1] + 1]] = b << 2 | np.where(last[1], 2, 0)
        texts = self.spelt.take(pa.array(spelt))
        _, offsets, data = texts.buffers()
        offsets, data = np.frombuffer(offsets, np.int64)[: len(texts) + 1], b"" if data is None else data.to_pybytes()
        tokens = np.append(0, np.cumsum(np.bincount(of[0], minlength=n) + np.bincount(of[1], minlength=n)))
        cuts = offsets[tokens].tolist()
        self.texts += [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        self.text_bytes += len(data)
        new = [valid.astype(np.int64), np.bincount(of[0], minlength=n), np.bincount(of[1], minlength=n), np.bincount(window, minlength=n), np.bincount(window, size_a * size_b, n).astype(np.int64)]
        self.numbers = np.concatenate([self.numbers, new], 1)
        self.pairs = np.concatenate([self.pairs, (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)])
        self.times = np.concatenate([self.times, times])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount((code >> np.uint64(32)).astype(np.int64), minlength=n))])

    def _right(self, raw: pa.Array, ids: np.ndarray, counts: np.ndarray, table: np.ndarray, joined: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the bytes of each piece's tokens are the piece."""
        ends = np.append(0, np.cumsum(counts))
        total = np.append(0, np.cumsum(table[ids]))
        right = total[ends[1:]] - total[ends[:-1]] == sizes
        if not right.all():  # compare the others only
            keep = np.repeat(right, counts)
            ids, joined = ids[keep], joined[np.repeat(right, sizes)]
        buffer = raw.take(pa.array(ids)).buffers()[2]
        same = (np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8))[: len(joined)] == joined
        if not same.all():
            at = np.repeat(np.flatnonzero(right), sizes[right])
            right[at[~same]] = False
        return right

    def _learn(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of some pieces: tokenised, verified, and aligned unless their id tuples are known."""
        sizes = ends - starts
        stops = np.cumsum(sizes)
        joined = block[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1])]
        texts = [block[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [[x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([x[1:] for x in texts], num_threads=1)]
        counts = [np.fromiter(map(len, x), np.int64, len(x)) for x in found]
        ids = [np.fromiter((i for y in x for i in y), np.uint16, int(n.sum())) for x, n in zip(found, counts, strict=True)]
        right = self._right(self.raw_a, ids[0], counts[0], self.size_a, joined, sizes) & self._right(self.raw_b, ids[1], counts[1], self.size_b, joined, sizes)
        entries, new, at = np.zeros(len(texts), np.int64), [], [np.append(0, np.cumsum(x)).tolist() for x in counts]
        first = len(self.texts)
        for k, ok in enumerate(right.tolist()):
            key = ids[0][at[0][k] : at[0][k + 1]].tobytes() + (b"\xff\xff" if ok else b"\xff\xfe") + ids[1][at[1][k] : at[1][k + 1]].tobytes()
            entries[k] = entry = self.known.setdefault(key, first + len(new))
            if entry == first + len(new):
                new.append(k)
        if new:
            only = np.array(new)
            keep = [np.repeat(np.isin(np.arange(len(texts)), only), n) for n in counts]
            self._align([x[y] for x, y in zip(ids, keep, strict=True)], [n[only] for n in counts], right[only])
        return entries

    def windows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and entry of each window of some texts; empty texts have none."""
        size = np.diff(offs)
        own = np.flatnonzero(size)
        first = offs[:-1][own] + np.arange(len(own))  # of each text that is not empty, with the space before it
        block = np.full(len(data) + len(own) + 8, 32, np.uint8)
        there = np.ones(len(data) + len(own), bool)
        there[first] = False
        block[:-8][there] = data
        block[-8:] = 0
        begin = np.zeros(len(there), bool)
        if not self.whole and len(there) > 2:
            begin[1:-1] = (block[1:-9] == 32) & _SOLID[block[:-10]] & _AFTER[block[2:-8]]
            begin[first[1:] - 1] = False  # a text's last byte
        begin[first] = True
        starts = np.flatnonzero(begin)
        ends, text = np.append(starts[1:], len(there)), own[np.searchsorted(first, starts, "right") - 1]
        if len(self.known) > KNOWN or self.text_bytes > KNOWN_BYTES:
            self._clear()
        sizes, entries = ends - starts, np.full(len(starts), -1, np.int64)
        if len(plain := np.flatnonzero(sizes <= LONG)):
            hashes = chain(parts(block), starts[plain], sizes[plain])
            distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
            new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
            if new.any():
                s, e = starts[plain[where[new]]], ends[plain[where[new]]]
                found, n = self._learn(block, s, e), e - s
                stop = np.cumsum(n)
                slot = len(self.raw_at) + np.arange(len(s))
                self.raw_at = np.concatenate([self.raw_at, len(self.raw) - 8 + stop - n])
                self.sizes, self.slots = np.concatenate([self.sizes, n]), np.concatenate([self.slots, found])
                self.raw = np.concatenate([self.raw[:-8], block[np.repeat(s - (stop - n), n) + np.arange(stop[-1])], np.zeros(8, np.uint8)])
                put = np.searchsorted(self.hashes, distinct[new])
                self.hashes, self.entries = np.insert(self.hashes, put, distinct[new]), np.insert(self.entries, put, slot)
            slot = self.entries[np.searchsorted(self.hashes, distinct)][back]
            same = (self.sizes[slot] == sizes[plain]) & alike(block, starts[plain], self.raw, self.raw_at[slot], np.minimum(sizes[plain], self.sizes[slot]))
            entries[plain[same]] = self.slots[slot[same]]
        if len(odd := np.flatnonzero(entries < 0)):
            entries[odd] = self._learn(block, starts[odd], ends[odd])
        return text, entries

    def align(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: numbers (A, B, groups, links), SHA-256 of the groups; text, pair, times of their distinct pairs."""
        n = len(offs) - 1
        text, entries = self.windows(data, offs)
        valid = np.bincount(text, self.numbers[0][entries], n) == np.bincount(text, minlength=n)
        keep = valid[text]
        text, entries = text[keep], entries[keep]
        numbers = np.stack([np.bincount(text, x, n).astype(np.int64) for x in self.numbers[1:, entries]])
        ends, listed, digests = np.searchsorted(text, np.arange(n + 1)).tolist(), entries.tolist(), []
        for lo, hi in zip(ends, ends[1:], strict=False):
            groups = b"".join(itemgetter(*listed[lo:hi])(self.texts)) if hi - lo > 1 else self.texts[listed[lo]] if hi > lo else b""
            digests.append(hashlib.sha256(memoryview(groups)[:-1]).hexdigest() if groups else "")
        own, copies = np.unique(text << 32 | entries, return_counts=True)
        text, entries = own >> 32, own & 0xFFFFFFFF
        many = self.ends[entries + 1] - self.ends[entries]
        at = np.repeat(self.ends[entries] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        code = np.repeat(text, many).astype(np.uint64) << np.uint64(32) | self.pairs[at]
        order = np.argsort(code)
        code, times = code[order], (self.times[at] * np.repeat(copies, many))[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        times = np.add.reduceat(times, first) if len(first) else times
        code = code[first]
        return numbers, digests, (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), times


FIELDS = "block long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, range int, entries int, pairs array<int>, held array<int>, places binary, times binary"


def _range(pair: np.ndarray) -> np.ndarray:
    return pair.astype(np.int64) % 65521 % RANGES


def aligned(docs: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """A row for each document (place in its block, numbers, groups), and rows of its block's pairs by range."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ["key", *(x.split()[0] for x in FIELDS.split(", "))]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a, b)
        block, place, waiting = TaskContext.get().partitionId() << 32, 0, []
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

        def row_batch(key: pa.Array, **columns: object) -> pa.RecordBatch:
            n = len(key)
            return pa.RecordBatch.from_arrays([key, *(pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names[1:], kinds, strict=True))], names)

        def flush() -> pa.RecordBatch:
            where, pair, times = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(_range(pair).astype(np.uint64) << np.uint64(48) | pair.astype(np.uint64) << np.uint64(16) | where.astype(np.uint64))
            where, pair, times = where[order], pair[order], times[order]
            bounds = np.searchsorted(_range(pair), np.arange(RANGES + 1)).tolist()
            out: dict[str, list] = {c: [] for c in ("block", "range", "entries", "pairs", "held", "places", "times")}
            for r, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if hi > lo:
                    first = lo + np.flatnonzero(np.append(True, pair[lo + 1 : hi] != pair[lo : hi - 1]))
                    small = times[lo:hi].astype("<u1" if times[lo:hi].max() < 256 else "<u4" if times[lo:hi].max() < 1 << 32 else "<u8")
                    row = (block, r, hi - lo, pair[first].view(np.int32), np.diff(np.append(first, hi)).astype(np.int32), where[lo:hi].astype("<u2").tobytes(), small.tobytes())
                    for column, x in zip(out.values(), row, strict=True):
                        column.append(x)
            return row_batch(pa.nulls(len(out["block"]), of_key), **out)

        for batch in batches:
            of_key = batch.column(0).type
            for lo, hi, data, offs in portions(*text_bytes(batch.column(1)), PORTION):
                for begin in range(lo, hi, BLOCK_DOCS):
                    stop = min(begin + BLOCK_DOCS, hi)
                    own = offs[begin - lo : stop - lo + 1]
                    numbers, digests, where, pair, times = aligner.align(data[own[0] : own[-1]], own - own[0])
                    if waiting and place + stop - begin > BLOCK_DOCS:
                        yield flush()
                        block, place, waiting = block + 1, 0, []
                    yield row_batch(batch.column(0).slice(begin, stop - begin), block=np.full(stop - begin, block), place=np.arange(place, place + stop - begin), groups_sha256=digests, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), numbers, strict=True)))
                    waiting.append((where + place, pair, times))
                    place += stop - begin
                    if sum(len(x) for _, x, _ in waiting) >= BLOCK_PAIRS:
                        yield flush()
                        block, place, waiting = block + 1, 0, []
        if waiting:
            yield flush()

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {FIELDS}")


def corpus_sums(blocks: DataFrame) -> DataFrame:
    """block, place, n_best, count_sum for each document with links."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("docs"))
    counts = kept(counts.withColumn("a", F.shiftrightunsigned("pair", 16)))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # one row for each id of A
    counts = counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    total = blocks.agg(F.sum(F.col("entries").cast("long"))).first()[0] or 0
    salts = max(1, int(total // (RANGES * GROUP_PAIRS)))
    counts = counts.withColumn("range", F.expr(f"cast((cast(pair as bigint) & 4294967295) % 65521 % {RANGES} as int)")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        pair, docs, best = (known.column(c).to_numpy() for c in ("pair", "docs", "best"))
        order = np.argsort(pair)
        pair, docs, best = pair[order], docs[order], best[order].astype(np.int64)
        out: list[tuple] = []
        for block, pairs, held, places, times in zip(*(own.column(c) for c in ("block", "pairs", "held", "places", "times")), strict=True):
            held, where = held.values.to_numpy(), np.frombuffer(places.as_buffer(), "<u2")
            raw = times.as_buffer()
            times = np.frombuffer(raw, f"<u{len(raw) // len(where)}").astype(np.int64)
            at = np.repeat(np.searchsorted(pair, pairs.values.to_numpy()), held)
            there, back = np.unique(where, return_inverse=True)
            sums = np.zeros((2, len(there)), np.int64)
            np.add.at(sums[0], back, times * best[at])
            np.add.at(sums[1], back, times * docs[at])
            out.append((block.as_py(), there.astype(np.int32), sums[0], sums[1]))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["block", "places", "best", "sums"])

    sums = rows.select("range", "salt", "block", "pairs", "held", "places", "times").groupBy("range", "salt").cogroup(counts.groupBy("range", "salt")).applyInArrow(run, "block long, places array<int>, best array<long>, sums array<long>")
    each = sums.select("block", F.explode(F.arrays_zip("places", "best", "sums")).alias("x"))
    return each.groupBy("block", F.col("x.places").alias("place")).agg(F.sum("x.best").alias("n_best"), F.sum("x.sums").alias("count_sum"))


def alignments(docs: DataFrame, a: str, b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    a is a byte-level BPE of the tokenizers library (special tokens' strings are plain text), b a model of sentencepiece
    that adds a space; ids of at most 16 bits. Offsets in bytes where a token of either ends cut a text's tokens into
    groups; each pair of A and B token occurrences in a group is a link. An id pair's count is the number of documents
    that hold it linked; n_best: links whose count is the highest of their A id, ties included; count_sum: over links.
    groups_sha256: of `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those whose tokens' bytes differ from the text with a space before it, have zeros and ''.
    Null and repeated keys: each row counts as a document. Very long texts are read whole, in one task. Empty table: no
    rows. Other columns are not read.
    """
    found = kept(aligned(docs, key, text, a, b))
    sums = corpus_sums(found.where("range is not null"))
    rows = found.where("place is not null").join(sums, ["block", "place"], "left")
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
