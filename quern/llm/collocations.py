"""Operator 12: phrases that occur more often than their parts let expect, for each language.

1. Words are told apart by 64-bit hashes whose seeds are drawn for the job. A first pass gathers all distinct words: where
   two words had one hash, the job would start anew with other seeds, so hashes stand for words without error.
2. Each position is a path: language, its word and up to three more of its piece. A shard's paths, sorted, become a
   weighted automaton: states by depth with the degree of each (so paths share beginnings), labels in an alphabet of the
   words that it has, and the number of occurrences at each end. It is cut at fixed paths, about one for IN_RANGE
   positions of the corpus (every so many of an even, sorted sample of paths), so hot words and pairs are spread, too.
3. The automata of a prefix range are united, and weights of equal paths summed. A state's weight, the sum below it, is
   the count of its phrase. A phrase whose paths a cut separates comes out of several ranges, and its counts are added.
4. Candidates are composed with all counts: each cut looks up the count of its first part and of the rest.

With more than FAN ranges, automata go to FAN wide ranges first, where those of some shards are united and then cut.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import discard, kept
from quern.llm.spans import LOWER, fresh_seeds, hash_runs, lean, portions, text_bytes, word_hashes

LONGEST = 4
"""Words of a phrase."""
DEPTH = LONGEST + 1
SHARD = 3 << 20
"""Bytes of text in a shard; a longer text is one of its own."""
IN_RANGE = 1 << 19
"""Positions in a range, about."""
STEP = 1 << 13
"""Every so many positions, a path is in the sample."""
FAN = 512
"""Ranges that a shard is cut into at most."""

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_INSIDE = ~_ENDS
_INSIDE[[32, 9]] = False

PACKED = "range int, turn int, alphabet binary, labels binary, degrees binary, weights binary"


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as the largest needs; the first byte says how many."""
    size = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * k)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _wide(x: pa.Scalar) -> np.ndarray:
    raw = x.as_buffer()
    return np.frombuffer(raw, f"<u{raw[0] if isinstance(raw[0], int) else raw[0][0]}", offset=1).astype(np.int64)


def ordered(paths: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of paths (numbers below size) in order, with the sum of their weights."""
    bits = np.int64(max(1, int(size).bit_length()))
    keys = [paths[:, 0].astype(np.int64)]
    for k in range(1, DEPTH):  # as many columns as fit into one key
        if (int(keys[-1].max(initial=0)) + 1).bit_length() + bits <= 63:
            keys[-1] <<= bits
            keys[-1] |= paths[:, k]
        else:
            keys.append(paths[:, k].astype(np.int64))
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = False
        for key in keys:
            key = key[order]
            first[1:] |= key[1:] != key[:-1]
    del keys
    at = np.flatnonzero(first)
    return paths[order[at]], np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def states(paths: np.ndarray) -> list[np.ndarray]:
    """Where, among sorted distinct paths, the states of each depth from 1 on begin."""
    new, found = np.zeros(len(paths), bool), []
    new[:1] = True
    for k in range(DEPTH):
        new[1:] |= paths[1:, k] != paths[:-1, k]
        found.append(np.flatnonzero(new))
    return found


def packed(alphabet: np.ndarray, paths: np.ndarray, weights: np.ndarray) -> tuple[bytes, ...]:
    """The automaton of sorted distinct paths (rows of numbers in the alphabet): alphabet, labels, degrees, weights."""
    used = np.zeros(len(alphabet), bool)
    used[paths] = True
    paths, alphabet = (np.cumsum(used) - 1).astype(np.uint32)[paths], alphabet[used]
    starts = states(paths)
    degrees = [np.diff(np.searchsorted(below, np.append(own, len(paths)))) for own, below in zip(starts, starts[1:], strict=False)]
    labels = np.concatenate([[len(starts[0])], *(paths[own, k] for k, own in enumerate(starts))])
    return alphabet.astype("<i8").tobytes(), _small(labels), _small(np.concatenate(degrees)), _small(weights)


def unpacked(alphabet: pa.Scalar, labels: pa.Scalar, degrees: pa.Scalar, weights: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alphabet, paths and weights of an automaton."""
    labels, degrees, weights = _wide(labels), _wide(degrees), _wide(weights)
    n, labels, paths = int(labels[0]), labels[1:], np.zeros((len(weights), DEPTH), np.uint32)
    below = np.arange(len(weights))
    levels, at, of = [], 0, 0
    for k in range(DEPTH):
        levels.append((labels[at : at + n], degrees[of : of + n] if k < DEPTH - 1 else None))
        at, of = at + n, of + n
        n = int(levels[-1][1].sum()) if k < DEPTH - 1 else 0
    for k in range(DEPTH - 1, -1, -1):  # below: the state of depth k + 1 that each path goes through
        own, degree = levels[k]
        if degree is not None:
            below = np.repeat(np.arange(len(own)), degree)[below]
        paths[:, k] = own[below]
    return np.frombuffer(alphabet.as_buffer(), "<i8"), paths, weights


def union(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One automaton of several: alphabet, sorted paths, summed weights."""
    parts = [unpacked(*row) for row in zip(*(table.column(c) for c in ("alphabet", "labels", "degrees", "weights")), strict=True)]
    alphabet = np.unique(np.concatenate([x for x, _, _ in parts]))
    paths = np.concatenate([np.searchsorted(alphabet, x).astype(np.uint32)[p] for x, p, _ in parts])
    paths, weights = ordered(paths, np.concatenate([w for _, _, w in parts]), len(alphabet))
    return alphabet, paths, weights


def cut(alphabet: np.ndarray, paths: np.ndarray, weights: np.ndarray, cuts: list[tuple[int, ...]], first: int, turn: int) -> pa.RecordBatch:
    """Rows of PACKED: the automaton cut before each of the paths in cuts; ranges count from first."""
    path = lambda k: tuple(alphabet[paths[k]].tolist())
    at = [0, *(bisect_left(range(len(paths)), c, key=path) for c in cuts), len(paths)]
    rows = [(first + k, turn, *packed(alphabet, paths[lo:hi], weights[lo:hi])) for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)) if hi > lo]
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])


def shards(batches: Iterator[pa.RecordBatch], seeds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each shard: bytes, where words start and their texts end, an alphabet, a path of numbers in it for each word; languages, their hashes."""
    for batch in batches:
        names = batch.column(1).dictionary_encode()
        raw, at = text_bytes(names.dictionary)
        langs = hash_runs(raw, at[:-1], at[1:], seeds).view(np.int64)
        lang = names.indices.to_numpy()
        for lo, hi, data, offs in portions(*text_bytes(batch.column(0)), SHARD):
            words, text, starts = word_hashes(data, offs, _INSIDE, seeds)
            words = words.view(np.int64)
            words[words == 0] = 1  # 0 ends a path; a second word with 1 would be a clash
            stops = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
            together = (text[1:] == text[:-1]) & (stops[1:] == stops[:-1])  # a word and the next one
            near = together.copy()
            known, number = np.unique(words, return_inverse=True)
            alphabet = np.unique(np.concatenate([known, langs, [0]]))
            paths = np.full((len(words), DEPTH), np.searchsorted(alphabet, 0), np.uint32)
            paths[:, 0], paths[:, 1] = np.searchsorted(alphabet, langs)[lang[lo:hi][text]], np.searchsorted(alphabet, known)[number]
            for k in range(2, DEPTH):  # near: the next word is of the same piece
                n = max(len(words) - k + 1, 0)
                near[:n] = near[:n] & together[k - 2 : k - 2 + n]
                paths[:n, k] = np.where(near[:n], paths[k - 1 : k - 1 + n, 1], paths[0, k] if len(paths) else 0)
            yield data, starts, offs[text + 1], alphabet, paths, names.dictionary, langs


def _lower(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of bytes, with A-Z as a-z, as strings."""
    sizes = ends - starts
    stops = np.append(0, np.cumsum(sizes))
    raw = LOWER[data[np.repeat(starts - stops[:-1], sizes) + np.arange(stops[-1])]]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


def vocabulary(rows: DataFrame, seeds: np.ndarray) -> DataFrame:
    """kind, hash, word, n, path: distinct words of shards (kind 0), languages with their words (1), sampled paths (2)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = STEP // 2
        for data, starts, stops, alphabet, paths, names, langs in shards(batches, seeds):
            known, at = np.unique(paths[:, 1], return_index=True)
            known = alphabet[known]
            gap = np.append(np.flatnonzero(~_INSIDE[data]), len(data))
            ends = np.minimum(gap[np.searchsorted(gap, starts[at])], stops[at])
            own, n = np.unique(paths[:, 0], return_counts=True)
            own = alphabet[own]
            place = {h: k for k, h in enumerate(langs.tolist())}
            sample = alphabet[paths[ahead::STEP]]
            ahead = (ahead - len(paths)) % STEP
            sizes = [len(known), len(own), len(sample)]
            kind = np.repeat(np.arange(3, dtype=np.int32), sizes)
            hashes = np.concatenate([known, own, np.zeros(len(sample), np.int64)])
            words = pa.concat_arrays([_lower(data, starts[at], ends), names.take(pa.array([place[h] for h in own.tolist()], pa.int64())).cast(pa.string()), pa.nulls(len(sample), pa.string())])
            path = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(sizes[0] + sizes[1], np.int32), np.arange(len(sample) + 1, dtype=np.int32) * DEPTH)), pa.array(sample.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(hashes), words, pa.array(np.concatenate([np.zeros(len(known), np.int64), n, np.zeros(len(sample), np.int64)])), path], ["kind", "hash", "word", "n", "path"])

    return rows.mapInArrow(run, "kind int, hash long, word string, n long, path array<long>")


def cutting(sample: DataFrame, every: int) -> list[tuple[int, ...]]:
    """Every so manieth path of a sample in order: one row for each range comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = every // 2
        for batch in batches:
            yield batch.take(pa.array(np.arange(ahead, batch.num_rows, every)))
            ahead = (ahead - batch.num_rows) % every

    parts = max(1, sample.count() // (64 * every))
    rows = sample.select("path").repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(run, "path array<long>")
    return sorted({tuple(r[0]) for r in rows.collect()})


def counts(rows: DataFrame, seeds: np.ndarray, cuts: list[tuple[int, ...]], positions: int, least: int) -> DataFrame:
    """lang (hash), words (hashes), f for all phrases of up to LONGEST words with f >= least."""
    wide = cuts if len(cuts) < FAN else [cuts[k * len(cuts) // FAN] for k in range(1, FAN)]
    turns = 1 if wide is cuts else max(1, positions // FAN // IN_RANGE)
    place = [0, *(bisect_left(cuts, c) for c in wide), len(cuts)]

    @lean
    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (_, _, _, alphabet, paths, _, _) in enumerate(shards(batches, seeds)):
            paths, weights = ordered(paths, np.ones(len(paths), np.int64), len(alphabet))
            yield cut(alphabet, paths, weights, wide, 0, number % turns)

    def cut_again(table: pa.Table) -> pa.Table:
        k = table.column("range")[0].as_py()
        first = place[k] + (k > 0)
        return pa.Table.from_batches([cut(*union(table), cuts[first : place[k + 1]], first, 0)])

    def summed(table: pa.Table) -> pa.Table:
        k = table.column("range")[0].as_py()
        alphabet, paths, weights = union(table)
        edges = [np.array(c) for c in cuts[max(k - 1, 0) : k + 1]]  # the paths that this range begins with and ends before
        found: list[tuple[np.ndarray, ...]] = []
        for depth, starts in enumerate(states(paths)):
            if depth == 0:
                continue
            own = alphabet[paths[starts, : depth + 1]]
            f = np.add.reduceat(weights, starts) if len(starts) else weights[:0]
            partial = np.zeros(len(starts), bool)
            for edge in edges:
                partial |= (own == edge[: depth + 1]).all(1)
            keep = np.flatnonzero((own[:, depth] != 0) & ((f >= least) | partial))
            found.append((own[keep, 0], own[keep, 1:], f[keep]))
        lists = [x for _, w, _ in found for x in w]
        pa.default_memory_pool().release_unused()
        return pa.table({"lang": np.concatenate([x for x, _, _ in found]), "words": pa.array(lists, pa.list_(pa.int64())), "f": np.concatenate([f for _, _, f in found])})

    packs = rows.mapInArrow(sharded, PACKED)
    if wide is not cuts:
        packs = packs.groupBy("range", "turn").applyInArrow(cut_again, PACKED)
    phrases = packs.groupBy("range").applyInArrow(summed, "lang long, words array<long>, f long")
    return phrases.groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(known: DataFrame) -> DataFrame:
    """lang, words, a, k, l, r, score of each phrase of two words or more, by its lowest-scoring cut."""
    phrases = known.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    cuts = cuts.join(known.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "a", "cut.*")


def outside(phrases: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Without the phrases that a longer one holds in its words and that has at least percent of their count."""
    n = F.size("words")
    longer = known.where(n > 2).select("lang", "words", "f", F.explode(F.sequence(F.lit(2), n - 1)).alias("size"))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("size") + 1)))
    held = longer.groupBy("lang", F.slice("words", F.col("at"), F.col("size")).alias("words")).agg(F.max("f").alias("most"))
    wide = lambda x, by: F.col(x).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
    return phrases.join(held, ["lang", "words"], "left").where(F.col("most").isNull() | (wide("most", 100) < wide("a", percent))).drop("most")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, percent: int = 80, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    Texts have A-Z as a-z, and are split at [.,;:!?\\n-\\r] into pieces and those at spaces and tabs into words. Phrases of
    2 to 4 words with a >= least occurrences; l and r are the counts of the parts of the cut that has the lowest
    floor(2000000 a / (l + r)), n all words of the language. Phrases that a longer one with percent of their count holds
    are dropped. Order: score, a, then the phrase.

    Null or empty text: no words. Null lang: "und", together with rows that say so. Ties are broken by the phrase, so
    ranks are total; repeated rows count each time; very long texts and words are read whole (a text is in one task).
    Empty table: no rows. Other columns are not read. Hashes and ranges differ between runs, the result does not.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    for again in range(9):
        seeds = fresh_seeds()
        found = kept(vocabulary(rows, seeds))
        names = kept(found.where("kind < 2").select("kind", "hash", "word").distinct())
        if names.groupBy("kind", "hash").count().where("count > 1").isEmpty():
            break
        discard(found, names)
        if again == 8:
            raise ArithmeticError("words with equal hashes under nine draws of seeds")
    langs = kept(found.where("kind = 1").groupBy(F.col("hash").alias("lang"), F.col("word").alias("name")).agg(F.sum("n").alias("n")))
    positions = langs.agg(F.sum("n")).first()[0] or 0
    ranges = -(-positions // IN_RANGE)
    cuts = cutting(found.where("kind = 2"), max(1, IN_RANGE // STEP)) if ranges > 1 else []
    known = kept(counts(rows, seeds, cuts, positions, least))
    discard(found)
    best = outside(scored(known), known, percent)
    order = [F.desc("score"), F.desc("a")]
    best = best.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first).drop("rank")
    best = kept(best.withColumn("id", F.monotonically_increasing_id()))
    spelt = best.select("id", F.posexplode("words").alias("at", "hash")).join(names.where("kind = 0").select("hash", "word"), "hash")
    spelt = spelt.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    best = best.join(spelt, "id").join(langs, "lang").withColumn("phrase", F.array_join("spelt.word", " "))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= first)
    return best.select(F.col("name").alias(lang), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
