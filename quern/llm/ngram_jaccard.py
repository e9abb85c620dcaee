"""Operator 7: texts whose word n-gram sets have a Jaccard similarity of at least a threshold, and their components.

1. Every text becomes its set of n-gram hashes. Texts with the same set are one class, told by two 64-bit digests of the
   set that come from two word hashes; their seeds are drawn for the job, so that no text can be written to meet another.
   From here on classes are joined, not texts. Different sets below a size (of 80 %: four) can't be similar, so classes
   of few n-grams have no partner; larger ones must share several, each told apart by 48 bits at least.
2. n-grams are dealt by hash to count, for each, the classes that have it. One that no other class has can't take part
   in an overlap: it only counts as unshared. n-grams with their counts go back to their classes. An n-gram that many
   classes of one load have is combined there: only its number goes to be counted, and its classes wait elsewhere, load
   by load, until its count joins them. So nobody holds the whole list of a frequent n-gram.
3. Rare first: unshared n-grams, then the others by (count, hash). With n n-grams of which at least c = ceil(t n) must be
   shared, a partner shares one of the first n - c + 1 (the prefix). A class whose unshared n-grams fill the prefix has
   no partner, and is done; most are.
4. Classes are joined on the n-grams of their prefixes, with the length filter, the positional filter and the suffix
   filter (here: sizes in fixed ranges of the order of hashes, whose differences bound the overlap), each pair of
   classes once, and what is left is verified on the sets.
5. Where thousands of near copies share an n-gram, pairs are not listed at once. A round joins each list's members with
   a few leaders only; what is now connected needs no further pair. When the pairs between different components are few
   enough, or rounds find few links, they are all joined, so no link between components is lost. Long lists are salted:
   each of their rows stands in one of several groups, and what it is joined with in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import discard, kept
from quern.llm.spans import fresh_seeds, lean, mix, portions, set_digests, shingles, text_bytes

FLUSH = 2 << 20
"""n-grams a task gathers before it deals them out, at least; more where there are so many buckets that each gets few."""
OFTEN = 16
"""Classes of one load that make an n-gram combined there."""
SPREAD = 256
"""Rows of a list, about, in each of its groups."""
IN_BUCKET = 3 << 20
"""n-grams in a bucket, about (8 bytes each; a task holds one bucket)."""
RANGES = 64
"""Ranges of the suffix filter."""
ROUNDS, LEADERS, LINEAR = 3, 8, 2
"""Rounds with leaders at most; leaders of a list; pairs for each row of the join that are few enough to list all."""
HEAD = 64
"""n-grams of a prefix that a row brings along, so that a pair is made once."""
YIELD = 0.05
"""A round of which fewer pairs than this share are links is the last with leaders."""


def sets_of(docs: DataFrame, key: str, text: str, width: int, seeds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, n (size of the set), class and check (digests of the set by either seeds, null if it is empty) for each row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            n, digests = [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)]
            for _, _, part, starts in portions(data, offs):
                lanes = [shingles(part, starts, width, own) for own in seeds]
                n.append(np.diff(lanes[0][1]))
                digests.append(np.stack([set_digests(*lane)[k] for k, lane in enumerate(lanes)]))
            size, lanes = np.concatenate(n), np.concatenate(digests, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *(pa.array(lane, mask=size == 0) for lane in lanes)], ["key", "n", "class", "check"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n long, class long, check long")


def clash(members: DataFrame) -> bool:
    """Whether different sets have one class: the first digest is the same, the second is not."""
    both = members.where("class is not null").groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    return not both.where("low <> high").isEmpty()


def _packed(columns: list[list[bytes] | list[int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "bucket" else pa.int64() if n in ("load", "gram", "often") else pa.binary()) for n, c in zip(names, columns, strict=True)], names)


def _stretches(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal keys starts and ends."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return zip(cuts.tolist(), np.append(cuts, len(keys))[1:].tolist(), strict=True)


def _joined(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in table.column(name)), dtype)


def dealt(docs: DataFrame, text: str, width: int, bits: int, seeds: np.ndarray) -> DataFrame:
    """n-grams (48 bits of their hash) by bucket, packed: low and high part, and the classes they are of.

    Rows with a gram: one that OFTEN classes of a load have. Its own bucket gets how many (often); the classes are in a
    row of any bucket.
    """
    names = ["bucket", "low", "high", "of", "classes", "sizes", "load", "gram", "often"]
    gather, often = max(FLUSH, 2 << bits), OFTEN

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, np.ndarray] = {}
        count, load = 0, TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            classes, sizes = np.array([*waiting], np.int64), np.array([len(x) for x in waiting.values()], np.int64)
            grams, of = np.concatenate([*waiting.values()]), np.repeat(np.arange(len(classes), dtype=np.uint32), sizes)
            order = np.argsort(grams, kind="stable")  # by bucket too, which is the first bits
            grams, of, columns = grams[order], of[order], [[] for _ in names]
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            times = np.diff(np.append(first, len(grams)))
            for k in np.flatnonzero(times >= often):
                own, gram = of[first[k] : first[k] + times[k]], int(grams[first[k]])
                there = int(mix(np.array([gram ^ load], np.uint64))[0]) >> (64 - bits) if bits else 0
                rows = ((gram >> (48 - bits), None, None, None, None, None, load, gram, int(times[k])), (there, None, None, None, classes[own].tobytes(), sizes[own].astype("<u4").tobytes(), load, gram, None))
                for row in rows:
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
            keep = np.repeat(times < often, times)
            grams, of = grams[keep], of[keep]
            bucket = (grams >> np.uint64(48 - bits)).astype(np.uint32)
            for lo, hi in _stretches(bucket):
                part = grams[lo:hi]
                there, at = np.unique(of[lo:hi], return_inverse=True)
                row = (int(bucket[lo]), part.astype("<u4").tobytes(), (part >> np.uint64(32)).astype("<u2").tobytes(), at.astype("<u4" if len(there) > 1 << 16 else "<u2").tobytes(), classes[there].tobytes(), sizes[there].astype("<u4").tobytes(), load, None, None)
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            return _packed(columns, names)

        for batch in batches:
            for _, _, part, starts in portions(*text_bytes(batch.column(0))):
                hashes, ends = shingles(part, starts, width, seeds)
                digests = set_digests(hashes, ends)[0]
                for digest, lo, hi in zip(digests.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if hi > lo and digest not in waiting:
                        # a text's own n-grams are told apart by 64 bits; two of them may have the same 48
                        waiting[digest] = hashes[lo:hi] >> np.uint64(16)
                        count += hi - lo
                if count >= gather:
                    yield flush()
                    waiting, count, load = {}, 0, load + 1
        if waiting:
            yield flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, low binary, high binary, of binary, classes binary, sizes binary, load long, gram long, often long")


REPLY = ["bucket", "classes", "sizes", "counts", "low", "high", "df", "load", "gram", "often"]
REPLIES = "bucket int, classes binary, sizes binary, counts binary, low binary, high binary, df binary, load long, gram long, often long"


def replies(owner: np.ndarray, size: np.ndarray, gram: np.ndarray, df: np.ndarray, bits: int) -> list[list]:
    """Columns of REPLY: n-grams with their counts, by the bucket of the class that has them."""
    columns = [[] for _ in REPLY]
    to = mix(owner.view(np.uint64)) >> np.uint64(64 - bits) if bits else np.zeros(len(owner), np.uint64)
    order = np.lexsort((owner, to))
    gram, owner, size, df, to = gram[order], owner[order], size[order], df[order], to[order]
    for lo, hi in _stretches(to):
        there, at, n = np.unique(owner[lo:hi], return_index=True, return_counts=True)
        row = (int(to[lo]), there.tobytes(), size[lo:hi][at].astype("<u4").tobytes(), n.astype("<u4").tobytes(), gram[lo:hi].astype("<u4").tobytes(), (gram[lo:hi] >> np.uint64(32)).astype("<u2").tobytes(), df[lo:hi].astype("<u2").tobytes(), None, None, None)
        for column, x in zip(columns, row, strict=True):
            column.append(x)
    return columns


def shared(rows: DataFrame, bits: int) -> DataFrame:
    """Of each bucket, the n-grams of two classes or more, with their number of classes, dealt by class (REPLY).

    For each combined n-gram and load: the number of its classes (df), and, apart, the classes of the load.
    """

    def run(table: pa.Table) -> pa.Table:
        often = table.filter(table.column("often").is_valid())
        waiting = table.filter(pc.and_(table.column("gram").is_valid(), table.column("often").is_null()))
        table = table.filter(table.column("gram").is_null())
        gram = _joined(table, "low", "<u4").astype(np.uint64) | _joined(table, "high", "<u2").astype(np.uint64) << np.uint64(32)
        owners, sizes, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [len(x.as_buffer()) // 4 for x in table.column("low")]
        for of, classes, size, n in zip(table.column("of"), table.column("classes"), table.column("sizes"), lengths, strict=True):
            raw = of.as_buffer()
            at = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
            owners.append(np.frombuffer(classes.as_buffer(), "<i8")[at])
            sizes.append(np.frombuffer(size.as_buffer(), "<u4")[at])
        owner, size = np.concatenate(owners), np.concatenate(sizes)
        hot, loads, numbers = (often.column(c).to_numpy() for c in ("gram", "load", "often"))
        many, back = np.unique(hot.view(np.uint64), return_inverse=True)
        order = np.argsort(gram)
        same = gram[order][1:] == gram[order][:-1]
        order = order[np.append(same, False) | np.append(False, same) | np.isin(gram[order], many)] if len(gram) else order
        order = order[np.lexsort((owner[order], gram[order]))]
        gram, owner, size = gram[order], owner[order], size[order]
        if len(gram):  # a class that several tasks sent counts once
            first = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))
            gram, owner, size = gram[first], owner[first], size[first]
        every, at = np.unique(np.append(gram, many), return_inverse=True)
        df = np.bincount(at[: len(gram)], minlength=len(every)) + np.bincount(at[len(gram) :], np.bincount(back, numbers, len(many)), len(every)).astype(np.int64)
        df = np.minimum(df, 65535)
        keep = df[at[: len(gram)]] >= 2
        columns = replies(owner[keep], size[keep], gram[keep], df[at[: len(gram)]][keep], bits)
        for k in range(len(hot)):
            row = (None, None, None, None, None, None, None, int(loads[k]), int(hot[k]), int(df[at[len(gram) + back[k]]]))
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        for load, one, classes, size in zip(*(waiting.column(c).to_pylist() for c in ("load", "gram", "classes", "sizes")), strict=True):
            for column, x in zip(columns, (None, classes, size, None, None, None, None, load, one, None), strict=True):
                column.append(x)
        return pa.Table.from_batches([_packed(columns, REPLY)])

    return rows.groupBy("bucket").applyInArrow(run, REPLIES)


def rejoined(answers: DataFrame, bits: int) -> DataFrame:
    """All n-grams by the bucket of their class: the combined ones once their counts have joined their loads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("classes")]
            n = [len(x) for x in owners]
            gram, df = (np.repeat(batch.column(c).to_numpy(), n) for c in ("gram", "often"))
            size = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("sizes"))])
            yield _packed(replies(np.concatenate([np.zeros(0, np.int64), *owners]), size, gram.view(np.uint64), df, bits), REPLY)

    numbers = answers.where("often is not null").select("load", "gram", "often")
    waiting = answers.where("gram is not null and often is null").select("load", "gram", "classes", "sizes")
    packed = waiting.join(numbers, ["load", "gram"]).select("gram", "often", "classes", "sizes").mapInArrow(run, REPLIES)
    return answers.where("bucket is not null").union(packed)


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Classes that can have a partner: class, n, unshared, grams (shared ones, rarest first), ranges (their numbers)."""

    def run(table: pa.Table) -> pa.Table:
        gram = _joined(table, "low", "<u4").astype(np.uint64) | _joined(table, "high", "<u2").astype(np.uint64) << np.uint64(32)
        counts = _joined(table, "counts", "<u4")
        owner, size = np.repeat(_joined(table, "classes", "<i8"), counts), np.repeat(_joined(table, "sizes", "<u4"), counts)
        order = np.lexsort((gram, _joined(table, "df", "<u2"), owner))
        order = order[np.append(True, (gram[order][1:] != gram[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(order)]]  # several loads may have sent one
        gram, owner, size = gram[order].view(np.int64), owner[order], size[order].astype(np.int64)
        classes, first, counts = np.unique(owner, return_index=True, return_counts=True)
        n = size[first]
        keep = np.flatnonzero((n - counts < n - -(-percent * n // 100) + 1) & (n >= least_size(percent)))
        out = [gram[first[k] : first[k] + counts[k]] for k in keep]
        ranges = [np.bincount(x // ((1 << 48) // RANGES), minlength=RANGES).astype(np.int32) for x in out]
        lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))
        return pa.table({"class": classes[keep], "n": n[keep], "unshared": (n - counts)[keep], "grams": lists(out, np.int64), "ranges": lists(ranges, np.int32)})

    return rows.groupBy("bucket").applyInArrow(run, "class long, n long, unshared long, grams array<long>, ranges array<int>")


def least_size(percent: int) -> float:
    """The size from which on a set can be similar to another: one n-gram more or less must leave the threshold."""
    return percent / (100 - percent) if percent < 100 else float("inf")


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest overlap of sets of n and m that makes their similarity reach the threshold."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold: suffix filter, then the sets themselves."""
    side = lambda k, *cols: sets.select(F.col("class").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))
    near = pairs.join(side("a", "n", "ranges"), "a").join(side("b", "n", "ranges"), "b")
    most = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = near.where(most >= least_overlap(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")
    both = near.join(side("a", "grams"), "a").join(side("b", "grams"), "b").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
    # of different sets of one size, at least one n-gram is not shared, whatever its 48 bits say
    both = both.withColumn("common", F.least("common", F.when(F.col("n_a") == F.col("n_b"), F.col("n_a") - 1).otherwise(F.least("n_a", "n_b"))))
    return both.where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def passing(x: str, y: str, percent: int) -> Column:
    """The length filter, and the positional filter for two rows (columns ending in x and y) that share an n-gram.

    Of what stands before that n-gram only shared n-grams can be in both sets.
    """
    of = lambda name: (F.col(name + x), F.col(name + y))
    (n, m), (i, j), (u, v) = of("n"), of("at"), of("unshared")
    most = F.least(i - u, j - v) + F.least(n - i, m - j)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most >= least_overlap(n, m, percent))


def similar(sets: DataFrame, percent: int) -> DataFrame | None:
    """node, root for the classes that are linked, directly or not; None if no two share an n-gram of their prefixes."""
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    step = F.floor(F.log(F.col("n")) / float(np.log(100 / percent))).cast("int")  # sets of the same step pass the length filter
    own = ("class", "n", "unshared", "step", "at")
    posts = sets.select("class", "n", "unshared", step.alias("step"), F.posexplode(F.slice("grams", F.lit(1), (prefix - F.col("unshared")).cast("int"))).alias("i", "gram"))
    posts = posts.select("gram", *own[:-1], (F.col("unshared") + F.col("i")).alias("at"))
    lists = posts.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1").select("gram")
    posts = kept(posts.join(lists, "gram"))
    labels, links, tried, last = None, None, None, False
    for turn in range(ROUNDS + 1):
        now = posts.withColumn("part", F.col("class")) if labels is None else posts.join(labels.toDF("class", "root"), "class", "left").select(*posts.columns, F.coalesce("root", "class").alias("part"))
        parts = now.groupBy("gram", "part").agg(F.count("*").alias("k")).groupBy("gram").agg(F.sum("k").alias("rows"), (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("cross")).where("cross > 0")
        parts = kept(parts)
        rows, cross = parts.agg(F.sum("rows"), F.sum("cross") / 2).first()
        if not rows:
            discard(parts)
            break
        now = kept(now.join(parts.select("gram", (F.floor(F.col("rows") / SPREAD) + 1).cast("int").alias("salts")), "gram"))
        last = last or turn == ROUNDS or cross <= LINEAR * rows
        mine = F.pmod(F.xxhash64("class", F.lit(turn)), F.col("salts")).cast("int").alias("salt")
        salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        if last:
            # a pair that shares an earlier n-gram among the first HEAD is left to that one
            heads = sets.select("class", F.slice("grams", 1, HEAD).alias("head"))
            earlier = F.slice("head", F.lit(1), F.least(F.col("at") - F.col("unshared"), F.lit(HEAD)).cast("int"))
            now, before = kept(now.join(heads, "class").select("gram", "salts", *own, "part", earlier.alias("earlier"))), now
            discard(before)
            columns = lambda k: (F.col(c).alias(f"{c}_{k}") for c in (*own, "part", "earlier") if c != "step")
            x = now.select("gram", "step", mine, *columns("x"))
            y = now.select("gram", "salts", F.explode(F.array(*(F.col("step") + d for d in (-1, 0, 1)))).alias("step"), *columns("y"))
            y = y.select("gram", "step", salt, *(c for c in y.columns if c not in ("gram", "step", "salts")))
            pairs = x.join(y, ["gram", "step", "salt"]).where("class_x < class_y and part_x <> part_y").where(~F.arrays_overlap("earlier_x", "earlier_y"))
        else:
            # at first those with the least unshared n-grams lead, as an original among its edited copies has
            by = F.col("unshared") / F.col("n") if labels is None else F.xxhash64("class", F.lit(turn)) / F.lit(2.0**63)
            leaders = now.select("gram", "salts", "step", "part", F.struct(by.alias("by"), *(F.col(c).alias(f"{c}_y") for c in (*own, "part"))).alias("l"))
            if labels is not None:  # one of each component; at first each class is one
                leaders = leaders.groupBy("gram", "salts", "step", "part").agg(F.min("l").alias("l"))
            # components draw one of LEADERS places, and each place has one leader
            place = F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(LEADERS)).alias("place")
            leaders = leaders.groupBy("gram", "salts", "step", place).agg(F.min("l").alias("l"))
            leaders = leaders.select("gram", "step", salt, *(f"l.{c}_y" for c in (*own, "part") if c != "step"))
            pairs = now.select("gram", "step", mine, *(F.col(c).alias(f"{c}_x") for c in (*own, "part") if c != "step")).join(leaders, ["gram", "step", "salt"]).where("part_x <> part_y")
        pairs = pairs.where(passing("_x", "_y", percent)).select(F.least("class_x", "class_y").alias("a"), F.greatest("class_x", "class_y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = kept(pairs)
        found = kept(verified(pairs, sets, percent))
        discard(now, parts)
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        labels = components(links)
        if last:
            break
        last = found.count() < YIELD * pairs.count()
    return labels


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: key, n_shingles, class (equal sets; null if empty), component_id.

    Words are runs of bytes other than ASCII white space, with A-Z as a-z; a set has the distinct runs of width words
    (with fewer words, all as one). Rows link where 100 |x & y| >= percent |x | y|; component_id is the smallest key
    that links reach. Sets are told apart by 128 bits of keyed hashes, n-grams within a text by 64, across sets by 48.

    Null or empty text, or only white space: n_shingles 0, linked with nothing, component_id its own key. Null keys take
    part, but are no component's smallest. Repeated rows: one component. Very long texts are read whole, and a word of
    any length is one word; a text's own n-grams are in one task. Empty table: no rows. Other columns are not read.
    How many buckets there are, and how many rounds with leaders, depends on the data; the result does not.
    """
    for again in range(9):
        seeds = fresh_seeds(), fresh_seeds()
        members = kept(sets_of(docs, key, text, width, seeds))
        if not clash(members):
            break
        discard(members)
        if again == 8:
            raise ArithmeticError("sets with equal digests under nine draws of seeds")
    total = members.agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(total // IN_BUCKET).bit_length())
    answers = kept(shared(dealt(docs, text, width, bits, seeds[0]), bits))
    sets = kept(candidates(rejoined(answers, bits), percent))
    discard(answers)
    labels = similar(sets, percent)
    classes = members.where("class is not null").groupBy("class").agg(F.min("key").alias("low"))
    if labels is not None:
        classes = classes.join(labels.toDF("class", "root"), "class", "left").select("class", "low", F.coalesce("root", "class").alias("root"))
        lows = classes.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
        classes = classes.join(lows, "root").select("class", F.col("least").alias("low"))
    classes = kept(classes)
    return members.join(classes, "class", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "class", F.coalesce("low", "key").alias("component_id"))
