"""Searches of query blocks over shards of vectors, with the best scores so far shared between shards."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import kept

PER_SHARD, PER_BLOCK, LANE = 4096, 2048, 4
"""Vectors in a shard, queries in a block, and shards of a ball that one task searches one after another, about."""
BALLS, SAMPLE = 64, 4096
"""Balls at most, and vectors that their centers are found from, at most."""


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(raw: pa.Scalar) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw.as_buffer().to_pybytes())) as found:
        return {k: found[k] for k in found.files}


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and their vectors; wholly equal rows once."""
    ids, lists = table.column("id").to_numpy(), table.column("vector").combine_chunks()
    x = lists.flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1))[: len(ids)]
    return ids[new], x[new]


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector divided by its largest absolute component, and that; so squares neither overflow nor vanish."""
    most = np.abs(x).max(1, initial=0.0).astype(float)
    return x / np.where(most > 0, most, 1.0)[:, None], most


def directed(x: np.ndarray) -> np.ndarray:
    """Each vector as one of length 1; zeros stay."""
    y, _ = scaled(x)
    return y / np.maximum(np.sqrt((y * y).sum(1)), 1e-300)[:, None]


def centers_of(x: np.ndarray, k: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """k directions round which the sample lies (k-means)."""
    y = directed(x)
    centers = y[np.random.default_rng(seed).choice(len(y), min(k, len(y)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(y @ centers.T, 1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, y)
        centers = directed(np.where(np.abs(sums).sum(1, keepdims=True) > 0, sums, centers))
    return centers


class Best:
    """The k best (score, least id first) of each query of a block so far, and a floor that any new one must reach."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.queries, self.floor = queries, floor.copy()
        self.low = -np.inf if floor.dtype.kind == "f" else -(2**63 - 1)
        self.scores, self.ids = np.full((len(queries), k), self.low, floor.dtype), np.full((len(queries), k), 2**63 - 1)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of the queries in rows, a column for each of ids."""
        scores = np.where(ids[None, :] == self.queries[rows][:, None], self.low, scores)
        hit = ((scores >= self.floor[rows][:, None]) & (scores > self.low)).any(1)
        if not hit.any():
            return
        rows = rows[hit]
        s = np.concatenate([self.scores[rows], scores[hit]], 1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])

    def rows(self) -> pa.Table:
        q, at = np.nonzero((self.scores > self.low) & (self.scores >= self.floor[:, None]))
        return pa.table({"query": self.queries[q], "id": self.ids[q, at], "score": self.scores[q, at]})


Build = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]
Scan = Callable[[dict[str, np.ndarray], np.ndarray, Best], None]


def balls(vectors: DataFrame, number: int) -> dict[int, np.ndarray]:
    """For each length of vectors, centers of up to BALLS balls, from the SAMPLE vectors that come first by a hash."""
    some = vectors.select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(SAMPLE).toArrow()
    by_dim: dict[int, list] = {}
    for x in some.column("vector"):
        by_dim.setdefault(len(x), []).append(x.values.to_numpy(zero_copy_only=False).astype(float))
    return {dim: centers_of(np.array(rows), min(BALLS, number)) for dim, rows in by_dim.items()}


def in_balls(rows: DataFrame, centers: dict[int, np.ndarray], element: str) -> DataFrame:
    """id, vector, dim, ball (that of the nearest center; 0 where the length has none)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            ball = np.zeros(len(batch), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                if dim in centers:
                    ball[at] = np.argmax(directed(x) @ centers[dim].T, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(dims.astype(np.int32)), pa.array(ball)], ["id", "vector", "dim", "ball"])

    return rows.select("id", "vector").mapInArrow(run, f"id long, vector array<{element}>, dim int, ball int")


def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Numbers each ball's rows into parts of about size, by a hash of id and vector, so that a frequent id or vector is spread."""
    parts = rows.groupBy("dim", "ball").agg((F.floor((F.count("*") - 1) / size) + 1).alias("parts"))
    return rows.join(parts, ["dim", "ball"]).withColumn(name, F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int")).drop("parts")


def reachable(bounds: dict[int, tuple[np.ndarray, ...]], dim: int, q: np.ndarray, floor: np.ndarray) -> list[int]:
    """Balls that may hold an inner product of at least floor for some query.

    bounds: for each length, the balls' numbers, and center, radius and largest component of their vectors (center and
    radius are of vectors divided by that component).
    """
    numbers, centers, radii, tops = bounds[dim]
    own, most = scaled(q)
    length = np.sqrt((own * own).sum(1))
    with np.errstate(over="ignore", invalid="ignore"):
        most_ball = own @ centers.T + length[:, None] * radii
        limit = (most_ball + np.abs(most_ball) * 1e-9 + 1e-6 * length[:, None]) * most[:, None] * tops  # rounding never hides a ball
        hit = ~(limit < floor.astype(float)[:, None]) | (floor == (-np.inf if floor.dtype.kind == "f" else -(2**63 - 1)))[:, None]
    return numbers[hit.any(0)].tolist()


def anew(df: DataFrame) -> DataFrame:
    """The same columns as new ones, so that both sides of a cogroup may come from one table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def search(vectors: DataFrame, queries: DataFrame, k: int, build: Build, scan: Scan, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors for each query, of those that scan() finds.

    vectors and queries have id (long) and vector (array of one type); only vectors of a query's own length are
    comparable. Vectors lie in balls (of directions; as many as there are full blocks of queries, BALLS at most), and a
    ball's vectors are dealt to shards of about PER_SHARD, each built once; queries are dealt to blocks in the same way.
    First every block searches one shard of its own ball, or of the next ball that has any. The k-th scores it finds there
    are a floor. A block then meets only the balls whose bound (inner product with the center, and length times radius)
    reaches the floor of one of its queries at least: shards of other balls are never sent to it. A ball's shards stand in
    lanes of LANE; inside a lane each shard starts from the floor that the ones before it have raised, and the lane of the
    first shard goes on with what was found there. Of each lane only what reaches the floor comes back.
    """
    element = "bigint" if score == "long" else "double"
    kind = np.dtype(np.int64 if score == "long" else np.float64)
    low = -np.inf if kind.kind == "f" else -(2**63 - 1)
    once = [rows.groupBy("id", "vector").agg(F.lit(1)).select("id", "vector") for rows in (vectors, queries)]
    points, asked = kept(once[0]), kept(once[1])
    centers = balls(points, max(1, min(BALLS, asked.count() // PER_BLOCK)))
    shards = dealt(in_balls(points, centers, element), PER_SHARD, "shard")
    blocks = dealt(in_balls(asked, centers, element), PER_BLOCK, "block")

    def build_shard(table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        y, most = scaled(x)
        top = float(most.max(initial=0.0)) or 1.0
        y = y * (most / top)[:, None]
        center = y.mean(0)
        radius = float(np.sqrt(((y - center) ** 2).sum(1).max(initial=0.0)))
        own = {c: table.column(c)[:1] for c in ("dim", "ball", "shard")}
        return pa.table(own | {"tree": pa.array([packed(**build(ids, x))], pa.binary()), "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": [radius], "top": [top]})

    def build_block(table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        return pa.table({c: table.column(c)[:1] for c in ("dim", "ball", "block")} | {"queries": pa.array([packed(ids=ids, x=x)], pa.binary())})

    def enclosing(table: pa.Table) -> pa.Table:
        """One ball round all shards of a ball, and which of these is the first."""
        c, r, t = np.array(table.column("center").to_pylist(), float), table.column("radius").to_numpy(), table.column("top").to_numpy()
        top = float(t.max())
        c, r = c * (t / top)[:, None], r * (t / top)
        center = c.mean(0)
        radius = float((np.sqrt(((c - center) ** 2).sum(1)) + r).max())
        own = {c: table.column(c)[:1] for c in ("dim", "ball")}
        return pa.table(own | {"first": pa.array([int(table.column("shard").to_numpy().min())], pa.int32()), "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": [radius], "top": [top]})

    trees = kept(shards.groupBy("dim", "ball", "shard").applyInArrow(build_shard, "dim int, ball int, shard int, tree binary, center array<double>, radius double, top double"))
    sets = kept(blocks.groupBy("dim", "ball", "block").applyInArrow(build_block, "dim int, ball int, block int, queries binary").withColumnRenamed("ball", "of"))
    around = trees.select("dim", "ball", "shard", "center", "radius", "top").groupBy("dim", "ball").applyInArrow(enclosing, "dim int, ball int, first int, center array<double>, radius double, top double")
    found_balls = around.orderBy("dim", "ball").collect()  # BALLS rows at most for each length of vectors
    spark, bounds, first_of = vectors.sparkSession, {}, []
    for dim in {r.dim for r in found_balls}:
        own = [r for r in found_balls if r.dim == dim]
        bounds[dim] = tuple(np.array([r[c] for r in own]) for c in ("ball", "center", "radius", "top"))
        near = centers.get(dim, np.zeros((1, dim)))
        for of in range(len(near)):  # the ball itself, or the next one that has vectors
            r = own[int(np.argmax(near[[x.ball if x.ball < len(near) else 0 for x in own]] @ near[of] + 2.0 * np.array([x.ball == of for x in own])))]
            first_of.append((dim, of, r.ball, r.first))
    pilots = spark.createDataFrame(first_of, "dim int, of int, ball int, shard int")

    def searched(shard_rows: pa.Table, block_rows: pa.Table) -> Best | None:
        if not len(shard_rows) or not len(block_rows):
            return None
        block, done = unpacked(block_rows.column("queries")[0]), None
        floor, state = (block_rows.column(c)[0] for c in ("floor", "state"))
        best = Best(block["ids"], k, np.frombuffer(floor.as_buffer(), kind) if floor.is_valid else np.full(len(block["ids"]), low, kind))
        if state.is_valid:  # the first shard has been searched, and is in this lane
            done, before = block_rows.column("done")[0].as_py(), unpacked(state)
            best.scores, best.ids = before["scores"], before["ids"]
        numbers = shard_rows.column("shard").to_numpy()
        for i in np.argsort(numbers):
            if numbers[i] != done:
                scan(unpacked(shard_rows.column("tree")[int(i)]), block["x"], best)
        return best

    key = ("dim", "of", "block")

    def first(shard_rows: pa.Table, block_rows: pa.Table) -> pa.Table:
        best = searched(shard_rows, block_rows)
        n = 1 if best else 0
        meets = [reachable(bounds, block_rows.column("dim")[0].as_py(), unpacked(block_rows.column("queries")[0])["x"].astype(float), best.floor)] if best else []
        return pa.table({c: block_rows.column(c)[:n] for c in key} | {"ball": shard_rows.column("ball")[:n], "done": shard_rows.column("shard")[:n], "floor": pa.array([best.floor.tobytes()] if best else [], pa.binary()), "state": pa.array([packed(scores=best.scores, ids=best.ids)] if best else [], pa.binary()), "meets": pa.array(meets, pa.list_(pa.int32()))})

    def rest(shard_rows: pa.Table, block_rows: pa.Table) -> pa.Table:
        best = searched(shard_rows, block_rows)
        return best.rows() if best else pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.from_numpy_dtype(kind))})

    start = sets.withColumns({"floor": F.lit(None).cast("binary"), "state": F.lit(None).cast("binary"), "done": F.lit(None).cast("int")})
    to_first = trees.select("dim", "ball", "shard", "tree").join(pilots, ["dim", "ball", "shard"]).join(sets.select(*key), ["dim", "of"])
    pilot = kept(anew(to_first).groupBy(*key).cogroup(anew(start).groupBy(*key)).applyInArrow(first, "dim int, of int, block int, ball int, done int, floor binary, state binary, meets array<int>"))
    lanes = trees.select("dim", "ball", F.floor(F.col("shard") / LANE).cast("int").alias("lane")).distinct()
    pairs = pilot.select(*key, F.explode("meets").alias("ball")).join(lanes, ["dim", "ball"])
    to_rest = trees.select("dim", "ball", "shard", "tree", F.floor(F.col("shard") / LANE).cast("int").alias("lane")).join(pairs, ["dim", "ball", "lane"])
    own_lane = (F.col("ball") == F.col("at")) & (F.col("lane") == F.floor(F.col("done") / LANE))
    started = sets.join(pilot.select(*key, F.col("ball").alias("at"), "done", "floor", "state"), [*key]).join(pairs, [*key]).withColumn("state", F.when(own_lane, F.col("state")))
    hits = anew(to_rest).groupBy(*key, "ball", "lane").cogroup(anew(started).groupBy(*key, "ball", "lane")).applyInArrow(rest, f"query long, id long, score {score}")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
