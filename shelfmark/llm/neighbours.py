"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into parts of equal size with few
cut edges; a small network learns which part a vector belongs to. Every vector is
stored under its most probable part, every query visits its several most probable
parts, and what it meets there is ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import written

#: Sample rows the partition is learned from, neighbours in its graph, most parts, and recall aimed at when choosing the parts to visit.
SAMPLE_ROWS, GRAPH_NEIGHBOURS, MOST_PARTS, AIM = 6000, 10, 64, 0.97
#: Rows of queries and of vectors that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
HIDDEN = 64


@dataclass
class Router:
    """One hidden layer over the unit vector; ``visits`` is how many parts a query goes to."""

    dims: int
    parts: int
    visits: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    ids: np.ndarray
    sample: np.ndarray

    def best_of_sample(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each query its ``k`` best of the sample (ids and scores), and the last of those scores: no worse row can be among its ``k`` nearest."""
        floor, found, scores = np.full(len(x), -np.inf), [], []
        for i, v in enumerate(x):
            s = (self.sample * v).sum(axis=1)
            s[self.ids == ids[i]] = -np.inf
            top = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
            top = top[np.isfinite(s[top])]
            if len(top) == k:
                floor[i] = s[top].min() - 1e-9 * max(1.0, abs(s[top].min()))
            found.append(self.ids[top])
            scores.append(s[top])
        return floor, found, scores

    def scores(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def neighbour_lists(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 12) -> np.ndarray:
    """Parts of near-equal size with few edges of the neighbour graph between them.

    Begins with median cuts along main directions; then rows move to the part most
    of their neighbours are in, best gain first, while no part leaves 90 to 110 per
    cent of the even size.
    """
    part = np.zeros(len(x), np.int64)
    count = 1
    while count < parts:
        fresh = part * 2
        for p in range(count):
            rows = np.flatnonzero(part == p)
            centred = x[rows] - x[rows].mean(axis=0)
            direction = np.ones(x.shape[1]) / np.sqrt(x.shape[1]) + np.arange(x.shape[1]) * 1e-3
            for _ in range(8):
                direction = centred.T @ (centred @ direction)
                direction /= max(np.linalg.norm(direction), 1e-300)
            order = rows[np.argsort(centred @ direction, kind="stable")]
            fresh[order[len(order) // 2 :]] += 1
        part, count = fresh, count * 2
    a = np.repeat(np.arange(len(x)), near.shape[1])
    b = near.ravel()
    least, most = int(0.9 * len(x) / parts), int(np.ceil(1.1 * len(x) / parts))
    for _ in range(sweeps):
        ties = np.zeros((len(x), parts), np.int32)
        np.add.at(ties, (a, part[b]), 1)
        np.add.at(ties, (b, part[a]), 1)
        want = ties.argmax(axis=1)
        gain = ties[np.arange(len(x)), want] - ties[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < len(x) // 500:
            break
    return part


def train_router(ids: np.ndarray, sample: np.ndarray, parts: int, seed: int = 11) -> Router:
    """Partition the sample's neighbour graph and learn it; parts to visit are chosen on rows kept out of the training."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    dims = x.shape[1]
    near = neighbour_lists(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    part = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
    target[np.arange(len(x)), part] += 0.5
    tested = rng.permutation(len(x))[: max(1, len(x) // 10)]
    learned = np.setdiff1d(np.arange(len(x)), tested)
    r = Router(dims, parts, parts, rng.normal(0, np.sqrt(2.0 / dims) * 2, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts), ids, sample)
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (r.w1, r.b1, r.w2, r.b2)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    step = 0
    for epoch in range(40):
        rate = 0.01 if epoch < 25 else 0.002
        for rows in np.array_split(rng.permutation(learned), max(1, len(learned) // 128)):
            step += 1
            pre = unit[rows] @ r.w1 + r.b1
            hidden = np.maximum(pre, 0)
            logits = hidden @ r.w2 + r.b2
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            out = (prob - target[rows]) / len(rows)
            back = (out @ r.w2.T) * (pre > 0)
            for w, g, (m, v) in zip((r.w1, r.b1, r.w2, r.b2), (unit[rows].T @ back, back.sum(axis=0), hidden.T @ out, out.sum(axis=0)), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    home = r.scores(x).argmax(axis=1)
    k = min(20, len(x) - 1)
    s = x[tested] @ x.T
    s[np.arange(len(tested)), tested] = -np.inf
    truth = home[np.argpartition(-s, k - 1, axis=1)[:, :k]]
    order = np.argsort(-r.scores(x[tested]), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape).copy(), axis=1)
    needed = np.take_along_axis(rank, truth, axis=1)
    r.visits = next(m for m in range(1, parts + 1) if (needed < m).mean() >= AIM or m == parts)
    return r


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def fit(vectors: DataFrame) -> Router | None:
    """Router for usable (vec_id, embedding) rows, learned from at most about ``SAMPLE_ROWS`` of them; None without rows."""
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    if not sizes:
        return None
    dims, n = sizes[0].d, sizes[0].n
    share = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    rows = vectors.where(share & (F.size("embedding") == dims)).select("vec_id", "embedding").limit(2 * SAMPLE_ROWS).toArrow()
    sample = _matrix(rows.column("embedding"), dims).astype(np.float64) if rows.num_rows else np.zeros((0, dims))
    ids, first = np.unique(rows.column("vec_id").to_numpy(), return_index=True)
    sample = sample[first]
    parts = 1 << max(0, min(int(np.log2(MOST_PARTS)), round(float(np.log2(max(n, 1) / 500)))))
    parts = min(max(parts, 4), len(np.unique(sample, axis=0)) // 25)
    if parts < 2:
        return Router(dims, 1, 1, np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), ids, sample)
    return train_router(ids, sample, 1 << int(np.log2(parts)))


def nearest_in(queries: pa.Table, vectors: pa.Table, dims: int, k: int) -> tuple[list[int], list[int], list[float]]:
    """Exact top ``k`` of every query of a block among a block of vectors, ties to smaller ids, none below the query's floor.

    Rows of ``vectors`` are distinct. Equal vectors are scored once and stand for
    their k + 1 smallest ids (one may be the query's own), so a vector copied very
    often costs no more than one.
    """
    ids = vectors.column("vec_id").combine_chunks().to_numpy()
    raw = np.ascontiguousarray(_matrix(vectors.column("embedding"), dims))
    q_ids = queries.column("query_id").combine_chunks().to_numpy()
    q = _matrix(queries.column("query"), dims).astype(np.float64)
    floors = queries.column("floor").combine_chunks().to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, raw = ids[order], raw[order]
    known: dict[bytes, int] = {}
    group = np.array([known.setdefault(r.tobytes(), len(known)) for r in raw], np.int64)
    first = np.unique(group, return_index=True)[1]
    by_group = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    unique = raw[first].astype(np.float64)
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for a in range(0, len(q), 128):
        scores = q[a : a + 128] @ unique.T
        for i, row in enumerate(scores):
            own, vector = int(q_ids[a + i]), q[a + i]
            cut = -np.inf if len(row) <= k + 1 else np.partition(row, len(row) - k - 1)[len(row) - k - 1]
            cut = max(cut - 1e-9 * max(1.0, abs(cut)) if np.isfinite(cut) else cut, floors[a + i])
            close = np.flatnonzero(row >= cut)
            exact = (unique[close] * vector).sum(axis=1)
            found = [(-s, int(v)) for g, s in zip(close.tolist(), exact.tolist(), strict=True) for v in ids[by_group[begin[g] : min(begin[g + 1], begin[g] + k + 1)]].tolist() if v != own]
            for s, v in sorted(found)[:k]:
                out[0].append(own)
                out[1].append(v)
                out[2].append(-s)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row among all rows but its own, nearest first.

    ``vectors`` has vec_id (whole number) and embedding; other columns are ignored.
    Nearness is the inner product in double precision on the vectors as given; ties
    go to the smaller vec_id. Rows with a null id or a vector that is null, zero, of
    another length than most, or holds a null or non-finite component take no part.
    Rows of one vec_id and equal vectors count once; a query whose id stands on
    several vectors uses the smallest. Empty tables give no rows.

    A part of any size is cut into blocks of ``VECTOR_BLOCK`` rows, and its queries
    into blocks of ``QUERY_BLOCK``; each pair of blocks is one bounded piece of work.
    What a query finds in the sample bounds its result from below, so blocks send on
    no more than can still be among its nearest.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    good = written(good.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies")).select("vec_id", "embedding"))
    router = router or fit(good)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if router is None:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("embedding") == router.dims)
    shared, dims = spark.sparkContext.broadcast(router), router.dims

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = shared.value.scores(_matrix(batch.column("embedding"), dims).astype(np.float64)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["vec_id", "embedding", "part"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dims).astype(np.float64)
            parts = np.argsort(-shared.value.scores(x), axis=1, kind="stable")[:, : shared.value.visits].astype(np.int32)
            at = np.arange(len(x) + 1, dtype=np.int32) * parts.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(parts.ravel()))
            floor, found, scores = shared.value.best_of_sample(batch.column("vec_id").to_numpy(), x, k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, pa.array(floor), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
                names=["vec_id", "embedding", "parts", "floor", "found", "scores"],
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = written(good.mapInArrow(home, f"vec_id bigint, embedding {kind}, part int"))
    asked = good.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(visit, f"vec_id bigint, embedding {kind}, parts array<int>, floor double, found array<bigint>, scores array<double>")
    asked = written(asked)
    sampled = asked.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("found", "scores")).alias("f")).select("query_id", F.col("f.found").alias("vec_id"), F.col("f.scores").alias("score"))
    asked = written(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "floor", F.explode("parts").alias("part")))
    cut = lambda df, size, name: df.groupBy("part").agg((1 + F.floor(F.count(F.lit(1)) / size)).cast("int").alias(name))
    grid = F.broadcast(cut(placed, VECTOR_BLOCK, "vector_blocks").join(cut(asked, QUERY_BLOCK, "query_blocks"), "part"))  # one row per part: at most MOST_PARTS
    left = asked.join(grid, "part").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int")).withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.col("vector_blocks") - 1))
    ).select("part", "q", "v", "query_id", "query", "floor")
    right = placed.join(grid, "part").withColumn("v", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("vector_blocks")).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))
    ).select("part", "q", "v", "vec_id", "embedding")

    def meet(queries: pa.Table, block: pa.Table) -> pa.Table:
        found = nearest_in(queries, block, dims, k) if queries.num_rows and block.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    hits = left.groupBy("part", "q", "v").cogroup(right.groupBy("part", "q", "v")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = hits.unionByName(sampled).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
