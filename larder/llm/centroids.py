"""Centroid clustering with an equal-average equal-variance nearest-centroid search.

Components are quantised to whole numbers, so all distances and averages are exact. Centroids lie sorted by the sum
of their components. A vector starts at the centroid whose sum is nearest to its own and looks outward on both sides.
For ``k`` dimensions, sums ``s`` and deviations ``d = sqrt(k * sum of squares - s**2)``,

    k * distance >= (s_x - s_c)**2 + (d_x - d_c)**2

where the first term alone closes a whole side, since sums only grow further apart, and both together reject a single
centroid. What neither rejects gets its exact distance. Nothing is rejected at equality, so ties go to the smaller number.

Each round is one pass over the vectors in tasks that hold the few centroids; a task returns one row of sums and a count for each
centroid it met, however many vectors that has, and those rows are added up in two steps. Vectors are never grouped
or shuffled, so it makes no difference how uneven the clusters are.

Vectors that are null, don't have ``dims`` components or hold a null or non-finite one take no part. Finite components of any
size do: beyond 64 bits the arithmetic goes on in Python's whole numbers, and distances and their sums count as the
largest 64-bit number. Rows with a null id are assigned like others but start no centroid; equal ids are told apart by their
vectors in the starting order, and equal rows may start several centroids, of which the first takes all. With fewer vectors
than centroids there are fewer centroids; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.workspace import Workspace

CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
LONGEST = 2**63 - 1
#: Parts in which the tasks' sums are added up before they meet.
MERGE_PARTS = 64
#: Vectors that are searched at a time.
ROWS_AT_A_TIME = 8192


def quantised(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and their components as whole numbers: 64-bit ones, or Python's if some are too large."""
    kept = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(kept)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(kept), dims)
    finite = np.isfinite(flat).all(axis=1)
    kept, flat = kept[finite], flat[finite]
    if np.abs(flat).max(initial=0) * scale < 2**53:
        return kept, np.floor(flat * scale).astype(np.int64)
    exact = [[math.floor(x * scale) if abs(x) * scale < 2**53 else int(x) * scale for x in row] for row in flat.tolist()]
    return kept, np.array(exact, dtype=object).reshape(len(kept), dims)


def _root(x: np.ndarray) -> np.ndarray:
    """Square roots within one of the true ones, in whole numbers."""
    return np.array([math.isqrt(v) for v in x], dtype=object) if x.dtype == object else np.sqrt(x).astype(np.int64)


class NearestCentroid:
    """Centroids sorted by sum, asked for the nearest of many vectors at a time. ``met`` counts the exact distances taken."""

    def __init__(self, centroids: list[list[int]]):
        exact = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        self.dims = exact.shape[1]
        self.largest = max((abs(v) for row in centroids for v in row), default=0)
        order = sorted(range(len(centroids)), key=lambda c: (sum(centroids[c]), c))
        self.number = np.array(order, dtype=np.int64)
        self.sorted = exact[order]
        self.met = 0

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of, and squared distance to, each vector's nearest centroid."""
        numbers, distances = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors), dtype=np.int64)
        size = np.abs(vectors).max(axis=1, initial=0) if len(vectors) else np.zeros(0)
        small = 4 * self.dims * self.dims * self.largest**2 < 2**62
        fits = np.array([4 * self.dims * self.dims * int(s) ** 2 < 2**62 for s in size], dtype=bool) & small
        for rows, kind in ((np.flatnonzero(fits), np.int64), (np.flatnonzero(~fits), object)):
            for at in range(0, len(rows), ROWS_AT_A_TIME):
                part = rows[at : at + ROWS_AT_A_TIME]
                found, distance = self._search(vectors[part].astype(kind), self.sorted.astype(kind))
                numbers[part] = found
                distances[part] = distance if kind is np.int64 else [min(LONGEST, d) for d in distance]
        return numbers, distances

    def _search(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, many = len(x), self.dims, len(c)
        sum_x, sum_c = x.sum(axis=1), c.sum(axis=1)
        dev_x, dev_c = (_root(k * (v * v).sum(axis=1) - s * s) for v, s in ((x, sum_x), (c, sum_c)))
        right = np.searchsorted(sum_c, sum_x)  # the first centroid whose sum isn't smaller
        left = right - 1
        take_left = (left >= 0) & ((right == many) | (sum_x - sum_c[np.maximum(left, 0)] < sum_c[np.minimum(right, many - 1)] - sum_x))
        best = np.where(take_left, left, np.minimum(right, many - 1))
        left, right = left - take_left, right + ~take_left
        distance = ((x - c[best]) ** 2).sum(axis=1)
        self.met += n
        for step, at in ((-1, left), (1, right)):
            rows = np.arange(n)
            while len(rows := rows[(at[rows] >= 0) & (at[rows] < many)]):
                there = at[rows]
                apart = (sum_x[rows] - sum_c[there]) ** 2
                open_side = apart <= k * distance[rows]
                rows, there, apart = rows[open_side], there[open_side], apart[open_side]
                gap = np.maximum(np.abs(dev_x[rows] - dev_c[there]) - 2, 0)  # roots are within one of the true ones
                near = (apart + gap * gap <= k * distance[rows]).astype(bool)
                asked, there = rows[near], there[near]
                d = ((x[asked] - c[there]) ** 2).sum(axis=1)
                self.met += len(asked)
                better = (d < distance[asked]) | ((d == distance[asked]) & (self.number[there] < self.number[best[asked]]))
                better = better.astype(bool)
                distance[asked[better]], best[asked[better]] = d[better], there[better]
                at[rows] += step
        return self.number[best], distance


def _usable(vectors: DataFrame, dims: int) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter((F.size("v") == dims) & ~F.exists("v", bad))


def _start(vectors: DataFrame, n: int, dims: int, scale: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest hashes of 1:id, smaller vectors first where ids are equal."""
    # floor(scale * x) / scale keeps the order and doesn't overflow; larger doubles are whole numbers
    cut = F.transform("v", lambda x: F.when(F.abs(x) * scale < 2**53, F.floor(x * scale) / F.lit(float(scale))).otherwise(x))
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = _usable(vectors.filter("id IS NOT NULL"), dims).select(hashed.alias("h"), cut.alias("w")).orderBy("h", "w").limit(n).collect()
    return [[math.floor(x * scale) if abs(x) * scale < 2**53 else int(x) * scale for x in r["w"]] for r in rows]


def _averages(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """Centroids after each vector went to its nearest: floors of the exact averages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, sums, counts = NearestCentroid(centroids), {}, {}
        for batch in batches:
            _, x = quantised(batch.column(0), dims, scale)
            number, _ = nearest.assign(x)
            for c in np.unique(number).tolist():
                mine = x[number == c]
                exact = mine if mine.dtype == object or np.abs(mine).max(initial=0) * max(len(mine), 1) < 2**62 else mine.astype(object)
                sums[c] = [a + int(b) for a, b in zip(sums.get(c, [0] * dims), exact.sum(axis=0))]
                counts[c] = counts.get(c, 0) + len(mine)
        if counts:
            some = sorted(counts)
            part = pa.array([TaskContext.get().partitionId() % MERGE_PARTS] * len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), part, pa.array([counts[c] for c in some], pa.int64()), pa.array([[str(s) for s in sums[c]] for c in some], pa.list_(pa.string()))], names=["c", "part", "n", "sums"])

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        totals = [0] * dims
        for row in group["sums"]:
            totals = [a + int(b) for a, b in zip(totals, row)]
        return pd.DataFrame({"c": group["c"][:1], "part": 0, "n": group["n"].sum(), "sums": [[str(t) for t in totals]]})

    kinds = "c long, part long, n long, sums array<string>"
    partial = vectors.select("v").mapInArrow(run, kinds)
    merged = partial.groupBy("c", "part").applyInPandas(add_up, kinds).groupBy("c").applyInPandas(add_up, kinds)
    out = list(centroids)
    for row in merged.collect():  # one row a centroid
        out[row["c"]] = [int(s) // row["n"] for s in row["sums"]]
    return out


def _assigned(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> DataFrame:
    """id, cluster, distance of each vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = NearestCentroid(centroids)
        for batch in batches:
            kept, x = quantised(batch.column(1), dims, scale)
            number, distance = nearest.assign(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, space: Workspace, n_centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster and squared distance of each vector after ``rounds`` rounds, and the final centroids."""
    vectors = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    centroids = _start(vectors, n_centroids, dims, scale)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long"), []
    for _ in range(rounds):
        centroids = _averages(vectors, centroids, dims, scale)
    return space.write(_assigned(vectors, centroids, dims, scale), "assigned"), centroids


def cluster_report(vectors: DataFrame, space: Workspace, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    assigned, centroids = cluster(vectors, space, **settings)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}  # one row a centroid
    inertia = min(LONGEST, sum(sums.values()))
    rows = [(c, min(LONGEST, sums.get(c, 0)), inertia, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(told), "cluster")
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(n_centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same by brute force."""
    squares = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {n_centroids}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT n, arg_min(c.c, (d, c.c)) AS c, min(d) AS d FROM (SELECT v.n, c.c, {squares} AS d FROM v, c{r} c) c GROUP BY n)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS k FROM (SELECT a.c, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM a{r} a JOIN v USING (n)) GROUP BY c, i),
     m{r} AS (SELECT c, list(((s - (s % k + k) % k) // k)::BIGINT ORDER BY i) AS e FROM s{r} GROUP BY c),
     c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c)""")
    return ",\n     ".join(steps) + f"""
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (n) JOIN c{rounds} c ON c.c = a.c
"""
