"""Exact top-k inner-product search by columnar branch and bound.

Vectors are quantised to whole numbers, so scores are exact. Blocks of queries meet blocks of candidates, one
group for each pair of blocks, each of bounded size. In a group the candidates lie column by column; a query takes
the columns in order of its own largest components, so that most of its mass is spent first, and scores build up one
block of dimensions at a time. What the remaining dimensions can still add is at most the product of both remaining
norms, so from the first block on candidates that can't reach the query's bar are compacted away.

The bar is a score that k candidates are known to reach: a first pass over one block of candidates gives each query
its bar, which goes with the query to all other blocks and rises within each. A group returns what reaches the bar,
``k`` rows for each query at most, and a window over those makes the final ranks.

Vectors that are null or hold null or non-finite components take no part; finite ones do, whatever their size. Vectors meet only
vectors of the same length, whatever it is. Equal scores rank by smaller ``vec_id``; all candidates of the query's own
``vec_id`` are skipped, and repeated rows of another ``vec_id`` are candidates each (equal rows are searched once and
counted). Repeated rows of a query are answered each, with ranks of their own. Rows with a null ``vec_id`` take no
part. Scores beyond 64 bits count as the end of the range. Empty tables give empty results; other columns aren't
read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.workspace import Workspace

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 2048
#: Dimensions added between two rounds of pruning.
DIMENSIONS = 8
#: Doubles hold all whole numbers below this.
EXACT = 2**53
LONGEST = 2**63 - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) / scale of each component, which a double holds whatever its size (``scale`` is a power of two); null for
    vectors that take no part."""
    cut = lambda x: F.when(F.abs(x) * scale < EXACT, F.floor(x * scale) / F.lit(float(scale))).otherwise(x)  # noqa: E731  larger doubles are whole
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), F.transform(vector.cast("array<double>"), cut))


def _whole_scores(query: np.ndarray, vectors: np.ndarray, scale: int) -> np.ndarray:
    """Scores in whole numbers of any size, cut to 64 bits."""
    whole = lambda x: int(x * scale) if abs(x) * scale < EXACT else int(x) * scale
    q = [whole(x) for x in query.tolist()]
    exact = [sum(a * whole(b) for a, b in zip(q, row)) for row in vectors.tolist()]
    return np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in exact], dtype=np.int64)


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, bars: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, survivors: list | None = None, scale: int = 1
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of the candidates among the k best of each query that reach its bar. Components
    are whole multiples of 1 / ``scale``, scores of 1 / ``scale**2``, and bars and scores are in that unit.

    ``survivors`` takes up, for each query, how many candidates are left after each block of dimensions."""
    dims = vectors.shape[1]
    largest = [float(np.abs(a).max(initial=0)) for a in (queries, vectors)]
    exact = largest[0] * largest[1] * max(dims, 1) * scale**2 < EXACT
    # bounds are taken in doubles near 1 where the numbers themselves would lose digits or overflow
    shrink = [float(scale) if exact else 2.0 ** -np.frexp(x)[1] for x in largest]
    unit = 1.0 if exact else shrink[0] * shrink[1] / scale**2
    ties = (1 - 1e-9) * LONGEST * unit  # scores beyond 64 bits are ties
    columns, asked = np.ascontiguousarray((vectors * shrink[1]).T), queries * shrink[0]
    squares = columns**2
    norms = squares.sum(axis=0)
    error = 1e-12 * np.sqrt(norms)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, order in enumerate(np.argsort(-np.abs(asked), axis=1, kind="stable")):
        mine, given = asked[q, order], float(bars[q])
        mass = np.sqrt(np.append(np.cumsum((mine**2)[::-1])[::-1], 0.0))  # what is left of the query from a dimension on
        bar = (given - 1e-12 * abs(given)) * unit - 1e-290 if given > -LONGEST else -np.inf
        at, left = np.flatnonzero(ids != query_ids[q]), []
        scores, rest = np.zeros(len(at)), norms[at] * (1 + 1e-9)
        for done in range(0, dims, DIMENSIONS):
            some = order[done : done + DIMENSIONS]
            if 2 * len(at) > len(ids):  # whole columns are copied faster than most of them
                scores = scores + (mine[done : done + DIMENSIONS] @ columns[some])[at]
                rest = rest - squares[some].sum(axis=0)[at]
            else:
                block = columns[some[:, None], at]
                scores = scores + mine[done : done + DIMENSIONS] @ block
                rest = rest - np.einsum("ij,ij->j", block, block)
            slack = np.sqrt(np.maximum(rest, 0)) * (mass[min(done + DIMENSIONS, dims)] * (1 + 1e-9)) + mass[0] * error[at] + 1e-290
            if len(at) > k and (bar == -np.inf or 2 * len(at) <= len(ids)):
                low = np.partition(scores - slack, len(at) - k)[len(at) - k]
                if not exact:
                    low = min(low, ties) if low > -ties else -np.inf
                bar = max(bar, low)
            keep = np.flatnonzero(scores + slack >= bar)
            at, scores, rest = at[keep], scores[keep], rest[keep]
            left.append(len(at))
        if survivors is not None:
            survivors.append(left)
        values = scores.astype(np.int64) if exact else _whole_scores(queries[q], vectors[at], scale)
        reach = np.flatnonzero(values >= bars[q])
        best = reach[np.lexsort((ids[at[reach]], -values[reach].astype(object)))[:k]]
        found.append((np.full(len(best), q), at[best], values[best]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3


def search(vectors: DataFrame, is_query: Column, k: int, space: Workspace, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each row that ``is_query``, against all rows."""
    rows = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), is_query.alias("asks"), quantised(F.col(vector_column), scale).alias("v"))
    rows = rows.filter("v IS NOT NULL").groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"), F.count_if("asks").alias("asked"))
    spread = F.xxhash64("vec_id", "v")
    rows = space.write(rows.select("*", F.size("v").alias("dims"), F.xxhash64("v").alias("print"), spread.alias("spread")), "vectors")
    n, asks = rows.agg(F.count(F.lit(1)), F.count_if(F.col("asked") > 0)).first()
    candidate_blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-asks // QUERY_BLOCK))
    mine = lambda blocks: F.pmod("spread", F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # columns with names of their own: Spark takes equal columns of both sides of a cogroup for one
    candidates = rows.select(F.col("vec_id").alias("id"), F.col("v").alias("w"), F.col("copies").alias("n"), F.size("v").alias("dims"), mine(candidate_blocks).alias("c"))
    candidates = candidates.select("*", every(query_blocks).alias("q"))
    queries = rows.filter("asked > 0").select("vec_id", "v", "print", "asked", "dims", mine(query_blocks).alias("q"))
    lowest = -LONGEST - 1

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query_id", "print", "asked", "vec_id", "score", "copies")})
        query_ids, ids = left["vec_id"].to_numpy(), right["id"].to_numpy()
        asked, there = (np.stack(list(x)).astype(np.float64).reshape(len(x), -1) for x in (left["v"], right["w"]))
        q, c, score = best_of_block(asked, query_ids, left["bar"].to_numpy(), there, ids, k, scale=scale)
        names = left.iloc[q]
        return pd.DataFrame({
            "query_id": query_ids[q], "print": names["print"].to_numpy(), "asked": names["asked"].to_numpy(),
            "vec_id": ids[c], "score": score, "copies": right["n"].to_numpy()[c],
        })

    kinds = "query_id long, print long, asked long, vec_id long, score long, copies long"

    def met(asking: DataFrame, those: DataFrame, keys: list[str]) -> DataFrame:
        return asking.groupBy(*keys).cogroup(those.groupBy(*keys)).applyInPandas(meet, kinds)

    # first pass: one block of candidates, whose k-th score is a bar for all others
    opening = met(queries.withColumn("bar", F.lit(lowest)), candidates.filter("c = 0").drop("c"), ["dims", "q"])
    bars = opening.groupBy("query_id", "print").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k)
    bars = space.write(bars.select(F.col("query_id").alias("vec_id"), "print", "bar"), "bars")
    armed = queries.join(bars, ["vec_id", "print"], "left").withColumn("bar", F.coalesce("bar", F.lit(lowest)))
    found = met(armed.select("*", every(candidate_blocks).alias("c")), candidates, ["dims", "c", "q"])

    # at most k rows of a query and block come here; equal rows count each
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).withColumn("before", before).filter(F.col("before") < k)
    ranks = F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("copies"), F.lit(k)).cast("int"))
    ranked = near.select("query_id", F.explode(ranks).alias("rank"), "vec_id", "score", "asked")
    return ranked.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).select("query_id", "rank", "vec_id", "score")
