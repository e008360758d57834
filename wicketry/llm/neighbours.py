"""Approximate nearest neighbours by collision-counting hashing, for the largest inner product.

Vectors get one more coordinate, so that inner products become distances (largest product, smallest distance). Each of
``PROJECTIONS`` random lines keeps the vectors of a block as one sorted array. A query opens a window around its own
projection in every array; a vector in the window of a line collides there. Windows widen by ``WIDEN`` (virtual
rehashing: the same arrays serve every width) until enough vectors collide on at least ``THRESHOLD`` of the lines; these
are verified by exact inner products in double precision.

Vectors lie in blocks of bounded size, dealt by hash of the id, and the stated query set in blocks too: a task holds one block
of each, and arrays are never joined row by row. Vectors without structure (uniform on the sphere, as in the test tables) leave
a true neighbour's place on a line near to chance, so windows must be wide to reach a recall of 0.9; collisions are therefore
counted inside blocks, by array operations on ranks, and not emitted as rows. Each block answers its nearest ``k`` ids; the
best ``k`` of all blocks are the result. Recall of the defaults, measured against brute force, is in the README.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
another dimension than the query's aren't its candidates; ties go to the smaller vec_id; rows without a vec_id take no
part; of rows that repeat a vec_id, each is a candidate, the best counts, and none is a candidate of its own id; of queries
that repeat an id, one vector (the first in order) is asked; fewer than ``k`` candidates give fewer rows; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

PROJECTIONS, THRESHOLD, WIDEN = 96, 0.7, 1.2
#: Share of a block's vectors (and as many more as neighbours are asked for) that must collide often enough.
ENOUGH = 0.1
VECTORS, QUERIES, AT_ONCE = 8192, 4096, 64


def directions(dim: int) -> np.ndarray:
    return np.random.RandomState(dim).normal(size=(dim, PROJECTIONS))


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        square = (self.vectors**2).sum(1)
        self.scale = np.sqrt(square.max())
        self.lines = directions(vectors.shape[1] + 1)
        shadow = np.column_stack([self.vectors, np.sqrt(np.maximum(square.max() - square, 0))]) @ self.lines
        by = np.argsort(shadow, axis=0, kind="stable")
        self.sorted = np.take_along_axis(shadow, by, 0)
        self.rank = np.empty(by.shape, np.uint16)  # place of each vector in each sorted array
        np.put_along_axis(self.rank, by, np.arange(len(ids), dtype=np.uint16)[:, None], 0)
        self.rank = np.ascontiguousarray(self.rank.T)
        self.first = 0.55 * shadow.std()

    def candidates(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Of each query, which vectors collide often enough."""
        n, m = len(self.ids), PROJECTIONS
        q = np.column_stack([queries / np.linalg.norm(queries, axis=1)[:, None] * self.scale, np.zeros(len(queries))]) @ self.lines
        out = np.zeros((len(q), n), bool)
        open_, half = np.arange(len(q)), max(self.first, 1e-12)
        wanted = min(n, k + 1 + int(np.ceil(ENOUGH * n)))
        while len(open_):
            count = np.zeros((len(open_), n), np.uint8)
            whole = np.ones(len(open_), bool)
            for j in range(m):
                lo = np.searchsorted(self.sorted[:, j], q[open_, j] - half, "left")
                hi = np.searchsorted(self.sorted[:, j], q[open_, j] + half, "right")
                whole &= hi - lo == n
                count += (self.rank[j][None, :] - lo.astype(np.uint16)[:, None]) < (hi - lo).astype(np.uint16)[:, None]
            often = count >= int(THRESHOLD * m)
            done = (often.sum(1) >= wanted) | whole
            out[open_[done]] = often[done] | whole[done, None]
            open_, half = open_[~done], half * WIDEN
        return out

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        rows = []
        for at in range(0, len(ids), AT_ONCE):
            some = queries[at : at + AT_ONCE]
            for i, q, found in zip(ids[at : at + AT_ONCE], some, self.candidates(some, k), strict=True):
                c = np.flatnonzero(found & (self.ids != i))
                score = np.einsum("ij,j->i", self.vectors[c], q)
                best = np.lexsort((self.ids[c], -score))
                best = best[np.sort(np.unique(self.ids[c][best], return_index=True)[1])][:k]  # an id once, with its best score
                rows += zip([int(i)] * len(best), self.ids[c][best].tolist(), score[best].tolist(), strict=True)
        return rows


def usable(df: DataFrame) -> DataFrame:
    """Rows that take part, with ``dim``."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` (vec_id, vec) for each of ``queries``."""
    vectors, queries = (usable(x.select("vec_id", F.col("vec").cast("array<double>").alias("vec"))) for x in (vectors, queries))
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    n, nq = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n // (VECTORS * 3 // 4))), max(1, -(-nq // QUERIES))
    left = vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def answer(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for at in range(0, len(v), 60_000) if len(v) and len(q) else ():  # ranks are 16 bits wide
            part = v.iloc[at : at + 60_000]
            block = Block(part["vec_id"].to_numpy(), np.stack(part["vec"].to_list()).astype(float))
            rows += block.nearest(q["vec_id"].to_numpy(), np.stack(q["vec"].to_list()).astype(float), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    key = ["vb", "qb", "dim"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(answer, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return nearest(v, v.filter("vec_id % 20 = 0"))
