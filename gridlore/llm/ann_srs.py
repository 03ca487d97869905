"""Nearest neighbours by few stable projections indexed in a kd-tree (after SRS, Sun et al. 2014).

Largest inner product is turned into least distance by one more coordinate and by scaling each query to the largest
norm. Gaussian projections to ``PROJECTIONS`` numbers keep distances up to a chi-square factor. The projected points of
a block stand in a kd-tree; a query meets its leaves from near to far, and their points by projected distance. Points
are verified on the original vectors until a chi-square test says that a point nearer than the k-th found would have
been met already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An even number, for the chi-square distribution in closed form.
PROJECTIONS = 16
#: Chance with which each true neighbour has been met when a search stops.
CERTAINTY = 0.93
LEAF = 64
#: Leaves that are met together at first, and points that are verified together; both grow fourfold as a search goes on.
LEAVES = 16
VERIFIED = 256
#: Rows of an index block, and queries that meet a block at once.
BLOCK = 32768
#: Numbers of such a block, where vectors are long.
BLOCK_NUMBERS = 1 << 22
QUERY_BLOCK = 4096


def chi_square(x: np.ndarray | float, degrees: int = 8) -> np.ndarray | float:
    """Distribution function with an even number of degrees of freedom."""
    half, term, total = np.asarray(x) / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_limit(chance: float, degrees: int) -> float:
    """Where the distribution function reaches ``chance``."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < chance else (low, middle)
    return high


class ProjectedTree:
    """The distinct vectors of a block, by the leaves of a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, keep: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)
        _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[by_group], np.arange(len(first) + 1))
        copies = [ids[by_group[a : min(b, a + keep + 1)]] for a, b in zip(begin[:-1], begin[1:], strict=True)]  # smallest ids
        x = vectors[first]
        self.largest = largest
        rest = np.sqrt(np.maximum(largest - (x * x).sum(1), 0.0))
        axes = np.random.default_rng(8).normal(size=(x.shape[1] + 1, PROJECTIONS))
        self.axes = axes[:-1]
        projected = x @ axes[:-1] + rest[:, None] * axes[-1]
        leaves, todo = [], [np.arange(len(x))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            p = projected[rows]
            axis = int(np.argmax(p.max(0) - p.min(0)))
            middle = len(rows) // 2
            split = np.argpartition(p[:, axis], middle)
            todo += [rows[split[:middle]], rows[split[middle:]]]
        order = np.concatenate(leaves)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in leaves])])
        self.low = np.array([projected[r].min(0) for r in leaves])
        self.high = np.array([projected[r].max(0) for r in leaves])
        self.x, self.copies, self.projected = x[order], [copies[i] for i in order], projected[order]
        self.first = np.array([c[0] for c in self.copies])
        self.limit = chi_square_limit(CERTAINTY, PROJECTIONS)
        self.asked = self.verified = 0  # queries, and points that they were compared with on the original vectors

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest found, without the query's own row."""
        scale = np.sqrt(self.largest / (q * q).sum())  # keeps the order, and sets near points off from far ones
        p = q @ self.axes * scale
        away = np.maximum(np.maximum(self.low - p, p - self.high), 0.0)
        away = (away * away).sum(1)
        order = np.argsort(away, kind="stable")
        want = k + 1  # one of them may be the query's own vector
        rows, score = np.zeros(0, np.int64), np.zeros(0)
        self.asked += 1
        place, leaves, together = 0, LEAVES, VERIFIED
        while place < len(order) and away[order[place]] <= self._reach(score, scale, want):
            met = order[place : place + leaves]
            met = met[away[met] <= self._reach(score, scale, want)]
            place, leaves = place + leaves, 4 * leaves
            size = self.bounds[met + 1] - self.bounds[met]
            near = np.arange(size.sum()) + np.repeat(self.bounds[met] - np.cumsum(size) + size, size)
            apart = self.projected[near] - p
            apart = np.einsum("ij,ij->i", apart, apart)
            within = np.flatnonzero(apart <= self._reach(score, scale, want))
            within = within[np.argsort(apart[within], kind="stable")]
            near, apart = near[within], apart[within]
            at = 0
            while at < len(near):
                stop = min(at + together, int(np.searchsorted(apart, self._reach(score, scale, want), "right")))
                if stop <= at:
                    break
                found = near[at:stop]
                self.verified += len(found)
                rows, score = np.concatenate([rows, found]), np.concatenate([score, self.x[found] @ q])
                best = self._best(rows, score, want) if len(rows) > want else np.lexsort((self.first[rows], -score))
                rows, score = rows[best], score[best]
                at, together = stop, 4 * together
        exact = (self.x[rows] * q).sum(1)  # the same sum wherever a vector stands, so that copies tie
        ids = np.concatenate([self.copies[r] for r in rows] or [np.zeros(0, np.int64)])
        exact = np.repeat(exact, [len(self.copies[r]) for r in rows])
        other = ids != query_id
        ids, exact = ids[other], exact[other]
        best = np.lexsort((ids, -exact))[:k]
        return ids[best], exact[best]

    def _reach(self, score: np.ndarray, scale: float, want: int) -> float:
        """Projected distance (squared) beyond which the chi-square test rules points out."""
        if len(score) < want:
            return np.inf
        return self.limit * max(2 * self.largest - 2 * scale * score[-1], 0.0)

    def _best(self, rows: np.ndarray, score: np.ndarray, want: int) -> np.ndarray:
        least = -np.partition(-score, want - 1)[want - 1]
        near = np.flatnonzero(score >= least - 1e-9 * (1 + abs(least)))
        return near[np.lexsort((self.first[rows[near]], -score[near]))[:want]]


def _sound(vector: str) -> Column:
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0)


FOUND = "query_id long, vec_id long, score double"


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest rows by inner product, for each row that ``is_query`` picks: query_id, rank, vec_id, score.

    Ties go to the smaller id. Rows with a null id, or a vector that is null, empty, zero, or holds a null or a number
    that is not finite, take no part; neither do vectors of another length than the most common one (ties: the
    shortest). A query's own id is no candidate; of rows that repeat an id each is a candidate. Other columns are not
    read. Every query meets every block of the index, and both are dealt in blocks of bounded size.
    """
    wide = F.transform(F.col(vector_column), lambda x: x.cast("double")).alias("v")
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), wide, is_query.alias("is_query"))
    rows = rows.where(_sound("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max(norm).alias("m"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = float(most["m"]) * (1 + 1e-12)
    blocks, query_blocks = -(-most["n"] // max(1, min(BLOCK, BLOCK_NUMBERS // most["d"]))), max(1, -(-most["q"] // QUERY_BLOCK))
    rows = rows.where(F.size("v") == most["d"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    data = rows.select("id", "v", dealt(blocks).alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.where("is_query").select("id", "v", every(blocks).alias("block"), dealt(query_blocks).alias("query_block"))

    def meet(block: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if block.num_rows and asked.num_rows:
            tree = ProjectedTree(_ids(block), _matrix(block), largest, k)
            for query_id, q in zip(_ids(asked), _matrix(asked), strict=True):
                ids, scores = tree.nearest(int(query_id), q, k)
                for column, x in zip(found, (np.full(len(ids), query_id), ids, scores), strict=True):
                    column.append(x)
        columns = [np.concatenate(c) if c else [] for c in found]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ("block", "query_block")
    met = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").to_numpy()


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
