"""Exact top-k inner products by a dual search of two cover trees.

Vectors are scaled to integers. Data and queries are dealt into blocks; each
pair of blocks builds a cover tree of its queries and one of its data and
searches them together. A node holds a centre, the radius that covers all points
below, and children whose centres are further apart than half the radius. No
point below a data node can score higher against any query below a query node
than the product of the centres plus what both radii allow, so a pair of nodes
is left out if that is below the worst k-th score in the query group. The block
results are merged per query.

Scores are exact: where the largest numbers of both blocks may give products
beyond 2^53, both blocks are taken as Python's integers (a score beyond a 64-bit
integer is set to its limit). Bounds are floats in any case, widened by more than
their rounding.

Cases: null vectors, and vectors with a null or non-finite component, take no
part, nor do rows without an id. Only vectors of the same length are compared. A
row with the query's id is the query's own. Repeated rows are candidates of their
own; a repeated query is answered once. Ties go to the smaller id. Fewer
candidates than k give as many rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import blocks_for, ship
from stepweave.session import cut_lineage

SCALE = 1024
DATA_BLOCK = 16_384
QUERY_BLOCK = 4_096
DATA_LEAF = 48
QUERY_LEAF = 4
MOST_CENTRES = 512
MOST_OPEN = 256


class Tree:
    """A cover tree in arrays. ``points`` are reordered so that a node is a range of them."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.low, self.high, self.centre, self.radius, self.children = [], [], [], [], []
        self._build(0, len(points), 0)
        self.centres = points[np.array(self.centre, int)] if self.centre else points[:0]
        self.norms = np.sqrt((self.centres * self.centres).sum(1))
        self.radius = np.array(self.radius)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = points[self.order]

    def _distances(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.points[rows] - self.points[centre]
        return np.sqrt((d * d).sum(1))

    def _build(self, low: int, high: int, centre: int) -> int:
        """A node over ``order[low:high]`` around the point ``centre``."""
        rows = self.order[low:high]
        away = self._distances(rows, centre)
        node = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.centre.append(centre)
        # a hair more than the distances, against rounding
        self.radius.append(float(away.max()) * (1 + 1e-12) + 1e-9)
        self.children.append(np.empty(0, int))
        if high - low <= self.leaf or away.max() == 0:
            return node
        apart = away.max() / 2
        centres, nearest, owner = [centre], away, np.zeros(len(rows), int)
        # the furthest point becomes a centre while it lies apart from all others
        while len(centres) < MOST_CENTRES and nearest.max() > apart:
            new = int(rows[nearest.argmax()])
            d = self._distances(rows, new)
            closer = d < nearest
            nearest = np.where(closer, d, nearest)
            owner[closer] = len(centres)
            centres.append(new)
        by = np.argsort(owner, kind="stable")
        self.order[low:high] = rows[by]
        ends = low + np.cumsum(np.bincount(owner, minlength=len(centres)))
        starts = np.r_[low, ends[:-1]]
        kids = [
            self._build(int(a), int(b), c) for a, b, c in zip(starts, ends, centres) if a < b
        ]
        self.children[node] = np.array(kids, int)
        return node


class DualSearch:
    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
        self.k = k
        self.exact = queries.dtype != object
        self.q = Tree(queries.astype(float), QUERY_LEAF)
        self.d = Tree(data.astype(float), DATA_LEAF)
        self.queries, self.query_ids = queries[self.q.order], query_ids[self.q.order]
        self.data, self.data_ids = data[self.d.order], data_ids[self.d.order]
        n = len(queries)
        self.scores: list[np.ndarray] = [np.empty(0, queries.dtype)] * n
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n
        # a lower bound of each query's k-th best score
        self.worst = np.full(n, -np.inf)

    def _score(self, low: int, high: int, rows: np.ndarray) -> None:
        """All products of queries ``low:high`` with the data ``rows``; the best k stay."""
        products = self.queries[low:high] @ self.data[rows].T
        ids = self.data_ids[rows]
        for i in range(low, high):
            mine = products[i - low]
            good = (mine >= self.worst[i]) & (ids != self.query_ids[i])
            if not good.any():
                continue
            scores = np.r_[self.scores[i], mine[good]]
            names = np.r_[self.ids[i], ids[good]]
            best = np.lexsort((names, -scores))[: self.k] if self.exact else np.array(
                sorted(range(len(scores)), key=lambda j: (-scores[j], names[j]))[: self.k]
            )
            self.scores[i], self.ids[i] = scores[best], names[best]
            if len(best) == self.k:
                last = float(scores[best[-1]])
                self.worst[i] = last if self.exact else np.nextafter(last, -np.inf)

    def _bounds(self, q: int, nodes: np.ndarray) -> np.ndarray:
        centre, radius = self.q.centres[q], self.q.radius[q]
        radii = self.d.radius[nodes]
        norm, norms = self.q.norms[q], self.d.norms[nodes]
        reach = self.d.centres[nodes] @ centre + norm * radii + norms * radius + radius * radii
        # rounding goes with the size of the terms, not with that of their sum
        return reach + 1e-9 + 1e-12 * (norm * norms + norm * radii + norms * radius + radius * radii)

    def run(self) -> None:
        if len(self.queries) and len(self.data):
            self._descend(0, np.array([0]))

    def _descend(self, q: int, nodes: np.ndarray) -> None:
        """Take a query node through the data nodes left by its parent."""
        low, high = int(self.q.low[q]), int(self.q.high[q])
        nodes = nodes[self._bounds(q, nodes) >= self.worst[low:high].min()]
        if len(self.q.children[q]):
            # open the data nodes that are wider than the query node
            wide = [n for n in nodes if len(self.d.children[n]) and self.d.radius[n] >= self.q.radius[q]]
            if wide and len(nodes) < MOST_OPEN:
                opened = np.concatenate([self.d.children[n] for n in wide])
                nodes = np.r_[np.setdiff1d(nodes, wide), opened]
            for child in self.q.children[q]:
                self._descend(int(child), nodes)
            return
        queue = nodes
        while len(queue):
            bounds = self._bounds(q, queue)
            order = np.argsort(-bounds, kind="stable")
            queue, bounds = queue[order], bounds[order]
            keep = bounds >= self.worst[low:high].min()
            queue = queue[keep]
            if not len(queue):
                return
            now, queue = queue[:8], queue[8:]
            leaves = [np.arange(self.d.low[n], self.d.high[n]) for n in now if not len(self.d.children[n])]
            inner = [self.d.children[n] for n in now if len(self.d.children[n])]
            if leaves:
                self._score(low, high, np.concatenate(leaves))
            if inner:
                queue = np.concatenate([queue, *inner])


def _matrices(queries: list[list[float]], data: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks as floats where all their products are exact, else both as Python integers."""
    q, d = (np.array(v, float).reshape(len(v), -1) for v in (queries, data))
    if q.size and d.size and np.abs(q).max() * np.abs(d).max() * q.shape[1] >= 2.0**53:
        return tuple(np.array([[int(v) for v in row] for row in m], object) for m in (queries, data))
    return q, d


def _limited(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vector: str = "embedding",
    id_col: str = "vec_id",
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` highest integer inner products."""
    ship(vectors.sparkSession)

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(
            F.col("id").isNotNull() & F.col("v").isNotNull() & fine
        )
        # doubles hold these whole numbers as they are
        return rows.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: _floor(x * scale)).alias("v"))

    data = cut_lineage(whole(vectors))
    asked = cut_lineage(whole(queries).dropDuplicates(["id"]))
    n_data, n_asked = data.count(), asked.count()
    d, q = blocks_for(n_data, DATA_BLOCK), blocks_for(n_asked, QUERY_BLOCK)
    data = data.select(
        "*", F.pmod(F.xxhash64("id"), F.lit(d)).alias("db"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("qb")
    ).withColumn("db", F.col("db").cast("int"))
    asked = asked.select(
        "*",
        F.pmod(F.xxhash64("id"), F.lit(q)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("db"),
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            asked_for, among = _matrices(left.column("v").to_pylist(), right.column("v").to_pylist())
            s = DualSearch(asked_for, left.column("id").to_numpy(), among, right.column("id").to_numpy(), k)
            s.run()
            for i, query in enumerate(s.query_ids.tolist()):
                out[0].extend([query] * len(s.ids[i]))
                out[1].extend(s.ids[i].tolist())
                out[2].extend(map(_limited, s.scores[i]))
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    keys = ["db", "qb", "dim"]
    pairs = asked.groupBy(*keys).cogroup(data.groupBy(*keys))
    found = pairs.applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(x):
    """Floor as a double, also beyond 64-bit integers."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
