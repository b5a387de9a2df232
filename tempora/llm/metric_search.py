"""Exact top-k inner products by best-first search of M-trees.

Vectors are turned into integers. Inner products become distances: with M the largest norm of a block and the extra
component sqrt(M^2 - |x|^2), the distance of x to a query falls as the inner product grows. Each block of vectors is
built into an M-tree, bottom-up: pages of entries, each with its covering radius and its distance to the parent's
object. A search takes pages by their least possible distance; an entry whose stored parent distance already rules it
out by the triangle inequality is dropped before its own distance is computed. Distances only steer and prune, with a
margin for rounding; scores are exact integers, ties go to the smaller id.

Queries and vectors are dealt into blocks; each block's tree meets each block of queries once, as packed arrays, and
the best of each meeting are merged. Work is spread over (vector blocks x groups of query blocks) keys of one size.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, queries in a block, entries in a page, and query blocks that meet a tree in one task.
VECTORS, QUERIES, PAGE, TOGETHER = 8192, 1024, 64, 8


def _split(points: np.ndarray, rows: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """rows in runs of at most size, near ones together: halved again and again between two far objects."""
    if len(rows) <= size:
        return [rows]
    a = points[rows[rng.integers(len(rows))]]
    b = points[rows[np.argmax(((points[rows] - a) ** 2).sum(1))]]
    c = points[rows[np.argmax(((points[rows] - b) ** 2).sum(1))]]
    order = np.argsort((points[rows] - b) @ (c - b), kind="stable")
    half = -(-len(rows) // (2 * size)) * size if len(rows) > 2 * size else len(rows) // 2
    return _split(points, rows[order[:half]], size, rng) + _split(points, rows[order[half:]], size, rng)


class MTree:
    """Pages of a metric tree over integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        rng = np.random.default_rng(len(ids))
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        self.most = float(norms.max()) if len(norms) else 0.0
        points = np.concatenate([vectors.astype(np.float64), np.sqrt(np.maximum(self.most - norms, 0))[:, None]], 1)
        self.ids, self.vectors = ids, vectors
        #: Nodes of each level: the routing object, covering radius, and for each child its distance to that object.
        level = []
        for rows in _split(points, np.arange(len(ids)), PAGE, rng):
            level.append(self._page(points[rows], None, rows))
        while len(level) > 1:
            centres = np.array([n[0] for n in level])
            level = [self._page(centres[rows], np.array([level[r][1] for r in rows]), [level[r] for r in rows]) for rows in _split(centres, np.arange(len(level)), PAGE, rng)]
        self.root = level[0] if level else None

    @staticmethod
    def _page(objects: np.ndarray, radii: np.ndarray | None, children) -> tuple:
        """(routing object, covering radius, children's objects, their parent distances, their radii, children)."""
        mean = objects.mean(0)
        centre = objects[np.argmin(((objects - mean) ** 2).sum(1))]
        away = np.sqrt(((objects - centre) ** 2).sum(1))
        reach = float((away + (radii if radii is not None else 0)).max())
        return centre, reach, objects if radii is not None else None, away, radii, children

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """([(score, id)] of the k best but own, best first; the number of vectors whose score was computed)."""
        if self.root is None:
            return [], 0
        q = np.append(query.astype(np.float64), 0.0)
        norm = float(q @ q)
        margin = 1e-6 * (1.0 + norm + self.most)
        # An inner product s is a squared distance of norm + most - 2 s.
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        reach = float("inf")
        start = float(np.sqrt(((q - self.root[0]) ** 2).sum()))
        queue, tick, computed = [(max(0.0, start - self.root[1]), 0, start, self.root)], 0, 0
        while queue:
            bound, _, to_centre, (_, _, objects, away, radii, children) = heapq.heappop(queue)
            if bound > reach:
                break
            lower = np.abs(to_centre - away)
            if objects is not None:
                near = np.flatnonzero(lower - radii <= reach)
                distance = np.sqrt(((objects[near] - q) ** 2).sum(1))
                for i, d in zip(near.tolist(), distance.tolist(), strict=True):
                    if (low := max(bound, d - radii[i])) <= reach:
                        tick += 1
                        heapq.heappush(queue, (low, tick, d, children[i]))
                continue
            rows = children[lower <= reach]
            if not len(rows):
                continue
            computed += len(rows)
            scores, ids = self.vectors[rows] @ query, self.ids[rows]
            if len(best) == k:
                keep = scores >= best[0][0]
                scores, ids = scores[keep], ids[keep]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                reach = float(np.sqrt(max(0.0, norm + self.most - 2.0 * best[0][0]) + margin))
        return [(s, -i) for s, i in sorted(best, reverse=True)], computed


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, vector array<long>): floor(scale * x) of each component; rows with a null id, vector or component, or one that isn't finite, are left out."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    read = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    return read.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False))).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("vector"))


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table["id"])
    return ids, np.asarray(table["vector"].combine_chunks().flatten()).reshape(len(ids), -1)


def top_inner_products(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """The k best of all other vectors for each query: query_id (long), rank (int, from 1), id_col (long), score (long).

    Queries are the rows whose id is divisible by `every`; the score is the inner product of the integer vectors; ties
    go to the smaller id. Vectors that are null or empty, or hold null or non-finite components, take no part; a query
    meets only vectors of its own length. A row's own id is no candidate, also where it is repeated; rows that repeat an
    id are separate candidates, and separate queries. Fewer than k rows come back where there are fewer candidates; an
    empty table gives an empty one. Other columns are dropped.
    """
    sound = quantised(vectors, id_col, vector_col).where(F.size("vector") > 0).withColumn("wide", F.size("vector"))
    n = vectors.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // (every * query_block)))
    groups = -(-query_blocks // TOGETHER)

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "wide": pa.array([table["wide"][0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(MTree(*_packed(table)), protocol=5)], pa.binary())})

    def collect(table: pa.Table) -> pa.Table:
        return pa.table({"query_block": pa.array([table["query_block"][0].as_py()], pa.int64()), "wide": pa.array([table["wide"][0].as_py()], pa.int32()), "queries": pa.array([pickle.dumps(_packed(table), protocol=5)], pa.binary())})

    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        for tree in trees["tree"]:
            tree = pickle.loads(tree.as_py())
            for packed in queries["queries"]:
                ids, rows = pickle.loads(packed.as_py())
                found += [(int(i), best, score) for i, row in zip(ids, rows, strict=True) for score, best in tree.search(row, int(i), k)[0]]
        return pa.table({name: pa.array([f[c] for f in found], pa.int64()) for c, name in enumerate(("query_id", "id", "score"))})

    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    trees = sound.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block", "wide").applyInArrow(build, "block long, wide int, tree binary")
    asked = sound.where(F.pmod("id", F.lit(every)) == 0).withColumn("query_block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)))
    queries = asked.groupBy("query_block", "wide").applyInArrow(collect, "query_block long, wide int, queries binary").withColumn("group", F.pmod("query_block", F.lit(groups)))
    # A tree goes to each group of query blocks, a query block to each tree: as many meetings as blocks x groups, none larger than another.
    left = trees.withColumn("group", upto(groups)).groupBy("block", "wide", "group")
    right = queries.withColumn("block", upto(blocks)).groupBy("block", "wide", "group")
    found = left.cogroup(right).applyInArrow(search, "query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
