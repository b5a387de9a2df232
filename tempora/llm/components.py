"""Connected components of an edge table.

Edges are first contracted in chunks of a bounded size: each task joins the vertices of its chunk and keeps one edge a
vertex. Chunks are contracted again while that shrinks the table; a table of one chunk is done. What is left beyond that
size is labelled by alternating large-star and small-star rounds, each a few aggregations and joins of an edge list, none
of which gathers a vertex's neighbours in one place. Labels are the smallest id of each component. Every step is written
to the shared folder, so that a lost executor costs at most one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import written

#: Edges that one task contracts at most, as far as partitions are even.
CHUNK = 400_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An edge (vertex, smallest vertex reached in this chunk) for each vertex but the smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 50_000):
        a, b = zip(*pairs[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook each vertex's larger (or smaller) neighbours, and itself, onto its smallest neighbour."""
    sides = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hooked = sides.join(low, "a")
    if large:
        out = hooked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the edges (a, b); component is the smallest id reached. Loops are ignored."""
    now = written(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    size = now.count()
    while size:
        chunks = -(-size // CHUNK)
        dealt = now.coalesce(1) if chunks == 1 else now.repartition(chunks)
        now = written(dealt.mapInArrow(_contract, "a long, b long"), "edges")
        before, size = size, now.count()
        if chunks == 1:
            break
        if size > CHUNK and size > 0.7 * before:
            now = _stars(now)
            break
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _stars(now: DataFrame) -> DataFrame:
    before = None
    while True:
        now = written(_star(_star(now, True), False), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state
