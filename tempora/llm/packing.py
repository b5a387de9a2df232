"""Conflict-constrained best-fit packing of documents into fixed token budgets.

Documents are dealt at random, by a hash of their id, into groups of a bounded number of pieces; each group is packed on
its own, so that groups can be packed anywhere and a lost executor repeats only its own. In a group, pieces come
longest first. Bins are kept by what they have left; each carries bitmaps of the sources and of the duplicate clusters
that it holds. The successor of a piece's length among the remainders in use is searched first, then the next larger,
until a bin without a conflict is found: the tightest compatible one. A document longer than the budget is cut into
full bins and a rest, which is packed like the others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, GROUP = 2048, 4096


class BestFit:
    """Bins of one group."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list[int]] = []  # what each holds: sources, clusters (bitmaps)
        self.by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bit r: some bin has r left

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a piece; source and cluster are single bits."""
        rests = self.used >> size
        rest = size - 1
        while rests:
            step = (rests & -rests).bit_length()
            rests >>= step
            rest += step
            for k, b in enumerate(self.by_rest[rest]):
                held = self.bins[b]
                if not (held[0] & source or held[1] & cluster):
                    del self.by_rest[rest][k]
                    if not self.by_rest[rest]:
                        self.used &= ~(1 << rest)
                    return self._put(b, rest, size, source, cluster)
        self.bins.append([0, 0])
        return self._put(len(self.bins) - 1, self.capacity, size, source, cluster)

    def _put(self, b: int, rest: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        held = self.bins[b]
        held[0] |= source
        held[1] |= cluster
        if rest > size:
            self.by_rest[rest - size].append(b)
            self.used |= 1 << rest - size
        return b, self.capacity - rest


def word_count(text: str):
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row for each piece: id_col, piece (from 0), bin (string), bin_offset, n_words (long) and cluster (long).

    Sizes are in words. No bin holds two pieces of one source, nor of one duplicate cluster: texts that are equal after
    case and white space are folded. A null source is a source of its own kind, shared by all rows without one. A text
    without words (or null) takes no room: it gets piece 0 with n_words 0 and a null bin. Rows that repeat, in part or
    whole, are packed each: equal rows are counted and numbered first, so that each has bins of its own. Every row is
    packed whole; a hot source spreads over as many bins as it has documents. An empty table gives an empty one. Other
    columns are dropped.
    """
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    sized = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(source_col), F.lit(0)).alias("source"), F.xxhash64(folded).alias("cluster"), word_count(text_col).alias("words"))
    # Equal rows are told apart by a number, which follows from the data alone.
    counted = sized.groupBy("id", "source", "cluster", "words").agg(F.count(F.lit(1)).alias("n"))
    sized = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    full = F.floor(F.col("words") / capacity)
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0).cast("long")))))
    pieces = pieces.withColumn("size", F.when(F.col("piece") < full, F.lit(capacity).cast("long")).otherwise(F.col("words") - full * capacity))
    whole = pieces.where((F.col("size") == capacity) | (F.col("size") == 0))
    rest = pieces.where((F.col("size") < capacity) & (F.col("size") > 0))
    groups = max(1, -(-docs.count() // group))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("id", "source", "cluster", "words", "copy", "piece"), F.lit(groups)))
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        ids, size, piece, source, cluster = (table[c].to_pylist() for c in ("id", "size", "piece", "source", "cluster"))
        fit, part = BestFit(capacity), table["part"][0].as_py()
        number = {w: {x: 1 << i for i, x in enumerate(dict.fromkeys(v))} for w, v in (("s", source), ("c", cluster))}
        bins, offsets = [""] * len(ids), [0] * len(ids)
        for i in sorted(range(len(ids)), key=lambda i: (-size[i], str(ids[i]), cluster[i], piece[i])):
            b, offsets[i] = fit.place(size[i], number["s"][source[i]], number["c"][cluster[i]])
            bins[i] = f"{part}-{b}"
        return pa.table({"id": table["id"], "piece": table["piece"], "bin": pa.array(bins, pa.string()), "bin_offset": pa.array(offsets, pa.int64()), "n_words": table["size"], "cluster": table["cluster"]})

    packed = dealt.groupBy("part").applyInArrow(pack, f"id {kind}, piece long, bin string, bin_offset long, n_words long, cluster long")
    name = F.concat_ws("-", F.lit("full"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.hex("source"), F.hex("cluster"), "words", "copy", "piece")
    own = F.when(F.col("size") > 0, name)
    alone = whole.select("id", "piece", own.alias("bin"), F.when(F.col("size") > 0, F.lit(0).cast("long")).alias("bin_offset"), F.col("size").alias("n_words"), "cluster")
    return packed.unionByName(alone).withColumnRenamed("id", id_col)
