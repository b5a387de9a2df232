"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Order MinHash samples, for each of several hash functions, the few smallest occurrence-labelled shingles of a document
and keeps them in text order: two documents agree on a sample when they share those shingles in the same order, which
follows their edit similarity. Equal samples bring documents together; documents that agree on enough samples form
families; within a family, the sequences of shingles are aligned and only pairs that reach the similarity are linked.
Classes are the connected components of these links.

similarity(a, b) = A / (|a| + |b| - A), with A the length of the longest common subsequence of the two sequences of
five-word shingles: Jaccard similarity that respects order.

Exact copies are folded onto their smallest id before anything else, by aggregation. Where rows repeat an id with other
words, each of its texts meets those of other ids, and the id joins what they are near to. Documents that share a sample all
meet: those of a small group as pairs, those of a larger one in blocks, two at a time, of which a task keeps as few pairs
as connect what agrees; so a family holds every two documents that agree. Families larger than a block are aligned block by
block; blocks are dealt anew as long as that links enough. Then what still agrees across classes is connected once more,
and every two blocks of such documents are aligned with each other, so that no pair that agrees is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import U64, Words, join_hot, mix, slices, windows, written
from tempora.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: Samples of a document, and shingles in a sample. Two documents of similarity s agree on a sample with a probability
#: of about s**4: at 0.8 on 13 of 32, and on fewer than AGREE of 32 once in a thousand pairs. Of few shingles, c shared and
#: u in all, samples agree with C(c, 4) / C(u, 4), which is less: below SHORT shingles one sample is enough.
SAMPLES, LENGTH, AGREE, SHORT = 32, 4, 5, 40
#: Documents that share a sample and meet as pairs, that are aligned together while classes form, and of a block of larger
#: groups: of their samples, and of their texts. These deal the work out; none of them bounds what meets.
NEAR, BLOCK, MEET, TEXTS = 8, 64, 2048, 256
#: Families are dealt anew while that links one in so many of the documents of large families.
FEW = 100
_RNG = np.random.default_rng(7919)
_XOR = _RNG.integers(0, 2**63, (SAMPLES, 1), dtype=np.uint64)
_MUL = _RNG.integers(0, 2**62, (SAMPLES, 1), dtype=np.uint64) * U64(2) + U64(1)


def shingle_runs(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, shingle hashes in text order, word hashes) of each text; a text of 1 to size - 1 words is one shingle."""
    for a, b in slices(texts):
        w = Words(texts.slice(a, b - a))
        hashes = w.hashes()
        runs, at = windows(hashes, w.first, size, 0x9FB21C651E98DF25)
        edges = np.searchsorted(at, w.first)
        for i in range(b - a):
            words = hashes[w.first[i] : w.first[i + 1]]
            own = runs[edges[i] : edges[i + 1]]
            if 0 < len(words) < size:
                whole = U64(len(words))
                with np.errstate(over="ignore"):
                    for x in words:
                        whole = mix(whole * U64(0x9FB21C651E98DF25) + x)
                own = np.array([whole], np.uint64)
            yield a + i, own, words


def _labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its occurrence so far."""
    by = np.argsort(shingles, kind="stable")
    x = shingles[by]
    if not (same := x[1:] == x[:-1]).any():
        return shingles
    index = np.arange(len(x))
    start = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), index, 0))
    out = np.empty_like(shingles)
    out[by] = mix(x + (index - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return out


def order_min_hash(shingles: np.ndarray) -> np.ndarray:
    """The SAMPLES keys of a document: hashes of its LENGTH smallest labelled shingles, in text order."""
    ranked = (_labelled(shingles)[None, :] ^ _XOR) * _MUL
    if ranked.shape[1] > LENGTH:
        at = np.sort(np.argpartition(ranked, LENGTH - 1, axis=1)[:, :LENGTH], axis=1)
    else:
        at = np.broadcast_to(np.arange(ranked.shape[1]), (SAMPLES, ranked.shape[1]))
    keys = np.arange(SAMPLES, dtype=np.uint64) + U64(1)
    for column in at.T:
        keys = mix(keys * U64(0xD6E8FEB86659FD93) + shingles[column])
    return keys


def banded_lcs(x: Sequence[int], y: Sequence[int], band: int) -> int:
    """Longest common subsequence of x and y whose matches lie within band of the diagonal, 64 columns at a time."""
    same, most = 0, min(len(x), len(y))
    while same < most and x[same] == y[same]:
        same += 1
    tail = 0
    while tail < most - same and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[same : len(x) - tail], y[same : len(y) - tail]
    where: dict[int, int] = {}
    for i, s in enumerate(x):
        where[s] = where.get(s, 0) | 1 << i
    rows = (1 << len(x)) - 1
    for j in range(0, len(y), 64):
        low, high = max(0, j - band), min(len(x), j + 64 + band)
        if low >= high:
            break
        mask = (1 << high - low) - 1
        v = rows >> low & mask
        for s in y[j : j + 64]:
            if u := v & where.get(s, 0) >> low:
                v = (v + u | v - u) & mask
        rows = rows & ~(mask << low) | v << low
    return same + tail + len(x) - rows.bit_count()


def similarity(x: Sequence[int], y: Sequence[int], at_least: float = SIMILARITY) -> float:
    """Order-respecting Jaccard similarity, or 0.0 if it is below at_least."""
    total = len(x) + len(y)
    need = at_least * total / (1 + at_least)
    if not total or min(len(x), len(y)) < need - 1e-9:
        return 0.0
    common = banded_lcs(x, y, int(total * (1 - at_least) / (1 + at_least)) + 1)
    value = common / (total - common)
    return value if value >= at_least - 1e-12 else 0.0


def _sketches(id_col: str, text_col: str):
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, rows = batch.column(id_col), batch.column("text_hash"), []
            for i, own, words in shingle_runs(batch.column(text_col)):
                keys = order_min_hash(own) if len(own) else np.zeros(0, np.uint64)
                place = (np.arange(len(words), dtype=np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)
                p, q = (int(mix(words ^ (place * U64(k))).sum(dtype=np.uint64)) for k in (1, 0x2545F491))
                sig = (keys & U64(255)).astype(np.uint8).tobytes()
                rows.append((ids[i].as_py(), hashes[i].as_py(), p - (1 << 63), q - (1 << 63), len(own), keys.view(np.int64).tolist(), sig))
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return run


def _least_agreeing(n: np.ndarray) -> np.ndarray:
    """The samples that a pair has to agree on, by the number of shingles of its shorter document."""
    return np.where(n < SHORT, 1, AGREE)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, their sig and n) that agree on enough samples and whose lengths allow the similarity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = (np.asarray(batch.column(c)).astype(float) for c in ("na", "nb"))
        sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SAMPLES) for c in ("sa", "sb"))
        keep = ((sa == sb).sum(1) >= _least_agreeing(np.minimum(na, nb))) & (np.minimum(na, nb) >= SIMILARITY * np.maximum(na, nb) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])


def _connect(table: pa.Table) -> pa.Table:
    """In each pair of blocks of a sample's documents, as few pairs as connect those of two classes that agree."""
    key, i, j, ids, n, known = (np.asarray(table[c]) for c in ("key", "i", "j", "id", "n", "known"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, SAMPLES)
    by = np.lexsort((ids, j, i, key))
    new = np.logical_or.reduce([x[by][1:] != x[by][:-1] for x in (key, i, j)])
    a, b = [], []
    for left in np.split(by, np.flatnonzero(new) + 1):
        while len(left) > 1 and (known[left] != known[left[0]]).any():
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                k = reached.pop()
                low, high = np.minimum(n[left], n[k]), np.maximum(n[left], n[k])
                near = (known[left] != known[k]) & (low >= SIMILARITY * high - 1e-9) & ((sig[left] == sig[k]).sum(1) >= _least_agreeing(low))
                hit, left = left[near], left[~near]
                reached += hit.tolist()
                a.append(np.full(len(hit), ids[k]))
                b.append(ids[hit])
    none = np.zeros(0, np.int64)
    return pa.table({"a": pa.array(np.concatenate([none, *a])), "b": pa.array(np.concatenate([none, *b]))})


def _in_pairs(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """rows with i and j: each group dealt into blocks of about `most` rows by id and sig, each row once for each pair of blocks it is in."""
    blocks = F.ceil(F.col(size) / most).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id", "sig", group), blocks).cast("int")).withColumn("blocks", blocks)
    others = F.when(F.col("blocks") == 1, F.array("own")).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _connected(rows: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) that connect those of two classes that agree, of rows (key, many, id, n, sig, known) that share a key."""
    dealt = _in_pairs(rows, "key", "many", MEET).withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, total // MEET))))
    return dealt.groupBy("part").applyInArrow(_connect, "a long, b long")


def _align(table: pa.Table) -> pa.Table:
    """Links inside each block of a family, as few as connect what the similarity connects; known classes stay joined."""
    ids, block, known = (table[c].to_pylist() for c in ("id", "block", "known"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, SAMPLES)
    shingles = [own for _, own, _ in shingle_runs(table["text"].combine_chunks())]
    members: dict[str, list[int]] = {}
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        members.setdefault(block[i], []).append(i)
    links: list[tuple[int, int, float]] = []
    for rows in members.values():
        root = {i: i for i in rows}

        def find(i: int, root: dict[int, int] = root) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        seen: dict[int, int] = {}
        for i in rows:
            root[find(i)] = find(seen.setdefault(known[i], i))
        if len(seen) == 1:
            continue
        runs = {i: shingles[i].tolist() for i in rows}
        n, own, sigs = np.array([len(runs[i]) for i in rows]), np.array([find(i) for i in rows]), sig[rows]
        codes = np.unique(np.concatenate([_labelled(shingles[i]) for i in rows]), return_inverse=True)[1]
        first = np.cumsum(n) - n
        mark = np.zeros(int(codes.max()) + 1, bool)
        open_pairs: list[np.ndarray] = []
        for k in range(len(rows) - 1):
            agree = (sigs[k + 1 :] == sigs[k]).sum(1)
            at = np.flatnonzero((own[k + 1 :] != own[k]) & (agree >= _least_agreeing(np.minimum(n[k + 1 :], n[k])))) + k + 1
            if not len(at):
                continue
            # What two documents share without regard to order bounds what they share in order.
            mark[codes[first[k] : first[k] + n[k]]] = True
            common = np.add.reduceat(mark[codes], first)[at]
            mark[:] = False
            at = at[common >= SIMILARITY * (n[at] + n[k]) / (1 + SIMILARITY) - 1e-9]
            open_pairs.append(np.stack([np.full(len(at), k), at, agree[at - k - 1]]))
        x, y, agree = np.concatenate([np.zeros((3, 0), np.int64), *open_pairs], axis=1)
        for k in np.argsort(-agree, kind="stable"):
            i, j = rows[x[k]], rows[y[k]]
            if find(i) != find(j) and (value := similarity(runs[i], runs[j])):
                root[find(j)] = find(i)
                links.append((ids[i], ids[j], value))
    return pa.table({n: pa.array([r[k] for r in links], t) for k, (n, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})


def _left_over(pairs: DataFrame, groups: DataFrame, total: int, texts: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """(rows of _align, their number): all blocks of large families' documents that agree with some of another class, two by two."""
    label = written(texts.where(F.col("size") > BLOCK).select("id").distinct().join(classes, "id", "left").select("id", F.coalesce("class_id", "id").alias("known")), "labels")
    side = lambda s: label.select(F.col("id").alias(s), F.col("known").alias(f"k{s}"))
    few = pairs.join(side("b"), "b").join(side("a"), "a").where("ka <> kb").select("a", "b")
    named = groups.join(label, "id")
    mixed = named.groupBy("key").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x < y").select("key")
    open_pairs = few.unionAll(_connected(named.join(mixed, "key", "left_semi"), total))
    family = connected_components(open_pairs).join(label, "id").join(texts.select("id", "text_hash", "sig"), "id")
    sizes = family.groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    rows = written(_in_pairs(family.join(sizes, "component"), "component", "many", TEXTS).drop("sig"), "left_over")
    block = F.concat_ws("/", "component", "i", "j").alias("block")
    return rows.select("id", "text_hash", "known", block).join(texts.select("id", "text_hash", "sig", "text").hint("merge"), ["id", "text_hash"]), rows.count()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, class_id (the smallest id of its class) and copy_of (the smallest id with the same words).

    Words are runs of bytes other than ASCII white space. A text without words (or null) is a class of its own; one of
    fewer than five words is near only to texts with the same words. Rows with a null id are returned with null
    classes. Rows that repeat an id share its class: that of all texts near any of theirs. Other columns are dropped,
    whatever their names.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    all_sketches = written(ids.mapInArrow(_sketches("id", "text"), "id long, text_hash long, p long, q long, n int, keys array<long>, sig binary"), "sketches")
    sketches = all_sketches.where("id IS NOT NULL AND n > 0")
    total = all_sketches.count()
    # Groups of exact copies only: what has no copy needs no look-up, and the largest groups are looked up by broadcast.
    copies = written(sketches.groupBy("p", "q", "n").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("copy_of")).where("many > 1"), "copies")
    folded = join_hot(sketches, copies, ["p", "q", "n"], "many", total, "left")
    distinct = written(folded.where("copy_of IS NULL OR id = copy_of").select(*sketches.columns).dropDuplicates(["id", "p", "q", "n"]), "distinct")
    kept = join_hot(all_sketches.select("id", "p", "q", "n"), copies, ["p", "q", "n"], "many", total, "left")
    kept = written(kept.select("id", F.when(F.col("n") > 0, F.coalesce("copy_of", "id")).otherwise(F.col("id")).alias("copy_of")), "kept")
    # An id that stands for several texts joins them.
    several = kept.where("id IS NOT NULL").groupBy("id").agg(F.min("copy_of").alias("x"), F.max("copy_of").alias("y")).where("x < y").select("id")
    joined = written(kept.join(several, "id", "left_semi").where("id <> copy_of").select(F.col("id").alias("a"), F.col("copy_of").alias("b")).distinct(), "joined")

    keyed = distinct.select("id", "n", "sig", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared")
    met = written(join_hot(keyed, shared, ["key"], "many", SAMPLES * total), "met")
    side = lambda s: met.where(F.col("many") <= NEAR).select("key", F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))
    near = side("a").join(side("b"), "key").where("a < b").select("a", "b", "na", "nb", "sa", "sb")
    pairs = written(near.mapInArrow(_agreeing, "a long, b long").distinct(), "pairs")
    groups = met.where(F.col("many") > NEAR)
    grouped = groups.count()
    connected = written(_connected(groups.withColumn("known", F.col("id")), grouped), "connected")

    family = connected_components(pairs.unionAll(connected))
    family = family.join(distinct.select("id", "text_hash", "sig"), "id")
    sizes = family.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # Texts are dealt out by id at every size: the plan, and with it the disk it takes, doesn't change as families grow.
    texts = ids.join(family.join(sizes, "component").hint("merge"), ["id", "text_hash"])
    texts = written(texts.dropDuplicates(["id", "text_hash"]), "families")
    links = classes = None
    deal, large = 0, texts.where(F.col("size") > BLOCK).count()
    while True:
        if classes is None:
            todo = texts.withColumn("known", F.col("id"))
        else:
            label = texts.where(F.col("size") > BLOCK).join(classes, "id", "left").withColumn("known", F.coalesce("class_id", "id")).drop("class_id")
            split = label.groupBy("component").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x < y").select("component")
            todo = label.join(split, "component", "left_semi")
        spread = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("id", "sig", F.lit(deal)), F.ceil(F.col("size") / BLOCK))).otherwise(F.lit(0))
        todo = todo.withColumn("block", F.concat_ws("/", "component", spread))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(1, texts.count() // (4 * BLOCK)))))
        new = written(dealt.groupBy("part").applyInArrow(_align, "a long, b long, similarity double"), "links")
        links, found = new if links is None else links.unionAll(new), new.count()
        classes = connected_components(links.select("a", "b").unionAll(joined)).select("id", F.col("component").alias("class_id"))
        deal += 1
        # Dealing only saves alignments: what it leaves is met in full.
        if found * FEW < large or not large:
            break
    rows, left = _left_over(pairs, groups, grouped, texts, classes)
    if left:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(1, left // (2 * TEXTS)))))
        links = links.unionAll(written(dealt.groupBy("part").applyInArrow(_align, "a long, b long, similarity double"), "links"))
        classes = connected_components(links.select("a", "b").unionAll(joined)).select("id", F.col("component").alias("class_id"))
    out = kept.join(classes.select(F.col("id").alias("copy_of"), "class_id"), "copy_of", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "copy_of")).alias("class_id"), F.when(F.col("id").isNotNull(), F.col("copy_of")).alias("copy_of"))
