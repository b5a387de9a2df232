"""Ranking: vectors, BM25 with a phrase clause, weighted reciprocal ranks, fused scores, validity after fusion.

All operators take many queries at once. Vectors meet queries in blocks: items are dealt into slices, queries into blocks
of QUERY_BLOCK, and each pair of a slice and a block is one matrix product whose best rows leave the task. BM25 explodes the
tokens where the text is and keeps those that a query has before anything is shuffled. Phrases are looked up by their
rarest word. Only a table of terms of checked size is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tempora.functions.text import tokens
from tempora.operators.graph import expansion
from tempora.session import settled

K1, B = 1.2, 0.75
#: Reciprocal ranks: the constant, and the weights of the two branches.
RRF, DENSE, SPARSE = 60, 1.0, 0.1
#: Queries and items that meet in one task, and rows of a table that may be broadcast.
QUERY_BLOCK, ITEM_SLICE, BROADCAST_ROWS = 512, 65_536, 100_000
#: Scores of queries and items that a task holds at once.
CELLS = 1_000_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def small(rows: DataFrame) -> DataFrame:
    """A table that is joined by its key, marked for broadcast if its size allows; beyond, it is joined by shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def vector_pool(queries: DataFrame, items: DataFrame, pool: int, metric: str = "cosine") -> DataFrame:
    """(query, id, score, rank): the pool best items of each query (query, vector), by 'cosine' or 'l2'.

    Every item meets each stated query once, in matrix products of bounded size; vectors of a query's length take part.
    A vector without length has no cosine.
    """
    n_items, n_queries = items.count(), queries.count()
    slices, blocks = max(1, -(-n_items // ITEM_SLICE)), max(1, -(-n_queries // QUERY_BLOCK))
    sound = lambda df, key: df.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(F.col(key), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("wide"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = sound(items, "id").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("block", upto(blocks))
    right = sound(queries, "query").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("slice", upto(slices))
    by = ("slice", "block", "wide")

    def best(item: pa.Table, query: pa.Table) -> pa.Table:
        take_query, take_item, scores = [], [], []
        if item.num_rows and query.num_rows:
            x, q = (np.asarray(t["vector"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (item, query))
            ids = np.asarray(item["id"])
            if metric == "cosine":
                norms = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None]
                score = np.divide(q @ x.T, norms, out=np.full(norms.shape, np.nan), where=norms > 0)
            else:
                score = np.stack([-np.sqrt(((x - v) ** 2).sum(1)) for v in q])
            score = np.round(score, 9)
            for k, row in enumerate(score):
                order = np.lexsort((ids, -row))[:pool]
                order = order[~np.isnan(row[order])]
                take_query += [k] * len(order)
                take_item += order.tolist()
                scores += row[order].tolist()
        return pa.table({"query": query["query"].take(pa.array(take_query, pa.int64())), "id": item["id"].take(pa.array(take_item, pa.int64())), "score": pa.array(scores, pa.float64())})

    kinds = f"query {queries.schema['query'].dataType.simpleString()}, id {items.schema['id'].dataType.simpleString()}, score double"
    return ranked(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, kinds), pool)


def ranked(scores: DataFrame, pool: int) -> DataFrame:
    """The pool best of each query, ranked from 0, ties by id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")) - 1
    return scores.withColumn("rank", rank).where(F.col("rank") < pool)


def postings(items: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, dl) of items (id, text), of all terms or of those wanted (term), which are picked before anything is shuffled."""
    words = items.select("id", tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    rows = words.select("id", "dl", F.explode("w").alias("term"))
    rows = rows if wanted is None else rows.join(small(wanted), "term", "left_semi")
    return rows.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, items: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score) for queries (query, text): each distinct query term counts once; only items that share a term appear."""
    terms = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    sizes = items.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    lists = postings(items, wanted)
    return _summed(lists.join(lists.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").join(small(terms), "term").join(F.broadcast(sizes), F.lit(True)), k1, b)


def _summed(met: DataFrame, k1: float, b: float) -> DataFrame:
    """(query, id, score) of postings beside their queries, document frequencies and sizes of the corpus."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query", "id").agg(F.sum(part).alias("score"))


def _lines(items: DataFrame) -> DataFrame:
    """(id, dl, line): the tokens of items (id, text) as one string, for tasks that count them."""
    return items.select("id", tokens(F.col("text")).alias("w")).select("id", F.size("w").cast("long").alias("dl"), F.array_join("w", " ").alias("line"))


def _counted(batch: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the place in words and the number of each distinct word of a batch of lines, by row and place."""
    parts = pc.split_pattern(batch.column("line"), " ")
    at = pc.index_in(pc.list_flatten(parts), value_set=words)
    known = np.asarray(at.is_valid())
    key = np.asarray(pc.list_parent_indices(parts), np.int64)[known] * len(words) + np.asarray(at.drop_null(), np.int64)
    key, n = np.unique(key, return_counts=True)
    return key // len(words), key % len(words), n


class _Corpus:
    """What BM25 needs to know of all items before it can score one: how many have a term, how many there are, how long they are.

    The terms of the queries are gathered on the driver; a task over items sends a row for each. Rows that repeat an id are kept
    apart (`repeated`), as their counts belong together; all other items (`single`) are scored where their text is read.
    """

    def __init__(self, terms: DataFrame, items: DataFrame):
        asked = terms.orderBy("query", "term").collect()
        self.queries, self.words = list(dict.fromkeys(r["query"] for r in asked)), sorted({r["term"] for r in asked})
        place, number = {t: i for i, t in enumerate(self.words)}, {q: i for i, q in enumerate(self.queries)}
        self.asked = sorted((place[r["term"]], number[r["query"]]) for r in asked)
        items = items.select("id", "text")
        twice = items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        self.single, self.repeated = items, None
        if not twice.isEmpty():
            self.single, self.repeated = (items.join(small(twice), "id", how) for how in ("left_anti", "left_semi"))
        words = self.words

        def sizes(batches):
            df, n, dl = np.zeros(len(words), np.int64), 0, 0
            known = pa.array(words, pa.string())
            for batch in batches:
                n, dl = n + batch.num_rows, dl + int(np.asarray(batch.column("dl")).sum())
                if words:
                    df += np.bincount(_counted(batch, known)[1], minlength=len(words))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"at": pa.array([-2, -1, *some.tolist()], pa.int64()), "n": pa.array([n, dl, *df[some].tolist()], pa.int64())})

        found = {r["at"]: r["n"] for r in _lines(self.single).mapInArrow(sizes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
        n, dl = found.get(-2, 0), found.get(-1, 0)
        self.df = np.array([found.get(i, 0) for i in range(len(words))], np.int64)
        if self.repeated is not None:
            more = self.repeated.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).first()
            n, dl = n + more["n"], dl + (more["dl"] or 0)
            for r in postings(self.repeated, terms.select("term").distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
                self.df[place[r["term"]]] += r["df"]
        self.n, self.avgdl, self.terms = n, dl / n if n else 0.0, terms

    def scored(self, items: DataFrame, k1: float, b: float, pairs: DataFrame | None = None) -> DataFrame:
        """(query, id, score) of some of the items, by shuffle; of some pairs (query, id) only, if stated."""
        spark = items.sparkSession
        df = spark.createDataFrame([(t, int(x)) for t, x in zip(self.words, self.df) if x], "term string, df long")
        sizes = spark.createDataFrame([(self.n, self.avgdl)], "n long, avgdl double")
        met = postings(items, self.terms.select("term").distinct()).join(F.broadcast(df), "term").join(F.broadcast(sizes), F.lit(True)).join(small(self.terms), "term")
        return _summed(met if pairs is None else met.join(small(pairs.select("query", "id").distinct()), ["query", "id"], "left_semi"), k1, b)

    def best(self, pool: int, k1: float, b: float) -> DataFrame:
        """(query, id, score) of the single items: each task's `pool` best of each query."""
        words, queries, n, avgdl = self.words, self.queries, self.n, self.avgdl
        idf = np.log(1 + (n - self.df + 0.5) / (self.df + 0.5))
        of, who = np.array([t for t, _ in self.asked], np.int64), np.array([q for _, q in self.asked], np.int64)
        first = np.searchsorted(of, np.arange(len(words) + 1))
        kinds = self.terms.schema["query"].dataType, self.single.schema["id"].dataType
        many, at_once = np.diff(first), max(1, CELLS // max(1, len(queries)))

        def task(batches):
            known, held = pa.array(words, pa.string()), None
            for batch in batches:
                row, term, tf = _counted(batch, known)
                dl = np.asarray(batch.column("dl"))[row]
                part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                for start in range(0, batch.num_rows, at_once):
                    wide = min(at_once, batch.num_rows - start)
                    x, y = np.searchsorted(row, [start, start + wide])
                    times, terms = many[term[x:y]], term[x:y]
                    upto = np.cumsum(times)
                    query = who[np.arange(upto[-1] if len(upto) else 0) + np.repeat(first[terms] - upto + times, times)]
                    score = np.bincount(query * wide + np.repeat(row[x:y] - start, times), np.repeat(part[x:y], times), len(queries) * wide).reshape(len(queries), wide)
                    score = np.round(score, 9)
                    least = np.partition(score, wide - pool, axis=1)[:, wide - pool] if wide > pool else np.zeros(len(queries))
                    q, i = np.nonzero((score >= least[:, None]) & (score > 0))
                    new = pa.table({"q": q, "id": batch.column("id").take(pa.array(start + i)), "score": score[q, i]})
                    held = new if held is None else pa.concat_tables([held, new])
                    if held.num_rows > 8 * pool * len(queries):
                        held = first_of(held)
            if held is not None:
                held = first_of(held)
                yield from pa.table({"query": pa.array(queries).cast(to_arrow_type(kinds[0])).take(held["q"]), "id": held["id"], "score": held["score"]}).to_batches()

        def first_of(held: pa.Table) -> pa.Table:
            held = held.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
            q = np.asarray(held["q"])
            return held.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < pool))

        return _lines(self.single).mapInArrow(task, f"query {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double")


def bm25_pool(queries: DataFrame, items: DataFrame, pool: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score, rank): the pool best items of each query by bm25, rounded to nine places; ties by id.

    An item is scored where its text is read, so that a task sends its best rows only, not a row for each query and item.
    Where the queries have more terms than may be broadcast, all is done by shuffle.
    """
    terms = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    if terms.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return ranked(bm25(queries, items, k1, b).withColumn("score", F.round("score", 9)), pool)
    corpus = _Corpus(terms, items)
    found = corpus.best(pool, k1, b)
    if corpus.repeated is not None:
        found = found.unionByName(corpus.scored(corpus.repeated, k1, b).withColumn("score", F.round("score", 9)))
    return ranked(found, pool)


def bm25_of(queries: DataFrame, items: DataFrame, pairs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score) as bm25 over all items, of the pairs (query, id) only: other items are counted, not scored."""
    terms = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    if terms.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return bm25(queries, items, k1, b).join(pairs.select("query", "id").distinct(), ["query", "id"], "left_semi")
    near = items.select("id", "text").join(small(pairs.select("id").distinct()), "id", "left_semi")
    return _Corpus(terms, items).scored(near, k1, b, pairs)


def phrase_bonus(queries: DataFrame, items: DataFrame, bonus: float) -> DataFrame:
    """(query, id, score): the bonus where the query's words stand in an item one after the other."""
    line = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    asked = queries.select("query", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    lists = postings(items, asked.select(F.explode("w").alias("term")).distinct())
    # A phrase is looked for only in items that have its rarest word; one with a word that no item has is nowhere.
    df = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = asked.select("query", "w", F.explode(F.array_distinct("w")).alias("term")).join(df, "term", "left")
    rare = words.groupBy("query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rare"), F.first("w").alias("w")).where("rare.df > 0")
    hits = lists.select("term", "id").join(rare.select("query", line(F.col("w")).alias("phrase"), F.col("rare.term").alias("term")), "term")
    met = items.select("id", line(tokens(F.col("text"))).alias("line")).join(hits, "id").where(F.expr("contains(line, phrase)"))
    return met.select("query", "id", F.lit(bonus).alias("score"))


def rrf(branches: dict[str, tuple[DataFrame, float]], k: int = RRF) -> DataFrame:
    """(query, id, score, first_seen): sums of weight / (k + rank) over ranked branches; a weight of 0 removes its branch.

    first_seen orders ties as the branches were given, then by rank.
    """
    parts = None
    for n, (rows, weight) in enumerate(branches.values()):
        if weight:
            part = rows.select("query", "id", (F.lit(weight) / (k + F.col("rank"))).alias("part"), (F.lit(n * 1_000_000) + F.col("rank")).alias("seen"))
            parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("query", "id").agg(F.sum("part").alias("score"), F.min("seen").alias("first_seen"))


def min_max(scores: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within a query; a branch of equal scores becomes 1."""
    window = Window.partitionBy("query")
    low, high = F.min("score").over(window), F.max("score").over(window)
    return scores.withColumn("score", F.when(high - low < 1e-12, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fused(sparse: DataFrame, dense: DataFrame, weight: float = 0.75) -> DataFrame:
    """weight * scaled sparse + (1 - weight) * scaled dense; a missing branch counts 0."""
    s = min_max(sparse).select("query", "id", F.col("score").alias("s"))
    d = min_max(dense).select("query", "id", F.col("score").alias("d"))
    return s.join(d, ["query", "id"], "full").select("query", "id", (weight * F.coalesce("s", F.lit(0.0)) + (1 - weight) * F.coalesce("d", F.lit(0.0))).alias("score"))


def hybrid(queries: DataFrame, items: DataFrame, valid: Column, k: int = 6, sparse_weight: float = SPARSE, scope: Column | None = None, validity: str = "post") -> DataFrame:
    """(query, id, score, place): vectors and BM25 fused, validity applied, cut to k.

    queries: (query, text, vector); items: (id, text, vector, ...), with the columns that `valid` and `scope` use. A scope
    narrows the items before ranking. validity 'post' filters the fused pools, as the product does, so that fewer than k
    may remain; 'pre' filters before ranking.
    """
    pool = max(3 * k, 15) if scope is None else max(2 * k, 8)
    inside = items if scope is None else items.where(scope)
    inside = inside.where(valid) if validity == "pre" else inside
    dense = vector_pool(queries, inside, pool)
    sparse = bm25_pool(queries, inside, pool)
    both = rrf({"dense": (dense, DENSE), "sparse": (sparse, sparse_weight)})
    kept = both.join(items.where(valid).select("id"), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first_seen"))
    return kept.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "score", "place")


def sweep(dense: DataFrame, sparse: DataFrame, weights: list[float]) -> DataFrame:
    """Both branches fused for every sparse weight: (weight, query, id, score); the branches are ranked once."""
    grid = dense.sparkSession.createDataFrame([(w,) for w in weights], "weight double")
    both = dense.select("query", "id", "rank", F.lit(0).alias("branch")).unionAll(sparse.select("query", "id", "rank", F.lit(1).alias("branch")))
    part = F.when(F.col("branch") == 0, F.lit(DENSE)).otherwise(F.col("weight")) / (RRF + F.col("rank"))
    met = both.join(F.broadcast(grid), F.lit(True)).where((F.col("branch") == 0) | (F.col("weight") > 0))
    return met.groupBy("weight", "query", "id").agg(F.sum(part).alias("score"))


def graph_augmented(queries: DataFrame, items: DataFrame, edges: DataFrame, valid: Column, k: int = 6, extra: int = 3, sparse_weight: float = SPARSE) -> DataFrame:
    """(query, id, part, place): the hybrid's hits, then up to `extra` more from the documents one edge away from theirs.

    queries: (query, text, vector); items: (id, doc, text, vector, ...). The neighbours are ranked like a scoped search of
    their own, each query within its own scope: pairs of a query and an item meet by document, not all with all.
    """
    base = settled(hybrid(queries, items, valid, k, sparse_weight), "hybrid")
    seeds = base.join(items.select("id", "doc"), "id").select("query", F.col("doc").alias("id")).distinct()
    near = expansion(edges, seeds).select("query", F.col("id").alias("doc"))
    pool = max(2 * extra, 8)
    scope = near.join(items.select("id", "doc", "vector"), "doc").join(queries.select("query", F.col("vector").alias("q")), "query")
    scope = settled(scope.select("query", "id", F.round(cosine(F.col("q"), F.col("vector")), 9).alias("dense")), "scope")
    scored = scope.join(bm25_of(queries, items, scope).select("query", "id", F.round("score", 9).alias("sparse")), ["query", "id"], "left")
    at = lambda name: F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last(name), "id")) - 1
    both = scored.withColumns({"d": at("dense"), "s": at("sparse")})
    part = lambda rank, weight, has: F.when(has & (F.col(rank) < pool), weight / (RRF + F.col(rank)))
    both = both.withColumns({"d_part": part("d", DENSE, F.col("dense").isNotNull()), "s_part": part("s", sparse_weight, F.col("sparse").isNotNull())}).where("d_part IS NOT NULL OR s_part IS NOT NULL")
    seen = F.least(F.when(F.col("d_part").isNotNull(), F.col("d")), F.when(F.col("s_part").isNotNull(), 1_000_000 + F.col("s")))
    both = both.select("query", "id", (F.coalesce("d_part", F.lit(0.0)) + F.coalesce("s_part", F.lit(0.0))).alias("score"), seen.alias("first_seen")).join(items.where(valid).select("id"), "id", "left_semi")
    more = both.join(base.select("query", "id"), ["query", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first_seen"))
    more = more.withColumn("place", place).where(F.col("place") <= extra)
    return base.select("query", "id", F.lit("base").alias("part"), "place").unionAll(more.select("query", "id", F.lit("extra"), "place"))
