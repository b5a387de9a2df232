"""A persistent inverted index: postings by term, kept current in segments, with BM25 and phrases served from it alone.

The index is a folder of immutable segments and a chain of manifests. A segment holds the postings of a load (term, doc, tf,
positions, dl), bucketed by a hash of the term and sorted by term within a bucket, and the length of each of its documents.
A load is the difference between the corpus and what the index knows by fingerprints: new and changed documents are indexed
in a segment of their own, and each document that the load touches is noted in the manifest's tombstones with the load's
number, so that older postings of it no longer count. Segments are merged in levels: when FANOUT segments of a level are
there, they become one of the next level, without what is dead in them; a posting is rewritten once for each level.

A manifest names the live segments. It is written under a new name and made current by one rename, so that readers see the
state before a load or after it, never half of one, and a load that failed leaves nothing but files that the next one drops.
Queries read the buckets of their own terms only, with the term pushed down to the files, and never a text.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.text import tokens
from tempora.operators.retrieval import B, K1, small

#: Segments of one level that are merged into one of the next.
FANOUT = 4
POSTINGS = "term string, doc long, tf int, dl int, positions array<int>, bucket int"
LENGTHS = "doc long, dl int, fingerprint string"
TOMBSTONES = "doc long, seq int"


class Busy(RuntimeError):
    """Another load has made its manifest current meanwhile."""


@dataclass
class Segment:
    """One immutable part of the index: its folder, the number of the newest load in it, and how often it was merged."""

    name: str
    seq: int
    level: int


@dataclass
class Manifest:
    version: int = 0
    buckets: int = 64
    segments: list[Segment] = field(default_factory=list)
    #: Folders of (doc, seq): postings of doc in segments older than seq are dead.
    tombstones: list[str] = field(default_factory=list)


class TextIndex:
    """An index in a shared folder. Documents are (doc long, text string); a null text has no terms."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    # Files

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return hadoop, hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        hadoop, files = self._fs()
        where = hadoop(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []

    def manifest(self) -> Manifest:
        """The current manifest: that of the greatest version."""
        names = [n for n in self._names(f"{self.path}/manifests") if n.endswith(".json")]
        if not names:
            return Manifest(buckets=self._buckets)
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect())
        raw = json.loads(text)
        return Manifest(raw["version"], raw["buckets"], [Segment(**s) for s in raw["segments"]], raw["tombstones"])

    def _publish(self, manifest: Manifest) -> None:
        """Make a manifest current by one rename; raises where its version is taken."""
        hadoop, files = self._fs()
        folder = f"{self.path}/manifests"
        files.mkdirs(hadoop(folder))
        staged, final = hadoop(f"{folder}/.{uuid.uuid4().hex}"), hadoop(f"{folder}/{manifest.version:09d}.json")
        out = files.create(staged, False)
        out.write(bytearray(json.dumps({"version": manifest.version, "buckets": manifest.buckets, "segments": [s.__dict__ for s in manifest.segments], "tombstones": manifest.tombstones}).encode()))
        out.close()
        if files.exists(final) or not files.rename(staged, final):
            files.delete(staged, False)
            raise Busy(str(manifest.version))

    def collect_garbage(self) -> list[str]:
        """Drop the folders that the current manifest doesn't name: what failed loads, merges and older versions left."""
        hadoop, files = self._fs()
        now = self.manifest()
        live = {s.name for s in now.segments} | set(now.tombstones)
        dead = [n for n in self._names(f"{self.path}/parts") if n not in live]
        for name in dead:
            files.delete(hadoop(f"{self.path}/parts/{name}"), True)
        for name in self._names(f"{self.path}/manifests")[:-1]:
            files.delete(hadoop(f"{self.path}/manifests/{name}"), False)
        return dead

    # Loads

    def _part(self, name: str, what: str) -> str:
        return f"{self.path}/parts/{name}/{what}"

    def _write_segment(self, postings: DataFrame, lengths: DataFrame, seq: int, level: int, buckets: int) -> Segment:
        name = f"segment-{seq:09d}-{uuid.uuid4().hex[:8]}"
        rows = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        rows = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc"), F.lit(_spread(rows, buckets)))).sortWithinPartitions("bucket", "term", "doc")
        rows.select("term", "doc", "tf", "dl", "positions", "bucket").write.partitionBy("bucket").parquet(self._part(name, "postings"))
        lengths.select("doc", "dl", "fingerprint").write.parquet(self._part(name, "lengths"))
        return Segment(name, seq, level)

    def lengths(self, manifest: Manifest | None = None) -> DataFrame:
        """(doc, dl, fingerprint) of the documents that the index has now."""
        return self._alive("lengths", LENGTHS, manifest or self.manifest())

    def postings(self, manifest: Manifest | None = None) -> DataFrame:
        """(term, doc, tf, dl, positions, bucket) that count now."""
        return self._alive("postings", POSTINGS, manifest or self.manifest())

    def _alive(self, what: str, ddl: str, now: Manifest, segments: list[Segment] | None = None) -> DataFrame:
        out = None
        for s in segments if segments is not None else now.segments:
            part = self.spark.read.schema(ddl).parquet(self._part(s.name, what)).withColumn("seq", F.lit(s.seq))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], ddl)
        columns = [c for c in out.columns if c != "seq"]
        if not now.tombstones:
            return out.select(*columns)
        graves = self.spark.read.schema(TOMBSTONES).parquet(*(self._part(t, "docs") for t in now.tombstones)).groupBy("doc").agg(F.max("seq").alias("since"))
        return out.join(small(graves), "doc", "left").where("since IS NULL OR seq >= since").select(*columns)

    def load(self, documents: DataFrame) -> dict[str, int]:
        """Bring the index to these documents (doc, text): returns how many are new, changed and gone.

        doc must be unique and not null. A load without differences writes nothing. A load that fails anywhere leaves the
        index as it was; run again, it does the same.
        """
        now = self.manifest()
        docs = documents.select("doc", F.coalesce("text", F.lit("")).alias("text"))
        prints = docs.select("doc", F.md5("text").alias("fingerprint"))
        known = self.lengths(now).select("doc", F.col("fingerprint").alias("old"))
        change = F.when(F.col("old").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("old") != F.col("fingerprint"), "changed")
        plan = known.join(prints, "doc", "full").select("doc", change.alias("change")).where("change IS NOT NULL")
        seq = now.version + 1
        staged = f"plan-{seq:09d}-{uuid.uuid4().hex[:8]}"
        plan.write.partitionBy("change").parquet(self._part(staged, "docs"))
        plan = self.spark.read.schema("doc long, change string").parquet(self._part(staged, "docs"))
        counts = {r["change"]: r["n"] for r in plan.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = {k: counts.get(k, 0) for k in ("new", "changed", "gone")}
        if not counts:
            return done
        fresh = docs.join(plan.where("change <> 'gone'").select("doc"), "doc", "left_semi").withColumn("w", tokens(F.col("text")))
        words = fresh.select("doc", F.size("w").alias("dl"), F.posexplode("w").alias("at", "term"))
        postings = words.groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
        segment = self._write_segment(postings, fresh.select("doc", F.size("w").alias("dl"), F.md5("text").alias("fingerprint")), seq, 0, now.buckets)
        tombstones = list(now.tombstones)
        if done["changed"] + done["gone"]:
            name = f"graves-{seq:09d}-{uuid.uuid4().hex[:8]}"
            plan.where("change <> 'new'").select("doc", F.lit(seq).alias("seq")).write.parquet(self._part(name, "docs"))
            tombstones.append(name)
        self._publish(Manifest(seq, now.buckets, [*now.segments, segment], tombstones))
        self._merge()
        return done

    def _merge(self) -> None:
        """Merge the segments of a level, as long as one has FANOUT of them; with one segment left, tombstones are paid off."""
        while True:
            now = self.manifest()
            full = next((level for level in sorted({s.level for s in now.segments}) if sum(s.level == level for s in now.segments) >= FANOUT), None)
            if full is None:
                return
            old = [s for s in now.segments if s.level == full]
            rest = [s for s in now.segments if s.level != full]
            # The merged segment counts as old as the youngest in it: what older tombstones kill is left out here.
            merged = self._write_segment(self._alive("postings", POSTINGS, now, old), self._alive("lengths", LENGTHS, now, old), max(s.seq for s in old), full + 1, now.buckets)
            graves = now.tombstones if rest else []
            self._publish(Manifest(now.version + 1, now.buckets, [*rest, merged], graves))

    # Queries

    def coverage(self, documents: DataFrame) -> DataFrame:
        """(state, docs): how many documents are 'indexed', 'stale', 'missing' from the index, or 'extra' in it."""
        prints = documents.select("doc", F.md5(F.coalesce("text", F.lit(""))).alias("now"))
        met = self.lengths().join(prints, "doc", "full")
        state = F.when(F.col("fingerprint").isNull(), "missing").when(F.col("now").isNull(), "extra").when(F.col("fingerprint") != F.col("now"), "stale").otherwise("indexed")
        return met.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("docs"))

    def of_terms(self, terms: DataFrame, now: Manifest) -> DataFrame:
        """The postings of terms (term): files of other buckets aren't opened, other terms are filtered where they are read."""
        wanted = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(now.buckets)).cast("int"))
        return self.postings(now).join(small(wanted), ["bucket", "term"], "left_semi").drop("bucket")

    def bm25(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(query, id, score) of queries (query, text), as operators.retrieval.bm25 over the texts."""
        now = self.manifest()
        terms = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        lists = self.of_terms(terms, now)
        df = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        sizes = self.lengths(now).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        met = lists.drop("positions").join(df, "term").join(small(terms), "term").join(F.broadcast(sizes), F.lit(True))
        return met.groupBy("query", F.col("doc").alias("id")).agg(F.sum(part).alias("score"))

    def phrases(self, queries: DataFrame) -> DataFrame:
        """(query, id, times): how often the words of each query (query, text) stand in a document one after the other.

        Positions less their place in the phrase must agree for all words; words are met by document and that difference,
        so that only documents which have the words where they belong are gathered.
        """
        now = self.manifest()
        words = queries.select("query", F.posexplode(tokens(F.col("text"))).alias("place", "term"))
        length = words.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
        lists = self.of_terms(words, now)
        starts = lists.select("term", "doc", F.explode("positions").alias("at")).join(small(words), "term").withColumn("start", F.col("at") - F.col("place"))
        whole = starts.groupBy("query", "doc", "start").agg(F.count(F.lit(1)).alias("found")).join(small(length), "query").where("found = size")
        return whole.groupBy("query", F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("times"))


def _spread(rows: DataFrame, buckets: int) -> int:
    """Files of a bucket that a load writes: one for each shuffle partition beyond a bucket's own, so that a hot term is several files."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, -(-partitions // buckets))
