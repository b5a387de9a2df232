"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from labelled rows: words and word beginnings (3 to 7 letters, so that inflected forms count)
that are far commoner in toxic texts. Features are densities of lexicon hits, how near hits stand to second persons,
and rates of capitals, punctuation and obfuscation; trees and calibration are fitted with Spark ML on a bounded sample of
the labelled rows (SAMPLE rows, those whose ids have the smallest hashes), one part of which is kept for calibration.
Scoring is one pass over the whole texts, in parallel, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import written

#: Labelled rows that the model is fitted on at most, and terms in the lexicon at most.
SAMPLE, TERMS = 8000, 3000
#: Toxic texts that a term must be in, and the least log ratio of its rates.
SUPPORT, RATIO = 6, 2.0
FEATURES = ("hits", "density", "strong_density", "weight", "peak", "near_you", "you_rate", "capitals", "shouted", "marks", "exclaimed", "obfuscated", "digits", "length")
#: Second persons of the corpus's languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tu tus vosotros usted ustedes".split())
#: Letters that digits and signs stand in for.
_LOOKALIKES = str.maketrans("013457@$", "oieastas")
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W_]+[*#$%&@]+|[*#$%&@]{2,}[^\W_]|[^\W\d_]+[0-9@$*]+[^\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def terms(chunk: str) -> list[str]:
    """The words in a chunk without white space, lower-cased; letters that signs stand in for put back."""
    chunk = chunk.lower()
    if chunk.isalpha():
        return [chunk]
    core = _EDGES.sub("", chunk)
    if core.isalpha():
        return [core]
    return _WORD.findall(core.translate(_LOOKALIKES)) if core else []


def beginnings(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return [f"={word}", *(word[:n] for n in range(3, min(7, len(word)) + 1))]


def features(text: str, lexicon: dict[str, float], memo: dict[str, tuple]) -> list[float]:
    """The FEATURES of a text; of an empty one, zeros."""
    chunks = text.split()
    if not chunks:
        return [0.0] * len(FEATURES)
    hits, yous, weight, peak, strong, n = [], [], 0.0, 0.0, 0, 0
    capitals = shouted = odd = 0
    for chunk in chunks:
        found = memo.get(chunk)
        if found is None:
            words = terms(chunk)
            if len(memo) > 200_000:
                memo.clear()
            found = memo[chunk] = (
                [max((lexicon.get(t, 0.0) for t in beginnings(w)), default=0.0) for w in words],
                any(w in YOU for w in words), chunk[:1].isupper(), len(chunk) > 2 and chunk.isupper(), bool(_ODD.search(chunk)))
        for w in found[0]:
            if w:
                hits.append(n)
                weight += w
                peak = max(peak, w)
                strong += w > 2 * RATIO
            n += 1
        if found[1]:
            yous.append(n - 1)
        capitals += found[2]
        shouted += found[3]
        odd += found[4]
    near, k = 0, 0
    for h in hits:
        while k + 1 < len(yous) and abs(yous[k + 1] - h) <= abs(yous[k] - h):
            k += 1
        near += bool(yous) and abs(yous[k] - h) <= 5
    size, total = len(chunks), len(text)
    marks = sum(map(text.count, ".,;:!?*#$%&@|"))
    digits = sum(map(text.count, "0123456789"))
    return [float(len(hits)), len(hits) / size, strong / size, weight / size, peak, near / size, len(yous) / size, capitals / size, shouted / size, marks / total, text.count("!") / total, odd / size, digits / total, math.log1p(size)]


def _with_features(docs: DataFrame, lexicon: dict[str, float], id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            rows = [features(t.as_py() or "", sent.value, memo) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[id_col, "features"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, features array<double>")


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """{term: log ratio of its rates in toxic and other texts} from (text, toxic); counted once for each text."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], schema=schema)
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
                words = {w for chunk in (text or "").split() for w in terms(chunk)}
                (toxic if label else clean).update({t for w in words for t in beginnings(w)})
                if len(toxic) + len(clean) > 300_000:
                    yield rows()
        yield rows()

    sizes = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["n"] or not sizes["t"] or sizes["t"] == sizes["n"]:
        return {}
    counts = labelled.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (sizes["t"] + 1)) - F.log((F.col("clean") + 0.5) / (sizes["n"] - sizes["t"] + 1))
    best = counts.where(F.col("toxic") >= SUPPORT).select("term", ratio.alias("ratio"), "toxic").where(F.col("ratio") >= RATIO)
    return {r["term"]: r["ratio"] for r in best.orderBy(F.desc(F.col("ratio") * F.sqrt("toxic")), "term").limit(TERMS).collect()}


def held_out(id_col: str) -> Column:
    """Whether a row's label is kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """A row for each document: id_col, held_out (boolean), score (double, 0 to 1) and features (array<double>).

    Labels are learned from rows that aren't held out, at most `sample` of them; ids, languages and sources are no
    features. Null and empty texts have features of zero and are scored like others. Rows with a null id or label
    teach nothing; of an id with several labels, the largest counts. Without labels of both kinds every score is the
    share of toxic labels (0.0 without labels). Repeated rows are scored alike and all returned; of an id with several
    texts, the first in order teaches. The lexicon has at most TERMS terms, the weightiest. Other columns are dropped.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    # The sample is bounded by a parameter, so it may be sent to every task.
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).groupBy(id_col, "toxic").agg(F.min("text").alias("text"))
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))), "labelled")
    fit_rows = rows.where("part <> 0")
    lexicon = learn_lexicon(fit_rows.dropDuplicates(["text"]).repartition(6))
    featured = _with_features(docs, lexicon, id_col, text_col).withColumn("held_out", held_out(id_col))
    share = rows.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    if not lexicon or not 0 < share < 1:
        return featured.select(id_col, "held_out", F.lit(float(share)).alias("score"), "features")
    table = written(_with_features(rows, lexicon, id_col, "text").join(rows.select(id_col, F.col("toxic").cast("double").alias("label"), "part"), id_col).withColumn("x", array_to_vector("features")).coalesce(2), "features")
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=12, maxDepth=3, maxBins=64, stepSize=0.3, seed=7).fit(table.where("part <> 0"))
    raw = vector_to_array("probability")[1]
    calibration = trees.transform(table.where("part = 0")).select(raw.alias("p"), "label")
    if calibration.isEmpty():
        calibration = trees.transform(table).select(raw.alias("p"), "label")
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(calibration)
    scored = isotonic.transform(trees.transform(featured.withColumn("x", array_to_vector("features"))).withColumn("p", raw))
    # A calibrated step function ties many texts; what remains of the trees' order breaks the ties without crossing steps.
    return scored.select(id_col, "held_out", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * 0.999 + F.col("p") * 0.001)).alias("score"), "features")
