"""URL filtering: rules first, then the ratio of two character language models.

Both models are variable-order Markov models over the characters of URLs with Witten-Bell interpolation: the
probability of a character after a context of up to ORDER characters mixes the counts of that context with the
probability after the context without its first character, weighted by how many different characters follow it. The
models are trained on the URLs that the rules accept and reject, but for one in HELD_OUT, by a hash of the URL. A URL's
score is the mean log-likelihood difference of its characters; it is allowed where the score reaches a threshold that is
calibrated on the URLs held out: the midpoint between the mean scores of the accepted and of the rejected among them.

DataFrame functions only. URLs are counted once with their multiplicity, n-grams once over the whole corpus, so that
the joins meet each n-gram once for each distinct URL that has it. Those that all URLs have, such as the beginning, are
looked up by broadcast, and so are URLs that many pages have; hot keys never land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import join_hot, written

ORDER, HELD_OUT = 4, 5
#: The alphabet that the lowest order spreads its remaining probability over.
ALPHABET = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "\u0002"


def url_host(url: str) -> Column:
    """What lies between the first :// and the next /, ? or #, with A to Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: str) -> Column:
    """What follows the host, up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; rules are (verdict, 'host/path...')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _models(grams: DataFrame) -> DataFrame:
    """(gram, llr): log P(last character | context, accepted) - log P(..., rejected), for each gram of ORDER + 1 characters."""
    scored = grams.select("gram", F.lit(1.0 / ALPHABET).alias("p_good"), F.lit(1.0 / ALPHABET).alias("p_bad"))
    for k in range(ORDER + 1):
        tail = F.right("gram", F.lit(k + 1))
        seen = grams.groupBy(tail.alias("tail")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        contexts = seen.groupBy(F.left("tail", F.lit(k)).alias("context")).agg(*(f(c).alias(n) for c in ("good", "bad") for f, n in ((F.sum, f"all_{c}"), (lambda c: F.sum((F.col(c) > 0).cast("long")), f"kinds_{c}"))))
        level = seen.withColumn("context", F.left("tail", F.lit(k))).join(contexts, "context")
        scored = scored.withColumn("tail", tail).join(level, "tail")
        mixed = lambda c: F.when(F.col(f"all_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"p_{c}"))
        scored = scored.select("gram", mixed("good").alias("p_good"), mixed("bad").alias("p_bad"))
    return scored.select("gram", (F.log("p_good") - F.log("p_bad")).alias("llr"))


def held_out(url: str) -> Column:
    """1 for the URLs that calibrate the threshold and teach the models nothing, else 0."""
    return (F.pmod(F.crc32(F.col(url).cast("binary")), F.lit(HELD_OUT)) == 0).cast("int")


def calibrated() -> Column:
    """The threshold, an aggregate over judged pages (url, ruled, score): from held-out ones, or all where a kind is missing; 0.0 without both kinds."""
    mean = lambda what, some: F.avg(F.when((F.col("ruled") == what) & some, F.col("score")))
    held = held_out("url") == 1
    return F.coalesce(*((mean("allow", some) + mean("block", some)) / 2 for some in (held, F.lit(True))), F.lit(0.0))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each page: id_col, url, host, path, rule, score (double) and verdict ('allow' or 'block').

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest that fits decides,
    and pages without one are judged by score. A null URL, or one without ://, has an empty host and path; a URL
    without characters, or any URL where the rules accept or reject nothing, scores 0.0 and is allowed. Repeated rows
    are judged alike and all returned. Other columns are dropped.
    """
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = url_host("url"), url_path("url")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = read.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    urls = judged.groupBy("url").agg(F.count(F.lit(1)).alias("times"), F.first("ruled").alias("ruled")).where("url IS NOT NULL AND url <> ''")
    # Characters as an array: taking a slice costs the same wherever it lies, so that long URLs take linear time.
    characters = F.concat(F.array(*[F.lit(START)] * ORDER), F.split("url", ""))
    urls = urls.withColumn("learn", held_out("url") == 0).withColumn("characters", characters)
    places = F.sequence(F.lit(1), F.size("characters") - ORDER)
    gram = lambda i: F.array_join(F.slice("characters", i, F.lit(ORDER + 1)), "")
    grams = urls.select("url", "times", "ruled", "learn", F.explode(F.transform(places, gram)).alias("gram"))
    count = lambda what: F.sum(F.when((F.col("ruled") == what) & F.col("learn"), F.col("times")).otherwise(0))
    counts = written(grams.groupBy("gram").agg(count("allow").alias("good"), count("block").alias("bad"), F.count(F.lit(1)).alias("many")), "grams")
    models = written(_models(counts).join(counts.select("gram", "many"), "gram"), "models")
    total = counts.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    scores = join_hot(grams.select("url", "gram"), models, ["gram"], "many", total).groupBy("url").agg(F.avg("llr").alias("score"))
    scores = written(scores.join(urls.select("url", "times"), "url"), "scores")
    judged = join_hot(judged, scores, ["url"], "times", read.count(), "left").drop("times")
    out = written(judged.withColumn("score", F.coalesce("score", F.lit(0.0))), "judged")
    cut = out.agg(calibrated().alias("cut")).first()["cut"]
    return out.select(F.col("id").alias(id_col), "url", "host", "path", "rule", "score", F.coalesce("ruled", F.when(F.round(F.col("score") - F.lit(cut), 9) >= 0, "allow").otherwise("block")).alias("verdict"))
