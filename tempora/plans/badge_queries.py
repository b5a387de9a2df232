"""Page marks and repeated units among sentences of documents, numbered as articles, clauses and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import badges as B
from tempora.plans.catalog import query
from tempora.session import table

_LINES = r"""d AS (SELECT doc_id, lang, source, regexp_split_to_array(regexp_replace(text, '[“”"]', '', 'g'), '[.\n]+') AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, lang, source, trim(regexp_replace(unnest(l), '[\s\p{Z}]+', ' ', 'g')) AS s, generate_subscripts(l, 1) - 1 AS i FROM d),
y AS (SELECT doc_id, i, s, CASE i % 11 WHEN 0 THEN 'Điều ' || CAST(i // 11 + 1 AS VARCHAR) || '. ' || s WHEN 4 THEN 'Điều khoản bị sửa đổi ' || lang WHEN 7 THEN 'b) ' || lang || length(s) % 2 WHEN 8 THEN 'b) ' || lang || length(s) % 2 WHEN 9 THEN '3.' || source WHEN 1 THEN 'câu ' || s WHEN 10 THEN CASE length(s) % 3 WHEN 0 THEN 'mở “' WHEN 1 THEN 'đóng ”' ELSE 'câu ' || s END ELSE CAST(length(s) % 2 + 1 AS VARCHAR) || '. ' || CASE WHEN length(s) % 3 = 0 THEN source ELSE 'câu ' || s END END AS line FROM x),
z AS (SELECT *, trim(line) AS said, sum(CASE WHEN line = 'mở “' THEN 1 WHEN line = 'đóng ”' THEN -1 ELSE 0 END) OVER w AS depth, count(*) FILTER (WHERE i % 11 = 0) OVER w AS nth FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT *, depth - least(min(depth) OVER (PARTITION BY doc_id ORDER BY i), 0) AS clamped FROM z),
o AS (SELECT *, coalesce(lag(clamped) OVER (PARTITION BY doc_id ORDER BY i), 0) > 0 AS quoted, CASE i % 11 WHEN 0 THEN 'article' WHEN 4 THEN 'badge' WHEN 7 THEN 'point' WHEN 8 THEN 'point' WHEN 9 THEN 'other' WHEN 1 THEN 'other' WHEN 10 THEN 'other' ELSE 'clause' END AS level FROM q),
c AS (SELECT *, CASE WHEN level = 'clause' AND NOT quoted THEN lag(said) OVER (PARTITION BY doc_id, nth, level, quoted, left(said, 1) ORDER BY i) END AS before FROM o),
u AS (SELECT *, coalesce(before = said, false) AS repeat, last_value(CASE WHEN level = 'clause' AND NOT quoted AND coalesce(before <> said, true) THEN left(said, 1) END IGNORE NULLS) OVER (PARTITION BY doc_id, nth ORDER BY i) AS under FROM c),
k AS (SELECT *, level <> 'badge' AND NOT repeat AND NOT (level = 'point' AND NOT quoted AND row_number() OVER (PARTITION BY doc_id, nth, level, quoted, under, said ORDER BY i) > 1) AS kept FROM u)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents (doc_id, text): each sentence a line that begins an article, a clause, a point, a page mark or nothing."""
    pieces = F.split(F.regexp_replace("text", '[“”"]', ""), r"[.\n]+", -1)

    def line(piece, i):
        s = F.trim(F.regexp_replace(piece, r"[\s\p{Z}]+", " "))
        long, of, word = F.char_length(s), i % 11, F.concat(F.lit("câu "), s)
        point = F.concat(F.lit("b) "), "lang", (long % 2).cast("string"))
        other = F.when(long % 3 == 0, "mở “").when(long % 3 == 1, "đóng ”").otherwise(word)
        clause = F.concat((long % 2 + 1).cast("string"), F.lit(". "), F.when(long % 3 == 0, F.col("source")).otherwise(word))
        return (
            F.when(of == 0, F.concat(F.lit("Điều "), (F.floor(i / 11) + 1).cast("string"), F.lit(". "), s)).when(of == 4, F.concat(F.lit("Điều khoản bị sửa đổi "), "lang"))
            .when(of.isin(7, 8), point).when(of == 9, F.concat(F.lit("3."), "source")).when(of == 1, word).when(of == 10, other).otherwise(clause)
        )

    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.transform(pieces, line), "\n").alias("text"))


@query(f"""WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE before <> said) AS n_differs, count(*) FILTER (WHERE i % 11 = 9) AS n_glued, sha256(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept)) AS kept_sha256 FROM k GROUP BY doc_id""")
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without page marks and repeated units, and how many of its clauses differ under one number."""
    texts = B.cleaned_texts(B.marked_lines(_numbered(spark, sf_dir), "doc_id", "text"), "doc_id")
    return texts.select("doc_id", "n_lines", "n_kept", "n_differs", "n_glued", F.sha2("text", 256).alias("kept_sha256"))


@query(f"""WITH {_LINES} SELECT b.doc_id, (b.i)::INTEGER AS line_no, b.said AS badge, CAST(n.nth AS VARCHAR) AS article, n.level, CASE n.level WHEN 'clause' THEN left(n.said, 1) END AS number FROM k b JOIN k n ON n.doc_id = b.doc_id AND n.i = b.i + 1 WHERE b.level = 'badge'""")
def badge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page marks of all documents, with the units they stand before."""
    return B.badge_labels(B.marked_lines(_numbered(spark, sf_dir), "doc_id", "text"), "doc_id")
