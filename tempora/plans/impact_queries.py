"""Amending articles from order lines: the edges they give, and how these agree with a list of affected units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import impacts as I
from tempora.plans.catalog import query
from tempora.session import table

_ARTICLES = r"""a AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, 'A' || l_orderkey || '#than/dieu_' || l_linenumber AS source_key, l_orderkey || '/2019/NĐ-CP' AS base, (l_suppkey % 60 + 1) || '/2020/TT-NHNN' AS other, CAST(l_partkey % 50 + 1 AS VARCHAR) AS b, l_linenumber AS ln, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS valid_from, l_partkey % 5 AS kind FROM lineitem),
t AS (SELECT *, 'Điều ' || ln || '. ' || CASE kind WHEN 0 THEN 'Sửa đổi một số điều của Thông tư số ' || other || chr(10) || '1. Sửa đổi khoản ' || ln || ' Điều ' || b || ' như sau:' || chr(10) || '“' || ln || '. Hàng ' || l_returnflag || ' theo Điều 9.”' || chr(10) || '2. Bãi bỏ Điều ' || b || ', Điều 90.'
  WHEN 1 THEN 'Bãi bỏ khoản 4 Điều ' || b
  WHEN 2 THEN 'Sửa đổi Điều ' || b || chr(10) || '1. Bãi bỏ điểm c khoản 7.' || chr(10) || '2. Bổ sung khoản ' || ln || ' “' || l_returnflag || '” và khoản 8 “' || l_linestatus || '”.'
  WHEN 3 THEN 'Điều khoản thi hành' || chr(10) || '1. Có hiệu lực ngay.' || chr(10) || '2. Thay thế cụm từ “' || l_linestatus || '” tại Điều ' || b || '.' || chr(10) || 'Nơi nhận:' || chr(10) || '- Như Điều 5;'
  ELSE 'Hàng ' || l_returnflag || chr(10) || '1. Bãi bỏ quy định cũ.' || chr(10) || '2. Bổ sung Điều ' || b || '.' END AS text FROM a),
s AS (SELECT *, strpos(text, '“') - 1 AS s1, length(text) - strpos(reverse(text), '”') + 1 AS s2 FROM t),
e AS (
  SELECT key, source_key || '#khoan_1' AS source_key, other || '#than/dieu_' || b || '#khoan_' || ln AS target_key, 'sua_doi' AS op, s1, s2, valid_from, substr(text, strpos(text, chr(10)) + 4, s2 - strpos(text, chr(10)) - 3) AS command, '' AS warnings FROM s WHERE kind = 0
  UNION ALL SELECT key, source_key || '#khoan_2', other || '#than/dieu_' || x, 'bai_bo', NULL, NULL, valid_from, 'Bãi bỏ Điều ' || b || ', Điều 90.', '' FROM s, LATERAL (SELECT unnest([b, '90']) AS x) WHERE kind = 0
  UNION ALL SELECT key, source_key, base || '#than/dieu_' || b || '#khoan_4', 'bai_bo', NULL, NULL, valid_from, 'Bãi bỏ khoản 4 Điều ' || b, '' FROM s WHERE kind = 1
  UNION ALL SELECT key, source_key || '#khoan_1', base || '#than/dieu_' || b || '#khoan_7#diem_c', 'bai_bo', NULL, NULL, valid_from, 'Bãi bỏ điểm c khoản 7.', '' FROM s WHERE kind = 2
  UNION ALL SELECT key, source_key || '#khoan_2', base || '#than/dieu_' || b || '#khoan_' || x, 'bo_sung', s1, s2, valid_from, 'Bổ sung khoản ' || ln || ' “' || l_returnflag || '” và khoản 8 “' || l_linestatus || '”.', 'gap' FROM s, LATERAL (SELECT unnest([CAST(ln AS VARCHAR), '8']) AS x) WHERE kind = 2
  UNION ALL SELECT key, source_key || '#khoan_2', base || '#than/dieu_' || b, 'thay_cum_tu', s1, s2, valid_from, 'Thay thế cụm từ “' || l_linestatus || '” tại Điều ' || b || '.', '' FROM s WHERE kind = 3
  UNION ALL SELECT key, source_key || '#khoan_1', NULL, 'bai_bo', NULL, NULL, valid_from, 'Bãi bỏ quy định cũ.', 'no_target' FROM s WHERE kind = 4
  UNION ALL SELECT key, source_key || '#khoan_2', base || '#than/dieu_' || b, 'bo_sung', NULL, NULL, valid_from, 'Bổ sung Điều ' || b || '.', 'unworded' FROM s WHERE kind = 4)"""


def _articles(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Every order as a document, its lines as articles that change others; of some orders (l_orderkey), if stated."""
    s, lit = (lambda c: F.col(c).cast("string")), F.lit
    lines = table(spark, sf_dir, "lineitem")
    lines = (lines if orders is None else lines.join(orders, "l_orderkey", "left_semi")).withColumns({"ln": s("l_linenumber"), "b": (F.col("l_partkey") % 50 + 1).cast("string"), "other": F.concat((F.col("l_suppkey") % 60 + 1).cast("string"), lit("/2020/TT-NHNN")), "base": F.concat(s("l_orderkey"), lit("/2019/NĐ-CP"))})
    join = lambda *parts: F.concat(*(F.col(p[1:]) if p.startswith("$") else lit(p) for p in parts))
    body = (
        F.when(F.col("l_partkey") % 5 == 0, join("Sửa đổi một số điều của Thông tư số ", "$other", "\n1. Sửa đổi khoản ", "$ln", " Điều ", "$b", " như sau:\n“", "$ln", ". Hàng ", "$l_returnflag", " theo Điều 9.”\n2. Bãi bỏ Điều ", "$b", ", Điều 90."))
        .when(F.col("l_partkey") % 5 == 1, join("Bãi bỏ khoản 4 Điều ", "$b"))
        .when(F.col("l_partkey") % 5 == 2, join("Sửa đổi Điều ", "$b", "\n1. Bãi bỏ điểm c khoản 7.\n2. Bổ sung khoản ", "$ln", " “", "$l_returnflag", "” và khoản 8 “", "$l_linestatus", "”."))
        .when(F.col("l_partkey") % 5 == 3, join("Điều khoản thi hành\n1. Có hiệu lực ngay.\n2. Thay thế cụm từ “", "$l_linestatus", "” tại Điều ", "$b", ".\nNơi nhận:\n- Như Điều 5;"))
        .otherwise(join("Hàng ", "$l_returnflag", "\n1. Bãi bỏ quy định cũ.\n2. Bổ sung Điều ", "$b", "."))
    )
    key = F.concat_ws("-", *(s(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    return lines.select("l_orderkey", key.alias("key"), F.concat(lit("Điều "), "ln", lit(". "), body).alias("text"), F.concat(lit("A"), s("l_orderkey"), lit("#than/dieu_"), "ln").alias("source_key"), "base", F.col("l_shipdate").cast("date").cast("string").alias("valid_from"))


@query(f"WITH {_ARTICLES}, d AS (SELECT DISTINCT l_orderkey FROM s WHERE kind <> 3), k AS (SELECT key FROM s WHERE l_orderkey IN (SELECT l_orderkey FROM d)) SELECT key, source_key, target_key, op, s1::INTEGER AS span_start, s2::INTEGER AS span_end, valid_from, command, warnings FROM e WHERE key IN (SELECT key FROM k)")
def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all amending documents, with the place of the new wording and what can't be told."""
    edges = I.impact_edges(_articles(spark, sf_dir, I.amending_documents(_articles(spark, sf_dir), "l_orderkey")))
    return edges.withColumn("warnings", F.array_join("warnings", ","))


@query(f"""WITH {_ARTICLES}, o AS (SELECT DISTINCT split_part(target_key, '#', 1) AS base, regexp_extract(target_key, 'dieu_([^#]+)', 1) AS article, CASE WHEN target_key LIKE '%#diem%' THEN 'diem' WHEN target_key LIKE '%#khoan%' THEN 'khoan' END AS level, CASE WHEN target_key LIKE '%#diem%' THEN regexp_extract(target_key, 'diem_(.+)', 1) WHEN target_key LIKE '%#khoan%' THEN regexp_extract(target_key, 'khoan_(.+)', 1) END AS number FROM e WHERE target_key IS NOT NULL),
l AS (SELECT DISTINCT base, b AS article, CASE WHEN l_quantity > 25 THEN 'khoan' END AS level, CASE WHEN l_quantity > 25 THEN CAST(l_suppkey % 3 + 3 AS VARCHAR) END AS number FROM s WHERE kind <> 0 AND kind <> 4)
SELECT 'edge' AS side, * FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.base = o.base AND l.article = o.article AND (l.level IS NULL OR o.level IS NULL OR (l.level = o.level AND l.number = o.number)))
UNION ALL SELECT 'list', * FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE l.base = o.base AND l.article = o.article AND (l.level IS NULL OR o.level IS NULL OR (l.level = o.level AND l.number = o.number)))""")
def impact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the edges and the units that documents list as affected disagree, both ways."""
    edges = I.impact_edges(_articles(spark, sf_dir))
    below = F.col("l_quantity") > 25
    listed = table(spark, sf_dir, "lineitem").where("l_partkey % 5 IN (1, 2, 3)").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/2019/NĐ-CP")).alias("base"), (F.col("l_partkey") % 50 + 1).cast("string").alias("article"), F.when(below, "khoan").alias("level"), F.when(below, (F.col("l_suppkey") % 3 + 3).cast("string")).alias("number"))
    return I.checked(edges, listed)
