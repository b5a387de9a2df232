"""Official numbers in titles that are built from orders: split, misspelled, with foreign letters, of unknown agencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import numbers as N
from tempora.plans.catalog import query
from tempora.session import table


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS kind, (o_custkey % 900 + 1) || CASE WHEN o_custkey % 5 = 0 THEN 'a' ELSE '' END AS no, CAST(year(o_orderdate) AS VARCHAR) AS y, o_custkey % 2 = 0 AS even FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN no || '/' || y || '/TT-NHNN' WHEN 1 THEN no || '/' || y || '/NĐ-CP' WHEN 2 THEN no || '/' || y || '/QH14' WHEN 3 THEN no || '/' || y || '/TT-BTC' WHEN 4 THEN no || '/QĐ-TTg' WHEN 5 THEN no || '/' || y || '/ZZ-XYZ' WHEN 6 THEN no || '/' || y || CASE WHEN even THEN '/TTLT-BTC-BNV' ELSE '/TT-BTC-BNV' END END AS number,
  CASE WHEN kind IN (0, 3) THEN 'TT' WHEN kind = 1 THEN 'NĐ' WHEN kind = 4 THEN 'QĐ' WHEN kind = 5 THEN 'ZZ' WHEN kind = 6 AND even THEN 'TTLT' WHEN kind = 6 THEN 'TT' END AS type,
  CASE kind WHEN 0 THEN 'NHNN' WHEN 1 THEN 'CP' WHEN 2 THEN 'QH' WHEN 3 THEN 'BTC' WHEN 4 THEN 'TTg' WHEN 5 THEN 'XYZ' WHEN 6 THEN 'BTC,BNV' END AS agencies,
  CASE WHEN kind IN (0, 1, 2, 3, 6) THEN true END AS normative, CASE kind WHEN 0 THEN 'glued' WHEN 3 THEN 'lookalike' WHEN 5 THEN 'unknown_type,unknown_agency' WHEN 6 THEN CASE WHEN even THEN '' ELSE 'several_agencies' END WHEN 7 THEN NULL ELSE '' END AS warnings FROM o""")
def title_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each order's title, its type and agencies, whether it is normative, and what had to be mended."""
    no = F.concat((F.col("o_custkey") % 900 + 1).cast("string"), F.when(F.col("o_custkey") % 5 == 0, "a").otherwise(""))
    rows = table(spark, sf_dir, "orders").withColumns({"no": no, "y": F.year("o_orderdate").cast("string"), "kind": F.col("o_orderkey") % 8})
    said = lambda *parts: F.concat(*(F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts))
    titles = [
        said("Thông tư số ", "$no", "/", "$y", "/TT- NHNN quy định, sửa đổi 1/2010/TT-BTC"), said("Thông tư số ", "$no", "/", "$y", "/TT- Quy định (", "$no", "/", "$y", "/NĐ-CP)"), said("Luật số ", "$no", "/", "$y", "/qh14."),
        said("Thông tư ", "$no", "/", "$y", "/TT-BTС; 2/2011/TT-BCT"), said("QĐ ", "$no", "/QĐ-TTG về"), said("văn bản ", "$no", "/", "$y", "/ZZ-XYZ"),
    ]
    title = F.when(F.col("kind") == 6, F.when(F.col("o_custkey") % 2 == 0, said("$no", "/", "$y", "/TTLT-BTC-BNV")).otherwise(said("$no", "/", "$y", "/tt-btc-BNV"))).when(F.col("kind") == 7, said("không số ", "$no", "/", "$y", " và ", "$no", "/", "$y", "/NĐ--CP"))
    for n, text in enumerate(titles):
        title = title.when(F.col("kind") == n, text)
    out = N.title_numbers(rows.select("o_orderkey", title.alias("title")), "o_orderkey", "title", N.vocabulary(spark))
    return out.select("o_orderkey", "number", "type", F.array_join("agencies", ",").alias("agencies"), "normative", F.array_join("warnings", ",").alias("warnings"))
