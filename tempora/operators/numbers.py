"""Official numbers by a grammar and a vocabulary: read out of titles, repaired where that can be proven, never cut short.

A candidate runs to the next separator and is a number as a whole or not at all. Its codes meet the vocabulary, a table, by
equality: that fixes their spelling and says what is known. A candidate that ends in a hyphen was split by white space; it is
put together with the next word only where every agency is then known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.text import LATIN, LOOKALIKES

#: Types of documents that are normative, that may be, and that aren't; those of several agencies; agencies; assemblies.
NORMATIVE, EITHER, ADMINISTRATIVE = "NĐ TT TTLT NQ PL L", "QĐ", "CT TB HD KH BC TTr CV VBHN"
JOINT = "TTLT"
AGENCIES = "CP TTg CTN NHNN BTC BCT BNNMT BXD BGDĐT BYT BTP BNV BQP BCA BNG BVHTTDL BKHCN UBDTTG TANDTC VKSNDTC UBND SHB VCB BIDV"
ASSEMBLIES = "QH UBTVQH"

VOCABULARY = "role string, code string, normative boolean, joint boolean"
_NO, _YEAR = r"\d{1,4}[a-zA-Z]?", r"\d{4}"
_TAIL = r"[^\s/,;.)\]]+"
_CANDIDATE = rf"(?U)\b{_NO}/(?:{_YEAR}/)?[^\s,;.)\]]+(?:(?<=-)\s+[A-Za-zĐđ][A-Za-zĐđ-]*)?"
_ASSEMBLY, _OTHER = rf"(?iU)^({_NO})/({_YEAR})/(QH|UBTVQH)(\d{{1,2}})$", rf"(?U)^({_NO})/(?:({_YEAR})/)?({_TAIL})$"
_CODE = r"^[A-Za-zĐđ]+$"


def vocabulary(spark: SparkSession) -> DataFrame:
    """The known codes, as a table (role, code, normative, joint); other tables of this form will do as well."""
    rows = [("type", c, known, c in JOINT.split()) for said, known in ((NORMATIVE, True), (EITHER, None), (ADMINISTRATIVE, False)) for c in said.split()]
    rows += [(role, c, None, None) for role, said in (("agency", AGENCIES), ("assembly", ASSEMBLIES)) for c in said.split()]
    return spark.createDataFrame(rows, VOCABULARY)


def _group(pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract("read", pattern, n), F.lit(""))


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, read, glued): what may be a number in a text, in order; glued: put together over white space."""
    found = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_CANDIDATE), 0)).alias("nth", "said"))
    return found.select(key, "nth", F.regexp_replace("said", r"(?U)\s+", "").alias("read"), F.col("said").rlike(r"(?U)\s").alias("glued"))


def parsed(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, nth, number, no, year, type, agencies, term, normative, warnings) of candidates that are numbers.

    number is the published form: zeros and what the vocabulary doesn't know stay as written, known codes are spelled as it
    spells them. type is null and term is given for acts of an assembly. normative: by type, and with a year only; null where
    the type doesn't tell. Warnings: glued, lookalike (letters of other scripts read as Latin), unknown_type,
    several_agencies (of a type of one), unknown_agency, unknown_assembly. Texts are in composed form (NFC). known: a
    vocabulary whose codes differ in more than case.
    """
    known = known.select("role", F.lower("code").alias("folded"), F.col("code").alias("spelled"), "normative", "joint")
    a = rows.withColumns({"no": _group(_ASSEMBLY, 1), "year": _group(_ASSEMBLY, 2), "house": F.upper(_group(_ASSEMBLY, 3)), "term": _group(_ASSEMBLY, 4)})
    acts = a.where("no IS NOT NULL").withColumns({"role": F.lit("assembly"), "folded": F.lower("house")}).join(known, ["role", "folded"], "left")
    none, texts = F.lit(None).cast("string"), "array<string>"
    glued = F.when(F.col("glued"), "glued")
    acts = acts.select(key, "nth", F.concat("no", F.lit("/"), "year", F.lit("/"), "house", "term").alias("number"), "no", "year", none.alias("type"), F.array("house").alias("agencies"), "term", F.lit(True).alias("normative"), F.array_compact(F.array(glued, F.when(F.col("spelled").isNull(), "unknown_assembly"))).alias("warnings"))
    b = a.where("no IS NULL").withColumns({"no": _group(_OTHER, 1), "year": _group(_OTHER, 2), "codes": F.split(_group(_OTHER, 3), "-", -1)})
    b = b.where(F.col("no").isNotNull() & (F.size("codes") > 1) & ~F.array_contains("codes", ""))
    parts = b.select(key, "nth", "no", "year", "glued", F.posexplode("codes").alias("at", "raw")).withColumn("latin", F.translate("raw", LOOKALIKES, LATIN))
    mended = ~F.col("raw").rlike(_CODE) & F.col("latin").rlike(_CODE)
    parts = parts.withColumns({"mended": mended, "code": F.when(mended, F.col("latin")).otherwise(F.col("raw")), "role": F.when(F.col("at") == 0, "type").otherwise("agency")})
    parts = parts.withColumn("folded", F.lower("code")).join(known, ["role", "folded"], "left")
    first = F.col("at") == 0
    whole = parts.groupBy(key, "nth", "no", "year", "glued").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("spelled", "code").alias("code")))).alias("codes"),
        F.max(F.when(first, F.col("spelled").isNotNull())).alias("type_known"), F.max(F.when(first, F.col("normative"))).alias("may"), F.coalesce(F.max(F.when(first, F.col("joint"))), F.lit(False)).alias("joint"),
        F.coalesce(F.min(F.when(~first, F.col("spelled").isNotNull())), F.lit(False)).alias("agencies_known"), F.max("mended").alias("mended"),
    ).where("agencies_known OR NOT glued")
    codes = F.transform("codes", lambda c: c["code"])
    whole = whole.withColumns({"type": F.get(codes, F.lit(0)), "agencies": F.slice(codes, 2, F.size(codes))})
    number = F.concat_ws("/", "no", "year", F.array_join(codes, "-"))
    told = F.array(glued, F.when(F.col("mended"), "lookalike"), F.when(~F.col("type_known"), "unknown_type"), F.when(F.col("type_known") & ~F.col("joint") & (F.size("agencies") > 1), "several_agencies"), F.when(~F.col("agencies_known"), "unknown_agency"))
    rest = whole.select(key, "nth", number.alias("number"), "no", "year", "type", F.col("agencies").cast(texts).alias("agencies"), none.alias("term"), F.when(F.col("may"), F.col("year").isNotNull()).otherwise(F.col("may")).alias("normative"), F.array_compact(told).alias("warnings"))
    return acts.unionByName(rest)


def title_numbers(titles: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """Each title's own number: the first candidate that is one. Titles without have a row of nulls; keys tell titles apart."""
    rows = parsed(candidates(titles, key, text), key, known)
    fields = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*fields), "nth").alias("own"))
    return titles.select(key).join(first, key, "left").select(key, *(F.col(f"own.{c}").alias(c) for c in fields if c != "nth"))
