"""The corpus browser, the document graph, incremental loading and text functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import keys as K
from tempora.functions import text as T
from tempora.functions.html import sanitize
from tempora.operators import graph as G
from tempora.operators import incremental as I
from tempora.operators import normative as N
from tempora.operators import positional as P
from tempora.operators import quotes as Q
from tempora.operators import span_joins as J
from tempora.plans.catalog import query
from tempora.session import table

PAGE, PAGE_SIZE = 2, 25


@query("""SELECT doc_id, n_chars, total::BIGINT AS total FROM (SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE text ILIKE '%license%' ORDER BY doc_id LIMIT 25 OFFSET 25)""")
def ilike_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a case-insensitive text search, with the number of all matches."""
    found = table(spark, sf_dir, "documents").where(F.col("text").ilike("%license%")).select("doc_id", "n_chars")
    page = found.orderBy("doc_id").offset((PAGE - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    return page.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


@query("SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT category, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS category FROM part) WHERE category ILIKE '%e%' GROUP BY category ORDER BY n DESC, category LIMIT 10""")
def list_member_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest members of a list column that match a search: a report of the first ten."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("category")).where(F.col("category").ilike("%e%"))
    return words.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split(p_name, ' ')) AS c) WHERE lower(c) = (SELECT lower(min(split_part(p_name, ' ', 1))) FROM part))")
def list_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose list column has a member, whatever its case: here the first word of all names."""
    part = table(spark, sf_dir, "part")
    wanted = part.agg(F.upper(F.min(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("wanted"))
    return part.join(F.broadcast(wanted), F.exists(F.split("p_name", " "), lambda c: F.lower(c) == F.lower("wanted"))).select("p_partkey")


@query("""WITH l AS (SELECT o_orderkey, unnest(range(o_orderkey, o_orderkey + 3)) AS doc_id FROM orders)
SELECT o_orderkey, doc_id, n_chars FROM l JOIN documents USING (doc_id)""")
def linked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the documents whose ids they list."""
    base = F.col("o_orderkey")
    links = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(base, base + 2)).alias("doc_id"))
    return links.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("o_orderkey", "doc_id", "n_chars")


@query("""SELECT conv_id, turn, role, left(text, 280) AS snippet FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 15""")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifteen turns of each conversation, as snippets."""
    last = P.top_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), "role", "text"], 15)
    return last.select("conv_id", "turn", "role", F.left("text", F.lit(280)).alias("snippet"))


@query("""SELECT conv_id, string_agg('[' || role || '] ' || left(text, 280), ' | ' ORDER BY turn, role, text) AS context FROM conversations GROUP BY conv_id""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt context of each conversation, in order."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.left("text", F.lit(280)))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda r: r["line"]), " | ").alias("context"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_doc"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_doc")).distinct()


@query("""
WITH g AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS t FROM lineitem), seeds AS (SELECT n_nationkey AS query, 's' || s_suppkey AS id FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 100 = 0
  UNION ALL SELECT n_nationkey, 'p' || (n_nationkey + 1) FROM nation)
SELECT DISTINCT query, x AS id FROM (SELECT query, t AS x FROM seeds JOIN g ON s = id UNION ALL SELECT query, s FROM seeds JOIN g ON t = id) z WHERE NOT EXISTS (SELECT 1 FROM seeds q WHERE q.query = z.query AND q.id = z.x)""")
def one_hop_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is one edge away from each query's seeds, without the seeds."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0")
    seeds = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("query"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    seeds = seeds.unionAll(nation.select("n_nationkey", F.concat(F.lit("p"), (F.col("n_nationkey") + 1).cast("string"))))
    return G.expansion(_graph(spark, sf_dir), seeds)


@query("""
WITH e AS (SELECT user_id, event_type, event_id FROM events), b AS (SELECT user_id AS target_doc, event_id % 7 AS source_doc FROM e WHERE event_type = 'error' OR event_id % 11 = 0), r AS (SELECT user_id FROM e WHERE event_type = 'purchase' AND event_id % 40 = 0)
SELECT target_doc, array_to_string(list_sort(list(DISTINCT source_doc)), ',') AS repealed_by FROM b WHERE target_doc NOT IN (SELECT user_id FROM r) GROUP BY target_doc""")
def legislative_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is repealed and not replaced, with what repealed it."""
    e = table(spark, sf_dir, "events")
    repeals = e.where("event_type = 'error' OR event_id % 11 = 0").select((F.col("event_id") % 7).alias("source_doc"), F.col("user_id").alias("target_doc"), F.lit("BAI_BO").alias("rel_type"))
    replaced = e.where("event_type = 'purchase' AND event_id % 40 = 0").select(F.lit(0).cast("long").alias("source_doc"), F.col("user_id").alias("target_doc"), F.lit("THAY_THE").alias("rel_type"))
    return G.void(repeals.unionAll(replaced)).select("target_doc", F.array_join(F.transform("repealed_by", lambda x: x.cast("string")), ",").alias("repealed_by"))


@query("""
WITH e AS (SELECT l_orderkey AS s, l_partkey AS t, l_returnflag AS k, l_linenumber AS p FROM lineitem), d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 UNION SELECT p_partkey FROM part),
x AS (SELECT s AS id, k, 'source' AS side, p FROM e UNION ALL SELECT t, k, 'target', p FROM e)
SELECT id, count(*)::BIGINT AS n_edges, count(DISTINCT k || side)::BIGINT AS n_kinds, min(p)::INTEGER AS priority FROM x WHERE id NOT IN (SELECT id FROM d) GROUP BY id""")
def stub_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that aren't documents, with how much they are wanted."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_doc"), F.col("l_partkey").alias("target_doc"), F.col("l_returnflag").alias("rel_type"), F.col("l_linenumber").alias("priority"))
    docs = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id")).union(table(spark, sf_dir, "part").select("p_partkey"))
    return G.stubs(edges, docs)


@query("""
WITH b AS (SELECT p_brand || '/' || p_size AS number, count(DISTINCT p_partkey) AS n, min(p_partkey) AS one FROM part GROUP BY 1)
SELECT number, n::BIGINT AS n_claims, CASE WHEN n = 1 THEN one END AS doc_id FROM b""")
def bridge_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with the one document that claims them, or none where several do."""
    return G.bridge(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("number")), "number", "p_partkey")


@query("""
WITH m AS (SELECT 'S' || s_suppkey AS stub, s_nationkey AS nat FROM supplier WHERE s_suppkey % 2 = 0), e AS (SELECT DISTINCT 'S' || l_suppkey AS s, 'N' || (l_partkey % 25) AS t FROM lineitem),
x AS (SELECT DISTINCT coalesce('N' || m.nat, s) AS source_doc, t AS target_doc FROM e LEFT JOIN m ON m.stub = s)
SELECT source_doc, target_doc FROM x WHERE source_doc <> target_doc""")
def stub_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges moved from stubs to the documents that arrived for them."""
    t = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = table(spark, sf_dir, "lineitem").select(t("S", F.col("l_suppkey")).alias("source_doc"), t("N", F.col("l_partkey") % 25).alias("target_doc")).distinct()
    mapping = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(t("S", F.col("s_suppkey")).alias("stub"), t("N", F.col("s_nationkey")).alias("doc_id"))
    return G.collapsed(edges, mapping)


@query("""
WITH new AS (SELECT DISTINCT c_nationkey AS doc_id, s_nationkey AS source_doc_id, c_mktsegment AS rel_type FROM customer JOIN supplier ON s_suppkey = c_custkey % 100 + 1),
old AS (SELECT DISTINCT c_nationkey AS doc_id, s_nationkey AS source_doc_id, c_mktsegment AS rel_type FROM customer JOIN supplier ON s_suppkey = c_custkey % 100 + 1 WHERE c_acctbal > 3000)
SELECT n.doc_id, n.source_doc_id, n.rel_type, coalesce(CASE WHEN s.n_nationkey < 20 THEN s.n_name END, n.source_doc_id::VARCHAR) || ' — ' || coalesce(CASE WHEN t.n_nationkey < 20 THEN t.n_name END, n.doc_id::VARCHAR) AS summary
FROM new n LEFT JOIN nation s ON s.n_nationkey = n.source_doc_id LEFT JOIN nation t ON t.n_nationkey = n.doc_id WHERE (n.doc_id, n.source_doc_id, n.rel_type) NOT IN (SELECT (doc_id, source_doc_id, rel_type) FROM old)""")
def change_events_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events that aren't recorded yet, with titles where there are any."""
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey") % 100 + 1)
    edges = lambda df: df.select(F.col("s_nationkey").alias("source_doc"), F.col("c_nationkey").alias("target_doc"), F.col("c_mktsegment").alias("rel_type"))
    titles = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    events = lambda df: G.change_events(edges(df), titles)
    return G.insert_ignore(events(both), events(both.where("c_acctbal > 3000")), ["doc_id", "source_doc_id", "rel_type"])


@query("""SELECT l_shipmode AS rel_type, n FROM (SELECT l_returnflag AS l_shipmode, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1)""")
def relation_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes outside a closed set, counted."""
    return G.unknown_relations(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rel_type")), ("A", "N"))


_VERSIONS = """old AS (SELECT doc_id % 97 AS doc, doc_id AS id, lang || '|' || n_chars AS body FROM documents WHERE doc_id % 97 <> 5),
new AS (SELECT doc_id % 97 AS doc, CASE WHEN doc_id % 97 = 11 THEN -doc_id ELSE doc_id END AS id, lang || '|' || (CASE WHEN doc_id % 97 = 7 AND doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END) AS body FROM documents WHERE doc_id % 97 <> 3)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A derived table and its next version: a document goes, one comes, one changes, one is split anew."""
    doc = F.col("doc_id") % 97
    docs = table(spark, sf_dir, "documents").select(doc.alias("doc"), "doc_id", "lang", "n_chars")
    body = lambda n: F.concat_ws("|", "lang", n.cast("string")).alias("body")
    old = docs.where("doc <> 5").select("doc", F.col("doc_id").alias("id"), body(F.col("n_chars")))
    changed = F.when((F.col("doc") == 7) & (F.col("doc_id") % 2 == 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return old, docs.where("doc <> 3").select("doc", F.when(F.col("doc") == 11, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("id"), body(changed))


@query(f"""WITH {_VERSIONS}, a AS (SELECT doc, string_agg(DISTINCT id || '=' || body, ',' ORDER BY id || '=' || body) AS f FROM old GROUP BY doc), b AS (SELECT doc, string_agg(DISTINCT id || '=' || body, ',' ORDER BY id || '=' || body) AS f FROM new GROUP BY doc)
SELECT doc, CASE WHEN a.f IS NULL THEN 'new' WHEN b.f IS NULL THEN 'extra' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc) WHERE a.f IS DISTINCT FROM b.f""")
def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose set of rows differs between two versions."""
    old, new = _versions(spark, sf_dir)
    return I.difference(I.fingerprints(old, "doc", ["id", "body"]), I.fingerprints(new, "doc", ["id", "body"]))


@query(f"""WITH {_VERSIONS}, s AS (SELECT * FROM new WHERE doc IN (5, 7, 11))
SELECT doc, id, body FROM old WHERE NOT (doc IN (5, 7, 11) AND id NOT IN (SELECT id FROM s)) AND id NOT IN (SELECT id FROM s) UNION ALL SELECT doc, id, body FROM s""")
def scoped_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after three documents are replaced: orphans gone, rows put in by key."""
    old, new = _versions(spark, sf_dir)
    scope = spark.createDataFrame([(5,), (7,), (11,)], "doc long")
    return I.upserted(old, new.join(scope, "doc", "left_semi"), scope, "doc", "id")


@query(f"WITH {_VERSIONS} SELECT id FROM old WHERE doc IN (7, 11) AND id NOT IN (SELECT id FROM new)")
def orphan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a scope that the next version doesn't have."""
    old, new = _versions(spark, sf_dir)
    return I.orphans(old, new, spark.createDataFrame([(7,), (11,)], "doc long"), "doc", "id")


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'X' || c_custkey END AS seg FROM customer)
SELECT c_custkey, coalesce(nullif(seg, ''), c_mktsegment) AS c_mktsegment, coalesce(nullif(c_name, ''), seg) AS c_name FROM customer JOIN p USING (c_custkey)""")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows enriched by non-empty values only; in some columns what is there wins."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    m = F.col("c_custkey") % 3
    seg = F.when(m == 0, "").when(m == 1, F.concat(F.lit("X"), F.col("c_custkey").cast("string")))
    return I.merged_fields(base, base.select("c_custkey", seg.alias("c_mktsegment"), seg.alias("c_name")), "c_custkey", ["c_mktsegment"], ["c_name"])


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'gis') AS s FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(s, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs') AS s FROM h)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query()
def html_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page reduced to a few inline tags, balanced and without attributes."""
    return table(spark, sf_dir, "pages").select("page_id", sanitize("html").alias("inline"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("link"))


@query(r"""SELECT page_id, left(trim(replace(regexp_replace(regexp_extract(url, '([^/?#]*)/?([?#].*)?$', 1), '(--[0-9]+|\.html?)$', ''), '-', ' ')), 80) AS title FROM pages""")
def url_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from URLs."""
    return table(spark, sf_dir, "pages").select("page_id", T.slug_title(F.col("url")).alias("title"))


def _markers_sql() -> str:
    """The groups by SQL: letters around a marker are told apart by doubling what isn't a letter, as there is no looking behind."""
    steps, cases, last = [], [], "d"
    for n, group in enumerate(("prohibition", "obligation", "permission", "condition")):
        words = "|".join(w.replace(" ", "  ") for w in sorted(T.MARKERS[group], key=len, reverse=True))
        pattern = rf"([^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_])"
        steps.append(rf"g{n} AS (SELECT *, regexp_matches(s, '{pattern}') AS m{n} FROM (SELECT * {'' if n == 0 else 'EXCLUDE (r) REPLACE (r AS s)'} FROM {last})), h{n} AS (SELECT *, regexp_replace(s, '{pattern}', '\1 \3', 'g') AS r FROM g{n})")
        last = f"h{n}"
        cases.append(f"CASE WHEN m{n} THEN '{group}' END")
    return rf"""WITH d AS (SELECT doc_id, '  ' || regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || '  ' AS s FROM documents), {", ".join(steps)}
SELECT doc_id, array_to_string(list_sort(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL)), ',') AS groups FROM {last}"""


@query(_markers_sql())
def modality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deontic groups of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.marker_groups(F.col("text")), ",").alias("groups"))


@query(r"""
WITH r AS (SELECT c_custkey, upper(c_custkey || '/' || (1990 + c_nationkey) || '/' || left(c_mktsegment, 2) || '-' || c_mktsegment) AS n, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN NULL ELSE regexp_replace(n, '^0+([0-9])', '\1') END AS number,
  CASE WHEN c_nationkey = 7 THEN NULL ELSE regexp_extract(n, '/([A-Z]+)-', 1) || regexp_extract(n, '^0*([0-9]+)', 1) || '-' || regexp_extract(n, '/([0-9]{4})/', 1) END AS id FROM r""")
def official_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official numbers written with spaces, leading zeros and small letters, made canonical, and the ids made of them."""
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("0"), F.col("c_custkey").cast("string"), F.lit(" / "), (1990 + F.col("c_nationkey")).cast("string"), F.lit("/"), F.lower(F.left("c_mktsegment", F.lit(2))), F.lit("-"), F.lower("c_mktsegment"))
    number = T.official_number(F.when(F.col("c_nationkey") == 7, F.concat(raw, F.lit("-"))).otherwise(raw))
    return c.select("c_custkey", number.alias("number"), T.doc_id_of(number).alias("id"))


@query(f"""SELECT doc_id, md5(translate(lower(text), '{T._MARKED}', '{T._PLAIN}')) AS kept, md5(replace(translate(lower(text), '{T._MARKED}', '{T._PLAIN}'), 'đ', 'd')) AS folded FROM documents""")
def accent_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two foldings of accents in every text, as digests: one keeps đ, one doesn't."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_keep_d(F.col("text"))).alias("kept"), F.md5(T.fold_all(F.col("text"))).alias("folded"))


@query(r"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 40 AS a, l_quantity::INTEGER AS c, l_returnflag AS f, 'N' || l_suppkey AS number FROM lineitem)
SELECT l_orderkey, l_linenumber, number || '#than/dieu_' || a || CASE WHEN f = 'N' THEN '#khoan_' || c ELSE '' END AS key,
  CASE WHEN f = 'N' THEN 'khoản ' || c || ' ' ELSE '' END || 'Điều ' || a || ' ' || number AS cited, a = 3 AS under_3 FROM l""")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node keys of chunk ids (articles, clauses, merged clauses), their citations, and prefixes at a boundary."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    text = lambda c: c.cast("int").cast("string")
    article, clause = F.concat(F.lit("Điều "), text(F.col("l_orderkey") % 40)), text(F.col("l_quantity"))
    label = F.when(F.col("l_returnflag") == "A", article).when(F.col("l_returnflag") == "N", F.concat(article, F.lit(" Khoản "), clause)).otherwise(F.concat(article, F.lit(" Khoản "), clause, F.lit("-99")))
    key = K.node_key(F.concat(text(F.col("l_partkey")), F.lit("::"), label), F.concat(F.lit("N"), text(F.col("l_suppkey"))))
    return l.select("l_orderkey", "l_linenumber", key.alias("key"), K.citation(key).alias("cited"), K.prefix_at(label, F.lit("Điều 3"), " ").alias("under_3"))


@query(r"""
WITH s AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Sửa đổi, bổ sung ' WHEN 'de' THEN '  BÃI BỎ ' WHEN 'fr' THEN 'Thay thế ' WHEN 'es' THEN 'bổ sung ' ELSE '' END || coalesce(text, '') AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lower(s), '^\s*bãi bỏ') THEN 'bai_bo' WHEN regexp_matches(lower(s), '^\s*thay thế') THEN 'thay_the' WHEN regexp_matches(lower(s), '^\s*sửa đổi, bổ sung') THEN 'sua_doi_bo_sung'
  WHEN regexp_matches(lower(s), '^\s*bổ sung') THEN 'bo_sung' WHEN regexp_matches(lower(s), '^\s*sửa đổi') THEN 'sua_doi' END AS op FROM s""")
def command_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation that a text commands: every text, behind a verb that follows from its language."""
    lang = F.col("lang")
    said = F.when(lang == "en", "Sửa đổi, bổ sung ").when(lang == "de", "  BÃI BỎ ").when(lang == "fr", "Thay thế ").when(lang == "es", "bổ sung ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.command_verb(F.concat(said, F.coalesce("text", F.lit("")))).alias("op"))


@query(r"""
WITH c AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS a, regexp_extract_all(left(text, length(text) // 2), '[0-9]+') AS b FROM documents),
x AS (SELECT doc_id, n, count(*) AS c FROM (SELECT doc_id, unnest(a) AS n FROM c) GROUP BY ALL), y AS (SELECT doc_id, n, count(*) AS c FROM (SELECT doc_id, unnest(b) AS n FROM c) GROUP BY ALL)
SELECT doc_id, n AS number, (x.c - coalesce(y.c, 0))::BIGINT AS more FROM x LEFT JOIN y USING (doc_id, n) WHERE x.c > coalesce(y.c, 0)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text has more often than its first half."""
    docs = table(spark, sf_dir, "documents")
    runs = lambda c: F.explode(F.regexp_extract_all(c, F.lit(r"([0-9]+)"), 1)).alias("number")
    whole = docs.select("doc_id", runs(F.col("text")))
    half = docs.select("doc_id", runs(F.left("text", F.floor(F.char_length("text") / 2).cast("int"))))
    return N.multiset_difference(whole, half, ["doc_id", "number"], "more")


@query(r"""
WITH w AS (SELECT doc_id, CASE WHEN text LIKE '%@%' THEN 1 END AS a, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 2 END AS b, CASE WHEN n_chars < 500 THEN 3 END AS c FROM documents)
SELECT coalesce(least(a, b, c), 9)::INTEGER AS tier, count(*)::BIGINT AS n FROM w GROUP BY 1""")
def flag_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the most serious of their flags, by ordered rules."""
    rules = ((1, F.col("text").contains("@")), (2, F.col("text").rlike("[0-9]{4}")), (3, F.col("n_chars") < 500))
    return table(spark, sf_dir, "documents").select(N.tier(rules, 9).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT p_brand, list_sort(list_distinct(list(p_size % 5))) AS xs, count(*) AS n, count(DISTINCT p_size % 5) AS k FROM part WHERE p_size % 7 <> 0 GROUP BY p_brand)
SELECT p_brand, len(list_filter([0, 1, 2, 3, 4], lambda x: NOT list_contains(xs, x)))::INTEGER AS missing, len(list_filter(xs, lambda x: x > 4))::INTEGER AS foreign_values, n > k AS repeated FROM d""")
def partition_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the values seen cover a closed domain: missing, foreign and repeated ones."""
    values = table(spark, sf_dir, "part").where("p_size % 7 <> 0").groupBy("p_brand").agg(F.collect_list(F.col("p_size") % 5).alias("xs"))
    proof = N.partition_proof(F.col("xs"), F.array(*map(F.lit, range(5))))
    return values.select("p_brand", proof["missing"].alias("missing"), proof["foreign"].alias("foreign_values"), proof["repeated"].alias("repeated"))


@query(r"""
WITH d AS (SELECT doc_id, replace('Điều 1. ' || source || chr(10) || '1. ' || text, '"', '''') AS first FROM documents),
u AS (SELECT doc_id, 'Điều 1' AS article, regexp_replace(first, '\s+$', '') AS body, 9 AS char_start FROM d UNION ALL SELECT doc_id, 'Điều 2', 'Điều 2. End' || chr(10) || '“Điều 9. quoted”', 9 + length(first) + 1 FROM d)
SELECT doc_id, article, 'Chương I' AS chapter, char_start::INTEGER AS char_start, (char_start + length(body))::INTEGER AS char_end, md5(body) AS body, true AS exact FROM u""")
def article_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, inside an amending text of articles, split with exact offsets."""
    body = F.concat(F.lit("Chương I\nĐiều 1. "), F.col("source"), F.lit("\n1. "), F.col("text"), F.lit("\nĐiều 2. End\n“Điều 9. quoted”\nNơi nhận:\n- x"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(body, F.lit('"'), F.lit("'")).alias("whole"))
    split = Q.article_rows(docs, "doc_id", "whole").join(docs, "doc_id")
    exact = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("body")
    return split.select("doc_id", "article", "chapter", "char_start", "char_end", F.md5("body").alias("body"), exact.alias("exact"))


_QUOTED = r"""d AS (SELECT doc_id, replace(replace(replace(coalesce(text, ''), 'th', '“th'), 'en', 'en”'), 'es', '"') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM d),
o AS (SELECT doc_id, line_no, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1)::BIGINT AS start FROM l),
c AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(t, '([“”"])', chr(1) || '\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split_regex(regexp_replace(t, '([“”"])', chr(1) || '\1', 'g'), chr(1)), 1) AS run FROM d),
r AS (SELECT doc_id, run, left(piece, 1) AS mark, run > 1 AS marked, sum(length(piece)) OVER w - length(piece) AS start,
        sum(CASE WHEN run > 1 AND left(piece, 1) = '“' THEN 1 WHEN run > 1 AND left(piece, 1) = '”' THEN -1 ELSE 0 END) OVER w AS depth, sum(CASE WHEN run > 1 AND left(piece, 1) = '"' THEN 1 ELSE 0 END) OVER w % 2 = 1 AS straight
      FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY run)),
b AS (SELECT doc_id, min(depth) >= 0 AND arg_max(depth, run) = 0 AND NOT arg_max(straight, run) AS balanced FROM r GROUP BY doc_id),
n AS (SELECT o.doc_id, o.line_no, o.start, max(run) AS run FROM o JOIN r ON r.doc_id = o.doc_id AND r.start <= o.start GROUP BY ALL)"""


@query(f"""WITH {_QUOTED}
SELECT n.doc_id, n.line_no::INTEGER AS line_no, n.start::INTEGER AS start, balanced, depth::INTEGER AS depth, straight, balanced AND (depth > 0 OR straight OR (marked AND r.start = n.start)) AS masked
FROM n JOIN r ON r.doc_id = n.doc_id AND r.run = n.run JOIN b ON b.doc_id = n.doc_id""")
def quote_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line of every text, how deep in quotations it begins; marks are put where certain letters stand."""
    docs = _with_marks(spark, sf_dir)
    lines, runs = Q.masked_lines(docs, "doc_id", "t"), Q.quote_runs(docs, "doc_id", "t")
    last = J.met(lines.withColumn("at", F.col("start")), runs.select("doc_id", "run", F.col("start").alias("a"), F.col("end").alias("b"), "depth", "straight", "balanced"), ["doc_id"], ("start", "at"), ("a", "b"))
    best = last.groupBy("doc_id", "line_no", "start", "masked").agg(F.max_by(F.struct("balanced", "depth", "straight"), "run").alias("r"))
    return best.select("doc_id", "line_no", "start", "r.balanced", "r.depth", "r.straight", "masked")


def _with_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    for a, b in (("th", "“th"), ("en", "en”"), ("es", '"')):
        text = F.replace(text, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN i % 5 = 4 THEN '“' || replace(replace(x, '"', ''), '”', '') || '”' WHEN i % 5 = 0 THEN (i // 5 + 1) || '. ' || replace(x, '"', '') WHEN i % 5 < 3 THEN chr((96 + i % 5)::INTEGER) || ') ' || replace(x, '"', '') ELSE replace(x, '"', '') END AS line FROM l),
o AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1) AS a, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS n FROM m),
u AS (SELECT * FROM o WHERE i % 5 < 3), c AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, i // 5 + 1 AS k FROM u),
d AS (SELECT *, lead(a) OVER (PARTITION BY doc_id, i % 5 = 0 ORDER BY i) AS nxt_clause FROM c)
SELECT doc_id, CASE WHEN i % 5 = 0 THEN 'khoan_' || k ELSE 'khoan_' || k || '#diem_' || chr((96 + i % 5)::INTEGER) END AS unit, CASE WHEN i % 5 = 0 THEN 'clause' ELSE 'point' END AS kind,
       CASE WHEN i % 5 > 0 THEN 'khoan_' || k END AS parent, a::INTEGER AS char_start, coalesce(CASE WHEN i % 5 = 0 THEN nxt_clause ELSE nxt END, n)::INTEGER AS char_end FROM d""")
def numbered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses and points of every text whose lines are numbered in turn, each fifth one quoted and so no unit."""
    bare = lambda x: F.replace(x, F.lit('"'), F.lit(""))
    said = lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("“"), F.replace(bare(x), F.lit("”"), F.lit("")), F.lit("”"))).when(i % 5 == 0, F.concat((F.floor(i / 5) + 1).cast("string"), F.lit(". "), bare(x))).when(i % 5 < 3, F.concat(F.char(96 + i % 5), F.lit(") "), bare(x))).otherwise(bare(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), said), "\n").alias("t"))
    return Q.unit_rows(docs, "doc_id", "t").withColumn("char_start", F.col("char_start").cast("int")).withColumn("char_end", F.col("char_end").cast("int"))


@query("""WITH t AS (SELECT doc_id AS id, length(text) AS n FROM documents), s AS (SELECT id, unnest(range(n // 10)) AS k, n FROM t WHERE n >= 40), v AS (SELECT id, k, k * 7 % n AS a, least(n, k * 7 % n + 5 + k * k % 90) AS b FROM s),
w AS (SELECT id, k AS j, k * 11 % n AS c, least(n, k * 11 % n + 1 + k * 3 % 40) AS d FROM s WHERE k % 3 = 0)
SELECT v.id, count(*)::BIGINT AS pairs, sum(least(b, d) - greatest(a, c))::BIGINT AS shared FROM v JOIN w ON v.id = w.id AND a < d AND c < b GROUP BY v.id""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of two dense sets over every text meet, and how much they share."""
    n = F.char_length("text")
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), n.alias("n")).where("n >= 40").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 10).cast("int") - 1))).withColumn("k", F.col("k").cast("long"))
    v = base.select("id", (F.col("k") * 7 % F.col("n")).alias("a"), F.least("n", F.col("k") * 7 % F.col("n") + 5 + F.col("k") * F.col("k") % 90).alias("b"))
    w = base.where("k % 3 = 0").select("id", (F.col("k") * 11 % F.col("n")).alias("c"), F.least("n", F.col("k") * 11 % F.col("n") + 1 + F.col("k") * 3 % 40).alias("d"))
    pairs = J.met(v, w, ["id"], ("a", "b"), ("c", "d"), True).where("a < d AND c < b")
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.least("b", "d") - F.greatest("a", "c")).alias("shared"))
