"""Validity, versions of units, and order-dependent queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import keys as K
from tempora.functions import temporal as V
from tempora.operators import hierarchy as H
from tempora.operators import positional as P
from tempora.plans.catalog import query
from tempora.session import table

AS_OF = "1996-06-30"
_SPANS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate::DATE AS vf,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + 90 END AS vt, o_orderstatus = 'F' AS sup FROM orders)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as validities: from the order date, for 90 days; every seventh is open; finished ones are superseded."""
    day = F.to_date("o_orderdate")
    until = F.when(F.col("o_orderkey") % 7 != 0, F.date_add(day, 90))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", day.alias("vf"), until.alias("vt"), (F.col("o_orderstatus") == "F").alias("sup"))


@query(f"WITH {_SPANS} SELECT o_orderkey FROM o WHERE NOT sup AND vf <= DATE '{AS_OF}' AND (vt IS NULL OR vt >= DATE '{AS_OF}')")
def effective_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in force on a day, both bounds counting."""
    return _spans(spark, sf_dir).where(V.effective(F.col("vf"), F.col("vt"), F.col("sup"), AS_OF)).select("o_orderkey")


@query(f"WITH {_SPANS} SELECT o_orderkey FROM o WHERE NOT sup AND vf <= DATE '{AS_OF}' AND (vt IS NULL OR vt > DATE '{AS_OF}')")
def effective_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in force on a day, the last day not counting."""
    return _spans(spark, sf_dir).where(V.effective(F.col("vf"), F.col("vt"), F.col("sup"), AS_OF, "half_open")).select("o_orderkey")


@query(f"""
WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS own, strftime(o_orderdate, '%Y-%m-%d') AS parent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT coalesce(nullif(own, ''), nullif(parent, '')) AS valid_from, count(*)::BIGINT AS n FROM l
WHERE coalesce(nullif(own, ''), nullif(parent, ''))::DATE <= DATE '{AS_OF}' GROUP BY 1""")
def effective_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's own date, or its order's where it has none; empty text counts as none."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, iso("l_shipdate")).otherwise("").alias("own"))
    both = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), iso("o_orderdate").alias("parent")), "l_orderkey")
    dated = both.select(V.inherited(F.col("own"), F.col("parent")).alias("valid_from"))
    return dated.where(V.effective(V.parse_date(F.col("valid_from")), F.lit(None).cast("date"), F.lit(False), AS_OF)).groupBy("valid_from").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_SPANS}, s AS (SELECT o_orderpriority, CASE WHEN NOT sup AND vf <= DATE '{AS_OF}' AND (vt IS NULL OR vt >= DATE '{AS_OF}') THEN 1 ELSE 0 END AS e FROM o)
SELECT o_orderpriority, count(*)::BIGINT AS n, sum(e)::BIGINT AS n_effective, (count(*) - sum(e))::BIGINT AS n_expired FROM s GROUP BY 1""")
def status_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status in each facet; what hasn't begun is expired."""
    status = V.status(F.col("vf"), F.col("vt"), F.col("sup"), AS_OF)
    return _spans(spark, sf_dir).withColumn("s", status).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == "effective").alias("n_effective"), F.count_if(F.col("s") == "expired").alias("n_expired"))


@query(f"WITH {_SPANS} SELECT o_custkey, max(vf) AS valid_from, min(coalesce(vt, DATE '9999-12-31')) AS valid_to FROM o GROUP BY 1 HAVING max(vf) < min(coalesce(vt, DATE '9999-12-31'))")
def co_validity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which everything a key cites is in force, where there are any."""
    out = _spans(spark, sf_dir).groupBy("o_custkey").agg(F.max("vf").alias("valid_from"), F.min(F.coalesce("vt", F.lit("9999-12-31").cast("date"))).alias("valid_to"))
    return out.where(F.col("valid_from") < F.col("valid_to"))


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    return P.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


_EDGES = """e AS (SELECT 'c' || o_custkey || '#o' || o_orderkey || '#l' || l_linenumber AS target_key,
    's' || l_suppkey || '#o' || o_orderkey || '#p' || l_partkey AS source_key,
    CASE WHEN l_returnflag = 'R' THEN 'bai_bo' ELSE 'sua_doi' END AS op, strftime(l_shipdate, '%Y-%m-%d') AS valid_from,
    l_partkey AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  r AS (SELECT 's' || l_suppkey || '#o' || l_orderkey AS target_key, strftime(l_shipdate, '%Y-%m-%d') AS valid_from FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments between keys made of the star schema; some suppliers' acts are repealed as a whole."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    t = lambda *x: F.concat(*(F.lit(p) if p[0] in "#cosp" and len(p) <= 2 else F.col(p).cast("string") for p in x))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    amend = lines.select(
        t("s", "l_suppkey", "#o", "o_orderkey", "#p", "l_partkey").alias("source_key"), t("c", "o_custkey", "#o", "o_orderkey", "#l", "l_linenumber").alias("target_key"),
        F.when(F.col("l_returnflag") == "R", H.REPEAL).otherwise("sua_doi").alias("op"), day.alias("valid_from"), F.col("l_partkey").alias("ord"),
    )
    acts = lines.where("l_returnflag = 'A' AND l_quantity > 45").select(F.concat(F.lit("z"), F.col("l_partkey").cast("string")).alias("source_key"), t("s", "l_suppkey", "#o", "l_orderkey").alias("target_key"), F.lit(H.REPEAL).alias("op"), day.alias("valid_from"), F.lit(0).cast("long").alias("ord"))
    return amend.unionByName(acts)


@query(f"""
WITH {_EDGES}, a AS (SELECT * FROM e WHERE valid_from <= '{AS_OF}'), rep AS (SELECT DISTINCT target_key FROM r WHERE valid_from <= '{AS_OF}'
    UNION SELECT target_key FROM a WHERE op = 'bai_bo')
SELECT op, count(*)::BIGINT AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.target_key = a.source_key OR rep.target_key = regexp_extract(a.source_key, '^(.*)#p', 1) OR rep.target_key = split_part(a.source_key, '#', 1))
GROUP BY op""")
def dead_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments that still count on a day: those whose own act isn't repealed."""
    live = H.alive(H.applied(_edges(spark, sf_dir), AS_OF))
    return live.where(~F.col("source_key").startswith("z")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_EDGES}, a AS (SELECT * FROM e WHERE valid_from <= '{AS_OF}'), rep AS (SELECT DISTINCT target_key FROM r WHERE valid_from <= '{AS_OF}'
    UNION SELECT target_key FROM a WHERE op = 'bai_bo'),
live AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.target_key = a.source_key OR rep.target_key = regexp_extract(a.source_key, '^(.*)#p', 1) OR rep.target_key = split_part(a.source_key, '#', 1))),
k AS (SELECT DISTINCT target_key AS key FROM e), m AS (SELECT key, count(live.op) AS n, max(CASE WHEN live.op IS NOT NULL THEN live.valid_from || lpad(live.ord::VARCHAR, 12, '0') || live.op END) AS last
  FROM k LEFT JOIN live ON live.target_key = key GROUP BY key)
SELECT CASE WHEN last IS NULL THEN 'intact' WHEN last LIKE '%bai_bo' THEN 'repealed' ELSE 'amended' END AS status, count(*)::BIGINT AS n_keys, sum(n)::BIGINT AS n_applied FROM m GROUP BY 1""")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by their state on a day, over all units that anything ever amended."""
    edges = _edges(spark, sf_dir)
    keys = edges.where(~F.col("source_key").startswith("z")).select(F.col("target_key").alias("key")).distinct()
    out = H.current_version(keys, edges.withColumn("ord", F.struct("ord", "op")), AS_OF)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_applied").alias("n_applied"))


@query(f"""
WITH {_EDGES}, k AS (SELECT DISTINCT 'c' || o_custkey || '#o' || o_orderkey AS key FROM orders),
x AS (SELECT regexp_extract(target_key, '^(.*)#l', 1) AS key, max(valid_from || '|' || target_key) AS m FROM e GROUP BY 1)
SELECT key, substr(m, 12) AS target_key, left(m, 10) AS valid_from FROM x JOIN k USING (key)""")
def descendant_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest amendment strictly below each order's key."""
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("#o"), F.col("o_orderkey").cast("string")).alias("key"))
    return H.newest_deeper(keys, _edges(spark, sf_dir).where(~F.col("source_key").startswith("z")))


@query("""
WITH ends AS (SELECT source_key AS key, 'source' AS role FROM (SELECT 'n' || s_nationkey AS source_key FROM supplier) UNION ALL SELECT 'n' || c_nationkey, 'target' FROM customer)
SELECT key, max(role) AS role FROM ends GROUP BY key""")
def overlay_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges with their role; a key that is ever a target is one."""
    n = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    # Each customer is amended by the first supplier of its nation; suppliers and customers of a nation meet by key.
    first = table(spark, sf_dir, "supplier").select(n("s_nationkey").alias("source_key")).distinct()
    edges = first.join(table(spark, sf_dir, "customer").select(n("c_nationkey").alias("target_key")).distinct(), F.col("source_key") == F.col("target_key"), "full")
    return H.overlay_nodes(edges).where(F.col("key").isNotNull())


@query(r"""
WITH e AS (SELECT DISTINCT 'n' || c_nationkey || '#c' || c_custkey AS key FROM customer WHERE c_acctbal > 0), m AS (SELECT DISTINCT 'n' || s_nationkey AS key FROM supplier WHERE s_acctbal > 5000)
SELECT key, 'edge' AS side FROM e WHERE split_part(key, '#', 1) NOT IN (SELECT key FROM m)
UNION ALL SELECT key, 'mark' FROM m WHERE key NOT IN (SELECT split_part(key, '#', 1) FROM e)""")
def reconcile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on either side that nothing on the other side covers, by equality or ancestry."""
    text = lambda *x: F.concat(*(F.lit(p) if len(p) <= 2 else F.col(p).cast("string") for p in x)).alias("key")
    edges = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(text("n", "c_nationkey", "#c", "c_custkey"))
    return H.reconciled(edges, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(text("n", "s_nationkey")).distinct())


@query("""
WITH h AS (SELECT c_nationkey AS query, c_custkey AS key, CASE WHEN c_acctbal < 5000 OR c_nationkey % 5 = 0 THEN 'repealed' WHEN c_acctbal < 7000 THEN 'amended' ELSE 'intact' END AS status FROM customer),
w AS (SELECT *, max(CASE WHEN status <> 'repealed' THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS left_over FROM h)
SELECT query, key, status FROM w WHERE status <> 'repealed' OR left_over = 0""")
def drop_repealed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without the repealed ones, unless a query has no others."""
    bal = F.col("c_acctbal")
    c = table(spark, sf_dir, "customer")
    versions = c.select(F.col("c_custkey").alias("key"), F.when((bal < 5000) | (F.col("c_nationkey") % 5 == 0), "repealed").when(bal < 7000, "amended").otherwise("intact").alias("status"))
    return H.annotated(c.select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("key")), versions).select("query", "key", "status")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
s AS (SELECT doc_id, line_no, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, line_no::INTEGER AS line_no, start::INTEGER AS start, n::INTEGER AS n FROM s""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its offset."""
    lines = P.lines_with_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return lines.select("doc_id", "line_no", "start", F.char_length("line").alias("n"))


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn up to each turn."""
    c = table(spark, sf_dir, "conversations")
    return P.carry_forward(c, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "user_turn").select("conv_id", "turn", "user_turn")


@query("""
WITH i AS (SELECT user_id, value, sum(CASE WHEN event_type = 'login' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, island::BIGINT AS island, count(*)::BIGINT AS n FROM i GROUP BY ALL""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events that a login begins."""
    out = P.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "login", "island")
    return out.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS sizes FROM documents),
g AS (SELECT doc_id, sizes, 1 AS i, sizes[1] AS used, 0 AS bin FROM l
  UNION ALL SELECT doc_id, sizes, i + 1, CASE WHEN used + 1 + sizes[i + 1] <= 2000 THEN used + 1 + sizes[i + 1] ELSE sizes[i + 1] END, CASE WHEN used + 1 + sizes[i + 1] <= 2000 THEN bin ELSE bin + 1 END FROM g WHERE i < len(sizes))
SELECT doc_id, (bin)::INTEGER AS bin, count(*)::BIGINT AS n_lines, max(used)::INTEGER AS chars FROM g GROUP BY doc_id, bin""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed greedily into chunks of at most 2000 characters."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n", -1), F.char_length).alias("sizes"))
    both = sizes.select("doc_id", F.arrays_zip(F.col("sizes").alias("size"), P.packed_sizes(F.col("sizes"), 2000).alias("bin")).alias("z"))
    lines = both.select("doc_id", F.explode("z").alias("z")).select("doc_id", "z.size", "z.bin")
    return lines.groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("n_lines"), (F.sum("size") + F.count(F.lit(1)) - 1).cast("int").alias("chars"))


@query("""
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY list_transform(regexp_extract_all(p_type || ' ' || p_size || ' ' || p_name || ' ' || p_partkey, '[0-9]+'), lambda x: x::BIGINT), p_partkey)::INTEGER AS place FROM part""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in natural order: by all integers in them."""
    label = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"), "p_name", F.col("p_partkey").cast("string"))
    return P.top_per_group(table(spark, sf_dir, "part").withColumn("k", K.numbers_in(label)), ["p_brand"], ["k", "p_partkey"], 1 << 30, "place").select("p_partkey", "place")


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || ' (' || n || ')' END AS label FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)""")
def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made unique by repeat marks."""
    return P.uniquified(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type"), ["p_brand"], ["p_partkey"], "p_type", "label").select("p_partkey", "label")


@query("""
WITH n AS (SELECT conv_id, list_sort(list_distinct(list(turn * 2 + conv_id % 3))) AS xs FROM conversations GROUP BY conv_id)
SELECT conv_id, unnest(list_filter(range(list_min(xs), list_max(xs) + 1), lambda x: NOT list_contains(xs, x))) AS missing FROM n""")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers absent between the first and the last of a group."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.col("turn") * 2 + F.col("conv_id") % 3).alias("xs"))
    return P.missing_numbers(n, F.col("xs"), ["conv_id"], "missing")


@query("""
SELECT conv_id, turn, lead(role, 1) OVER w AS next_role, lead(role, 2) OVER w AS then_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next two leaves after each."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("role", 1).over(w).alias("next_role"), F.lead("role", 2).over(w).alias("then_role"))


@query(r"""
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS dmy, o_orderpriority AS p FROM orders),
r AS (SELECT o_orderkey, CASE left(p, 1) WHEN '1' THEN iso || ' ' WHEN '2' THEN replace(iso, '-', '/') WHEN '3' THEN left(iso, 8) || '31' WHEN '4' THEN '' ELSE iso END AS raw, CASE left(p, 1) WHEN '5' THEN '9' || dmy ELSE dmy END AS dmy FROM d)
SELECT o_orderkey, CASE WHEN regexp_full_match(trim(raw), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(trim(raw) AS DATE) END AS day,
  CASE WHEN regexp_full_match(dmy, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN substr(dmy, 7) || '-' || substr(dmy, 4, 2) || '-' || left(dmy, 2) END AS iso,
  CASE WHEN regexp_full_match(trim(raw), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN strftime(TRY_CAST(trim(raw) AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') END AS eve FROM r""")
def date_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant ISO dates (some with blanks, slashes, days that don't exist), day-first dates of the right shape, and the day before."""
    iso, dmy, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.left("o_orderpriority", F.lit(1))
    raw = F.when(kind == "1", F.concat(iso, F.lit(" "))).when(kind == "2", F.replace(iso, F.lit("-"), F.lit("/"))).when(kind == "3", F.concat(F.left(iso, F.lit(8)), F.lit("31"))).when(kind == "4", "").otherwise(iso)
    said = F.when(kind == "5", F.concat(F.lit("9"), dmy)).otherwise(dmy)
    return table(spark, sf_dir, "orders").select("o_orderkey", V.parse_date(raw).alias("day"), V.day_first(said).alias("iso"), V.day_before(raw).alias("eve"))
