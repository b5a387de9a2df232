"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.bpe import bpe_round_trip
from tempora.llm.common import documents
from tempora.llm.conversations import NOTHING, damage, repair_conversations
from tempora.llm.importance import importance_weights, resample
from tempora.llm.license_scan import scan_licenses
from tempora.llm.media import read_media, store_texts
from tempora.llm.metric_search import top_inner_products
from tempora.llm.near_dedup import near_duplicate_classes
from tempora.llm.packing import pack_documents
from tempora.llm.pii import find_personal_data, spans_text
from tempora.llm.substring_dedup import remove_repeated_passages
from tempora.llm.suffix_dedup import remove_repeated_bytes
from tempora.llm.toxicity import score_toxicity
from tempora.llm.url_filter import filter_urls

#: The URL rules of the registered query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicate_classes(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a 13-word window of a smaller document, removed."""
    out = remove_repeated_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates that every document contains."""
    return scan_licenses(documents(spark, sf_dir)).withColumn("containment", F.round("containment", 6))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    out = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of the largest inner product with every fiftieth vector."""
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as baseline JPEG and read back."""
    out = read_media(store_texts(documents(spark, sf_dir)))
    feature = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(":"), F.sha2("thumb_hash", 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    return pack_documents(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document, and the terms that reveal it."""
    out = find_personal_data(documents(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, encoded and decoded by the automaton of a public vocabulary."""
    import public_tokenizers

    out = bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 400-byte string which starts elsewhere too, removed."""
    out = remove_repeated_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importance of every document for the benchmark's n-grams, and the sample drawn by it."""
    weights = importance_weights(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return resample(weights).select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair_conversations(damage(rows))
    names = rows.select("conv_id").distinct()
    out = names.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
low AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN low USING (k), range(0, 13) r(j) WHERE least < doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) FILTER (hit.pos IS NULL) AS t, count(hit.pos) AS gone
         FROM pos p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.pos = hit.pos GROUP BY p.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400),
win AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS k FROM p),
hit AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
new AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS first FROM hit),
run AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM new),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, r, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY r), 1) AS a, a AS z FROM span
          UNION ALL SELECT doc_id, max(r) + 1, max(z), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(array_slice(b, piece.a, coalesce(piece.z, n + 1) - 1)), '' ORDER BY r) AS h FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12_SQL = r"""
WITH RECURSIVE hexes AS (SELECT i::BIGINT AS b, lpad(hex(i), 2, '0') AS hx, list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
df AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
       list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS g FROM d) GROUP BY ALL),
qf AS (SELECT g, count(*) AS c FROM (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
       list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS g FROM q) GROUP BY ALL),
sf AS (SELECT g, sum(c) AS c FROM df GROUP BY g),
dict AS MATERIALIZED (SELECT g, row_number() OVER () AS id FROM (SELECT g FROM sf UNION SELECT g FROM qf)),
tab AS (SELECT 0 AS j, hx, v FROM hexes UNION ALL SELECT 0, 'start', 4294967295
        UNION ALL SELECT j + 1, tab.hx, xor(tab.v >> 8, hexes.v) FROM tab JOIN hexes ON hexes.b = tab.v & 255 WHERE j <= (SELECT max(strlen(g)) FROM dict)),
bytes AS (SELECT id, n - 1 - k AS j, substr(h, 2 * k + 1, 2) AS hx FROM (SELECT id, strlen(g) AS n, hex(encode(g)) AS h, unnest(range(strlen(g))) AS k FROM dict)),
mixed AS (SELECT id, bit_xor(v) AS x FROM bytes JOIN tab USING (j, hx) GROUP BY id),
bucket AS MATERIALIZED (SELECT g, xor(xor(x, v), 4294967295) % 10000 AS b FROM dict JOIN mixed USING (id) JOIN tab ON tab.hx = 'start' AND tab.j = strlen(g)),
s AS (SELECT b, sum(c) AS s FROM sf JOIN bucket USING (g) GROUP BY b),
t AS (SELECT b, sum(c) AS t FROM qf JOIN bucket USING (g) GROUP BY b),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS S_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS T_all),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (S_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (T_all + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (b), total),
weighed AS (SELECT doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM df JOIN bucket USING (g) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS enough,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE enough)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 5 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
OP13_SQL = r"""
WITH RECURSIVE key AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
                 xor(c >> 8, list_reduce([xor(c, b) & 255, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295) % 20 AS code FROM key),
dam AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
               CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE code <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dam),
seen AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS ini,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
x AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM seen),
dp AS (
  SELECT conv_id, n + 1 AS i, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS v0, {'c': 6::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']} AS v1,
         {'c': 3::BIGINT, 'a': 'I', 'r': ['assistant:']} AS v2, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS v3 FROM num WHERE i = 1
  UNION ALL
  SELECT conv_id, i, list_min([b0, {'c': 3 + w2.c, 'a': 'I' || w2.a, 'r': list_prepend('user:', w2.r)}]) AS v0, list_min([b1, {'c': 3 + w2.c, 'a': 'I' || w2.a, 'r': list_prepend('user:', w2.r)}]) AS v1, w2 AS v2, w3 AS v3
  FROM (SELECT *, list_min([b2, {'c': 3 + b3.c, 'a': 'I' || b3.a, 'r': list_prepend('assistant:', b3.r)}]) AS w2, list_min([b3, {'c': 3 + b2.c, 'a': 'I' || b2.a, 'r': list_prepend('user:', b2.r)}]) AS w3
  FROM (SELECT conv_id, i, list_min([{'c': 4 + v0.c, 'a': 'D' || v0.a, 'r': v0.r}, CASE WHEN ini = 's' AND stays THEN {'c': t + v1.c, 'a': 'K' || v1.a, 'r': list_prepend(own, v1.r)} END, ku, ru]) AS b0,
               list_min([{'c': 4 + v1.c, 'a': 'D' || v1.a, 'r': v1.r}, ku, ru]) AS b1,
               list_min([{'c': 4 + v2.c, 'a': 'D' || v2.a, 'r': v2.r}, CASE WHEN ini = 'a' AND stays THEN {'c': t + v3.c, 'a': 'K' || v3.a, 'r': list_prepend(own, v3.r)} END,
                         CASE WHEN stays THEN {'c': 3 + t + v3.c, 'a': 'R' || v3.a, 'r': list_prepend('assistant:' || text, v3.r)} END]) AS b2,
               list_min([{'c': 4 + v3.c, 'a': 'D' || v3.a, 'r': v3.r}, ku, ru]) AS b3
  FROM (SELECT dp.conv_id, x.i, v0, v1, v2, v3, ini, text, role || ':' || text AS own, f NOT IN ('b', 'd') AS stays, CASE WHEN f = 't' THEN 3 ELSE 0 END AS t,
               CASE WHEN ini = 'u' AND f NOT IN ('b', 'd') THEN {'c': t + v2.c, 'a': 'K' || v2.a, 'r': list_prepend(own, v2.r)} END AS ku,
               CASE WHEN f NOT IN ('b', 'd') THEN {'c': 3 + t + v2.c, 'a': 'R' || v2.a, 'r': list_prepend('user:' || text, v2.r)} END AS ru
        FROM dp JOIN x ON dp.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = dp.i - 1)))),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
                 count(*) FILTER (f = 't') AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON c.conv_id IS NOT DISTINCT FROM facts.conv_id
LEFT JOIN dp ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = 1
"""

QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_license_scan, op3_substring_dedup, op4_toxicity, op5_exact_topk, op6_media_columns, op7_url_filter, op8_pii, op9_bpe_automaton, op10_best_fit_packing, op11_suffix_dedup, op12_importance_resampling, op13_conversation_repair)}
ORACLE_SQL = {"op3_substring_dedup": OP3_SQL, "op5_exact_topk": OP5_SQL, "op11_suffix_dedup": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_conversation_repair": OP13_SQL}
