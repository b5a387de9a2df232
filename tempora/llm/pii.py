"""Personal data: patterns for identifiers, and information-theoretic sanitisation of the terms that reveal them.

Protected entities are the values that the patterns find. How strongly a term reveals an entity is estimated from
co-occurrence over the whole corpus: the pointwise mutual information of the term and the entity, as a share of the
entity's information content,

    disclosure(t, e) = log(N n(e, t) / (n(e) n(t))) / log(N / n(e)),

with n counting documents, n(e, t) those that hold both. It is 1 where a term occurs with nothing but the entity. Terms are
whole runs of letters. Those from REMOVE_AT on are removed and those from GENERALISE_AT on generalised, wherever they stand
in a document that holds the entity; entities and pairs seen in fewer than SUPPORT documents are no evidence. Texts are
never shuffled: each pass reads them again, looks identifiers and terms up in filters of a fixed size, and sends counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import written

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, REMOVE_AT, GENERALISE_AT = 3, 0.9, 0.75
#: Bits of the filters of entities, terms and pairs that the later passes look up: a fixed size, whatever the corpus. Of
#: other words, one in 2^24 for each key is let through.
FILTER_BITS = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
#: Runs of 14 digits or more; those of fewer digits can't be cards.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the digits carry a valid Luhn check digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(filter(lambda c: "0" <= c <= "9", s))


def find_identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each identifier, ordered; leftmost and without overlaps within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or not p.lstrip("0") or len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str, start: int, kind: int, end: int) -> str:
    return f"{KINDS[kind]}:{text[start:end].lower() if kind < 2 else _digits(text[start:end])}"


def _terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside all spans."""
    ends = sorted((a, b) for a, _, b in spans)
    at, reach = 0, 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while at < len(ends) and ends[at][0] < e:
            reach = max(reach, ends[at][1])
            at += 1
        if s >= reach:
            yield m[0].lower(), s, e


def _bit(key: str) -> int:
    return zlib.crc32(key.encode()) & (1 << FILTER_BITS) - 1


def _filter(keys: DataFrame, key) -> bytes:
    """The filter that lets these keys through."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[[r[0] for r in keys.select(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(1 << FILTER_BITS)).alias("p")).distinct().collect()]] = True
    return np.packbits(bits).tobytes()


def _unpacked(sent) -> bytes:
    return np.unpackbits(np.frombuffer(sent.value, np.uint8)).tobytes()


def _pair_counts(keyed: DataFrame, entities: bytes, repeated: bytes) -> DataFrame:
    """(entity, term, n_pair, share), for the entities that the filter lets through.

    n_pair: documents that hold both. share: their texts, each divided by the number of such entities in it; summed over the
    entities, it is the number of texts that hold the term and any of them.
    """
    spark = keyed.sparkSession
    sent, again = spark.sparkContext.broadcast(entities), spark.sparkContext.broadcast(repeated)
    schema = pa.schema([("id", pa.string()), ("entity", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, twice = _unpacked(sent), _unpacked(again)
        counts: dict[tuple, list] = {}

        def rows() -> pa.RecordBatch:
            columns = zip(*((*k, *n) for k, n in counts.items()), strict=True) if counts else ([], [], [], [], [])
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text, key = text.as_py() or "", key.as_py()
                spans = find_identifiers(text)
                held = {e for s in spans if wanted[_bit(e := _entity(text, *s))]}
                if not held:
                    continue
                # Rows of an id that repeats are told apart by it, and counted once; others are counted here.
                name = key if twice[_bit(key)] else None
                own = {t for t, _, _ in _terms(text, spans)}
                for e in held:
                    for t in own:
                        both = counts.setdefault((name, e, t), [0, 0.0])
                        both[0] += 1
                        both[1] += 1 / len(held)
                    if len(counts) > 200_000:
                        yield rows()
        yield rows()

    met = keyed.mapInArrow(run, "id string, entity string, term string, n long, share double")
    once = met.groupBy("id", "entity", "term").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).withColumn("n", F.when(F.col("id").isNull(), F.col("n")).otherwise(1))
    return once.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.sum("share").alias("share"))


def _occurrences(keyed: DataFrame, id_col: str, entities: bytes, pairs: bytes) -> DataFrame:
    """(id_col, text_key, entity, term, start, end) of the terms of pairs that the filters let through, in texts that hold the entity."""
    context = keyed.sparkSession.sparkContext
    sent, both = context.broadcast(entities), context.broadcast(pairs)
    kind = keyed.schema[id_col].dataType.simpleString()
    names = ["entity", "term", "start", "end"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = _unpacked(sent), _unpacked(both)
        for batch in batches:
            def rows(at: list[int], found: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                index = pa.array(at, pa.int32())
                columns = zip(*found, strict=True) if found else ([], [], [], [])
                values = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *values], names=[id_col, "text_key", *names])

            at, found = [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                spans = find_identifiers(text)
                held = {e for s in spans if wanted[_bit(e := _entity(text, *s))]}
                memo: dict[str, list[str]] = {}
                for t, a, b in _terms(text, spans) if held else ():
                    if t not in memo:
                        memo[t] = [e for e in held if known[_bit(f"{e}\n{t}")]]
                    for e in memo[t]:
                        at.append(i)
                        found.append((e, t, a, b))
                if len(at) > 100_000:
                    yield rows(at, found)
                    at, found = [], []
            yield rows(at, found)

    return keyed.mapInArrow(run, f"`{id_col}` {kind}, text_key long, entity string, term string, start int, end int")


def _term_counts(texts: DataFrame, terms: bytes) -> DataFrame:
    """(term, documents that have it) for the terms that the filter lets through."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _unpacked(sent)
        memo: dict[str, bool] = {}
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for term in {t.lower() for t in set(_TERM.findall(text.as_py() or ""))}:
                    keep = memo.get(term)
                    if keep is None:
                        if len(memo) > 300_000:
                            memo.clear()
                        keep = memo[term] = wanted[_bit(term)] == 1
                    if keep:
                        counts[term] += 1
                if len(counts) > 200_000:
                    yield rows()
        yield rows()

    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, text_key (long), n_email, n_ip, n_card, n_phone (long), base and spans.

    base holds the identifiers and spans these and the terms that reveal them, as arrays of (start, kind, end, action):
    kind is a number in KINDS, offsets are code points, the end is exclusive, and the action is 'mask', 'remove' or
    'generalise'; arrays are ordered by start, then kind. Terms never overlap identifiers. A null text has no spans;
    rows with a null id have identifiers but no terms. text_key tells apart rows that repeat an id with another text;
    equal rows are all returned. Other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = "struct<start:int,kind:int,end:int,action:string>"
    span_type = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("action", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, held = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                spans = find_identifiers(text)
                base.append([{"start": a, "kind": k, "end": b, "action": "mask"} for a, k, b in spans])
                held.append(sorted({_entity(text, *x) for x in spans}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(span_type)), pa.array(held, pa.list_(pa.string()))], names=[id_col, "text_key", "base", "held"])

    keyed = docs.select(id_col, F.xxhash64(text_col).alias("text_key"), text_col)
    found = written(keyed.mapInArrow(scan, f"`{id_col}` {kind}, text_key long, base array<{span}>, held array<string>"), "personal")
    total = found.count()
    with_id = found.where(F.col(id_col).isNotNull())
    rows = with_id.select(id_col, F.explode("held").alias("entity"))
    entity = written(rows.distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= SUPPORT), "entities")
    entities = _filter(entity, F.col("entity"))
    repeated = _filter(with_id.where(F.size("held") > 0).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.col(id_col))
    named = keyed.where(F.col(id_col).isNotNull())
    counted = written(_pair_counts(named.select(F.col(id_col).cast("string"), text_col), entities, repeated), "counted")
    n = F.lit(float(max(total, 2)))
    disclosure = lambda texts: F.log(n * F.col("n_pair") / (F.col("n_entity") * texts)) / F.log(n / F.col("n_entity"))
    # A term stands in all texts that hold it beside an entity, if not in more: where that is too many, it needn't be counted.
    least = counted.groupBy("term").agg(F.sum("share").alias("least"))
    pairs = counted.where(F.col("n_pair") >= SUPPORT).join(entity.where(F.col("n_entity") < total), "entity").join(least, "term")
    pairs = written(pairs.where(disclosure(F.col("least")) >= GENERALISE_AT - 1e-6).drop("share", "least"), "pairs")
    terms = _term_counts(docs.select(text_col), _filter(pairs, F.col("term")))
    known = pairs.join(terms, "term").withColumn("disclosure", disclosure(F.col("n_term"))).where(F.col("disclosure") >= GENERALISE_AT)
    known = written(known.select("entity", "term", F.when(F.col("disclosure") >= REMOVE_AT, "remove").otherwise("generalise").alias("action")), "known")
    places = _occurrences(named, id_col, _filter(known, F.col("entity")), _filter(known, F.concat_ws("\n", "entity", "term")))
    revealed = places.join(known, ["entity", "term"]).groupBy(id_col, "text_key", "start", "end").agg(F.max("action").alias("action"))
    revealed = revealed.groupBy(id_col, "text_key").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "action")).alias("revealed"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    out = found.join(revealed, [id_col, "text_key"], "left")
    spans = F.array_sort(F.concat("base", F.coalesce("revealed", F.array().cast(f"array<{span}>"))))
    return out.select(id_col, "text_key", *map(count, range(4)), "base", spans.alias("spans"))


def spans_text(spans: str):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def rewrite(text: str, spans: list[dict]) -> str:
    """The text without its personal data: identifiers give way to their kind, terms to a mark or to nothing."""
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        out.append(text[at : max(at, s["start"])])
        out.append({"mask": f"<{KINDS[s['kind']].upper()}>", "generalise": "<TERM>"}.get(s["action"], ""))
        at = s["end"]
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rewritten; columns and rows stay, and texts without personal data are unchanged."""
    found = find_personal_data(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias("__tempora_id"), F.col("text_key").alias("__tempora_key"), F.col("spans").alias("__tempora_spans"))
    found = found.dropDuplicates(["__tempora_id", "__tempora_key"])
    joined = docs.withColumn("__tempora_hash", F.xxhash64(text_col)).join(found, F.col(id_col).eqNullSafe(F.col("__tempora_id")) & (F.col("__tempora_hash") == F.col("__tempora_key")), "left")

    @F.pandas_udf("string")
    def clean(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or t is None else rewrite(t, s))

    return joined.withColumn(text_col, F.when(F.col("__tempora_spans").isNull(), F.col(text_col)).otherwise(clean(text_col, "__tempora_spans"))).select(*docs.columns)
