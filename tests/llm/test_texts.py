"""Licenses, personal data, tokens, media and toxicity."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tempora.llm import license_scan as L
from tempora.llm import media as M
from tempora.llm import pii
from tempora.llm.bpe import Automaton, bpe_round_trip, compile_vocabulary
from tempora.llm.toxicity import score_toxicity

from . import cases

HERE = [(1, f"Some words here. {L.TEMPLATES[0][1]} More words."), (2, L.TEMPLATES[1][1]), (3, "x " * 40 + L.TEMPLATES[7][1].replace("redistribute", "share") + " y" * 50), (4, None), (5, ""), (6, "released under the license"), (7, L.TEMPLATES[4][1].upper())]


def test_licenses(spark):
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in HERE], "doc_id long, text string, template int, h string")
    got = {(r["doc_id"], r["license"]): r for r in L.scan_licenses(docs).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "GPL-3.0"), (7, "CC-BY-NC-4.0")}
    assert got[1, "MIT"]["at"] == 4 and got[1, "MIT"]["containment"] == 1.0
    assert 0.8 <= got[3, "GPL-3.0"]["containment"] < 1
    assert L.scan_licenses(docs.limit(0)).count() == 0
    assert L.scan_licenses(docs, [("none", "")]).count() == 0
    assert L.collision_probability(0.5) > 0.99


def test_many_templates_take_more_scans(spark, monkeypatch):
    monkeypatch.setattr(L, "BATCH", 4)
    docs = spark.createDataFrame(HERE, "doc_id long, text string")
    assert {r["doc_id"] for r in L.scan_licenses(docs).collect()} == {1, 2, 3, 7}


def test_every_template_covers_half_of_a_window_at_every_offset():
    for n in range(4, 100):
        wide, step = next((w, step) for w, step, least, most in L.CLASSES if least <= n <= most)
        own = [set(range(k, min(k + wide, n))) for k in range(0, n, step)]
        for offset in range(step):
            doc = [set(range(k - offset, k - offset + wide)) for k in range(0, offset + n, step)]
            assert max(len(x & y) / len(x | y) for x in own for y in doc) >= 0.5, (n, offset)


def test_templates_of_9_to_16_shingles_are_found_at_every_offset(spark):
    rng = random.Random(8)
    templates = [(f"t{n}", " ".join(cases.words(rng, n + 4))) for n in range(9, 17)]
    docs = [(100 * k + at, " ".join([*cases.words(rng, 48 + at), text, *cases.words(rng, 60)])) for k, (_, text) in enumerate(templates) for at in range(32)]
    got = {(r["doc_id"], r["license"]): r["at"] for r in L.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert len(got) >= 253
    assert all(at == 49 + i % 100 and name == templates[i // 100][0] for (i, name), at in got.items())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_identifiers(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_identifiers_are_those_of_the_patterns():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    rng = random.Random(5)
    parts = ["a", "@", ".", "1", "2", "9", "0", "+", "-", " ", "(", ")", "_", "%", "b.c", "4111 1111 1111 1111", "255", "+49 30 123456", "é", "\n", "00255", "256"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert pii.find_identifiers(text) == brute_identifiers(text), text


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"write to boss@x.org our zaphod today number{i}") for i in range(5)] + [(10 + i, f"the zaphod like word and today {i}" if i == 0 else f"plain words today {i}") for i in range(40)]
    rows += [(100, None), (None, "mail boss@x.org zaphod"), (101, "")]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, n_email int, base string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert len(got) == len(rows)
    revealed = {rows[0][1][s["start"] : s["end"]]: s["action"] for s in got[0]["spans"] if s["kind"] == 4}
    assert revealed["write"] == "remove" and revealed["zaphod"] in ("remove", "generalise") and "today" not in revealed
    assert got[100]["spans"] == [] and got[0]["n_email"] == 1 and [s["kind"] for s in got[None]["spans"]] == [0]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "boss" not in clean[0] and "<EMAIL>" in clean[0] and clean[12] == rows[7][1] and clean[100] is None
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_terms_far_from_the_entity_and_short_names(spark):
    gap = " plain words today" * 20
    rows = [(i, f"Zaphod{gap} {i} mail boss@x.org or Li,{gap} 王明. Zaphod") for i in range(5)] + [(10 + i, f"plain words today or mail {i}") for i in range(60)]
    rows += [(0, f"Zaphod{gap} boss@x.org"), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(docs).collect()
    assert len(found) == len(rows)
    got = next(r for r in found if r["doc_id"] == 2)
    terms = [rows[2][1][s["start"] : s["end"]] for s in got["spans"] if s["kind"] == 4]
    assert terms == ["Zaphod", "Li", "王明", "Zaphod"]
    near, brute = {t for _, t in rows[:5]}, pii.sanitise(docs).where("doc_id < 5").collect()
    assert len(brute) == 7 and not near & {r["text"] for r in brute} and not any("Zaphod" in r["text"] for r in brute)


def test_tokens_are_those_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    automaton = Automaton.load(open(path, encoding="utf-8").read())
    rng = random.Random(6)
    texts = ["", "<|endoftext|>hi<|startoftext|> <|endoftext|", "don't I'LL we've '' 's", "日本語 한국어 ١٢٣ ²½Ⅷ", "llll aaaa " + "ab" * 40, "x\x1cy\x1dz \x85b", "ΣΑΣ İstanbul ǅ"]
    texts += ["".join(rng.choice("abcdeinorst ,.!'") for _ in range(200)) for _ in range(200)] + [r[1] for r in cases.documents(3) if r[1]]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(automaton.encode(text), "<u4").tolist() == ids, text
        assert automaton.decode(automaton.encode(text)) == library.decode(ids, skip_special_tokens=False)
    docs = spark.createDataFrame([(1, None, 2), (2, "a b", 3), (None, "", 4)], "doc_id long, text string, ids int")
    assert {(r["doc_id"], r["n_tokens"], r["decoded"]) for r in bpe_round_trip(docs, path).collect()} == {(1, 0, ""), (2, 2, "a</w> b</w>"), (None, 0, "")}


def test_media_round_trip(spark, monkeypatch):
    docs = spark.createDataFrame(cases.documents(7), cases.SCHEMA)
    monkeypatch.setattr(M, "MOST_ROWS", 5)
    got = M.read_media(M.store_texts(docs)).join(docs.select("doc_id", "text").distinct(), "doc_id")
    for r in got.collect():
        data = (r["text"] or "").encode()
        padded = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (bytes(r["payload"]), r["n_bytes"], r["payload_bytes"]) == (padded, len(data), len(padded))
        assert r["tail_crc32"] == zlib.crc32(padded[-16:])
    assert M.read_media(M.store_texts(docs.limit(0))).count() == 0
    none = spark.createDataFrame([(1, None), (2, b"")], "id int, media binary")
    assert [(bytes(r["payload"]), r["width"]) for r in M.read_media(none).collect()] == [(b"", None)] * 2
    everything = np.random.default_rng(1).integers(0, 256, 192 * 3, dtype=np.uint8).tobytes()
    assert b"".join(g.tobytes() for g in M.thumbnails(M.encode([everything]))[0]) == everything


def colour_jpeg(luma: np.ndarray) -> bytes:
    """A baseline JPEG with three components (luma sampled 2 x 2), AC coefficients and no restarts, written here bit by bit."""
    down, across = luma.shape
    dc = {s: (c, n) for s, c, n in M._codes((0, 1, 5, 1, 1, 1, 1, 1, 1) + (0,) * 7, tuple(range(12)))}
    ac = {s: (c, n) for s, c, n in M._codes((0, 2, 1) + (0,) * 13, (0x00, 0x11, 0xF0))}
    bits = ""
    before = [0, 0, 0]

    def block(component, value, rough):
        nonlocal bits
        diff, before[component] = value - before[component], value
        size = abs(diff).bit_length()
        code, n = dc[size]
        bits += f"{code:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
        if rough:
            for symbol, extra in ((0x11, "1"), (0xF0, ""), (0x11, "0")):
                bits += f"{ac[symbol][0]:0{ac[symbol][1]}b}" + extra
        bits += f"{ac[0][0]:0{ac[0][1]}b}"

    for y in range(0, down, 2):
        for x in range(0, across, 2):
            for v in (0, 1):
                for h in (0, 1):
                    block(0, int(luma[y + v, x + h]) - 128, (x + v) % 3 == 0)
            block(1, (x * 7) % 50, True)
            block(2, -((y * 5) % 40), False)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    segment = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    table = lambda k, counts, symbols: bytes([k, *counts, *symbols])
    return (
        b"\xff\xd8" + segment(0xFE, b"comment") + segment(0xDB, bytes([0, 8, *[1] * 63]) + bytes([1, 3, *[1] * 63]))
        + segment(0xC0, bytes([8]) + (down * 8).to_bytes(2, "big") + (across * 8).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
        + segment(0xC4, table(0, (0, 1, 5, 1, 1, 1, 1, 1, 1) + (0,) * 7, range(12)) + table(0x10, (0, 2, 1) + (0,) * 13, (0x00, 0x11, 0xF0)))
        + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )


def test_baseline_jpeg_of_others():
    luma = np.random.default_rng(2).integers(0, 256, (6, 10), dtype=np.uint8)
    (grid,), (plain,) = M.thumbnails([colour_jpeg(luma), M.encode([bytes(192)])[0]])
    assert (grid == luma).all() and not plain.any()
    with pytest.raises(ValueError):
        M.thumbnails([b"GIF89a"])


def test_toxicity_is_learned_from_the_rows_that_may_teach(spark):
    rng = random.Random(8)
    insults = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = cases.words(rng, 60)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(60), "you " + rng.choice(insults))
        rows.append((i, " ".join(text)))
        teaches = zlib.crc32(str(i).encode()) % 4 != 2
        labels.append((i, int(toxic) if teaches else int(not toxic), "x"))
    rows += [(9000, None), (9001, ""), (None, "idiot")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    out = {r["doc_id"]: r for r in score_toxicity(docs, spark.createDataFrame([*labels, (None, 1, "y")], "doc_id long, toxic int, text string")).collect()}
    assert len(out) == len(rows)
    held = [i for i in range(600) if out[i]["held_out"]]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    assert sum((out[i]["score"] >= 0.3) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[9000]["score"] < 0.3
    nothing = score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in nothing.collect()} == {0.0}
    assert score_toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int, text string")).count() == 0


def test_tokens_of_every_code_point_and_of_random_mixes():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        automaton = Automaton.load(file.read())
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    same = lambda t: np.frombuffer(automaton.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and not same(f"a{chr(c)}b")] == []
    rng = random.Random(6)
    ranges = [(32, 127), (97, 123), (97, 123), (0xA0, 0x370), (0x300, 0x370), (0x1E00, 0x1F00), (0x3000, 0x9FFF), (0xAC00, 0xD7A0)]
    for _ in range(3000):
        assert same("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 25))))
    assert same("aaaa aaaaa " + "a" * 999 + " hahahahahahaha" * 40)


def test_merges_that_make_one_token_twice_or_never():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", "ab", "bc", "abc", "bc</w>", "abc</w>", "aa"])}
    merges = [["b", "c"], ["a", "b"], ["ab", "c"], ["a", "bc"], ["b", "c</w>"], ["ab", "c</w>"], ["a", "bc</w>"], ["a", "a"]]
    spec = {"model": {"end_of_word_suffix": "</w>", "vocab": vocab, "merges": merges}, "added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"[\p{L}]+"}}]}}
    automaton = Automaton(compile_vocabulary(spec))

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for x, y in merges:
            out = []
            for p in parts:
                if out and out[-1] == x and p == y:
                    out[-1] = x + y
                else:
                    out.append(p)
            parts = out
        return tuple(vocab[p] for p in parts)

    rng = random.Random(8)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        assert automaton.path(word.encode()) == plain(word), word


def test_no_texts_and_repeated_ones(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe_round_trip(spark.createDataFrame([], cases.SCHEMA), path).count() == 0
    rows = bpe_round_trip(spark.createDataFrame([(1, "two words", 0), (1, "two words", 0), (None, None, 1)], "doc_id long, text string, n_tokens int"), path).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 2, 2]


def test_media_that_cannot_be_read_have_a_reason(spark):
    good = M.encode([b"x" * 384])[0]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2")
    rows = [(0, good), (1, good[:-40]), (2, b"not an image"), (3, progressive), (4, None), (5, good[:30]), (6, good)]
    got = {r["k"]: r for r in M.read_media(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert got[0]["payload"] == got[6]["payload"] == b"x" * 384 and got[0]["error"] is None
    assert all(got[k]["error"] and got[k]["width"] is None and got[k]["payload"] == b"" for k in (1, 2, 3, 5))
    assert got[4]["error"] is None and got[4]["payload_bytes"] == 0


def test_template_hits_are_those_of_looking_everywhere(spark):
    rng = random.Random(5)
    templates = [(f"L{k}", " ".join(cases.words(rng, n))) for k, n in enumerate((5, 7, 12, 25, 60))]
    docs = []
    for i in range(120):
        words = templates[i % 5][1].split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = "edited"
        docs.append((i, " ".join(cases.words(rng, rng.randrange(90)) + words + cases.words(rng, rng.randrange(90)))))
    got = {(r["doc_id"], r["template"]): r["containment"] for r in L.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    wanted = {}
    for i, text in docs:
        own = set(cases.shingles(text))
        for k, (_, t) in enumerate(templates):
            share = len(set(cases.shingles(t)) & own) / len(set(cases.shingles(t)))
            if share >= 0.8:
                wanted[i, k] = share
    assert len(wanted) > 60 and set(got) <= set(wanted) and len(set(wanted) - set(got)) <= 0.02 * len(wanted)
    assert all(got[key] == pytest.approx(wanted[key]) for key in got)


def test_long_and_repeated_rows_of_licenses_and_personal_data(spark):
    notice = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    text = "filler words " * 40000 + L.TEMPLATES[1][1] + " more " * 1000 + "write to ann@example.org " * 3000 + notice
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert {(r["doc_id"], r["template"]) for r in L.scan_licenses(docs).collect()} == {(1, 1), (None, 1)}
    found = pii.find_personal_data(docs).collect()
    assert [r["n_email"] for r in found] == [3000] * 3


def test_terms_are_those_of_naive_counts_and_few_are_counted(spark, monkeypatch):
    """Spans equal those of plain counts over a small corpus; a term that too many texts hold beside entities isn't counted over the corpus."""
    rng = random.Random(31)
    entities = [f"user{k}@mail.example.com" for k in range(9)]
    names = cases.words(rng, 9)
    rows = []
    for i in range(900):
        words = cases.words(rng, 5) + rng.sample(["red", "green", "blue", "amber"], 2) + (["office"] if i % 3 else [])
        if i < 270:
            words += ["contact", entities[i % 9]] + [names[i % 9]] * (i % 5 > 0) + [entities[(i + 1) % 9]] * (i % 7 == 0)
        elif i % 20 == 0:
            words.append(rng.choice(names))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    counted, own = [], pii._term_counts
    monkeypatch.setattr(pii, "_term_counts", lambda texts, terms: counted.append(terms) or own(texts, terms))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = {i: (pii.find_identifiers(t), {pii._entity(t, *s) for s in pii.find_identifiers(t)}) for i, t in rows}
    terms = {i: list(pii._terms(t, held[i][0])) for i, t in rows}
    n_term, n_entity, n_pair = {}, {}, {}
    for i, _ in rows:
        own_terms = {t for t, _, _ in terms[i]}
        for t in own_terms:
            n_term[t] = n_term.get(t, 0) + 1
        for e in held[i][1]:
            n_entity[e] = n_entity.get(e, 0) + 1
            for t in own_terms:
                n_pair[e, t] = n_pair.get((e, t), 0) + 1
    reveal = {}
    for (e, t), n in n_pair.items():
        if n >= pii.SUPPORT and (d := np.log(900 * n / (n_entity[e] * n_term[t])) / np.log(900 / n_entity[e])) >= pii.GENERALISE_AT:
            reveal[e, t] = "remove" if d >= pii.REMOVE_AT else "generalise"
    want = {}
    for i, _ in rows:
        found = [(a, 4, b, max(does)) for t, a, b in terms[i] if (does := [reveal[e, t] for e in held[i][1] if (e, t) in reveal])]
        want[i] = sorted([(a, k, b, "mask") for a, k, b in held[i][0]] + found)
    assert got == want and any(s[1] == 4 for x in got.values() for s in x)
    bits = np.unpackbits(np.frombuffer(counted[0], np.uint8))
    assert all(bits[pii._bit(t)] for _, t in reveal)
    assert not bits[pii._bit("contact")]


def test_few_other_words_pass_the_filter_of_terms(spark):
    words = spark.range(60_000).selectExpr("translate(md5(CAST(id AS STRING)), '0123456789', 'ghijklmnop') AS w", "id < 20000 AS mine")
    sent = pii._filter(words.where("mine"), F.col("w"))
    others = words.where("NOT mine").groupBy().agg(F.concat_ws(" ", F.collect_list("w")).alias("text"))
    assert pii._term_counts(others, sent).count() <= 200
