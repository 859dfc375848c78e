"""Operators of runledger.llm against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import (components, decontaminate, langid, linededup, pieces, preferences, queries, secrets, simhash,
                           suffixes, topk, toxicity)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, spans string, h string, ids string"
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(3000))
TEXTS = [None, "", " \n ", "a", "Is it?", "the quick brown fox jumps over the lazy dog again and again today",
         "the quick brown fox jumps over the lazy dog again and again today", LONG, LONG + " x", "日本語 テキスト 🎉", "\x00\x01"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, "en", "s", 0, "c", "c", "c", "c") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, "no id at all", None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "fox jumps over the lazy dog"), (2, None), (3, ""), (None, "quick brown"), (4, " ".join(LONG.split()[50:75]))],
                                 "item_id bigint, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_decontamination_edge_cases(odd, empty, bench):
    got = by_id(decontaminate.contract(odd, bench))
    assert decontaminate.contract(odd, bench).count() == odd.count()
    assert (got[0]["n_words"], got[0]["n_hit"], got[1]["n_words"]) == (0, 0, 0)
    assert (got[5]["n_hit"], got[5]["n_items"], got[5]["contaminated"]) == (8, 1, True)
    assert got[5]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert got[7]["n_hit"] >= 25 and got[3]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contract(empty, bench).count() == 0
    assert decontaminate.contract(odd, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    blocks = decontaminate.document_hits(odd, bench, block_windows=5).select("doc_id", "hits", "items")
    whole = decontaminate.document_hits(odd, bench).select("doc_id", "hits", "items")
    assert sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))
    assert decontaminate.clean_documents(odd, bench).columns == odd.columns


def test_secrets_against_plain_patterns(odd, empty):
    rng = random.Random(5)

    def plain(t):
        out = []
        for kind, rx, ok in (("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12), ("access", secrets.ACCESS, lambda m: len(m[0]) >= 18),
                             ("hex", secrets.HEX, lambda m: len(m[0]) >= 16)):
            out += [(kind, m.start(), m.end()) for m in rx.finditer(t) if ok(m)]
        return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))

    for _ in range(3000):
        t = "".join(rng.choice("abcdef0123zX:= AKI\"é") for _ in range(50)) + rng.choice(["token", "PassWord", "api_key", "AKIA", "ſecret"]) \
            + rng.choice(["=", '": "', ":", " = "]) + "".join(rng.choice("abAZ09") for _ in range(rng.randint(0, 30)))
        assert plain(t) == [s for s in secrets.find_secrets(t) if s[0] in secrets.BASE_KINDS], t
    body = "A" * 30
    good = "x ghp_" + body + secrets.base62_crc(body)
    assert ("github", 2, 42) in secrets.find_secrets(good) and not secrets.find_secrets(good[:-1] + "!")
    assert ("card", 0, 16) in secrets.find_secrets("4111111111111111")
    assert secrets.contract(odd).count() == odd.count() and secrets.contract(empty).count() == 0


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.5]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 0.0]), (6, []), (None, [1.0, 1.0]), (7, [-1.0, 0.0, 9.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id bigint, embedding array<float>, score int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, k=4, block_rows=2, query_rows=1).collect()))
    one = 1024 * 1024
    assert got == [(0, 1, 1, 5 * one), (0, 2, 1, 5 * one), (0, 3, 100, one // 2), (0, 4, 6, 0),
                   (100, 1, 0, one // 2), (100, 2, 0, one // 2), (100, 3, 1, one // 2), (100, 4, 1, one // 2)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_line_dedup_edge_cases(odd, empty, spark):
    base = " ".join(f"k{i}" for i in range(80))
    near, far = base.replace("k79", "z"), base.replace("k20", "z").replace("k50", "y").replace("k70", "x")
    df = spark.createDataFrame([(2, near + "\n\nkeep", 1), (1, base + "\nshort\n" + far, 1), (3, "short\n  short \n", 1), (3, "short\n  short \n", 1),
                                (4, None, 1), (5, "", 1)], "doc_id bigint, text string, removed int")
    out = sorted((r["doc_id"], r["text"]) for r in linededup.deduplicate(df).where("doc_id < 4").collect())
    assert out == [(1, base + "\nshort\n" + far), (2, "\nkeep"), (3, ""), (3, "")]
    assert linededup.deduplicate(df).columns == df.columns and linededup.deduplicate(df).count() == 6
    assert linededup.deduplicate(odd).count() == odd.count() and linededup.contract(empty).count() == 0


def test_language_id_held_out(docs, odd, empty):
    model = langid.fit_on(docs)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert right >= 0.95 * n
    got = langid.contract(odd.unionByName(odd.where("doc_id = 5")))
    rows = by_id(got)
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[10]["lang_pred"] == "und" and rows[5]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.collect()) and langid.contract(empty).count() == 0
    assert langid.accepted(odd, model).columns == odd.columns


def test_preferences(spark):
    turn = "struct<role:string,text:string>"
    df = spark.createDataFrame([
        (1, [("user", "hi"), ("assistant", "A")], [("user", "hi"), ("assistant", "BB"), ("user", "c")]), (2, [("user", "x")], [("user", "x")]),
        (3, None, [(None, None)])], f"id int, chosen array<{turn}>, rejected array<{turn}>")
    a, b, c = sorted(preferences.format_pairs(df).collect())
    assert a["n_common"] == 1 and a["prompt"] == "<|user|>\nhi\n<|end|>\n" and a["chosen_text"] == "<|assistant|>\nA\n<|end|>\n"
    for text, spans, want in ((a["chosen_text"], a["chosen_mask"], ["A"]), (a["rejected_text"], a["rejected_mask"], ["BB"])):
        assert [text[s["start"]:s["end"]] for s in spans] == want
    assert (b["n_common"], b["chosen_text"], b["rejected_mask"]) == (1, "", []) and c["n_common"] == 0
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert preferences.contract(none).count() == 0


def test_simhash_against_all_pairs(docs, odd, empty):
    import xxhash

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))

    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = by_id(simhash.contract(docs))
    assert all(f"{plain(t):016x}" == got[k]["fingerprint"] for k, t in texts.items())
    ids = sorted(texts)
    codes = np.array([int(got[k]["fingerprint"], 16) for k in ids], dtype=np.uint64)
    least = {k: k for k in ids}
    for _ in range(len(ids)):
        now = {k: min(least[j] for j, near in zip(ids, np.bitwise_count(codes ^ codes[i]) <= 2) if near) for i, k in enumerate(ids)}
        if now == least:
            break
        least = now
    assert all(got[k]["component_id"] == least[k] for k in ids)
    rows = by_id(simhash.contract(odd))
    assert rows[0]["fingerprint"] == "0" * 16 and rows[0]["component_id"] == rows[2]["component_id"] == 0 and rows[6]["component_id"] == 5
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (5, 6)").count() == 1
    assert simhash.contract(empty).count() == 0


def test_simhash_blocks_lose_no_link(spark):
    rng = np.random.default_rng(3)
    near = [int(1 << a | 1 << b) for a in range(40) for b in range(a)]
    values = sorted({*near, *(int(x) for x in rng.integers(0, 2**62, 300))})
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(fps, block_rows=16)).collect()}
    want = {r["node"]: r["root"] for r in components.connected_components(simhash.links(fps, block_rows=10_000)).collect()}
    assert roots == want and len({roots.get(v, v) for v in near}) == 1


def test_pieces_equal_the_library(docs, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [r["text"] for r in docs.limit(100).collect()] + [t or "" for t in TEXTS] + ["  a  b ", "▁x ▁▁y", "x" * 500, "    " * 30 + "z", "<s> <0x41>", "a\n\n\tb  "]
    table = pieces.piece_table(pieces.default_model())
    import pyarrow as pa

    ids = table.encode_array(pa.array(texts))
    decoded = table.decode_array(ids).to_pylist()
    for t, i, d in zip(texts, ids.to_pylist(), decoded):
        want = sp.encode(t) + [2]
        assert i == want and d == sp.decode(want)
    got = by_id(pieces.digests(odd))
    assert got[0]["n_tokens"] == 1 and got[0]["ids_sha256"] == hashlib.sha256(b"2").hexdigest()
    assert pieces.digests(odd).count() == odd.count() and pieces.digests(empty).count() == 0


def plain_repeats(raws):
    seen = Counter(b[i:i + 200] for b in raws for i in range(len(b) - 199))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("class_rows", [20_000, 1])
def test_suffix_dedup_against_brute_force(spark, odd, empty, class_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "CLASS_ROWS", class_rows)
    rng = random.Random(9)
    base = "".join(rng.choice("abcde ") for _ in range(900))
    texts = [base, base[100:600] + "é" * 50, "x" * 450, "yz" * 101, base[:199], base[301:501], "q" + base[250:460] + "r" + base[240:440], None, "", base,
             *["".join(rng.choice("ab") for _ in range(20)) + base[i:i + 260] + str(i) for i in range(0, 300, 30)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, d int").repartition(5)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeats(df).collect()}
    want = plain_repeats([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    if class_rows > 1:
        assert suffixes.contract(odd).count() == odd.count() and suffixes.contract(empty).count() == 0


def test_toxicity_held_out(docs, odd, empty, spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(300)]
    bad = ["grobnik", "snarfel", "plukton"]
    texts, marks = [], []
    for i in range(800):
        t = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            t[rng.randrange(60)] = rng.choice(bad)
            t[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(t) + ".")
        marks.append(int(i % 4 == 0))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(marks)], "doc_id bigint, quality int, toxic int")
    got = by_id(toxicity.contract(df, labels))
    held = [i for i in got if got[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert all(got[i]["predicted"] == marks[i] for i in held)
    assert toxicity.contract(odd, labels).count() == odd.count() and toxicity.contract(empty, labels).count() == 0
    g = toxicity.Grammar(words={"grobnik": 5.0})
    assert g.clause("you are a grobnik")["targeted"] == 5 and g.clause("not a grobnik")["negated"] == 5
    assert g.clause("they said grobnik")["reported"] == 5 and g.clause("i will kill you")["threat"] == 1


def test_queries_have_contract_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
