"""Ranked search, spelling variants and HTML extraction against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from runledger.llm import htmltext, ranked, spelling

DOCS = "doc_id bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ranked search

def plain_search(docs, items, k=10):
    terms = lambda text: [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    found = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = set()
    for item, ts in wanted.items():
        scored = []
        for d, c, n in found:
            if n:
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
                if score > 0:
                    scored.append((-score, d is None, d or 0, d))
        out |= {(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])}
    return out


def searched(spark, docs, items, **more):
    frame = spark.createDataFrame(docs, DOCS).withColumn("slot", F.lit(1)).withColumn("score", F.lit("x")).repartition(5)
    rows = ranked.search(frame, spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit(2)), **more).collect()
    assert len(rows) == len({(r["item_id"], r["rank"]) for r in rows})
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows}


def test_search_equals_plain_scoring(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["Été", "été", "A", "a", " ", "naïve-B", "7"]
    docs = [(i, rng.choice([" ", "\n", "--", "\x00"]).join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(30)] + [(7, "w1"), (None, "w1 w2"), (400, None), (401, ""), (402, "... \n")]
    docs.append((403, " ".join(rng.choice(words) for _ in range(60_000))))
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(25)] + [(3, "w39 w38"), (90, None), (91, "!"), (None, "w5"), (92, "absent")]
    want = plain_search(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, block_pairs=20) == want
    assert searched(spark, docs, items, k=3) == plain_search(docs, items, 3)


def test_search_pieces_cover_the_text():
    text = ("ab c " * 700_000 + "end").encode()
    n, hits = ranked.counts(ranked.automaton(["ab", "c", "end"]), text)
    assert (n, dict(hits)) == (1_400_001, {0: 700_000, 1: 700_000, 2: 1})
    long = b"x" * 3_000_000 + b" y"
    assert ranked.counts(ranked.automaton(["y"]), long) == (2, Counter({0: 1}))


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "w1")]) == set()
    assert searched(spark, [(1, "w1")], []) == set()


# spelling variants

def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def plain_words(docs):
    count = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain_groups(words):
    # words at one edit share a deletion or are one: candidates from these, verified
    by = defaultdict(set)
    for w in words:
        for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by[x].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if edit_one(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def grouped(df):
    rows = spelling.group_variants(df).collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_equal_plain_grouping(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(7, 12))) for _ in range(30)] + ["aaaaaaa", "abababab", "x" * 60_000]
    docs = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = list(stems[min(int(rng.expovariate(0.3)), len(stems) - 2)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at:at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "Z", "é", "É"])
            words.append("".join(w))
        docs.append((i, rng.choice([" ", "1", "-", "\n"]).join(words)))
    docs += [docs[0], docs[0], (None, stems[0] + " " + stems[1]), (900, None), (901, ""), (902, stems[-1]), (903, stems[-1] + "y"), (904, stems[-1]), (905, stems[-1] + "y")]
    # a chain of forms: 2 < 20 < 200 occurrences
    docs.append((910, " ".join(["qqqqwwww"] * 2 + ["qqqqwwwe"] * 25 + ["qqqqwwee"] * 300)))
    frame = spark.createDataFrame(docs, DOCS).withColumn("word", F.lit(1)).withColumn("run", F.lit("r")).withColumn("n", F.lit(0))
    want = plain_groups(plain_words(docs))
    assert any(w[1] and w[2] != w[1] for w in want)
    assert grouped(frame) == want


def test_variants_of_the_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert grouped(df) == plain_groups(plain_words([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]))


def test_variants_without_words(spark):
    assert grouped(spark.createDataFrame([], DOCS)) == set()
    assert grouped(spark.createDataFrame([(1, "short words only"), (2, None)], DOCS)) == set()


def test_near_words_share_a_signature():
    """Letters part the vector; two changed dimensions leave PARTS - 2 parts alone."""
    rng = random.Random(3)
    for _ in range(500):
        w = "".join(rng.choice("abcdefghé") for _ in range(9))
        at, c = rng.randrange(9), rng.choice("abcdefghéz")
        for v in (w[:at] + c + w[at + 1:], w[:at] + w[at + 1:], w[:at] + c + w[at:]):
            parts = [sum(Counter(x for x in w if ord(x) % spelling.PARTS == i) != Counter(x for x in v if ord(x) % spelling.PARTS == i) for i in [p]) for p in range(spelling.PARTS)]
            assert sum(parts) <= 2


# HTML

PARAGRAPHS = "".join(f"<p>Sentence {i} of an article with a good many words, <a href=x>one link</a> &amp; more words behind it.</p>" for i in range(6))
LINES = [f"Sentence {i} of an article with a good many words, one link & more words behind it." for i in range(6)]


def lines(html):
    return htmltext.main_text(html).split("\n")


def test_html_boilerplate_goes():
    html = f"""<html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar">
      <header><h1>Site name</h1></header><nav><ul><li><a href=1>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
      <main><article><header><h1>Caf&eacute; &#8212; day</h1></header><!-- no -->{PARAGRAPHS}<div class="ad">Buy now</div>
      <form><p>Sign up</p><input></form><aside>Side</aside></article>
      <section id="comments"><article class="comment"><p>{'Nice text. ' * 400}</p></article></section></main>
      <div id="sidebar"><p>More</p></div><footer>&copy; 2020</footer></body></html>"""
    assert lines(html) == ["Café — day", *LINES]


def test_html_without_semantic_elements():
    menu = "<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div>"
    assert lines(f"<body>{menu}<div><h1>Title here</h1><div>{PARAGRAPHS}</div></div><div><a href=4>Imprint</a> <a href=5>Contact</a></div>") == ["Title here", *LINES]
    parts = f"<div><section><h2>One</h2>{PARAGRAPHS}</section><section><h2>Two</h2>{PARAGRAPHS}</section></div>"
    assert lines(f"<body>{menu}{parts}</body>") == ["One", *LINES, "Two", *LINES]
    assert lines(f"<h1>Title</h1>{PARAGRAPHS}") == ["Title", *LINES]


def test_html_blocks_and_white_space():
    html = f"<article><p>a\n <b>bold</b>text\t<br>next&nbsp;<i> x</i><p>unclosed<table><tr><td>1<td>2<tr><td>3</table>tail<ul><li>i<li>j</ul>{PARAGRAPHS}</article>"
    assert lines(html)[:8] == ["a boldtext next x", "unclosed", "1", "2", "3", "tail", "i", "j"]


def test_html_odd_pages():
    assert [htmltext.main_text(x) for x in (None, "", "<p>", "<!-- only", "<script>var a</script>", "<p><a href='x")] == [""] * 6
    assert htmltext.main_text("bare &amp text") == "bare & text"
    assert htmltext.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert htmltext.main_text("</p></div>stray<p>end") == "stray\nend"
    assert htmltext.main_text("<div class=header><p>All of it</p></div>") == "All of it"
    many = "<p>one two three four</p>" * 50_000
    assert htmltext.main_text(many).count("\n") == 49_999


def test_html_contract(spark):
    rows = [(1, "u", f"<article>{PARAGRAPHS}</article>"), (1, "u", f"<article>{PARAGRAPHS}</article>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = htmltext.contract(df).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in got) == sorted(
        [(0, "", "", 0), (2, "v", "", 0)] + [(1, "u", "\n".join(LINES), len("\n".join(LINES)))] * 2)
    assert htmltext.contract(df.limit(0)).count() == 0
