"""Cases in which an operator once did less than its whole job, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from runledger.llm import linededup, preferences, simhash, suffixes


def plain_removed(docs):
    """Removed line numbers by doc_id, lines compared pair by pair."""
    lines = []
    for d, text in sorted(docs):
        for i, line in enumerate(text.split("\n")):
            w = [x for x in line.replace("\t", " ").replace("\r", " ").replace("\f", " ").replace("\x0b", " ").split(" ") if x]
            if w:
                lines.append((d, i, {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}))
    gone = {}
    for n, (d, i, s) in enumerate(lines):
        if any(5 * len(s & t) >= 4 * len(s | t) for _, _, t in lines[:n]):
            gone.setdefault(d, []).append(i)
    return gone


def removed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {r["doc_id"]: r["removed"] for r in linededup.removed_lines(df).collect()}


def test_line_dedup_parts_words_by_any_white_space(spark):
    rng = random.Random(4)
    base = [f"k{i}" for i in range(60)]
    docs = [(1, " ".join(base) + "\n" + " ".join(base[:6]) + "\nx y")]
    for d in range(2, 12):
        near = base[:59] + [f"z{d}"]
        gaps = [rng.choice(["\t", "  ", " \r", "\f", "\x0b ", " "]) for _ in range(200)]
        docs.append((d, "".join(w + g for w, g in zip(near, gaps)) + "\r\n\t" + gaps[0].join(base[:6]) + "\r\nx\ty\n" + "\t".join(base[d:d + 9])))
    want = plain_removed(docs)
    assert all(want[d][:3] == [0, 1, 2] for d in range(2, 12))
    assert removed(spark, docs) == want


def test_suffix_classes_at_splitters_are_whole(spark):
    """Every text twice over many buckets and few leading tokens: all of it goes."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(240)) for _ in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id bigint, text string").repartition(8)
        left = [r["doc_id"] for r in suffixes.remove_repeats(df).collect() if len(r["kept"])]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert left == []


def test_simhash_keeps_unlike_documents_without_ids(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (8, texts[3])]
    kept = simhash.one_per_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3])], key=repr)


def test_line_dedup_meets_lines_of_repeated_words(spark):
    docs = [(1, "\n".join([" ".join("-" * 6), " ".join("ab" * 5), "a a a a a b", "a b c a b c a", "p q r s t"])),
            (2, "\n".join([" ".join("-" * 9), " ".join("ab" * 8), "a a a a a a b", "b c a b c a b", "p q r s u", " ".join("-" * 4)])),
            (3, "\n".join([" ".join("0" * 5), " ".join("-" * 12), "p q r s t u", " ".join("0" * 7)]))]
    want = plain_removed(docs)
    assert want == {2: [0, 1, 2, 3], 3: [1, 3]}
    assert removed(spark, docs) == want


def plain_pairs(turns):
    """(chosen id, rejected id, common turns) of all rivals."""
    convs = {}
    for c, n, role, text in sorted(turns):
        convs.setdefault(c, []).append((role, text))
    said = {c: sum(len(t) for r, t in ts if r == "assistant") for c, ts in convs.items()}
    out, latest = [], {}

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for c in sorted(convs):
        ts = convs[c]
        if ts[0] in latest:
            o = latest[ts[0]]
            pair = (o, c) if said[o] >= said[c] else (c, o)
            out.append((*pair, common(ts, convs[o])))
        latest[ts[0]] = c
        at = [i for i, (r, _) in enumerate(ts) if r == "assistant"]
        if any(ts[i][1] != ts[at[-1]][1] for i in at):
            out.append((c, c, at[-1]))
    return sorted(out)


def test_preferences_pair_equal_openings_of_the_whole_table(spark):
    rng = random.Random(3)
    turns = []
    for c in [*range(40), 999, 1000, 5003, 10 ** 9, 10 ** 9 + 7, 10 ** 12]:
        opening = "hot" if c % 3 or c > 900 else f"q{c % 12}"
        rest = [(1, "assistant", rng.choice(["yes", "no", "maybe so"])), (2, "user", rng.choice(["why", "how"])), (3, "assistant", rng.choice(["yes", "because"]))]
        turns += [(c, 0, "user", opening)] + [(c, *t) for t in rest[:rng.randint(0, 3)]]
    out = preferences.contract(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    got = sorted((r["chosen_id"], r["rejected_id"], r["n_common"]) for r in out.collect())
    assert got == plain_pairs(turns)
    assert all(n >= 1 for _, _, n in got) and any(a == b for a, b, _ in got)


def test_samples_are_bounded_and_take_one_row_per_key(spark):
    from runledger.llm.common import bounded_sample

    rows = [(1, "de", f"t{i}") for i in range(3000)] + [(1, "en", "x"), (1, None, "y"), (None, "de", "z")] + [(i, "en", "w") for i in range(2, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(7)
    got = sorted(tuple(r) for r in bounded_sample(df, "lang", 5, 2, text="text").collect())
    assert len(got) == 6 and got[0] == (1, "de", "t0") and sum(g == "en" for _, g, _ in got) == 5
    assert bounded_sample(df, "lang", 5, 1).count() == 5


def test_language_of_ids_with_and_without_a_language(spark):
    from runledger.llm import langid

    rows = [(i, "the house is on the hill " * 5, "en") for i in range(40)] + [(i, "das Haus steht auf dem Berg " * 5, "de") for i in range(40, 80)]
    rows += [(i, t, None) for i, t, _ in rows] + [(5, "las casas del monte", "es"), (None, "a", "en"), (99, None, "en"), (98, "y" * 900_000 + " house", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.contract(df).collect()
    assert len(out) == len(rows)
    kept = langid.accepted(df, langid.fit_on(df))
    assert kept.columns == df.columns and kept.where("doc_id < 80").count() >= 150


def loop_clause(grammar, text):
    """The grammar of a clause as one loop with counters."""
    from runledger.llm import toxicity as X

    tokens = X.TOKEN.findall(text)
    out, negated, reported, quoted = dict.fromkeys(X.TAPES, 0.0), 0, 0, 0
    near = [i for i, t in enumerate(tokens) if t in X.TARGETS]
    for i, t in enumerate(tokens):
        if t in X.QUOTES:
            quoted ^= 1
        elif t in X.NEGATIONS:
            negated = X.REACH + 1
        elif t in X.REPORTING:
            reported = 1
        else:
            w, close = grammar.insult(t), any(abs(i - j) <= X.REACH for j in near)
            if w:
                out["negated" if negated else "reported" if reported or quoted else "targeted" if close else "insult"] += w
            if t in X.VIOLENCE and close and not negated and not reported and not quoted:
                out["threat"] += 1.0
        negated = max(0, negated - 1)
    return out


def test_composed_transducers_equal_a_loop_and_are_linear():
    import time

    from runledger.llm import toxicity as X

    rng = random.Random(3)
    g = X.Grammar(words={"fool": 2.0, "you": 0.5, "ugly": 1.0}, stems={"idio": 3.0})
    words = ["you", "dich", "not", "nie", "said", '"', "fool", "ugly", "idiots", "kill", "house", "tree", "and"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))
        assert g.clause(text) == loop_clause(g, text), text
    started = time.time()
    g.clause("you fool " * 200_000)
    assert time.time() - started < 20


def test_stages_take_any_column_names(spark):
    from runledger.llm import decontaminate

    names = ["_id", "_h", "_removed", "_fp", "_n", "_text", "_w_id", "_w_fp", "fp", "h", "removed", "spans", "w", "key"]
    rows = [(i, f"alpha beta gamma delta epsilon zeta eta theta iota kappa number {i // 2}\nline two of it here {i % 3}", *range(len(names))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa number 1")], "item_id bigint, text string")
    assert linededup.deduplicate(df).columns == df.columns and linededup.deduplicate(df).count() == 8
    one = simhash.one_per_group(df)
    assert one.columns == df.columns
    assert {r["doc_id"] for r in one.collect()} == {r["component_id"] for r in simhash.contract(df).collect()}
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and clean.count() < 8


def plain_formatted(rows):
    """Preference pairs, prompts, completions and masks in plain Python."""
    convs = {}
    for c, n, role, text in {r for r in rows if r[0] is not None}:
        convs.setdefault(c, []).append((n, role or "user", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x))] for c, v in convs.items()}
    size = lambda ts: sum(len(t) for r, t in ts if r == "assistant")
    pairs, by_opening = [], {}
    for c in sorted(convs):
        by_opening.setdefault(convs[c][0], []).append(c)
    for ids in by_opening.values():
        for a, b in zip(ids, ids[1:]):
            first, second = (a, b) if size(convs[a]) >= size(convs[b]) else (b, a)
            pairs.append((first, second, "opening", convs[first], convs[second]))
    for c, ts in convs.items():
        said = [i for i, (r, _) in enumerate(ts) if r == "assistant"]
        rivals = [i for i in said if ts[i][1] != ts[said[-1]][1]]
        if rivals:
            pairs.append((c, c, "answer", ts[:said[-1] + 1], ts[:said[-1]] + [ts[rivals[-1]]]))
    out = []
    for a, b, kind, x, y in pairs:
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        show = lambda ts: "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in ts)

        def spans(ts):
            at, found = 0, []
            for r, t in ts:
                start = at + len(f"<|{r}|>\n")
                if r == "assistant":
                    found.append((start, start + len(t)))
                at = start + len(t) + len("\n<|end|>\n")
            return found
        out.append((a, b, kind, n, show(x[:n]), show(x[n:]), tuple(spans(x[n:])), show(y[n:]), tuple(spans(y[n:]))))
    return sorted(out, key=repr)


def test_preference_texts_and_masks_equal_plain_formatting(spark):
    rng = random.Random(12)
    rows = []
    for c in range(60):
        for n in range(rng.randrange(1, 6)):
            rows.append((c, n, rng.choice(["user", "assistant", "assistant", None]), rng.choice(["a", "bb", "é\n", None, "long " * 3000]) if n else rng.choice(["x", "y"])))
    rows += rows[:9] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)).withColumn("_c", F.lit(2))
    out = preferences.format_pairs(preferences.rival_pairs(df), keys=["chosen_id", "rejected_id", "kind"])
    got = sorted(((r["chosen_id"], r["rejected_id"], r["kind"], r["n_common"], r["prompt"], r["chosen_text"], tuple(map(tuple, r["chosen_mask"])),
                   r["rejected_text"], tuple(map(tuple, r["rejected_mask"]))) for r in out.collect()), key=repr)
    assert got == plain_formatted(rows)
    assert {g[2] for g in got} == {"opening", "answer"}


def test_line_dedup_fetches_sets_of_likely_lines_only(spark, monkeypatch):
    """Near copies of every distance: what is removed is exact, and lines far from any other are not read again."""
    rng = random.Random(21)
    written = {}
    through = linededup.through_parquet
    monkeypatch.setattr(linededup, "through_parquet", lambda df, label: written.setdefault(label, through(df, label)))

    def copies(n, changes):
        base = [f"k{rng.randrange(10 ** 6)}" for _ in range(n)]
        out = []
        for _ in range(6):
            words = list(base)
            for at in rng.sample(range(n), changes):
                words[at] = f"z{rng.randrange(10 ** 6)}"
            out.append(" ".join(words))
        return out

    far = [line for n in (60, 90, 120) for line in copies(n, n // 20)]
    assert removed(spark, list(enumerate(far))) == plain_removed(list(enumerate(far))) == {}
    assert written["line-pairs"].count() == 0 and written["line-sets"].count() == 0
    written.clear()
    mixed = far + [line for n in (12, 50, 90, 300) for changes in (0, 1, 2, 3) for line in copies(n, changes)]
    mixed += [" ".join(line.split(" ")[cut:]) for line in mixed[18:] for cut in (1, 7)]
    rng.shuffle(mixed)
    docs = [(i, "\n".join(mixed[i::40])) for i in range(40)]
    want = plain_removed(docs)
    assert len(want) > 20 and removed(spark, docs) == want
    monkeypatch.setattr(linededup, "FEW", 2)
    written.clear()
    assert removed(spark, docs) == want and written["meeting-lines"].count() > 0


def test_line_dedup_looks_for_odd_gaps_once(spark):
    """Null texts are left out by the text itself, not by a second look for odd white space."""
    docs = spark.createDataFrame([(1, "a  b\nc"), (2, None)], "doc_id bigint, text string")
    lines = linededup.lines_of(docs)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Contains(") == len(linededup.ODD_SIGNS)
    assert sorted(r["line"] for r in lines.collect()) == ["a b", "c"]
