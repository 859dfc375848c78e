"""Brute-force checks and invariants of the transcript jobs."""

import math
import re

import pytest
from pyspark.sql import functions as F

from runledger.functions import text as T
from runledger.operators import lines as L
from runledger.operators import sessions as S
from runledger.operators import transcripts as X
from runledger.sources import pages as P


def expected_kept(text, target):
    lines = text.split("\n")
    pin = [bool(l.strip()) and any(re.search(p, l, re.M) for p in (
        T.ANY_ERROR_MARKER, T.TEST_LINE.replace("(?m)", ""), T.CODE_SIGNATURE, T.DIFF_LINE.replace("(?m)", ""), T.PATH)) for l in lines]
    keep = {i for i, p in enumerate(pin) if p}
    used = sum(len(lines[i]) + 1 for i in keep)
    rest = sorted((-len(set(re.findall(r"\w+", l))), i) for i, l in enumerate(lines) if not pin[i] and l.strip())
    for _, i in rest:
        if used >= target:
            break
        keep.add(i)
        used += len(lines[i]) + 1
    return sorted(keep)


TEXTS = ["one\ntwo words\n\nthree whole words\nerror: broken\nx\n" * 5, "a\nb\nc", "def run(x):\n" + "plain text here\n" * 40,
         "- a diff line\n+ other\nunchanged line of text\n" + "é ü words\n" * 30, "x" * 500]


def test_kept_lines_match_brute_force(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for target in (40, 120, 10_000):
        got = [list(r[0]) for r in df.select(L.kept_lines(F.col("text"), target)).collect()]
        assert got == [expected_kept(t, target) for t in TEXTS]


def test_extractive_output(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for text, out in df.select("text", L.extractive_compress(F.col("text"), 60).alias("out")).collect():
        if len(text) <= 60:
            assert out == text
            continue
        kept, lines = expected_kept(text, 60), text.split("\n")
        if len(kept) >= len(lines):
            assert out == text
            continue
        want, prev = [], -1
        for i in kept:
            if i > prev + 1:
                want.append("…")
            want.append(lines[i])
            prev = i
        if prev < len(lines) - 1:
            want.append("…")
        if len("\n".join(want)) < len(text):
            assert out == "\n".join(want)


def test_downsample_matches_brute_force(spark):
    texts = ["hello wide  world\nof words", "tiny", "", "   padded out text with several words   ", "é" * 40 + " zz yy"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, out in df.select("text", L.downsample_text(F.col("text"), 0.4)).collect():
        tokens = max(1, math.ceil(len(text) / 4)) if text else 0
        target = max(1, math.floor(tokens * 0.4))
        if not text or tokens <= target:
            assert out == text
            continue
        share = max(0.01, min(1.0, target / tokens))
        pieces = []
        for m in re.finditer(r"\S+\s*", text):
            word = m.group(0).rstrip()
            pieces.append(word[:max(1, min(len(word), round(len(word) * share)))] + m.group(0)[len(word):])
        assert out == "".join(pieces).strip()[:target * 4].rstrip()


def trace(spark, n=60):
    rows = [(1, 0, "user", "fix app/a.py", None, None, None)]
    for i in range(1, n + 1):
        rows.append((1, 2 * i - 1, "assistant", "" if i % 3 == 0 else f"step {i}", i, "run", f'{{"n": {i % 5}}}'))
        text = "same output" if i % 7 == 0 else (f"error: number {i} " + "z" * 3000 if i % 4 == 0 else f"result {i} " + "y" * 2000)
        rows.append((1, 2 * i, "toolresult", text, i, None, None))
    rows += [(2, 0, "user", "small", None, None, None), (2, 1, "assistant", "only", None, None, None)]
    return spark.createDataFrame(rows, "session_id long, msg_idx long, role string, text string, call_id long, tool string, args string")


def brute_plan(rows, target_tokens):
    """Sequential re-planning of one session, the slow obvious way."""
    target, relief = target_tokens * 4, int(target_tokens * 4 * 0.75)
    results = [r for r in rows if r["role"] == "toolresult"]
    tail_start = min(r["msg_idx"] - 1 for r in results[-4:])
    items, seen = [], set()
    for r in reversed([r for r in results if r["msg_idx"] < tail_start]):
        key = " ".join(r["text"].split())
        items.append({"i": r["msg_idx"], "cost": len(r["text"]), "dup": key in seen, "prot": "error:" in r["text"], "drop": False})
        seen.add(key)
    items.reverse()

    def planned():
        inside = {x["i"]: x for x in items}
        total = n = 0
        for r in rows:
            x = inside.get(r["msg_idx"])
            if x is None:
                total += len(r["text"])
            elif x["drop"]:
                n += 1
            else:
                total += min(x["cost"], 5080 if x["prot"] else 1480)
        return total + min(n, 40) * 320

    for x in items:
        x["drop"] = x["dup"]
    if planned() > target:
        for x in sorted(items, key=lambda x: (x["prot"], x["i"])):
            if planned() <= relief:
                break
            x["drop"] = True
    return {x["i"] for x in items if x["drop"]}


@pytest.mark.parametrize("target", [2_000, 6_000, 12_000, 50_000])
def test_structural_drops_match_sequential_planning(spark, target):
    messages = trace(spark)
    rows = sorted((r for r in messages.where("session_id = 1").collect()), key=lambda r: r["msg_idx"])
    got = {r["msg_idx"] for r in X.structural_plan(messages, target).where("session_id = 1 AND dropped").collect()}
    assert got == brute_plan(rows, target)


def test_structural_output_keeps_pairs_and_tail(spark):
    messages = trace(spark)
    out = X.compress_structural(messages, 6_000)
    rows = out.where("session_id = 1").collect()
    assert max(r["msg_idx"] for r in rows) == 120
    guard = {r["session_id"]: r["ok"] for r in S.orphan_guard(messages, out).collect()}
    assert guard == {1: True, 2: True}
    first = next(r["text"] for r in rows if r["msg_idx"] == 0)
    assert first.startswith("fix app/a.py") and X.DIGEST_HEADER in first and first.endswith(X.DIGEST_END)
    assert len([x for x in first.split("\n") if x.startswith("- ")]) <= 40


def test_guard_reverts_broken_sessions(spark):
    messages = trace(spark, 6)
    broken = messages.where("NOT (session_id = 1 AND msg_idx = 3)")
    kept = S.with_guard(messages, broken)
    assert kept.count() == messages.count()


def test_compress_routes_by_mode_and_saves(spark):
    messages = trace(spark)
    modes = spark.createDataFrame([(1, "harvest"), (2, "passthrough")], "session_id long, mode string")
    report = {r["session_id"]: r for r in X.audit(messages, X.compress(messages, modes, 6_000)).collect()}
    assert report[1]["savings"] > 0.4 and report[1]["users_kept"] and report[1]["newest_kept"] and report[1]["guard_ok"]
    assert report[2]["savings"] == 0


def test_sweep_deeper_profiles_save_more(spark):
    profiles = spark.createDataFrame([("light", 1500, 4000, 10), ("deep", 200, 600, 4)],
                                     "profile string, stale_cap int, protected_cap int, intact int")
    # several lines per result, so that there is something to choose from
    lined = trace(spark).withColumn("text", F.regexp_replace("text", "(y{40}|z{40})", "$1 word\n"))
    sizes = {r["profile"]: r["n"] for r in X.sweep(lined, profiles).groupBy("profile").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert sizes["deep"] < sizes["light"]


def test_loop_line_in_notes(spark):
    rows = [(1, 0, "user", "go", None, None, None)]
    for i in range(1, 5):
        rows += [(1, 2 * i - 1, "assistant", "again", i, "ls", "-la"), (1, 2 * i, "toolresult", "same", i, None, None)]
    messages = spark.createDataFrame(rows, "session_id long, msg_idx long, role string, text string, call_id long, tool string, args string")
    note = X.session_notes(X.session_notes(messages)).where("msg_idx = 9").collect()
    assert len(note) == 1 and "ls(-la)" in note[0]["text"]


CALLS = "session_id long, msg_idx long, role string, text string, call_id string, tool string, args string, calls array<struct<id:string,tool:string,args:string>>"


def several_calls(n=40, user=True, size=900):
    """Each turn makes two calls; ids come back every third turn; the second result of some turns lost its id."""
    rows = [(1, 0, "user" if user else "system", "fix app/a.py", None, None, None, [])]
    for j in range(n):
        ids = [f"c{j % 3}{s}" for s in (0, 1)]
        rows.append((1, 1 + 3 * j, "assistant", "" if j % 2 else f"step {j}", None, None, None, [(x, "run", f"n {j}") for x in ids]))
        for s in (0, 1):
            rows.append((1, 2 + 3 * j + s, "toolresult", f"result {j} {s} " + "y" * size, None if s and j % 7 == 3 else ids[s], "run", None, []))
    return rows


def test_pairs_are_the_nearest_earlier_call(spark):
    rows = several_calls(12) + [(2, 0, "toolresult", "first", "c00", None, None, []), (2, 1, "assistant", "", None, None, None, [("c00", "t", "")])]
    got = {(r["session_id"], r["result_idx"]): (r["call_idx"], r["matched_by_id"]) for r in S.pair_calls(spark.createDataFrame(rows, CALLS)).collect()}
    want = {(1, 2 + 3 * j + s): (1 + 3 * j, not (s and j % 7 == 3)) for j in range(12) for s in (0, 1)}
    assert got == want | {(2, 0): (None, False)}


def test_prune_without_matching_id_keeps_the_nearest_call(spark):
    rows = several_calls(6)
    lost = [r[:4] + ((f"x{r[1]}" if r[2] == "toolresult" else r[4]),) + r[5:] for r in rows]
    kept = X.prune_recent(spark.createDataFrame(lost, CALLS)).collect()
    # the newest four results are 14, 15, 17, 18; the message before them calls at 13 and is left without calls
    assert sorted((r["msg_idx"], len(r["calls"])) for r in kept) == [(0, 0), (13, 0), (14, 0), (15, 0), (17, 0), (18, 0)]
    no_calls = [r[:7] + ([],) for r in rows]
    assert X.prune_recent(spark.createDataFrame(no_calls, CALLS)).count() == len(rows)


def test_structural_strips_one_of_several_calls(spark):
    messages = spark.createDataFrame(several_calls(), CALLS)
    rows = {r["msg_idx"]: r for r in X.compress_structural(messages, 6_000).collect()}
    plan = {r["msg_idx"]: r for r in X.structural_plan(messages, 6_000).collect()}
    dropped = {i for i, r in plan.items() if r["dropped"]}
    assert dropped and not dropped & set(rows)
    # results without an id have no call to strip: they stay
    assert {2 + 3 * j + 1 for j in range(40) if j % 7 == 3} <= set(rows)
    for j in range(40):
        left = [s for s in (0, 1) if 2 + 3 * j + s not in dropped]
        if not left and j % 2:
            assert 1 + 3 * j not in rows
        else:
            assert [c["id"] for c in rows[1 + 3 * j]["calls"]] == [f"c{j % 3}{s}" for s in left]
    entries = [x for x in rows[0]["text"].split("\n") if x.startswith("- ")]
    newest = sorted(dropped)[-len(entries):]
    assert entries[-1].startswith(f"- run(n {(newest[-1] - 2) // 3}) -> result {(newest[-1] - 2) // 3} ")


def test_sessions_without_user_message_stay_whole(spark):
    messages = spark.createDataFrame(several_calls(user=False), CALLS)
    out = X.compress_structural(messages, 2_000)
    assert out.exceptAll(messages).count() == 0 and out.count() == messages.count()


def test_levers_stay_pulled(spark):
    messages = spark.createDataFrame(several_calls(30, size=1300), CALLS)
    plain = X.structural_plan(messages, 50_000).first()
    assert (plain["trunc2"], plain["assist_cap"], plain["tail_cap"]) == (False, False, False)
    levers = spark.createDataFrame([(1, True, False, False)], "session_id long, trunc2 boolean, assist_cap boolean, tail_cap boolean")
    kept = X.structural_plan(messages, 50_000, levers).first()
    assert (kept["trunc2"], kept["assist_cap"], kept["tail_cap"]) == (True, False, False)
    n_items = X.structural_plan(messages, 50_000, levers).where("item").count()
    assert plain["planned_chars"] - kept["planned_chars"] == sum(min(len(r[3]), 1480) - 780 for r in several_calls(30, size=1300)[1:] if r[2] == "toolresult" and r[1] < 85)
    assert n_items == 56
    texts = [r["text"] for r in X.compress_structural(messages, 50_000, levers).where("role = 'toolresult' AND msg_idx < 85").collect()]
    assert max(map(len, texts)) < 800


def test_digest_ends_at_its_first_end_mark(spark):
    text = f"task\n\n{X.DIGEST_HEADER}\n- old\n{X.DIGEST_END}\nlater words {X.DIGEST_END} and more"
    open_block = f"task\n{X.DIGEST_HEADER}\n- old"
    df = spark.createDataFrame([(text,), (open_block,), ("task  ",)], "text string")
    got = [r[0] for r in df.select(X.merge_digest(F.col("text"), F.array(F.lit("- new")))).collect()]
    block = lambda *e: "\n\n" + "\n".join([X.DIGEST_HEADER, *e, X.DIGEST_END])
    assert got == [f"task\n\n\nlater words {X.DIGEST_END} and more" + block("- old", "- new"), "task" + block("- old", "- new"), "task" + block("- new")]


def test_user_turns_that_begin_with_thinking(spark):
    text = ('<message role="user"><thinking>a</thinking><text>b</text></message><message role="assistant">nothing tagged</message>'
            '<message role="user"><text>c </text><text>d</text></message><message role="user"><text></text>e</message>')
    rows = P.parse_transcripts(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("msg_idx").collect()
    assert [(r["msg_idx"], r["block_type"], r["text"]) for r in rows] == [
        (0, "text", "<thinking>a</thinking><text>b</text>"), (1, "text", "c"), (2, "text", "<text></text>e")]


def test_copies_are_found_once_for_all_profiles(spark, monkeypatch):
    messages = spark.createDataFrame(several_calls(40, size=900), CALLS)
    hashed, write = {}, X.through_parquet

    def spy(df, label):
        out = write(df, label)
        if "_key" in out.columns:
            hashed[label] = out.count()
        return out

    monkeypatch.setattr(X, "through_parquet", spy)
    plan = X.structural_plan(messages, profiles=X.profile_table(spark, X.PROFILES))
    assert plan.count() == 3 * messages.count()
    assert hashed and set(hashed.values()) == {messages.count()}


def test_pruning_reads_its_messages_twice(spark, tmp_path):
    """Once for roles and ids, once for what is kept; it used to be read again by every step."""
    reads = spark.sparkContext.accumulator(0)
    rows = several_calls()

    def counted(part):
        rows_ = list(part)
        reads.add(len(rows_))
        return iter(rows_)

    messages = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(counted), CALLS)
    kept = X.prune_recent(messages).collect()
    assert 0 < len(kept) < len(rows) and reads.value <= 2 * len(rows)


def test_gentle_sweep_ranks_lines_once(spark, capsys):
    """Every profile cuts a text as it would alone, but the lines are taken apart before the profiles fan out."""
    from runledger.operators.lines import extractive_compress

    lines = "\n".join(f"line {i} " + "word " * (i % 7) + ("error: bad" if i == 11 else "") for i in range(40))
    rows = [(1, 0, "user", "go")] + [(1, i, "toolresult", f"{lines if i % 2 else lines.replace('error: bad', '')}\nrow {i}") for i in range(1, 9)] + [(1, 9, "toolresult", None)]
    rows.append((1, 10, "toolresult", rows[1][3]))
    messages = spark.createDataFrame(rows, "session_id long, msg_idx long, role string, text string")
    profiles = spark.createDataFrame([("a", 200, 400, 2), ("b", 100, 90, 5), ("c", 5000, 6000, 0)], "profile string, stale_cap int, protected_cap int, intact int")
    out = X.sweep(messages, profiles)
    got = {(r["profile"], r["msg_idx"]): r["text"] for r in out.collect()}
    out.explain()
    top = capsys.readouterr().out.split("BroadcastNestedLoopJoin")[0]
    assert "…" in top and "w+" not in top
    for p in profiles.collect():
        cap = F.when(F.col("text").rlike("error: bad"), p["protected_cap"]).otherwise(p["stale_cap"])
        alone = dict(messages.select("msg_idx", F.when((F.col("msg_idx") == 0) | (F.col("msg_idx") > 10 - p["intact"]), F.col("text")).when(
            F.col("msg_idx") == 1, X.DUPLICATE_MARK).otherwise(extractive_compress(F.col("text"), cap))).collect())
        assert {i: t for (name, i), t in got.items() if name == p["profile"]} == alone


def test_sweep_equals_single_profiles(spark):
    messages = spark.createDataFrame(several_calls(60, size=3000), CALLS)
    out = X.sweep_structural(messages, X.profile_table(spark, {**X.PROFILES, "plain": tuple(X.KNOBS.values())}))
    plain = X.compress_structural(messages)
    assert out.where("profile = 'plain'").drop("profile").exceptAll(plain).count() == 0
    sizes = {r["profile"]: r["n"] for r in out.groupBy("profile").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert sizes["deep"] < sizes["medium"] < sizes["light"] < sizes["plain"]


def test_nested_text_is_walked_to_any_depth(spark):
    from runledger.operators.nested import nested_text

    values = ['{"b": [1, {"z": "x", "a": {"k": null}}], "a": "t", "n": 1.5}', "plain words", None, '"s"', "[]", '{"text": 5, "content": "c"}',
              '[[["deep"]], {"text": "own", "more": [1]}, "", false]', "{}", '[{"text": "br{ack}ets ["}]']
    df = spark.createDataFrame(list(enumerate(values)), "id long, j string")
    got = {r["id"]: r["text"] for r in nested_text(df, ["id"], "j").collect()}
    assert [got[i] for i in range(len(values))] == ["t\n1\n\nx\n1.5", "plain words", "", "s", "", "c", "deep\nown\n\nFalse", "", "br{ack}ets ["]
    assert nested_text(df.limit(0), ["id"], "j").count() == 0


def plain_blocks(body, mark):
    """The slow obvious way: character by character from every mark."""
    out, at = [], body.find(mark)
    while at >= 0:
        i, stack, quoted = at + len(mark), [], False
        start = i
        while i < len(body):
            ch = body[i]
            if not stack and ch not in "{[":
                break
            if quoted:
                if ch == "\\":
                    i += 1
                elif ch == '"':
                    quoted = False
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]":
                if stack.pop() != ch:
                    break
                if not stack:
                    out.append(body[start:i + 1])
                    break
            i += 1
        at = body.find(mark, at + len(mark))
    return out


def test_blocks_equal_a_character_loop(spark):
    import random

    rng = random.Random(9)
    parts = ['"k":', "{", "}", "[", "]", '"', "a", "\\", ' "x}" ', "\n", '"k":{', '"k":[', "é"]
    bodies = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ['"k":{"a":[' + "x" * 200_000 + ']}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page_id long, html string")
    blocks = P.extract_json_blocks(df, ["k", "none"])
    got = {}
    for r in blocks.orderBy("page_id", "block_no").collect():
        got.setdefault(r["page_id"], []).append(r["block"])
    want = {i: plain_blocks(b.replace('\\"', '"'), '"k":') for i, b in enumerate(bodies)}
    assert got == {i: b for i, b in want.items() if b}


def test_tfidf_selection_takes_rare_lines(spark):
    text = "\n".join(["common words again and again"] * 30 + ["a singular sentence", "error: pinned"] + ["common words again and again"] * 30)
    df = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, "\n" * 200), (5, "x" * 500)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.tfidf_compress(df, 60).collect()}
    assert got[2] == "short" and got[3] == "" and got[4] == "…" and got[5] == "x" * 500
    assert got[1].split("\n")[0] == "common words again and again" and "error: pinned" in got[1] and got[1].count("…") >= 1
    assert len(got[1]) < 120


def test_tfidf_tasks_grow_with_the_text(spark, monkeypatch):
    import math
    from collections import Counter

    rows = [(d, i, " ".join(f"w{(d * 7 + i * k) % 23}" for k in range(i % 9))) for d in range(40) for i in range(25)] + [(3, 4, "twice here")] * 2
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    monkeypatch.setattr(L, "TASK_CHARS", 500)
    for cap in (None, 5):
        scores = L.tfidf_scores(lines, cap)
        # no task holds the words of more lines because the table is longer
        assert scores.rdd.getNumPartitions() >= sum(len(r[2]) for r in rows) // 500
        got = Counter((r["doc_id"], r["line_no"], round(r["score"], 9)) for r in scores.collect())
        want = Counter()
        for d in range(40):
            mine = [r for r in rows if r[0] == d]
            tf = {}
            for _, i, line in mine:
                tf.setdefault(i, Counter()).update(line.split())
            total, df = sum(tf.values(), Counter()), Counter(t for c in tf.values() for t in c)
            known = sorted(total, key=lambda t: (-total[t], t))[:cap]
            for _, i, _ in mine:
                w = [n * (math.log((1 + len(mine)) / (1 + df[t])) + 1) for t, n in tf[i].items() if t in known]
                want[(d, i, round(sum(w) / math.sqrt(sum(x * x for x in w)) if w else 0.0, 9))] += 1
        assert got == want


def test_tfidf_selection_takes_texts_apart_once(spark, monkeypatch, capsys):
    written = []
    keep = L.through_parquet
    monkeypatch.setattr(L, "through_parquet", lambda df, label: written.append(label) or keep(df, label))
    df = spark.createDataFrame([(i, "\n".join(f"line {j % 7} of {i}" for j in range(50))) for i in range(30)], "doc_id long, text string")
    out = L.tfidf_compress(df, 60)
    out.explain()
    # no ranges of the whole table are sorted for the running costs of a text
    assert written == ["lines"] and "rangepartitioning" not in capsys.readouterr().out
    assert out.count() == 30


def test_paths_begin_at_words(spark):
    import random
    import re
    import time

    rng = random.Random(3)
    odd = ["a/b.py:12x/c.py", "a/b.txtt_x/c", "/x/y.c", "foo//bar/x.py", "a/b.abcdefg/h.py", "..//./a.b/c.de", "q/w.e:7/r/t.y", ""]
    odd += ["".join(rng.choice("ab/.:-1 (") for _ in range(rng.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i long, t string")
    got = {r["i"]: (r["p"], r["n"]) for r in df.select("i", T.paths(F.col("t")).alias("p"), T.path_names(F.col("t"), 3).alias("n")).collect()}
    for i, t in enumerate(odd):
        found = list(dict.fromkeys(re.findall(f"({T.PATH})", t, re.ASCII)))
        bare = [p.split(":")[0] for p in found]
        assert got[i] == (found, list(dict.fromkeys(n for n in bare + [p.rsplit("/", 1)[-1] for p in bare] if len(n) >= 3)))
    started = time.time()
    # one long word is read once, not once from each of its letters
    long = spark.range(1).select(T.paths(F.concat(F.repeat(F.lit("w"), 400_000), F.lit(" a/b.py"))).alias("p"))
    assert long.first()["p"] == ["a/b.py"] and time.time() - started < 20


def test_ratchets_read_texts_once(spark, capsys):
    rows = [(s, i, "toolresult" if i % 2 else "assistant", "1 failed" if i % 5 == 0 else "3 passed" if i == 21 else "x" * i) for s in range(3) for i in range(30)]
    out = S.session_ratchets(spark.createDataFrame(rows, "session_id long, msg_idx long, role string, text string"), 4, 1, 9)
    out.explain()
    # the running counts go over written marks
    assert "rlike" not in capsys.readouterr().out.lower()
    got = {r["msg_idx"]: r for r in out.where("session_id = 1").collect()}
    assert len(got) == 15 and out.count() == 45
    chars, total, largest, fails = 0, 0, 0, 0
    for s, i, role, text in rows[30:60]:
        chars += len(text)
        if role == "toolresult":
            tokens = max(1, -(-chars // 4))
            total, largest, fails = total + tokens, max(largest, tokens), fails + ("failed" in text)
            assert (got[i]["tokens"], got[i]["cumulative"], got[i]["largest"], got[i]["fail_rounds"], got[i]["ever_passed"]) == (
                tokens, total, largest, fails, i >= 21)


def test_audit_reads_its_input_once(spark, monkeypatch):
    seen = []
    keep = X.through_parquet
    monkeypatch.setattr(X, "through_parquet", lambda df, label: seen.append((label, df.columns)) or keep(df, label))
    rows = [(1, 0, "user", "please mark" + "u" * 500, None), (1, 1, "assistant", "a", 7), (1, 2, "toolresult", "r" * 300, 7)]
    df = spark.createDataFrame(rows, "session_id long, msg_idx long, role string, text string, call_id long").withColumn("tool", F.lit(None).cast("string"))
    thin = df.withColumn("text", F.substring("text", 1, 130))
    got = X.audit(df, thin, ["mark", "absent"]).first()
    assert [label for label, _ in seen] == ["audited", "audited-input"]
    assert (got["tokens_in"], got["tokens_out"], got["users_kept"], got["newest_kept"], got["markers_kept"]) == (203, 66, True, True, True)


def test_pruning_broadcasts_none_of_its_tables(spark, monkeypatch):
    """Millions of ids and flags are a few MB when written, which used to pass for their size and went to the driver whole."""
    plans, keep = [], X.through_parquet
    monkeypatch.setattr(X, "through_parquet", lambda df, label: plans.append(df) or keep(df, label))
    out = X.prune_recent(spark.createDataFrame(several_calls(6), CALLS))
    assert len(plans) == 3 and {r["msg_idx"] for r in out.collect()} >= {0, 14, 15, 17, 18}
    for df in [*plans, out]:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_audit_query_looks_for_whole_texts(spark, monkeypatch, tmp_path):
    """An end cut off a long message or result is a loss; only their first 60 and 120 characters used to be looked for."""
    from runledger.catalog import transcripts as Q

    rows = []
    for i in (1, 2, 3, 4):
        rows += [(i, 0, "user", "u" * 500 + "!", None), (i, 1, "assistant", "a", 7), (i, 2, "toolresult", "r" * 300 + "!", 7)]
    rows += [(4, 3, "user", None, None)]
    df = spark.createDataFrame(rows, "session_id long, msg_idx long, role string, text string, call_id long")
    cut = F.rtrim(F.regexp_replace("text", "!", ""))
    after = df.withColumn("text", F.when((F.col("session_id") == 2) & (F.col("role") == "user"), cut).when(
        (F.col("session_id") == 3) & (F.col("role") == "toolresult"), cut).otherwise(F.concat("text", F.lit(" and more"))))
    monkeypatch.setattr(X, "compress_gentle", lambda messages, **_: after)
    got = {r["session_id"]: (r["users_kept"], r["newest_kept"]) for r in Q.txt19(type("V", (), {"trace": df})).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False), 4: (False, True)}
