"""Preference formatting: one prompt, two masked completions.

For a pair of conversations the longest common turn prefix (equal role and
text, turn by turn) is rendered once as the prompt; what follows on each side is
rendered as the chosen and the rejected completion. A completion comes with its
loss mask: the [start, end) character spans of assistant texts inside it.

Pairs come in two kinds: ``opening``, two conversations that begin with the
same turn; ``answer``, the last answer of a conversation against its latest
earlier answer of another text, set behind the same turns. The second is no
rival to the same question; where a table has no repeated openings (as the
given ones), it is all there is.

Defined results: null texts are empty, null roles are 'user'; a pair without a
common turn has an empty prompt; a side that is all prefix has an empty
completion and an empty mask. All of it is array expressions inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import hash_partitions
from runledger.session import through_parquet

# template of a rendered turn: open, role, middle, text, close
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Spans of assistant texts in the rendered turns."""
    head = len(OPEN) + len(MIDDLE)

    def step(acc, t):
        start = acc["at"] + head + F.length(t["role"])
        end = start + F.length(t["text"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"),
                        F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", keys: list[str] | None = None) -> DataFrame:
    """``keys`` plus n_common, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask.

    ``chosen`` and ``rejected`` are arrays of (role, text) in order of turns.
    """
    keys = keys or [c for c in pairs.columns if c not in (chosen, rejected)]

    def clean(name):
        return F.transform(F.coalesce(name, F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(
            F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    both = pairs.select(*keys, clean(F.col(chosen)).alias("_c"), clean(F.col(rejected)).alias("_r"))
    shorter = F.least(F.size("_c"), F.size("_r"))
    differ = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get("_c", i) != F.get("_r", i)))
    cut = both.withColumn("n_common", F.get(differ, F.lit(0)))
    tail = {n: F.slice(n, F.col("n_common") + 1, F.size(n)) for n in ("_c", "_r")}
    return cut.select(*keys, "n_common", rendered(F.slice("_c", 1, F.col("n_common"))).alias("prompt"),
                      rendered(tail["_c"]).alias("chosen_text"), mask(tail["_c"]).alias("chosen_mask"),
                      rendered(tail["_r"]).alias("rejected_text"), mask(tail["_r"]).alias("rejected_mask"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): a row per conversation, turns in order; repeated rows count once."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.col("conv_id").isNotNull()).distinct().groupBy("conv_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def next_of_opening(convs: DataFrame) -> DataFrame:
    """(conv_id, other_id): each conversation and the one with the next id among those of an equal opening turn.

    Rows are dealt out by ranges of (opening, id), so an opening that very many
    conversations have is split like any other stretch of the order; the last
    row of a range looks at the first one of the next.
    """
    opening = F.get("turns", F.lit(0))
    slim = convs.select(F.xxhash64(opening).alias("o1"), F.hash(opening).alias("o2"), "conv_id")
    dealt = through_parquet(slim.repartitionByRange(hash_partitions(convs.sparkSession), "o1", "o2", "conv_id").withColumn(
        "part", F.spark_partition_id()), "openings")
    row = F.struct("o1", "o2", "conv_id")
    # one row per range, so the window over all of them is short
    heads = dealt.groupBy("part").agg(F.min(row).alias("head")).select(
        F.col("part").alias("_part"), F.lead("head").over(Window.orderBy("part")).alias("after"))
    inside = F.lead(row).over(Window.partitionBy("part").orderBy("o1", "o2", "conv_id"))
    seen = dealt.withColumn("inside", inside).join(F.broadcast(heads), F.col("part") == F.col("_part"))
    nxt = seen.select("o1", "o2", "conv_id", F.coalesce("inside", "after").alias("n"))
    return nxt.where((F.col("o1") == F.col("n.o1")) & (F.col("o2") == F.col("n.o2"))).select("conv_id", F.col("n.conv_id").alias("other_id"))


def opening_pairs(convs: DataFrame) -> DataFrame:
    """Conversations with an equal opening turn as rivals, each with the one of the next id, over the whole table.

    The one with more assistant text is chosen, the smaller id among equals.
    """
    answered = F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    known = convs.withColumn("answered", answered)
    other = known.select(F.col("conv_id").alias("other_id"), F.col("turns").alias("other_turns"), F.col("answered").alias("other_answered"))
    pairs = known.join(next_of_opening(convs), "conv_id").join(other, "other_id")
    first = F.col("answered") >= F.col("other_answered")
    return pairs.select(
        F.when(first, F.col("conv_id")).otherwise(F.col("other_id")).alias("chosen_id"),
        F.when(first, F.col("other_id")).otherwise(F.col("conv_id")).alias("rejected_id"),
        F.when(first, F.col("turns")).otherwise(F.col("other_turns")).alias("chosen"),
        F.when(first, F.col("other_turns")).otherwise(F.col("turns")).alias("rejected"))


def answer_pairs(convs: DataFrame) -> DataFrame:
    """Two answers to the same turns of one conversation, for each conversation with two different answers.

    Chosen is the conversation up to its last answer; rejected has in the place
    of that answer the latest earlier one with another text. Both ids are the
    conversation's own.
    """
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    last = F.element_at(F.filter(places, lambda i: F.get("turns", i)["role"] == "assistant"), -1)
    rivals = F.filter("turns", lambda t, i: (i < F.col("last")) & (t["role"] == "assistant") & (t["text"] != F.get("turns", F.col("last"))["text"]))
    found = convs.where(F.exists("turns", lambda t: t["role"] == "assistant")).withColumn("last", last).withColumn("rivals", rivals)
    own = found.where(F.size("rivals") > 0)
    return own.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
                      F.slice("turns", 1, F.col("last") + 1).alias("chosen"),
                      F.concat(F.slice("turns", 1, F.col("last")), F.slice("rivals", -1, 1)).alias("rejected"))


def rival_pairs(turns: DataFrame) -> DataFrame:
    """All pairs that the rows give: between conversations of one opening, and between answers of one conversation."""
    convs = through_parquet(conversations(turns), "conversations")
    return opening_pairs(convs).withColumn("kind", F.lit("opening")).unionByName(answer_pairs(convs).withColumn("kind", F.lit("answer")))


def contract(turns: DataFrame) -> DataFrame:
    """Rival pairs of the whole table, formatted; texts as digests, masks as span lists."""
    def spans(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = format_pairs(rival_pairs(turns), keys=["chosen_id", "rejected_id", "kind"])
    return out.select("chosen_id", "rejected_id", "kind", F.col("n_common").cast("long").alias("n_common"), F.sha2("prompt", 256).alias("prompt_sha256"),
                      F.sha2("chosen_text", 256).alias("chosen_sha256"), spans(F.col("chosen_mask")).alias("chosen_mask"),
                      F.sha2("rejected_text", 256).alias("rejected_sha256"), spans(F.col("rejected_mask")).alias("rejected_mask"))


# the same pairs and template
ORACLE_SQL = """
with t as (select distinct conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null),
 c as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns,
              coalesce(sum(case when role = 'assistant' then length(text) end), 0) as answered from t group by conv_id),
 p as (select *, lead({'conv_id': conv_id, 'turns': turns, 'answered': answered}) over (
              partition by turns[1].role, turns[1].text order by conv_id) as other from c),
 q as (select *, answered >= other.answered as first from p where other is not null),
 a as (select conv_id, turns, list_max([i for i in range(1, len(turns) + 1) if turns[i].role = 'assistant']) as last from c),
 b as (select *, list_max([i for i in range(1, last) if turns[i].role = 'assistant' and turns[i].text <> turns[last].text]) as rival from a where last is not null),
 r as (select case when first then conv_id else other.conv_id end as chosen_id, case when first then other.conv_id else conv_id end as rejected_id, 'opening' as kind,
              case when first then turns else other.turns end as ch, case when first then other.turns else turns end as re from q
       union all select conv_id, conv_id, 'answer', turns[1:last], list_append(turns[1:last - 1], turns[rival]) from b where rival is not null),
 n as (select *, coalesce(list_min([i for i in range(1, least(len(ch), len(re)) + 1) if ch[i] <> re[i]]) - 1, least(len(ch), len(re))) as n_common from r),
 u as (select *, ch[n_common + 1:] as ct, re[n_common + 1:] as rt from n),
 v as (select *,
   [length('<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10)) for x in ct] as cl,
   [length('<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10)) for x in rt] as rl from u),
 w as (select *,
   [coalesce(list_sum(cl[1:i - 1]), 0)::bigint + 5 + length(ct[i].role) for i in range(1, len(ct) + 1) if ct[i].role = 'assistant'] as cs,
   [length(ct[i].text) for i in range(1, len(ct) + 1) if ct[i].role = 'assistant'] as cn,
   [coalesce(list_sum(rl[1:i - 1]), 0)::bigint + 5 + length(rt[i].role) for i in range(1, len(rt) + 1) if rt[i].role = 'assistant'] as rs,
   [length(rt[i].text) for i in range(1, len(rt) + 1) if rt[i].role = 'assistant'] as rn from v)
select chosen_id, rejected_id, kind, n_common::bigint as n_common,
 sha256(coalesce(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10) for x in ch[1:n_common]], ''), '')) as prompt_sha256,
 sha256(coalesce(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10) for x in ct], ''), '')) as chosen_sha256,
 coalesce(array_to_string([(cs[i]::varchar || ':' || (cs[i] + cn[i])::varchar) for i in range(1, len(cs) + 1)], ','), '') as chosen_mask,
 sha256(coalesce(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10) for x in rt], ''), '')) as rejected_sha256,
 coalesce(array_to_string([(rs[i]::varchar || ':' || (rs[i] + rn[i])::varchar) for i in range(1, len(rs) + 1)], ','), '') as rejected_mask
from w
"""
