"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import (decontaminate, htmltext, langid, linededup, pieces, preferences, ranked, secrets, simhash, spelling, suffixes,
                           topk, toxicity)
from runledger.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# words, windows, occurrences, and the words that they cover
OP1_SQL = r"""
with d as (select row_number() over () as rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     bw as (select item, len(w) as n, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) as beg from b where len(w) > 0),
     win as (select distinct item, least(n, 10) as len, array_to_string(w[beg:beg + 9], ' ') as key from bw),
     lens as (select distinct len from win),
     dp as (select rid, w, len, unnest(range(1, len(w) - len + 2)) as beg from d, lens where len(w) >= len),
     occ as (select dp.rid, dp.beg, win.len, win.item from dp join win on win.len = dp.len and array_to_string(dp.w[dp.beg:dp.beg + dp.len - 1], ' ') = win.key),
     pos as (select rid, count(distinct p) as n_hit from (select distinct rid, unnest(range(beg, beg + len)) as p from (select distinct rid, beg, len from occ)) group by rid),
     its as (select rid, count(distinct item) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from occ where item is not null) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(pos.n_hit, 0)::bigint as n_hit, coalesce(its.n_items, 0)::bigint as n_items,
       sha256(coalesce(its.items, '')) as items_sha256, coalesce(pos.n_hit, 0) > 0 as contaminated
from d left join pos using (rid) left join its using (rid)
"""


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.contract(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
with e as (select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
           where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
     p as (select q.vec_id as query_id, c.vec_id, coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, least(len(q.v), len(c.v)) + 1)]), 0)::bigint as score
           from e q join e c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.contract(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.contract(table(spark, sf_dir, "documents"))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.contract(table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.contract(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.contract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_secret_spans, op3_exact_topk, op4_line_dedup, op5_language, op6_preferences, op7_simhash, op8_pieces, op9_suffix_dedup, op10_toxicity,
        op11_ranked_search, op12_spelling_variants, op13_html_text)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_exact_topk": OP3_SQL, "op4_line_dedup": linededup.ORACLE_SQL, "op6_preferences": preferences.ORACLE_SQL,
            "op11_ranked_search": ranked.ORACLE_SQL, "op13_html_text": htmltext.ORACLE_SQL}
