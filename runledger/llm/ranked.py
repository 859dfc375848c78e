"""Ranked lexical search: an Aho-Corasick scan of all documents for the terms of all items.

The distinct terms of the items, each guarded by a blank on both sides, form one
automaton that is broadcast to the workers. A document is scanned as it stands:
its bytes are mapped so that A-Z are lower-cased and every separator is a blank,
the automaton yields the occurrences of item terms, and each output leads to the
items that hold the term. There is no index of the documents and nothing of
their size is stored: a first scan sums what the weights need (documents with a
term, all terms, document frequencies), a second one scores. Scoring scatters a
document's weighted terms into a dense (documents x items) array of bounded
size; a task keeps the best ``k`` of each item, and Spark merges the tasks'.

The item side is bounded: items are dealt by hash into blocks of about
``BLOCK_PAIRS`` (item, term) pairs, each scanned for on its own, so that the
automaton, the collected frequencies and the broadcast have that size whatever
the number of items. One item is never split.

Defined results: a null or empty text has no terms and no rank; an item without
terms has no rows; rows that repeat an item_id are one item with the terms of
all of them, a null item_id being one such id; documents that repeat a doc_id
count, and rank, row by row; a null doc_id comes after all others among equal
scores; very long texts are scanned whole, in pieces that end at separators;
only doc_id, text, item_id are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import ascii_lower

# fixed by the contract: what parts terms, and the constants of the score
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT_UNIT, TF_UNIT, K_UNIT, FLAT, SLOPE, SATURATION = 1000, 1_000_000_000, 1000, 10, 90, 8
TOP = 10
# (item, term) pairs of one automaton, cells of one score array, bytes scanned at once
BLOCK_PAIRS, CELLS, PIECE = 500_000, 1 << 21, 1 << 20

_TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_MAP = bytes((b + 32 if 65 <= b <= 90 else b) if _TERM[b] else 32 for b in range(256))
_BLANK = 32


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term} ", i)
    if terms:
        found.make_automaton()
    return found


def pieces(mapped: bytes) -> Iterator[str]:
    """The mapped text, framed by blanks, in pieces that end at a blank."""
    start = 0
    while start < len(mapped):
        end = len(mapped) if len(mapped) - start <= PIECE else mapped.find(b" ", start + PIECE)
        end = len(mapped) if end < 0 else end
        yield f" {mapped[start:end].decode('utf-8')} "
        start = end


def counts(found: ahocorasick.Automaton, text: bytes) -> tuple[int, Counter]:
    """(number of all terms, occurrences of each item term) of one text."""
    mapped = text.translate(_MAP)
    inside = np.frombuffer(mapped, np.uint8) != _BLANK
    n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(inside) and inside[0])
    hits: Counter = Counter()
    if n and len(found):
        for piece in pieces(mapped):
            hits.update(map(itemgetter(1), found.iter(piece)))
    return n, hits


def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of a batch as bytes, one at a time; null is empty."""
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py() or b""


def corpus_stats(docs: DataFrame, terms: list[str]) -> tuple[int, int, list[int]]:
    """(documents with a term, terms of all documents, document frequency of each of ``terms``)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shared.value)
        df = np.zeros(len(shared.value) + 2, np.int64)
        for batch in batches:
            for text in texts(batch):
                n, hits = counts(found, text)
                df[-2] += n > 0
                df[-1] += n
                if hits:
                    df[np.fromiter(hits, np.int64, len(hits))] += 1
        kept = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(df[kept])], ["slot", "total"])

    rows = docs.select("text").mapInArrow(scan, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    total = dict((r["slot"], r["total"]) for r in rows)  # at most one row per term of the block
    return total.get(len(terms), 0), total.get(len(terms) + 1, 0), [total.get(i, 0) for i in range(len(terms))]


def keep_best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` entries of each item, best first."""
    order = np.lexsort((doc, missing, -score, item))
    item = item[order]
    first = np.searchsorted(item, item)
    return order[np.arange(len(item)) - first < k]


def scored(docs: DataFrame, terms: list[str], weights: list[int], postings: list[list[int]], n_items: int,
           n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(slot, doc_id, score): each task's best ``k`` documents of each item slot."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, weights, postings))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, lists = shared.value
        found, weight = automaton(names), np.array(w, np.int64)
        size = np.array([len(x) for x in lists], np.int64)
        begin, flat = np.concatenate([[0], np.cumsum(size)[:-1]]), np.concatenate([np.array(x, np.int64) for x in lists])
        best = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]
        floor = np.ones(n_items, np.int64)  # a score below its item's entry cannot enter any more

        def scatter(rows: list[tuple[int, int, np.ndarray, np.ndarray]], doc: np.ndarray, missing: np.ndarray) -> None:
            nonlocal best
            lens = [len(r[2]) for r in rows]
            term, tf = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
            m = np.repeat(np.array([r[1] for r in rows], np.int64), lens)
            gain = weight[term] * ((TF_UNIT * tf) // (K_UNIT * tf + SATURATION * m))
            fan = size[term]
            inside = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
            cell = np.repeat(np.repeat(np.arange(len(rows)), lens), fan) * n_items + flat[np.repeat(begin[term], fan) + inside]
            board = np.zeros(len(rows) * n_items, np.int64)
            np.add.at(board, cell, np.repeat(gain, fan))
            row, item = np.nonzero(board.reshape(len(rows), n_items) >= floor)
            at = np.array([r[0] for r in rows])[row]
            new = [item, board.reshape(len(rows), n_items)[row, item], doc[at], missing[at]]
            best = [np.concatenate(pair) for pair in zip(best, new)]
            keep = keep_best(*best, k)
            best = [x[keep] for x in best]
            last = np.flatnonzero(np.bincount(best[0], minlength=n_items) == k)
            floor[last] = best[1][np.searchsorted(best[0], last, side="right") - 1]

        per = max(1, CELLS // n_items)
        for batch in batches:
            ids = batch.column("doc_id")
            doc, missing = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
            rows = []
            for i, text in enumerate(texts(batch)):
                n, hits = counts(found, text)
                if hits:
                    m = 100 - SLOPE + (SLOPE * n * n_docs) // n_terms
                    rows.append((i, m, np.fromiter(hits, np.int64, len(hits)), np.fromiter(hits.values(), np.int64, len(hits))))
                if len(rows) == per:
                    scatter(rows, doc, missing)
                    rows = []
            if rows:
                scatter(rows, doc, missing)
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[2], mask=best[3]), pa.array(best[1])], ["slot", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "slot long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    words = F.explode(F.split(F.coalesce(ascii_lower(F.col("text")), F.lit("")), GAP)).alias("term")
    return items.select("item_id", words).where(F.col("term") != "").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, equal scores by doc_id."""
    spark = docs.sparkSession
    pairs = item_terms(items)
    blocks = -(-pairs.count() // block_pairs)
    out = []
    for b in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_pairs rows
        slots = {item: i for i, item in enumerate(dict.fromkeys(r["item_id"] for r in rows))}
        terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        postings: list[list[int]] = [[] for _ in terms]
        for r in rows:
            postings[number[r["term"]]].append(slots[r["item_id"]])
        if not terms:
            continue
        n_docs, n_terms, df = corpus_stats(docs, terms)
        weights = [math.floor(WEIGHT_UNIT * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]
        hits = scored(docs, terms, weights, postings, len(slots), n_docs, n_terms, k)
        best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(
            F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for item, i in slots.items()], f"slot long, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(best.join(F.broadcast(names), "slot").select("item_id", "rank", "doc_id", "score"))
    if not out:
        empty = items.select("item_id").where(F.lit(False))
        return empty.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, out)


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
     t as (select rid, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
     c as (select rid, term, count(*)::bigint as tf from t group by all),
     s as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
     i as (select distinct item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from benchmark),
     f as (select term, count(*)::bigint as df from c group by term),
     w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from f, s),
     p as (select i.item_id, d.doc_id, c.rid, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + ((90 * len(d.w) * s.n_docs) // s.n_terms)))))::bigint as score
           from i join c using (term) join w using (term) join d using (rid), s group by all),
     r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last, rid)::int as rank from p where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


def contract(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The op11 contract."""
    return search(docs, items).withColumn("rank", F.col("rank").cast("int"))
