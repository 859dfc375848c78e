"""Exact top-k search by inner product: every query against every row, term at a time.

Rows are sparse vectors of integers, floor(scale * x) per component. Candidates
and queries are cut into blocks by a hash; each pair of a candidate block and a
query block is one group. Inside it, every term (component) of the queries
scatters its weights times the term's postings into a dense score array of
queries by candidates; each query then keeps its k best of the block by
partition selection, and the blocks' winners are merged.

Both sides of a group are bounded by the block sizes, whatever the tables hold:
identical rows are counted first and stand for their copies (at most k of them
can win). A block holds block_rows rows on average; its size varies as that of
hash buckets does.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; components past the end of a shorter
vector count as 0, an empty vector scores 0 with all; rows that repeat a query's
id are not its candidates; repeated rows are candidates one by one, repeated
query rows one query. Scores are 64-bit integers (they wrap beyond that), ties
go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 512
QUERY_ROWS = 512


def matrix(values: pd.Series) -> np.ndarray:
    """Components as an integer matrix, shorter vectors filled with zeros."""
    width = max((len(v) for v in values), default=0)
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Term-at-a-time accumulation into dense arrays, one per query."""
    total = np.zeros((len(queries), len(block)), dtype=np.int64)
    for term in range(min(queries.shape[1], block.shape[1])):
        postings = np.flatnonzero(block[:, term])
        wanted = np.flatnonzero(queries[:, term])
        if len(postings) == 0 or len(wanted) == 0:
            continue
        weights = block[postings, term]
        if len(postings) == len(block) and len(wanted) == len(queries):
            total += queries[:, term, None] * weights[None, :]
        else:
            total[np.ix_(wanted, postings)] += queries[wanted, term, None] * weights[None, :]
    return total


def select(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(row) > k:
        least = np.partition(row, len(row) - k)[len(row) - k]
        at = np.flatnonzero(row >= least)
    else:
        at = np.arange(len(row))
    return at[np.lexsort((ids[at], -row[at]))][:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec: str = "embedding", key: str = "vec_id",
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, its k best other rows."""
    clean = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("x"), is_query.alias("is_query")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))))
    rows = clean.select("vec_id", "is_query", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))
    rows = rows.groupBy("vec_id", "x", "is_query").agg(F.count(F.lit(1)).alias("n"))
    queries = rows.where("is_query").select("vec_id", "x")
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks, cells = -(-max(n_rows, 1) // block_rows), -(-max(n_queries, 1) // query_rows)
    bucket = F.xxhash64("vec_id", "x")
    left = rows.select("vec_id", "x", F.least("n", F.lit(k)).cast("int").alias("n"), F.pmod(bucket, F.lit(blocks)).alias("b"),
                       F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("c"))
    right = queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("qx"), F.pmod(bucket, F.lit(cells)).cast("int").alias("c"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))

    def cell(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(wanted):
            block = block.loc[block.index.repeat(block["n"])]
            ids, data = block["vec_id"].to_numpy(), matrix(block["x"])
            names, total = wanted["query_id"].to_numpy(), None
            total = scores(matrix(wanted["qx"]), data)
            for i, name in enumerate(names):
                others = ids != name
                row, there = (total[i], ids) if others.all() else (total[i][others], ids[others])
                best = select(row, there, k)
                out.append(pd.DataFrame({"query_id": name, "vec_id": there[best], "score": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
