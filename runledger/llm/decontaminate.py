"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Every benchmark item is cut into windows of ``size`` words (an item with fewer
words is one window). A window's tokens are its word shingles; they are ordered
by rarity, i.e. by how often each occurs in the documents, and because a window
must be contained whole, its rarest shingle alone is the necessary prefix. A
document position that carries a window's prefix shingle is a candidate if the
window fits around it (positional bound: the shingle's offset; length bound:
the words left), and the item-sized slice of the document is then compared.

Documents are never shuffled: the windows are broadcast, in blocks of at most
``BLOCK_WINDOWS`` of bounded length each, and documents are scanned once per
block. Slim rows of hits are grouped per document.

Defined results: a null text has no words; an item without words has no
window; items with equal words share windows and are all reported; an item
without an id still hits words but is not listed; documents that repeat a
doc_id are judged row by row, repeated rows give equal rows; empty tables give
no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import ascii_lower, bound, free_names

# fixed by the contract: what parts words
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
# windows of one broadcast; a window is at most WINDOW words
BLOCK_WINDOWS = 50_000


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Add ``w``, the words of the lower-cased ``text``; every step is bound once per row.

    lower() is the same as A-Z only where all characters are ASCII.
    """
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(F.col(text)))
    split = bound(df, "_parts", F.split(F.coalesce(low, F.lit("")), GAP))
    first = F.when(F.get("_parts", F.lit(0)) == "", 2).otherwise(1)
    last = F.size("_parts") - F.when(F.element_at("_parts", -1) == "", 1).otherwise(0)
    return bound(split, "w", F.slice("_parts", first, F.greatest(last - first + 1, F.lit(0)))).drop("_parts")


def item_windows(benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: (words, n, k, items) with the shingle size k and the ids of the items that hold them."""
    items = with_words(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), "text").where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(shingle)).alias("k"), "items")


def shingle_at(words: Column, pos: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, pos + i) for i in range(k)])


def positions(docs: DataFrame, ks: list[int]) -> DataFrame:
    """One row per document position and shingle size, and one more per document (pos = n) that matches nothing.

    The document is known by its id and the hash of its text.
    """
    named = with_words(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), "text")
    each = named.select("doc_id", "h", "w", F.size("w").alias("n"), F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "_w"))

    def token(k: int) -> Column:
        return F.when(F.col("pos") + k <= F.col("n"), shingle_at(F.col("w"), F.col("pos"), k))

    if len(ks) == 1:
        return each.select("doc_id", "h", "w", "n", "pos", token(ks[0]).alias("token"))
    tokens = F.array(*[token(k) for k in ks])
    # the extra row stays one row
    return each.select("doc_id", "h", "w", "n", "pos", F.explode(
        F.when(F.col("pos") == F.col("n"), F.array(F.lit(None).cast("bigint"))).otherwise(tokens)).alias("token"))


def prefix_windows(docs: DataFrame, windows: DataFrame, ks: list[int]) -> DataFrame:
    """(token, offset, words, n, items): each window under its rarest shingle."""
    def shingled(k: int) -> DataFrame:
        each = F.transform(F.sequence(F.lit(0), F.col("n") - k), lambda i: shingle_at(F.col("words"), i, k))
        return windows.where(F.col("k") == k).select("words", "n", "items", F.posexplode(each).alias("offset", "token"))

    per = [shingled(k) for k in ks]
    shingles = reduce(DataFrame.unionByName, per)
    wanted = shingles.select("token").distinct()
    counts = positions(docs, ks).select("token").where(F.col("token").isNotNull()).join(F.broadcast(wanted), "token").groupBy("token").count()
    ranked = shingles.join(counts, "token", "left").select("words", "n", "items", F.struct(
        F.coalesce("count", F.lit(0)).alias("count"), "token", "offset").alias("s"))
    return ranked.groupBy("words", "n", "items").agg(F.min("s").alias("s")).select("s.token", "s.offset", "words", "n", "items")


def document_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: (doc_id, h, n, hits, items).

    ``hits`` are the (start, len) word intervals of occurrences, sorted;
    ``items`` the sorted ids, as strings, of the items with an occurring window.
    """
    windows = item_windows(benchmark, size, shingle)
    shape = windows.groupBy("k").count().collect()  # at most ``shingle`` rows
    ks, total = sorted(r["k"] for r in shape), sum(r["count"] for r in shape)
    if not ks:
        plain = with_words(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), "text").select("doc_id", "h", F.size("w").alias("n"))
        return plain.select("*", F.array().cast("array<struct<start:int,len:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks = -(-total // block_windows)
    if blocks == 1:
        prefixes = [prefix_windows(docs, windows, ks)]
    else:
        part = F.pmod(F.xxhash64("words"), F.lit(blocks))
        prefixes = [prefix_windows(docs, windows.where(part == b), ks) for b in range(blocks)]
    found = []
    for p in prefixes:
        side = F.broadcast(p.select(F.col("token").alias("_t"), "offset", F.col("words").alias("_words"), F.col("n").alias("_len"), "items"))
        start = F.col("pos") - F.col("offset")
        fits = (F.col("token") == F.col("_t")) & (start >= 0) & (start + F.col("_len") <= F.col("n"))
        rows = positions(docs, ks).join(side, fits, "left")
        same = F.slice("w", start + 1, F.col("_len")) == F.col("_words")
        rows = rows.where((F.col("pos") == F.col("n")) | (F.col("_t").isNotNull() & same))
        found.append(rows.select("doc_id", "h", "n", (F.col("pos") == F.col("n")).alias("mark"), start.alias("start"), F.col("_len").alias("len"), "items"))
    rows = reduce(DataFrame.unionByName, found)
    hit = F.when(~F.col("mark"), F.struct("start", "len"))
    per = rows.groupBy("doc_id", "h", "n").agg(
        (F.count_if("mark") / len(found)).cast("int").alias("copies"), F.sort_array(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("mark"), F.col("items")))))).alias("items"))
    return per.select("doc_id", "h", "n", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def covered(hits: Column) -> Column:
    """Number of words in the union of sorted (start, len) intervals."""
    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(x["start"], a["end"]))).alias("n"),
        F.greatest(a["end"], x["start"] + x["len"]).alias("end")), lambda a: a["n"])


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op1 contract."""
    hits = document_hits(docs, benchmark)
    n_hit = covered(F.col("hits")).cast("long")
    return hits.select("doc_id", F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns kept."""
    i, h = free_names(docs, "_id", "_h")
    bad = document_hits(docs, benchmark).where(F.size("hits") > 0).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_anti")
