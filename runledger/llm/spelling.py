"""Spelling variant grouping: words at one edit, found by PartEnum signatures of their letters.

A word's letter multiset is a binary vector with one dimension per (letter,
copy). One inserted or deleted letter changes one dimension, a replaced one at
most two, so near words have vectors at Hamming distance two or less. The
dimensions are partitioned into ``PARTS`` by their letter; vectors within two
differ in at most two parts, hence agree on all others, and enumerating every
choice of ``PARTS - 2`` parts gives signatures of which a near pair shares at
least one. Words made of the same syllables in another order have one multiset,
so a signature also carries what one edit leaves alone outside the multiset:
the shorter length m of the pair and one whole half of the word (its first or
its last m // 2 letters). Signatures are joined by equality, candidates are
verified by a bounded edit distance, and found pairs are made distinct.

A word's form is its near word of largest count, if that is ``RATIO`` times its
own; following forms ends after at most log10 of the largest count steps, so
the roots take that many equi-joins.

Only counts are computed from the documents, aggregated before they move, so a
frequent word is one row per task. A signature held by many words is a matter
of the vocabulary, not of the rows; Spark's skew join splits it.

Defined results: null and empty texts have no words; a null doc_id reads as the
empty string before the colon; rows that repeat a document count again; runs
and words of any length are taken whole; letters outside the class part runs;
only doc_id and text are read, so extra columns cannot clash; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import ascii_lower
from runledger.session import through_parquet

# fixed by the contract: letters, the code points and occurrences that a word has at least, the share of runs that lose a letter
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO, LOSS = 7, 2, 10, 31
# parts of the vector; a near pair agrees on PARTS - 2 of them
PARTS = 4


def occurrences(docs: DataFrame) -> DataFrame:
    """(word): every run of enough letters, lower-cased, some of them one letter short."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    # lower() is the same as A-Z only where all letters are ASCII
    low = each.select("doc", F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return low.select(F.when(h % LOSS == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): distinct words of enough letters and occurrences."""
    counted = occurrences(docs).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, upper, word, n): each word's signatures as the shorter (or equal) one of a pair and, if ``upper``, as the longer one."""
    letters = F.array_sort(F.split("word", ""))

    def part(i: int) -> Column:
        return F.array_join(F.filter("letters", lambda c: F.pmod(F.ascii(c), F.lit(parts)) == i), "")

    split = words.select("word", "n", F.length("word").alias("len"), letters.alias("letters")).select(
        "word", "n", "len", *[part(i).alias(f"p{i}") for i in range(parts)])
    as_either = F.explode(F.when(F.col("len") > MIN_LENGTH, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("upper")
    classed = split.select("*", as_either).withColumn("m", F.col("len") - F.col("upper").cast("int"))
    half = (F.col("m") / 2).cast("int")
    head, tail = F.substr("word", F.lit(1), half), F.substr("word", F.col("len") - half + 1)
    keys = [F.xxhash64("m", F.lit(end), piece, F.lit(str(kept)), *[F.col(f"p{i}") for i in kept])
            for end, piece in (("head", head), ("tail", tail)) for kept in combinations(range(parts), parts - 2)]
    return classed.select(F.explode(F.array(*keys)).alias("key"), "upper", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words at exactly one edit, in both directions."""
    sigs = signatures(words)
    shorter = sigs.where(~F.col("upper")).select("key", "word", "n")
    longer = sigs.select("key", "upper", F.col("word").alias("other"), F.col("n").alias("other_n"))
    once = F.col("upper") | (F.col("word") < F.col("other"))
    found = shorter.join(longer, "key").where(once & (F.levenshtein("word", "other", 1) == 1))
    pairs = found.select("word", "n", "other", "other_n").distinct()
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def with_forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    # the smallest of (-n, word) is the largest n, ties to the first in code-point order
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.minus") >= RATIO * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = through_parquet(vocabulary(docs), "spelling-words")
    facts = through_parquet(with_forms(words), "spelling-forms")
    top = facts.agg(F.max("form_n")).first()[0]
    if top is None:
        return facts.select("word", "form", F.col("word").alias("root"), "n", "n_near", "form_n")
    step = facts.where(F.col("form").isNotNull()).select(F.col("word").alias("from"), F.col("form").alias("to"))
    out = facts.withColumn("root", F.coalesce("form", "word"))
    # a chain of k forms ends at a count of at least MIN_COUNT * RATIO ** k; its first form is already taken
    for _ in range(max(0, math.floor(math.log10(top / MIN_COUNT) + 1e-9) - 1)):
        out = out.join(step, F.col("root") == F.col("from"), "left").withColumn("root", F.coalesce("to", "root")).drop("from", "to")
    return out.select("word", "form", "root", "n", "n_near", "form_n")
