"""Line deduplication by an exact set-similarity join.

A line's words are what runs of white space part; its tokens are its
distinct shingles of ``SHINGLE`` words (a line with fewer words is one
shingle). Lines match at Jaccard 4/5 or more; a line that matches an earlier
one (by doc_id, then line number) is removed, whether or not the earlier one
stays.

Equal lines form classes, and one line of a class goes on. Shingles are
ordered by rarity: their hashes are counted over all lines in a table of fixed
size. A line's prefix are its rarest shingles, as many as a match cannot miss
altogether; classes meet on prefix shingles that
more than one has, subject to the length filter (sizes within 4/5) and the
positional filter (what is left behind the shingle suffices) and the bitmap
filter (parities of the shingles that fall on each of 128 bits; as many shingles
at least as bits differ are in one line only), and meeting
classes are verified on their whole shingle sets. A shingle that few classes
share gives pairs of ids, made distinct before the sets are fetched; one that
many share gives an existence join, which yields one row per line however many
near copies there are. Lines of repeated words may have few shingles, or the
same ones, however long they are, so only lines of one shorter shingle stay out.

A text is taken apart once for counts, once for the prefixes of its lines and once more if
it holds a line in need of verification. All of it is DataFrame code.

Defined results: null and empty texts and blank lines are kept as they are;
documents that repeat id and text count as one document and lose the same
lines; null ids come first in the order; very long texts and lines are taken
whole; an empty table gives an empty one. Shingles are compared by 48-bit
hashes, equal lines by 96 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import bound, free_names
from runledger.session import through_parquet

SHINGLE = 5
# entries of the rarity table, a power of two
RARITY_SLOTS = 1 << 14
# classes that share a shingle up to which they are listed in pairs
FEW = 32
HASH_BITS = 48
# runs of white space that are not one space already, and what every text with such a run contains
ODD_GAP = r"[\t\r\f\x0B][ \t\r\f\x0B]*| [ \t\r\f\x0B]+"
ODD_SIGNS = ["  ", "\t", "\r", "\f", "\x0b"]


def spaced(text: Column) -> Column:
    """The text with one space for every run of white space inside its lines; a plain search spares most texts the pattern."""
    odd = reduce(Column.__or__, [F.contains(text, F.lit(sign)) for sign in ODD_SIGNS])
    return F.when(odd, F.regexp_replace(text, ODD_GAP, " ")).otherwise(text)


def line_words(line: Column) -> Column:
    return F.split(line, " ")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, line_no, line) of the lines that are not blank, their words joined by single spaces; a document is known by its id and the hash of its text."""
    named = docs.where(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("h"), spaced(F.col(text)).alias("t"))
    lines = named.select("doc_id", "h", F.posexplode(F.split("t", "\n")).alias("line_no", "raw"))
    return lines.select("doc_id", "h", "line_no", F.trim("raw").alias("line")).where(F.col("line") != "")


def class_keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("c1"), F.hash(line).alias("c2")]


def three_words(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(3)])


def shingles(threes: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of the two runs of three words that each shingle of five consists of."""
    n = F.greatest(F.size(threes) - SHINGLE + 1, F.lit(0))
    return F.zip_with(F.slice(threes, 1, n), F.slice(threes, 3, n), make)


def rarity(docs: DataFrame, text: str) -> list[int]:
    """Level of every slot: 0 up to twice the mean count of all lines' shingles, t from 2 ** t times the mean on.

    A statistic of RARITY_SLOTS numbers, whatever the size of the data, which
    goes through the driver to become part of the later plans.
    """
    words = bound(lines_of(docs, text).select("line"), "w", line_words(F.col("line")))
    each = words.select("w", F.posexplode("w").alias("at", "_w")).where(F.col("at") + SHINGLE <= F.size("w"))
    counts = each.groupBy(slot_of(three_words(F.col("w"), F.col("at")), three_words(F.col("w"), F.col("at") + 2)).alias("slot")).count()
    level = F.floor(F.log2(F.col("count") / F.sum("count").over(Window.partitionBy()) * RARITY_SLOTS))
    levels = [0] * RARITY_SLOTS
    for r in counts.select("slot", level.alias("level")).where("level >= 1").collect():
        levels[r["slot"]] = r["level"]
    return levels


def slot_of(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b).bitwiseAND(F.lit(RARITY_SLOTS - 1))


def ordered_shingles(threes: Column, levels: list[int]) -> Column:
    """Distinct shingles of a line, of its runs of three words, as (frequency, hash) keys, rarest first."""
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")
    level = lambda a, b: F.coalesce(F.get(table, slot_of(a, b).cast("int")), F.lit(0).cast("bigint"))
    low = F.lit((1 << HASH_BITS) - 1)
    return F.sort_array(F.array_distinct(shingles(threes, lambda a, b: F.xxhash64(a, b).bitwiseAND(low) + F.shiftleft(level(a, b), HASH_BITS))))


def parities(keys: Column) -> list[Column]:
    """Parity of the keys with each value of their seven lowest bits: all, and those with the seventh bit, by the other six."""
    def folded(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate(keys, F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    return [folded(lambda k: F.lit(1).cast("bigint")).alias("b0"), folded(lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("bigint"))).alias("b1")]


def run_hashes(lines: DataFrame) -> DataFrame:
    """The lines and ``t``, the hashes of the three words from each word on."""
    words = bound(lines, "w", line_words(F.col("line")))
    return bound(words, "t", F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)))).drop("w")


def prefixed_lines(docs: DataFrame, text: str, levels: list[int]) -> DataFrame:
    """(doc_id, h, line_no, c1, c2, size, b0, b1, keys) of the lines that are not blank: number of shingles, parities, prefix (none, if too few words)."""
    placed = bound(run_hashes(lines_of(docs, text)).select("doc_id", "h", "line_no", *class_keys(F.col("line")), "t"), "keys", ordered_shingles(F.col("t"), levels))
    s = F.size("keys")
    prefix = F.slice("keys", 1, F.when(s > 0, s - F.floor((4 * s + 4) / 5).cast("int") + 1).otherwise(0))
    return placed.select("doc_id", "h", "line_no", "c1", "c2", s.alias("size"), *parities(F.col("keys")), prefix.alias("keys"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, levels: list[int]) -> DataFrame:
    """(c1, c2, f, keys): whole shingle sets of the wanted (c1, c2, f), read from the documents of f again."""
    lists = wanted.groupBy(F.col("f.doc_id").alias("w_id"), F.col("f.h").alias("w_h")).agg(F.collect_set("f.line_no").alias("lines"))
    held = docs.select("doc_id", F.xxhash64(text).alias("h"), spaced(F.col(text)).alias("t")).join(
        lists, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    each = held.select("doc_id", "h", "lines", F.posexplode(F.split("t", "\n")).alias("line_no", "raw")).where(F.array_contains("lines", F.col("line_no")))
    named = each.select(F.struct("doc_id", "h", "line_no").alias("f"), F.trim("raw").alias("line"))
    return run_hashes(named).select(*class_keys(F.col("line")), "f", ordered_shingles(F.col("t"), levels).alias("keys")).dropDuplicates(["c1", "c2"])


def close_sizes(x: Column, y: Column) -> Column:
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def room_left(xs: Column, xp: Column, ys: Column, yp: Column) -> Column:
    return 9 * F.least(xs - xp, ys - yp) >= 4 * (xs + ys)


def overlap(x: Column, y: Column) -> Column:
    return 9 * F.size(F.array_intersect(x, y)) >= 4 * (F.size(x) + F.size(y))


def may_match(x: str, y: str) -> Column:
    """Size, positional and bitmap filter of two rows that share a shingle; shingles of one line alone are a ninth of both sizes at most."""
    xs, ys = F.col(f"{x}.size"), F.col(f"{y}.size")
    seventh = F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1"))
    unlike = F.bit_count(seventh) + F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0")).bitwiseXOR(seventh))
    return close_sizes(xs, ys) & room_left(xs, F.col(f"{x}.pos"), ys, F.col(f"{y}.pos")) & (9 * unlike <= xs + ys)


def later_matches(docs: DataFrame, lines: DataFrame, first: DataFrame, levels: list[int], text: str = "text") -> DataFrame:
    """(c1, c2) of the classes of which an earlier, different class is a match; ``lines`` have prefixes, ``first`` holds (c1, c2, f, b0, b1)."""
    one = lines.where(F.col("size") > 0).groupBy("c1", "c2").agg(F.any_value("size").alias("size"), F.any_value("keys").alias("keys"))
    rows = one.select("c1", "size", F.posexplode("keys").alias("pos", "key"))
    per_key = Window.partitionBy("key")
    shared = rows.withColumns({"low": F.min("c1").over(per_key), "high": F.max("c1").over(per_key)}).where("low <> high")
    # shingles that the same classes have bring the same pairs together; the rarest of them is enough
    owners = F.bit_xor(F.xxhash64("c1")).over(per_key)
    shared = shared.withColumns({"owners": owners, "n": F.count(F.lit(1)).over(per_key)}).groupBy("c1", "size", "owners", "n").agg(
        F.min(F.struct("key", "pos")).alias("k")).select("k.key", "c1", "size", "k.pos", "n")
    shared = through_parquet(shared.join(first.select("c1", "b0", "b1"), "c1"), "shared-shingles")

    few, many = shared.where(F.col("n") <= FEW), shared.where(F.col("n") > FEW)
    x, y = few.alias("x"), few.alias("y")
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.c1") < F.col("y.c1")) & may_match("x", "y")
    pairs = through_parquet(x.join(y, meets).select(F.col("x.c1").alias("a"), F.col("y.c1").alias("b")).distinct(), "line-pairs")
    x, y = many.alias("x"), many.alias("y")
    many = through_parquet(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c1") != F.col("y.c1")) & may_match("x", "y"), "left_semi"), "many-met")
    # whole shingle sets of the classes that meet another, from their first occurrences
    met = pairs.select(F.col("a").alias("c1")).union(pairs.select("b")).union(many.select("c1")).distinct()
    sets = through_parquet(shingle_sets(docs, first.select("c1", "c2", "f").join(met, "c1"), text, levels), "line-sets")

    side = lambda n: sets.select(F.col("c1").alias(n), F.col("c2").alias(f"{n}2"), F.col("f").alias(f"{n}f"), F.col("keys").alias(f"{n}k"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(overlap(F.col("ak"), F.col("bk")))
    a_later = F.col("af") > F.col("bf")
    late = found.select(F.when(a_later, F.col("a")).otherwise(F.col("b")).alias("c1"), F.when(a_later, F.col("a2")).otherwise(F.col("b2")).alias("c2"))

    meet = through_parquet(many.join(sets, "c1"), "meeting-lines")
    x, y = meet.alias("x"), meet.alias("y")
    match = ((F.col("x.key") == F.col("y.key")) & (F.col("x.f") < F.col("y.f")) & ((F.col("x.c1") != F.col("y.c1")) | (F.col("x.c2") != F.col("y.c2")))
             & may_match("x", "y") & overlap(F.col("x.keys"), F.col("y.keys")))
    return late.union(y.join(x, match, "left_semi").select("c1", "c2")).distinct()


def removed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, removed): sorted numbers of the removed lines of each document that loses any."""
    levels = rarity(docs, text)
    lines = through_parquet(prefixed_lines(docs, text, levels), "lines")
    first = through_parquet(lines.groupBy("c1", "c2").agg(
        F.min(F.struct("doc_id", "h", "line_no")).alias("f"), *[F.any_value(b).alias(b) for b in ("b0", "b1")]), "first-lines")
    late = later_matches(docs, lines, first.select("c1", "c2", "f", "b0", "b1"), levels, text).withColumn("late", F.lit(True))
    judged = lines.select("doc_id", "h", "line_no", "c1", "c2").join(first.select("c1", "c2", "f").join(late, ["c1", "c2"], "left"), ["c1", "c2"])
    later = ~F.struct("doc_id", "h", "line_no").eqNullSafe(F.col("f"))
    gone = judged.where(F.col("late").isNotNull() | later)
    return gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their later matches cut out of the text, all columns kept."""
    i, h, removed = free_names(docs, "_id", "_h", "_removed")
    gone = removed_lines(docs, text).select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("removed").alias(removed))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains(removed, at)), "\n")
    return joined.select(*[F.when(F.col(removed).isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns])


def contract(docs: DataFrame) -> DataFrame:
    """Per document: how many lines it has, which go (as a list and a count)."""
    gone = removed_lines(docs).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "removed")
    slim = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return slim.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


# token sets as sorted lists of shingle texts
ORACLE_SQL = r"""
with l as (select doc_id, generate_subscripts(p, 1) - 1 as line_no, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null)),
     w as (select doc_id, line_no, string_split(trim(line), ' ') as w from l where trim(line) <> ''),
     k as (select doc_id, line_no, array_to_string(w, ' ') as k, case when len(w) < 5 then [array_to_string(w, ' ')]
              else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as t from w),
     f as (select k, any_value(t) as t, min({'d': doc_id, 'l': line_no}) as f from k group by k),
     tok as (select k, f, len(t) as n, unnest(t) as tok from f),
     pairs as (select y.k, x.k as xk, x.n as xn, y.n as yn, count(*) as o from tok x join tok y on x.tok = y.tok and x.f < y.f
               and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) group by all),
     late as (select distinct k from pairs where 9 * o >= 4 * (xn + yn)),
     gone as (select k.doc_id, k.line_no from k join f using (k) left join late on late.k = k.k where late.k is not null or {'d': k.doc_id, 'l': k.line_no} <> f.f),
     per as (select doc_id, count(*) as n, string_agg(line_no::varchar, ',' order by line_no) as lines from gone group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(per.n, 0)::bigint as n_removed, coalesce(per.lines, '') as removed_lines
from documents d left join per using (doc_id)
"""
