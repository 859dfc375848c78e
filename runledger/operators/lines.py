"""Line-level compression of single texts.

A text is one value of one row, so everything about its lines is decided
inside the row with array functions: no explode, no regrouping shuffle.
The corpus-style TF-IDF score is the exception; it counts terms with
grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import text as T
from runledger.session import through_parquet

GAP = "…"


def distinct_words(line: Column) -> Column:
    """Number of distinct words of a line."""
    return F.size(F.array_distinct(F.regexp_extract_all(line, F.lit(r"(?U)(\w+)"), 1)))


def ranked_lines(lines: Column) -> Column:
    """What a choice of lines needs before it knows its budget: pinned numbers, the others richest first, the cost of the pinned ones."""
    described = F.transform(lines, lambda line, i: F.struct(
        i.alias("i"), (F.length(line) + 1).alias("cost"), T.pinned_line(line).alias("pin"),
        distinct_words(line).alias("score"), (F.trim(F.regexp_replace(line, r"(?U)\s", "")) == "").alias("blank")))

    def choose(d: Column) -> Column:
        pinned = F.filter(d, lambda x: x["pin"])
        rest = F.array_sort(F.transform(
            F.filter(d, lambda x: ~x["pin"] & ~x["blank"]),
            lambda x: F.struct((-x["score"]).alias("neg"), x["i"].alias("i"), x["cost"].alias("cost"))))
        used = F.aggregate(pinned, F.lit(0).cast("long"), lambda acc, x: acc + x["cost"])
        return F.struct(F.transform(pinned, lambda x: x["i"]).alias("pinned"), rest.alias("rest"), used.alias("used"))

    return T.let(described, choose)


def _kept(lines: Column, target: Column, ranked: Column | None = None) -> Column:
    def fill(s: Column) -> Column:
        # a line is taken while the budget is not yet used up before it
        taken = F.aggregate(
            s["rest"], F.struct(s["used"].alias("used"), F.lit(0).alias("n")),
            lambda acc, x: F.when(acc["used"] < target, F.struct(
                (acc["used"] + x["cost"]).alias("used"), (acc["n"] + 1).alias("n"))).otherwise(acc))["n"]
        return F.array_sort(F.concat(s["pinned"], F.transform(F.slice(s["rest"], F.lit(1), taken), lambda x: x["i"])))

    return T.let(ranked_lines(lines) if ranked is None else ranked, fill)


def kept_lines(text: Column, target_chars: int | Column) -> Column:
    """Zero-based numbers of the lines that stay: pinned ones, then the richest until the budget is used."""
    target = target_chars if isinstance(target_chars, Column) else F.lit(target_chars)
    return _kept(F.split(text, "\n", -1), target)


def _render(lines: Column, kept: Column) -> Column:
    """Kept lines in order, an ellipsis line for every gap."""

    def emit(i: Column, position: Column) -> Column:
        previous = F.when(position > 0, F.try_element_at(kept, F.greatest(position, F.lit(1)))).otherwise(F.lit(-1))
        line = F.try_element_at(lines, i + 1)
        return F.when(i > previous + 1, F.concat(F.lit(GAP + "\n"), line)).otherwise(line)

    last = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(-1))
    closing = F.when(last < F.size(lines) - 1, F.when(F.size(kept) > 0, F.lit("\n" + GAP)).otherwise(F.lit(GAP)))
    return F.concat(F.array_join(F.transform(kept, emit), "\n"), F.coalesce(closing, F.lit("")))


def extractive_compress(text: Column, target_chars: int | Column, ranked: Column | None = None) -> Column:
    """Keep pinned lines, then the lines richest in distinct words until the budget is used.

    Order is kept and gaps are marked. If that does not shorten the text it is
    cut to head and tail. Texts within the budget stay as they are. Where one
    text meets several budgets, ``ranked`` hands in its `ranked_lines`.
    """
    target = target_chars if isinstance(target_chars, Column) else F.lit(target_chars)
    n = F.length(text)
    head, tail = F.floor(target * 0.75).cast("int"), F.floor(target * 0.25).cast("int")
    cut = F.when(n <= head + tail + T.TRIM_SLACK, text).otherwise(F.concat(
        F.substring(text, F.lit(1), head), F.lit("\n… ["), (n - head - tail).cast("string"),
        F.lit(" chars trimmed] …\n"), F.right(text, tail)))

    def finish(s: Column) -> Column:
        return F.when(F.size(s["kept"]) >= F.size(s["lines"]), text).otherwise(T.let(
            _render(s["lines"], s["kept"]), lambda out: F.when(F.length(out) >= n, cut).otherwise(out)))

    # the target is bound with the lines: it may be an expression over the text
    chosen = T.let(F.struct(F.split(text, "\n", -1).alias("lines"), target.alias("target")), lambda b: T.let(
        F.struct(b["lines"].alias("lines"), _kept(b["lines"], b["target"], ranked).alias("kept")), finish))
    return F.when(n <= target, text).otherwise(chosen)


def line_scores(lines: DataFrame) -> DataFrame:
    """Fallback score: distinct words per line. ``lines``: doc_id, line_no, line."""
    return lines.select("doc_id", "line_no", distinct_words(F.col("line")).alias("score"))


# Characters of lines whose words one task counts (some 100 bytes a word while they are counted).
TASK_CHARS = 4_000_000


def tfidf_scores(lines: DataFrame, max_terms: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Sum of L2-normalised TF-IDF weights per line, lines of a document being its corpus.

    Smooth idf; with ``max_terms`` only so many most frequent terms of a
    document count (term order decides ties), without all. ``carry`` names
    columns of a line that are handed on. Lines move once, by document, into
    as many tasks as their characters ask for, so that what a task counts
    does not grow with the table; words are taken apart once, and every
    count and rank below is keyed by the document and reuses that layout.
    """
    spark = lines.sparkSession
    chars = lines.agg(F.sum(F.length("line").cast("long"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    keys = ["doc_id", "line_no", *carry]
    # a line that is there twice counts twice, like its document
    dealt = lines.select(*keys, "line").repartition(tasks, "doc_id").withColumn(
        "_copies", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "line_no"))).withColumn(
        "_n_lines", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    # a line without words keeps one row without a term
    words = dealt.select(*keys, "_copies", "_n_lines", F.explode_outer(
        F.regexp_extract_all(F.lower("line"), F.lit(r"(?U)(\w+)"), 1)).alias("term"))
    counts = words.groupBy(*keys, "_copies", "_n_lines", "term").agg(F.count(F.lit(1)).alias("tf"))
    of_term = Window.partitionBy("doc_id", "term")
    counts = counts.withColumn("df", F.count(F.lit(1)).over(of_term))
    used = F.col("term").isNotNull()
    if max_terms is not None:
        frequent = Window.partitionBy("doc_id").orderBy(F.col("term").isNull(), F.col("_total").desc(), F.col("term"))
        counts = counts.withColumn("_total", F.sum("tf").over(of_term)).withColumn("_r", F.dense_rank().over(frequent))
        used = used & (F.col("_r") <= max_terms)
    idf = F.ln((1 + F.col("_n_lines")) / (1 + F.col("df"))) + 1
    weighted = counts.withColumn("w", F.when(used, F.col("tf") * idf))
    scored = weighted.groupBy(*keys, "_copies").agg(
        (F.sum("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("score"))
    return scored.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"),
                         F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")).drop("_copy")


# scores are compared at so many decimals, so that the order does not hang on the order of addition
SCORE_DIGITS = 9


def tfidf_compress(docs: DataFrame, target_chars: int, max_terms: int | None = None) -> DataFrame:
    """(doc_id, text): `extractive_compress` with lines ranked by TF-IDF.

    Pinned lines stay. The others that are not blank are the corpus of the
    score; they are taken by descending score, earlier ones first, until the
    budget is used. Only lines of texts over the budget are taken apart, and
    once: they are written with their marks. The running costs of a text go
    along its scored lines, which lie together already.
    """
    over = docs.where(F.length("text") > target_chars)
    lines = over.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select(
        "doc_id", "line_no", "line", T.pinned_line(F.col("line")).alias("pin"), (F.length("line") + 1).cast("long").alias("cost"),
        (F.regexp_replace("line", r"(?U)\s", "") == "").alias("blank"))
    lines = through_parquet(lines, "lines")
    scored = tfidf_scores(lines.where("NOT pin AND NOT blank"), max_terms, carry=["cost"]).withColumn("score", F.round("score", SCORE_DIGITS))
    running = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("line_no")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    spent = scored.withColumn("upto", F.sum("cost").over(running))
    fixed = lines.where("pin").groupBy("doc_id").agg(F.sum("cost").alias("used"), F.collect_list("line_no").alias("_pins"))
    taken = spent.where(F.col("upto") - F.col("cost") < target_chars).join(fixed.select("doc_id", "used"), "doc_id", "left").where(
        F.coalesce("used", F.lit(0)) + F.col("upto") - F.col("cost") < target_chars).groupBy("doc_id").agg(F.collect_list("line_no").alias("_taken"))
    none = F.array().cast("array<int>")
    kept = taken.join(fixed, "doc_id", "full").select("doc_id", F.array_sort(F.concat(F.coalesce("_pins", none), F.coalesce("_taken", none))).alias("_kept"))
    t, kept_lines_ = F.col("text"), F.coalesce("_kept", F.array().cast("array<int>"))

    def finish(s: Column) -> Column:
        cut = T.head_tail(t, int(target_chars * 0.75), int(target_chars * 0.25))
        return F.when(F.size(s["kept"]) >= F.size(s["lines"]), t).otherwise(T.let(
            _render(s["lines"], s["kept"]), lambda out: F.when(F.length(out) >= F.length(t), cut).otherwise(out)))

    chosen = T.let(F.struct(F.split("text", "\n", -1).alias("lines"), kept_lines_.alias("kept")), finish)
    return docs.select("doc_id", "text").join(kept, "doc_id", "left").select(
        "doc_id", F.when(F.length(t) <= target_chars, t).otherwise(chosen).alias("text"))


def downsample_text(text: Column, ratio: float) -> Column:
    """Every word keeps its leading round(len * share) characters (at least one), then the token cap applies.

    The share is target tokens over actual tokens; texts within the target stay whole.
    """
    tokens = T.token_estimate(text)
    target = F.greatest(F.lit(1).cast("long"), F.floor(tokens * F.lit(ratio)))
    share = F.greatest(F.lit(0.01), F.least(F.lit(1.0), target / F.nullif(tokens, F.lit(0))))

    def shorten(piece: Column, share: Column) -> Column:
        def cut(word: Column) -> Column:
            keep = F.greatest(F.lit(1), F.least(F.length(word), F.rint(F.length(word) * share).cast("int")))
            return F.concat(F.substring(word, F.lit(1), keep), F.substring(piece, F.length(word) + 1, F.length(piece)))

        return T.let(F.regexp_replace(piece, r"(?U)\s+$", ""), cut)

    def all_words(s: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(r"(?U)(\S+\s*)"), 1)
        out = F.array_join(F.transform(pieces, lambda p: shorten(p, s["share"])), "")
        trimmed = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
        return F.regexp_replace(F.substring(trimmed, F.lit(1), s["chars"]), r"(?U)\s+$", "")

    shortened = T.let(F.struct(share.alias("share"), (target * T.CHARS_PER_TOKEN).cast("int").alias("chars")), all_words)
    return F.when(tokens <= target, text).when(F.coalesce(tokens, F.lit(0)) == 0, F.lit("")).otherwise(shortened)
