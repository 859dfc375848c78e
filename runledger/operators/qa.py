"""Text question rounds: item scores, challenge views, token F1, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean over validators and last scoring time per item; unscored items stay, with nulls."""
    per_item = scores.groupBy("item_id").agg(
        F.avg("score").alias("score"), F.max("scored_at").alias("last_scored_at"))
    return items.join(per_item, "item_id", "left")


def challenge_scores(items: DataFrame, scores: DataFrame, links: DataFrame, entrants: DataFrame) -> DataFrame:
    """Items of actively linked challenges with entrant and mean score."""
    active = links.where("is_active").select("challenge_id", "competition_id")
    return (item_scores(items, scores).join(active, "challenge_id")
            .join(entrants.select("entrant_id", "hotkey"), "entrant_id"))


def screener_challenge_scores(items: DataFrame, scores: DataFrame, links: DataFrame, entrants: DataFrame,
                              screeners: DataFrame) -> DataFrame:
    """The same view limited to screener challenges (before scores are aggregated)."""
    only = items.join(screeners.select("challenge_id"), "challenge_id", "left_semi")
    return challenge_scores(only, scores, links, entrants)


def question_detail(questions: DataFrame, produced: DataFrame, truths: DataFrame, scores: DataFrame) -> DataFrame:
    """Per question: produced answer, truth, mean score and the first non-null detail.

    ``questions``: question_id, question. ``produced``: question_id, answer.
    ``truths``: question_id, truth. ``scores``: question_id, validator_id, score, details.
    """
    per_question = scores.groupBy("question_id").agg(
        F.avg("score").alias("avg_score"),
        F.min_by("details", F.when(F.col("details").isNotNull(), F.col("validator_id"))).alias("details"))
    return (questions.join(produced, "question_id", "left").join(truths, "question_id", "left")
            .join(per_question, "question_id", "left"))


def platform_summary(active: DataFrame, entrants: DataFrame, links: DataFrame, validators: DataFrame, registered: DataFrame, burns: DataFrame) -> DataFrame:
    """One row of headline counts of the active competition.

    ``active`` has at most one row (competition_id); without one, entrants
    and challenges count zero. A validator is active if the register
    (validator_id, ``is_active``) says so and it is not archived.
    """
    from runledger.operators.rewards import burn_state

    here = F.broadcast(active.select(F.col("competition_id").alias("_active")))
    of_active = lambda df: df.join(here, F.col("competition_id") == F.col("_active"), "left_semi")
    live = validators.where(~F.col("is_archive")).join(registered.where("is_active").select("validator_id").distinct(), "validator_id", "left_semi")
    parts = [
        of_active(entrants).agg(F.count(F.lit(1)).alias("entrants")),
        of_active(links).agg(F.count(F.lit(1)).alias("challenges"), F.count_if(F.col("is_active")).alias("active_challenges")),
        validators.agg(F.count_if(~F.col("is_archive")).alias("validators")),
        live.agg(F.count(F.lit(1)).alias("active_validators")),
        burn_state(burns).select(F.col("is_active").alias("burn_active"), "burn_ratio"),
    ]
    out = parts[0]
    for p in parts[1:]:  # every part is a single row
        out = out.crossJoin(F.broadcast(p))
    return out


def multi_level_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean over compression levels with weight 1 / sqrt(level)."""
    w = 1 / F.sqrt("compression_ratio")
    known = F.col("score").isNotNull() & (F.col("compression_ratio") > 0)
    return scores.groupBy(*keys).agg(
        (F.sum(F.when(known, w * F.col("score"))) / F.nullif(F.sum(F.when(known, w)), F.lit(0.0))).alias("score"))


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def token_f1(answers: DataFrame, key: str = "question_id") -> DataFrame:
    """Token-level F1 of answer against truth with multiset overlap.

    Each text is exploded into its words, counted per (key, side, word) with
    map-side combining, and the overlap is the smaller of both counts.
    """
    sides = answers.select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), words(F.col("answer")).alias("w")),
        F.struct(F.lit(1).alias("side"), words(F.col("truth")).alias("w")))).alias("s"))
    counted = sides.select(key, "s.side", F.explode("s.w").alias("word")).groupBy(key, "word").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("t"))
    sums = counted.groupBy(key).agg(
        F.sum(F.least("a", "t")).alias("overlap"), F.sum("a").alias("n_answer"), F.sum("t").alias("n_truth"))
    f1 = F.when(F.col("n_answer") + F.col("n_truth") > 0,
                2 * F.col("overlap") / F.nullif(F.col("n_answer") + F.col("n_truth"), F.lit(0)))
    return answers.select(key).join(sums, key, "left").select(
        key, F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce(f1, F.lit(0.0)).alias("f1"))


def rollup_items(question_scores: DataFrame) -> DataFrame:
    """Mean question score per (item, validator)."""
    return question_scores.groupBy("item_id", "validator_id").agg(
        F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_questions"))
