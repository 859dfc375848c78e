"""Leaderboards, pages, ranks and queue orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.scale import global_totals


# up to here the rows before a page are cheaper to keep than to number by ranges
TOP_ROWS = 10_000


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, top_rows: int = TOP_ROWS) -> DataFrame:
    """One page of an ordered list with the total row count.

    The first pages are top-k: at most ``number * size`` rows per task, and
    only those are numbered. Deep pages are cut from positions that ranges of
    the order hand out, so that no task sees all rows before the page.
    """
    if number * size > top_rows:
        placed = global_totals(df, [], order, F.lit(1), "position", "total_rows")
        return placed.where((F.col("position") > (number - 1) * size) & (F.col("position") <= number * size)).withColumn(
            "position", F.col("position").cast("int")).select(*df.columns, "position", "total_rows")
    top = df.orderBy(*order).limit(number * size)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return numbered.where(F.col("position") > (number - 1) * size).crossJoin(F.broadcast(total))


def leaderboard(board: DataFrame, number: int = 1, size: int = 100) -> DataFrame:
    """Missing scores last, then score, screener pass, hotkey."""
    order = [F.col("total_score").desc_nulls_last(), F.col("screener_passed").desc(), F.col("hotkey").asc()]
    return page(board, order, number, size)


def entrant_page(entrants: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Most recent submitters first, entrants without a submission last."""
    order = [F.col("last_submit").desc_nulls_last(), F.col("hotkey").asc()]
    return page(entrants, order, number, size)


def board_page(status: DataFrame, competition_stats: DataFrame, screener_stats: DataFrame, number: int = 1,
               size: int = 50) -> DataFrame:
    """Entrant list page: status with both score tables joined on (competition, hotkey), latest submitters first."""
    on = ["competition_id", "hotkey"]
    joined = status.join(competition_stats, on, "left").join(screener_stats, on, "left")
    return page(joined, [F.col("last_submit").desc_nulls_last(), F.col("hotkey").asc(), F.col("competition_id").asc()], number, size)
