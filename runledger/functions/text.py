"""Text shape, flags and normal forms as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed markers and patterns of the transcript rules.
ERROR_MARKERS = (
    "traceback (most recent call last)",
    "assertionerror",
    "error:",
    "exception:",
    "failed",
    "failures=",
    "errors=",
    "fatal:",
)
# one case-insensitive pass instead of lower() and eight searches
ANY_ERROR_MARKER = "(?i)" + "|".join(re.escape(m) for m in ERROR_MARKERS)
FAILING_TEST = (r"(?m)\b[1-9]\d*\s+failed\b|\b[1-9]\d*\s+errors?\b|\bFAILED\b|\bAssertionError\b"
                r"|^\s*(?:FAIL|ERROR):\s")
PASSING_TEST = (r"(?m)^=+[^\n]*\b[1-9]\d*\s+passed\b[^\n]*=+\s*$|\b[1-9]\d*\s+passed\b(?![^\n]*\bfailed\b)"
                r"|^OK\s*$|^OK\s*\([^)]*\)\s*$")
PATH = r"(?:/)?[\w.-]+(?:/[\w.-]+)+\.[A-Za-z]{1,4}(?::\d+)?"
# the same matches for Java: begun where a word begins (or the last match ended), as a later start inside a word finds nothing more
FIND_PATH = r"(?:\G|(?<![\w.-]))/?[\w.-]++(?:/[\w.-]+)+\.[A-Za-z]{1,4}(?::\d+)?"
DIFF_LINE = r"(?m)^[ \t]*(?:[+\-]|@@|diff --git|---|\+\+\+)"
CODE_SIGNATURE = r"\b(?:def|class)\s+\w+|\bfunction\s+\w+|=>\s*\{|\b\w+\s*\([^)]*\)\s*:"
TEST_LINE = (r"(?m)^\s*(?:FAILED|ERROR|FAIL|XFAIL)[: ]\S.*$|^\s*\S+\.py::\S+.*$"
             r"|^\s*(?:FAIL|ERROR): test\S* \(.*\).*$|^.*\bAssertionError\b.*$")
TRIM_SLACK = 80
CHARS_PER_TOKEN = 4


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda over a one-element array binds the value; without it an array
    expression used inside another lambda is evaluated per element.
    """
    return F.transform(F.array(value), body)[0]


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis marking the cut."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, max(0, limit - 1)), F.lit("…")))


def head_tail(text: Column, head: int | Column, tail: int | Column, marker: str = "\n… [{} chars trimmed] …\n",
              slack: int = TRIM_SLACK) -> Column:
    """Head and tail of a long text; short ones (up to head + tail + slack) stay whole.

    ``{}`` in the marker stands for the number of characters cut.
    """
    n, head, tail = F.length(text), F.lit(head), F.lit(tail)
    left, _, right = marker.partition("{}")
    middle = [F.lit(left), (n - (head + tail)).cast("string"), F.lit(right)] if "{}" in marker else [F.lit(marker)]
    cut = F.concat(F.substring(text, F.lit(1), head), *middle, F.right(text, tail))
    return F.when(n <= head + tail + slack, text).otherwise(cut)


def file_safe(key: Column) -> Column:
    """Key usable as a file name: other characters become dashes, at most 120 characters."""
    raw = F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit("session"))
    dashed = F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}_.-]", "-"), r"^-+|-+$", "")
    return F.substring(F.coalesce(F.nullif(dashed, F.lit("")), F.lit("session")), 1, 120)


def normalize_role(role: Column) -> Column:
    """Lower case without separators: 'Tool_Result' and 'tool-result' are the same role."""
    return F.translate(F.lower(F.trim(F.coalesce(role, F.lit("")))), "_-", "")


def flatten_blocks(blocks: Column) -> Column:
    """Text of an array of typed blocks, one line per block that has text."""
    parts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.array_join(parts, "\n")


def token_estimate(text: Column) -> Column:
    """max(1, ceil(chars / 4)), 0 for empty text."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), F.ceil(n / CHARS_PER_TOKEN)))


def normal_form(text: Column) -> Column:
    """Lower case, digits of any script dropped, every other run of non-letters one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Nd}+", ""), "[^a-z]+", " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(text: Column) -> Column:
    """JSON text without blanks and with sorted keys at every level; null if it is no JSON."""
    # a variant keeps the fields of its objects in the order of their names
    return F.to_json(F.try_parse_json(text))


def scanned(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def has_error(text: Column, limit: int | None = None) -> Column:
    """Error marker anywhere, or in the first ``limit`` characters."""
    return scanned(text, limit).rlike(ANY_ERROR_MARKER)


def has_failing_test(text: Column, limit: int | None = None) -> Column:
    return scanned(text, limit).rlike(FAILING_TEST)


def has_passing_test(text: Column, limit: int | None = None) -> Column:
    return scanned(text, limit).rlike(PASSING_TEST)


def has_diff(text: Column) -> Column:
    return text.rlike(DIFF_LINE)


def has_test_line(text: Column) -> Column:
    return text.rlike(TEST_LINE)


def has_signature(text: Column) -> Column:
    return text.rlike(CODE_SIGNATURE)


def pinned_line(line: Column) -> Column:
    """Lines that a compression never drops: errors, test verdicts, signatures, diffs, paths."""
    return (F.trim(F.regexp_replace(line, r"(?U)\s", "")) != "") & (
        line.rlike(ANY_ERROR_MARKER) | has_test_line(line) | has_signature(line) | has_diff(line) | line.rlike(FIND_PATH))


def paths(text: Column) -> Column:
    """Distinct file paths in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({FIND_PATH})"), 1))


def path_names(text: Column, min_length: int = 4) -> Column:
    """Paths without line numbers and their last parts, at least ``min_length`` characters."""
    bare = F.transform(paths(text), lambda p: F.substring_index(p, ":", 1))

    def with_last(names: Column) -> Column:
        last = F.transform(names, lambda p: F.substring_index(p, "/", -1))
        return F.array_distinct(F.filter(F.concat(names, last), lambda n: F.length(n) >= min_length))

    return let(bare, with_last)
