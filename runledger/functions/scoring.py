"""Scoring arithmetic as Column expressions.

Everything stays inside whole-stage codegen; nothing here needs Python
workers. Inputs are Columns or column names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rule.
LOG_RATIO_LIMIT = 2.0
SCORE_FLOOR = -4.0
SAVINGS_HALF_WIDTH = 0.20
# (baseline passes, compressed passes) -> (base score, weight of the log ratio)
OUTCOMES = {
    (True, True): (1.0, 0.5),
    (True, False): (-4.0, 0.0),
    (False, True): (4.0, 0.5),
    (False, False): (0.0, 0.1),
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compression_ratio(base: Column | str, comp: Column | str) -> Column:
    """baseline / compressed to four digits; null when either side is null or zero."""
    a, b = _c(base), _c(comp)
    scaled = F.floor(a.cast("double") * 10000 / F.nullif(b, F.lit(0)) + 0.5)
    return F.when((a != 0) & (b != 0), scaled / 10000)


def log_token_ratio(base: Column | str, comp: Column | str) -> Column:
    """ln(base/comp) limited to [-2, 2]; unusable token counts give 0, not null."""
    a, b = _c(base).cast("double"), _c(comp).cast("double")
    raw = F.ln(a / F.nullif(b, F.lit(0.0)))
    limited = F.greatest(F.lit(-LOG_RATIO_LIMIT), F.least(F.lit(LOG_RATIO_LIMIT), raw))
    return F.when((a > 0) & (b > 0), limited).otherwise(F.lit(0.0))


def outcome_score(base_pass: Column | str, comp_pass: Column | str) -> Column:
    """struct(base, lam) for a verdict pair; null while either verdict is pending."""
    bp, cp = _c(base_pass), _c(comp_pass)
    chain = None
    for (b, c), (base, lam) in OUTCOMES.items():
        hit = (bp == F.lit(b)) & (cp == F.lit(c))
        value = F.struct(F.lit(base).alias("base"), F.lit(lam).alias("lam"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def pair_score(base_pass, comp_pass, base_tokens, comp_tokens) -> Column:
    """Score of one run against one baseline run."""
    outcome = outcome_score(base_pass, comp_pass)
    return outcome["base"] + outcome["lam"] * log_token_ratio(base_tokens, comp_tokens)


def savings_ratio(base: Column | str, comp: Column | str) -> Column:
    """Share of tokens saved; null unless both totals are positive."""
    a, b = _c(base).cast("double"), _c(comp).cast("double")
    return F.when((a > 0) & (b > 0), F.lit(1.0) - b / F.nullif(a, F.lit(0.0)))


def savings_multiplier(savings: Column | str) -> Column:
    """Smoothstep from 0 at -20 % to 1 at +20 % savings; unknown savings leave the score alone."""
    s = _c(savings)
    x = F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), (s + SAVINGS_HALF_WIDTH) / (2 * SAVINGS_HALF_WIDTH)))
    return F.when(s.isNull(), F.lit(1.0)).otherwise(x * x * (F.lit(3.0) - F.lit(2.0) * x))


def adjust_score(raw, base_tokens, comp_tokens) -> Column:
    """Pull a raw score towards the floor when tokens were not saved."""
    multiplier = savings_multiplier(savings_ratio(base_tokens, comp_tokens))
    return F.lit(SCORE_FLOOR) + (_c(raw) - F.lit(SCORE_FLOOR)) * multiplier


def broke_baseline(base_pass, comp_pass) -> Column:
    """True when the baseline passed and the compressed side is not known to pass."""
    return F.coalesce(_c(base_pass), F.lit(False)) & ~F.coalesce(_c(comp_pass), F.lit(False))


def negative_score(score) -> Column:
    return F.coalesce(_c(score) < 0, F.lit(False))


def close_to(a, b, tol: float = 1e-12) -> Column:
    """Symmetric tolerance comparison, relative and absolute by the same bound."""
    x, y = _c(a), _c(b)
    bound = F.greatest(F.lit(tol) * F.greatest(F.abs(x), F.abs(y)), F.lit(tol))
    return F.abs(x - y) <= bound
