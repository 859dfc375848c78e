"""Leases, retries and clean-up as set operations; usable per micro-batch or on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.values import capped_backoff


def seconds(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))


def requeue_stale(runs: DataFrame, now: Column, ttl_seconds: int = 2400) -> DataFrame:
    """Dispatched runs silent for longer than the TTL (at least a minute) go back to pending with a reason."""
    ttl = max(60, ttl_seconds)
    stale = (F.col("status") == "dispatched") & (F.col("updated_at") < now - seconds(ttl))
    return runs.select(
        *[c for c in runs.columns if c not in ("status", "updated_at")], stale.alias("requeued"),
        F.when(stale, "pending").otherwise(F.col("status")).alias("status"),
        F.when(stale, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(stale, F.lit(f"dispatch silent for more than {ttl} s, queued again")).alias("reason"))


def expired_assignments(assignments: DataFrame, now: Column, timeout_hours: float) -> DataFrame:
    return assignments.where(F.col("done_at").isNull() & (F.col("assigned_at") < now - seconds(timeout_hours * 3600)))


def expire_assignments(assignments: DataFrame, items: DataFrame, derived: DataFrame, now: Column, timeout_hours: float
                       ) -> tuple[DataFrame, DataFrame]:
    """Assignments and derived rows (by item) that survive the expiry of open assignments."""
    expired = expired_assignments(assignments, now, timeout_hours).select("batch_id").distinct()
    still = F.col("done_at").isNotNull() | ~(F.col("assigned_at") < now - seconds(timeout_hours * 3600))
    gone_items = items.join(expired, "batch_id", "left_semi").select("item_id")
    return assignments.where(F.coalesce(still, F.lit(True))), derived.join(gone_items, "item_id", "left_anti")


def claimable(validations: DataFrame, runs: DataFrame, now: Column, ttl_seconds: int, limit: int | None = None) -> DataFrame:
    """Open verdicts that may be claimed; verdicts of failed runs are scored false instead.

    With a ``limit`` the first ones by id, picked per task before they are merged; without, in no order.

    Free when nobody claimed, when the claim ran out, or when an old-style
    claim without expiry was never dated or is older than the TTL.
    """
    ttl = max(60, ttl_seconds)
    free = (F.col("validator_id").isNull() | (F.col("claim_expires_at") < now)
            | (F.col("claim_expires_at").isNull() & (F.col("claimed_at").isNull() | (F.col("claimed_at") < now - seconds(ttl)))))
    ready = runs.where("status IN ('completed', 'failed')").select("run_id", "status")
    found = (validations.where("scored_at IS NULL AND resolved IS NULL").where(F.coalesce(free, F.lit(False))).join(ready, "run_id")
             .select("validation_id", "run_id", F.when(F.col("status") == "failed", "score false").otherwise("claim").alias("action"),
                     F.when(F.col("status") != "failed", now + seconds(ttl)).alias("claim_until")))
    return found if limit is None else found.orderBy("validation_id").limit(limit)


def retry_due(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due deliveries in order; entries whose payload is no JSON object are dropped."""
    due = queue.where(F.col("next_attempt_at") <= now).orderBy("next_attempt_at", "id").limit(limit)
    return due.where(F.try_parse_json("payload").isNotNull())


def retry_stats(queue: DataFrame, now: Column) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("queued"), F.count_if(F.col("attempts") > 0).alias("retry_backlog"),
                     F.count_if(F.col("next_attempt_at") <= now).alias("due_now"))


def reschedule(failed: DataFrame, now: Column, base_seconds: float = 2.0, max_seconds: float = 300.0) -> DataFrame:
    """Next attempt of failed deliveries under capped exponential backoff."""
    attempts = F.col("attempts") + 1
    wait = capped_backoff(attempts, base_seconds, max_seconds)
    return failed.withColumns({
        "attempts": attempts, "next_attempt_at": F.timestamp_micros(F.unix_micros(now) + (wait * 1_000_000).cast("long"))})


def drop_inactive_batches(batches: DataFrame, items: DataFrame, links: DataFrame, comps: DataFrame) -> DataFrame:
    """Batches none of whose challenges belongs to an inactive competition."""
    dead = links.join(comps.where("NOT is_active").select("competition_id"), "competition_id", "left_semi").select("challenge_id")
    gone = items.join(dead, "challenge_id", "left_semi").select("batch_id")
    return batches.join(gone, "batch_id", "left_anti")
