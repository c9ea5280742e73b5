"""Review queue, commit of approved triples, and state reducers of multi-step runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.ordered import first_per_key
from fieldglass.sources.stores import upsert


def with_status(queue: DataFrame, status: str) -> DataFrame:
    return queue.filter(F.col("status") == status)


def auto_approve(queue: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pending items at or above the confidence become approved; a missing confidence is zero."""
    passes = (F.col("status") == "pending") & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold)
    return queue.withColumn("auto", passes).withColumn(
        "status", F.when(passes, "approved").otherwise(F.col("status"))
    )


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply ``(id, decision, reason)`` rows: approved or rejected."""
    d = decisions.select("id", F.col("decision").alias("_d"), F.col("reason").alias("_r"))
    return queue.join(d, "id", "left").withColumn("status", F.coalesce("_d", "status")).withColumn(
        "reject_reason", F.when(F.col("_d") == "rejected", F.coalesce("_r", F.lit(""))).otherwise(F.col("reject_reason"))
    ).drop("_d", "_r")


def commit_approved(queue: DataFrame, edges: DataFrame, version: str) -> DataFrame:
    """Approved triples become validated edges, the last one per (from, to, relation)."""
    new = with_status(queue, "approved").select(
        "from_id", "to_id", "relation",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.lit(True).alias("validated"),
        version,
    )
    return upsert(edges, new, ["from_id", "to_id", "relation"], version)


def merge_attempts(results: DataFrame, run: list[str], seq: str) -> DataFrame:
    """Last result per (id, attempt), placed where the pair was first seen."""
    keys = [*run, "id", "attempt"]
    rest = [c for c in results.columns if c not in (*keys, seq)]
    picked = results.withColumn("attempt", F.coalesce("attempt", F.lit(0))).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(seq)).alias("_r"), F.min(seq).alias("position")
    )
    return picked.select(*keys, "_r.*", "position")


def merge_by_id(items: DataFrame, run: list[str], key: str, seq: str) -> DataFrame:
    """First item per id; items without one are dropped."""
    return first_per_key(items.filter(F.coalesce(F.col(key), F.lit("")) != ""), [*run, key], [seq])


def merge_history(history: DataFrame, run: list[str], seq: str, prefix: int | None = None) -> DataFrame:
    """First entry per subtask and query; with ``prefix`` queries are told apart by so many first characters."""
    query = F.coalesce("query", F.lit(""))
    keyed = history.withColumn("_q", F.sha2(query, 256) if prefix is None else F.substring(query, 1, prefix))
    return first_per_key(keyed, [*run, "subtask_id", "_q"], [seq]).drop("_q")


def latest_successful(results: DataFrame, run: list[str], exclude_id=None) -> DataFrame:
    """Highest successful attempt per id."""
    good = results.filter(F.col("verdict") & F.col("id").isNotNull())
    if exclude_id is not None:
        good = good.filter(F.col("id") != F.lit(exclude_id))
    rest = [c for c in results.columns if c not in (*run, "id")]
    picked = good.groupBy(*run, "id").agg(F.max_by(F.struct(*rest), F.coalesce(F.col("attempt"), F.lit(0))).alias("_r"))
    return picked.select(*run, "id", "_r.*")


def features_in_order(results: DataFrame, run: list[str], position: list[str]) -> DataFrame:
    """First appearance of every feature over the result lists, with that position for ordering."""
    named = results.select(
        *run,
        F.trim(F.coalesce(F.col("feature_id").cast("string"), F.lit(""))).alias("feature_id"),
        F.trim(F.coalesce("feature_name", F.lit(""))).alias("feature_name"),
        F.struct(*position).alias("position"),
    ).filter(F.col("feature_id") != "")
    return named.groupBy(*run, "feature_id").agg(
        F.min_by("feature_name", "position").alias("feature_name"), F.min("position").alias("position")
    )


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

