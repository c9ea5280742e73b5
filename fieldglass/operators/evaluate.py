"""Retrieval and classification evaluation over long tables ``(query_id, rank, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import words
from fieldglass.operators.ordered import (
    median_position,
    order_statistics,
    quantile_position,
    top_per_group,
    upper_median_position,
)


def _doc_key(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"\.md$", "")


def mark_hits(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Retrieved rows with ``hit``: same document and a section that starts with the gold section.

    ``gold``: query_id, source_doc, section, type. Equi-join on the query; the
    document and section tests are row predicates.
    """
    g = gold.select(
        "query_id", _doc_key(F.col("source_doc")).alias("_doc"), F.col("section").alias("_section")
    )
    same_doc = _doc_key(F.col("source_doc")) == F.col("_doc")
    same_section = F.coalesce(F.col("section_num"), F.lit("")).startswith(F.col("_section"))
    return retrieved.join(g, "query_id").withColumn("hit", same_doc & same_section).drop("_doc", "_section")


def first_hit_rank(marked: DataFrame) -> DataFrame:
    return marked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("hit_rank"))


def hit_ranks(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Every gold question with the rank of its first hit, null when there is none."""
    return gold.join(first_hit_rank(mark_hits(retrieved, gold)), "query_id", "left")


def _recall(k: int) -> Column:
    return F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0))


def reciprocal_rank() -> Column:
    return F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))


def retrieval_metrics(ranked: DataFrame, ks: list[int] = fixed.RECALL_AT) -> DataFrame:
    """MRR and recall at k, overall (null type) and per type, in one grouping-sets aggregate."""
    rows = ranked.withColumn("type", F.coalesce(F.col("type"), F.lit("unknown")))
    grouped = rows.groupingSets([[], [F.col("type")]], F.col("type"))
    return grouped.agg(
        F.grouping("type").alias("overall"),
        F.count(F.lit(1)).alias("n"),
        F.avg(reciprocal_rank()).alias("mrr"),
        *[_recall(k).alias(f"recall_at_{k}") for k in ks],
    )


def suite_summary(per_query: DataFrame, config: str = "config") -> DataFrame:
    """Per configuration: means over present values and the true median latency."""
    means = per_query.groupBy(config).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")],
        F.avg("faithfulness").alias("faithfulness"),
    )
    p50 = order_statistics(per_query, [config], "latency_ms", {"p50_ms": median_position()}).drop("n")
    return means.join(p50, config, "left").withColumn("p50_ms", F.coalesce("p50_ms", F.lit(0.0)))


def latency_summary(per_query: DataFrame, config: str = "config") -> DataFrame:
    """Ablation latencies: positions n//2 and int(0.95 n) of the sorted values, and the mean."""
    picks = order_statistics(
        per_query, [config], "latency_ms", {"p50_ms": upper_median_position(), "p95_ms": quantile_position(0.95)}
    )
    means = per_query.groupBy(config).agg(F.avg("latency_ms").alias("mean_ms"))
    return picks.join(means, config)


def delta_vs_baseline(summary: DataFrame, name: str, metrics: list[str], baseline: str = "baseline") -> DataFrame:
    """Each preset minus the baseline row (the first name when no row is called so)."""
    pick = F.min_by(F.struct(name, *metrics), F.struct((F.col(name) != baseline).cast("int"), F.col(name)))
    base = summary.agg(pick.alias("b")).scalar()
    return summary.filter(F.col(name) != base[name]).select(
        name, *[(F.col(m) - base[m]).alias(f"d_{m}") for m in metrics]
    )


def classification_metrics(pairs: DataFrame, routes: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per route from (expected, predicted), one shuffle of counts."""
    counts = pairs.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("c"))
    hit = F.col("expected") == F.col("predicted")
    totals = []
    for r in routes:
        exp, pred = F.coalesce(F.col("expected") == r, F.lit(False)), F.coalesce(F.col("predicted") == r, F.lit(False))
        of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
        totals.append(
            F.struct(
                F.lit(r).alias("route"),
                of(exp & pred).alias("tp"),
                of(~exp & pred).alias("fp"),
                of(exp & ~pred).alias("fn"),
            )
        )
    rows = counts.agg(
        F.array(*totals).alias("s"),
        F.coalesce(F.sum(F.when(hit, F.col("c"))) / F.sum("c"), F.lit(0.0)).alias("accuracy"),
    ).select("accuracy", F.inline("s"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = rows.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", safe(2 * p * r, p + r)).withColumn("support", tp + fn)


def confusion_matrix(pairs: DataFrame, routes: list[str]) -> DataFrame:
    """Full route by route grid; labels outside the list are ignored."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(r,) for r in routes], "actual string")
    counts = (
        pairs.filter(F.col("expected").isin(routes) & F.col("predicted").isin(routes))
        .groupBy(F.col("expected").alias("actual"))
        .agg(*[F.sum((F.col("predicted") == r).cast("long")).alias(r) for r in routes])
    )
    return grid.join(counts, "actual", "left").na.fill(0, routes)


def failures(items: DataFrame) -> DataFrame:
    return items.filter(F.col("expected") != F.col("predicted"))


def failure_distribution(items: DataFrame) -> DataFrame:
    return failures(items).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def failure_samples(items: DataFrame, order: str, per_pair: int = 5) -> DataFrame:
    """The first rows of each (expected, predicted) pair in input order."""
    return top_per_group(failures(items), ["expected", "predicted"], [F.col(order)], per_pair)


def coverage(routed: DataFrame) -> DataFrame:
    """Questions resolved by a layer against those left to the fallback."""
    matched = F.sum((F.col("layer") != "fallback").cast("long"))
    return routed.agg(matched.alias("matched"), (F.count(F.lit(1)) - matched).alias("fallback"))


def failure_reason() -> Column:
    """Rule-based reason of a miss; the first rule that applies wins."""
    tokens = words(F.coalesce(F.col("query"), F.lit("")))
    # a token is upper case when it has a cased letter and none in lower case
    shouting = F.filter(
        tokens, lambda w: (F.length(w) >= 2) & (F.upper(w) == w) & (F.lower(w) != w)
    )
    return (
        F.when(F.coalesce(F.col("needs_decomposition"), F.lit(False)), "decomposition_needed")
        .when(F.size(tokens) <= 5, "ambiguous_query")
        .when(F.size(shouting) >= 2, "vocabulary_mismatch")
        .when(F.col("expected_route").isin("diagnostic", "comparative"), "multi_index_needed")
        .when(F.col("expected_route") == "procedural", "chunking_issue")
        .when(F.col("type").isin("terminology", "technology"), "vocabulary_mismatch")
        .otherwise("chunking_issue")
    )


def missed(details: DataFrame, at: int = 10) -> DataFrame:
    return details.filter(F.col("hit_rank").isNull() | (F.col("hit_rank") > at)).withColumn("reason", failure_reason())


def failure_reasons(details: DataFrame) -> DataFrame:
    """Count and share per reason, every reason listed."""
    counts = missed(details).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    listed = details.sparkSession.createDataFrame([(r,) for r in fixed.FAILURE_REASONS], "reason string")
    full = listed.join(counts, "reason", "left").na.fill(0, ["n"])
    return full.withColumn("pct", F.coalesce(F.try_divide(F.col("n") * 100.0, total.cast("double")), F.lit(0.0)))


def failure_sample(details: DataFrame, n: int = 50, per_reason: int = 10, seed: int = 42) -> DataFrame:
    """Seeded sample of the misses, then a few per reason; the digest of seed and id makes the order repeatable."""
    order = F.sha2(F.concat_ws("::", F.lit(str(seed)), F.col("query_id")), 256)
    sampled = missed(details).withColumn("_h", order).orderBy("_h", "query_id").limit(n)
    return top_per_group(sampled, ["reason"], [F.col("_h"), F.col("query_id")], per_reason).drop("_h")


def by_type(details: DataFrame) -> DataFrame:
    return details.groupBy(F.coalesce(F.col("type"), F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(reciprocal_rank()).alias("mrr"),
        _recall(5).alias("recall_at_5"),
        _recall(10).alias("recall_at_10"),
    )


def precision_at_k(ranked: DataFrame, expected: DataFrame, k: int, questions: DataFrame | None = None) -> DataFrame:
    """Expected items among the first k, divided by k even when fewer came back.

    One row for each of ``questions`` (all that have expected or ranked items, if not given); without results it scores 0.
    """
    asked = questions if questions is not None else expected.select("query_id").union(ranked.select("query_id"))
    e = expected.select("query_id", "item").distinct()
    hits = ranked.filter(F.col("rank") <= k).join(e, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    scored = asked.select("query_id").distinct().join(hits, "query_id", "left")
    return scored.select("query_id", (F.coalesce("_n", F.lit(0)) / F.lit(float(k))).alias("precision"))


def faithfulness(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of claims judged ``yes`` per answer; an answer without claims scores one."""
    yes = F.lower(F.trim(F.coalesce(F.col("verdict"), F.lit("")))).startswith("yes").cast("double")
    per = verdicts.groupBy("query_id").agg(F.avg(yes).alias("faithfulness"))
    return samples.join(per, "query_id", "left").withColumn("faithfulness", F.coalesce("faithfulness", F.lit(1.0)))


def answer_relevancy(samples: DataFrame, generated: DataFrame, per_answer: int = 3) -> DataFrame:
    """Mean cosine of a question with the questions generated from its answer; none scores zero.

    ``generated``: query_id, pos, embedding, all unit vectors as are the samples'.
    """
    from fieldglass.functions.vectors import dot

    kept = generated.filter(F.col("pos") < per_answer).select("query_id", F.col("embedding").alias("_g"))
    per = (
        kept.join(samples.select("query_id", "embedding"), "query_id")
        .groupBy("query_id")
        .agg(F.avg(dot(F.col("embedding"), F.col("_g"))).alias("answer_relevancy"))
    )
    return samples.join(per, "query_id", "left").withColumn(
        "answer_relevancy", F.coalesce("answer_relevancy", F.lit(0.0))
    )


def resume_pending(items: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Items whose id is not in the output yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")
