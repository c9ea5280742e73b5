"""Question routing: ordered pattern rules, class centroids, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.operators.retrieval import nearest_centroid


def _result(route: str, confidence: float, entity: str | None = None, value: Column | None = None) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(
        F.lit(route).alias("route"),
        F.lit(confidence).alias("confidence"),
        F.lit("regex").alias("layer"),
        text(F.lit(entity) if entity else None).alias("entity"),
        text(value).alias("value"),
    )


def rule_route(query: Column) -> Column:
    """First rule that matches as struct (route, confidence, layer, entity, value), null when none does."""
    part = lambda pattern, i: F.regexp_extract(query, pattern, i)
    lookup = "structured_lookup"
    rules = [
        (fixed.ALARM_CODE, _result(lookup, 1.0, "alarm_code", F.upper(part(fixed.ALARM_CODE, 0)))),
        (fixed.ALARM_WORD, _result(lookup, 1.0, "alarm_code", F.concat(F.lit("ALM-"), part(fixed.ALARM_WORD, 1)))),
        (fixed.MO_NAME, _result(lookup, 1.0, "mo_name", part(fixed.MO_NAME, 1))),
        (fixed.COUNTER_GROUP, _result(lookup, 1.0, "mid_group_id", part(fixed.COUNTER_GROUP, 1))),
        (fixed.COUNTER_NAME, _result(lookup, 0.95, "counter_name", part(fixed.COUNTER_NAME, 1))),
        (fixed.COMPARATIVE, _result("comparative", 0.85)),
        (fixed.PROCEDURAL, _result("procedural", 0.85)),
        (fixed.DIAGNOSTIC, _result("diagnostic", 0.85)),
        (fixed.NUMERIC_LOOKUP, _result(lookup, 0.85)),
        (fixed.DEFINITION, _result("definition_explain", 0.8)),
        (
            fixed.SPEC_REFERENCE,
            _result(
                "definition_explain",
                0.7,
                "spec_number",
                F.concat_ws(".", part(fixed.SPEC_REFERENCE, 1), part(fixed.SPEC_REFERENCE, 2)),
            ),
        ),
        (fixed.PARAM_NAME, _result(lookup, 0.9, "param_name", part(fixed.PARAM_NAME, 1))),
    ]
    return F.coalesce(*[F.when(query.rlike(pattern), result) for pattern, result in rules])


def route_questions(
    questions: DataFrame,
    centroids: DataFrame | None = None,
    query: str = "query",
    vector: str = "embedding",
    threshold: float = fixed.CENTROID_THRESHOLD,
) -> DataFrame:
    """Layered routing in one pass. Only questions the rules leave open carry a vector to the centroids."""
    ruled = questions.withColumn("_r", rule_route(F.col(query)))
    sure = F.coalesce(F.col("_r.confidence") >= fixed.RULE_THRESHOLD, F.lit(False))
    if centroids is None:
        near = ruled.withColumn("best_label", F.lit(None).cast("string")).withColumn("best_score", F.lit(None).cast("double"))
    else:
        near = nearest_centroid(ruled.withColumn("_v", F.when(~sure, F.col(vector))), centroids, "_v")
    hit = ~sure & F.coalesce(F.col("best_score") >= threshold, F.lit(False))
    by = lambda rule, label, other: F.when(sure, rule).when(hit, label).otherwise(other)
    return near.select(
        *questions.columns,
        by(F.col("_r.route"), F.col("best_label").cast("string"), "default_rag").alias("route"),
        by(F.col("_r.confidence"), F.col("best_score"), F.lit(0.0)).alias("confidence"),
        by(F.col("_r.layer"), F.lit("embedding"), "fallback").alias("layer"),
        F.when(sure, F.col("_r.entity")).alias("entity"),
        F.when(sure, F.col("_r.value")).alias("value"),
    )


def doc_types(route: Column, entity: Column) -> Column:
    """Document types to search for a route; a structured route with a known entity searches one."""
    by_entity = F.coalesce(
        *[F.when(entity == name, F.array(F.lit(doc))) for name, doc in fixed.ENTITY_DOC_TYPES.items()]
    )
    by_route = F.coalesce(
        *[F.when(route == r, F.array(*[F.lit(d) for d in docs])) for r, docs in fixed.ROUTE_DOC_TYPES.items()],
        F.array(*[F.lit(d) for d in fixed.UNKNOWN_ROUTE_DOC_TYPES]),
    )
    return F.coalesce(F.when(route == "structured_lookup", by_entity), by_route)


def doc_types_of_entities(route: Column, entities: Column) -> Column:
    """The same for a map of entities: alarm code before parameter name before object name."""
    first = F.coalesce(*[F.when(F.map_contains_key(entities, F.lit(n)), F.lit(n)) for n in fixed.ENTITY_DOC_TYPES])
    return doc_types(route, first)
