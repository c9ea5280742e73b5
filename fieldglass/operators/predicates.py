"""Row filters as composed Column predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import strip


def entity_filter(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def all_of(clauses: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def edge_filter(min_confidence: float = 0.0, validated: bool | None = None) -> Column:
    clauses = [F.col("confidence") >= min_confidence]
    if validated is not None:
        clauses.append(F.col("validated") == validated)
    return all_of(clauses)


def node_filter(node_type: str | None = None) -> Column:
    return all_of([F.col("node_type") == node_type] if node_type else [])


def retrieval_filter(product: str | None = None, release: str | None = None, terms: list[str] | None = None) -> Column:
    """Product (``both`` means any), release, and at least one of the keywords."""
    clauses = []
    if product and product != "both":
        clauses.append(F.col("product") == product)
    if release:
        clauses.append(F.col("release") == release)
    if terms:
        clauses.append(F.arrays_overlap(F.col("keywords"), F.array(*[F.lit(t) for t in terms])))
    return all_of(clauses)


def generation_filter(column: str, generation: str) -> Column:
    col = F.col(column)
    return col.isNull() | col.isin(generation, "both")


def null_like(col: Column) -> Column:
    """Missing, or one of the words used for missing. An empty text is a value."""
    return col.isNull() | F.coalesce(F.lower(strip(col)).isin(*fixed.NULL_LIKE), F.lit(False))


def is_noise_term(col: Column) -> Column:
    return col.rlike(fixed.NOISE_TERM)


def mentions_any(text: Column, excluded: list[str]) -> Column:
    """Whether a text carries one of the excluded embedded ids."""
    ids = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({fixed.EMBEDDED_FEATURE_ID})"), 1)
    return F.arrays_overlap(ids, F.array(*[F.lit(e) for e in excluded])) if excluded else F.lit(False)


def exclude_documents(docs: DataFrame, excluded: DataFrame, text: str = "text", key: str = "feature_id") -> DataFrame:
    """Drop documents naming an excluded id. Works on an exclusion table of any size.

    Only documents that name an id are exploded; what is joined back is their ids.
    """
    doc_id = docs.columns[0]
    named = docs.select(
        doc_id, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({fixed.EMBEDDED_FEATURE_ID})"), 1))).alias(key)
    )
    hit = named.join(excluded.select(key).distinct(), key, "left_semi").select(doc_id).distinct()
    return docs.join(hit, doc_id, "left_anti")


def score_cut(df: DataFrame, threshold: float = fixed.RERANK_THRESHOLD, score: str = "score") -> DataFrame:
    return df.filter(F.col(score) >= threshold)
