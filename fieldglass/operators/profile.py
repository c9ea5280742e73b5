"""Dataset profile: size, text lengths, moments, correlations, outliers, recommendation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass import fixed_values as fixed
from fieldglass.operators.ordered import positions
from fieldglass.session import scalar_of, union_all


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def present(col: Column) -> Column:
    """Value as double, NaN turned into null as the profile treats both as missing."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def size_category(count: Column) -> Column:
    return (
        F.when(count > fixed.SIZE_LARGE, "Large").when(count > fixed.SIZE_MEDIUM, "Medium").otherwise("Small")
    )


def dataset_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("size_category", size_category(F.col("row_count")))


def text_lengths(df: DataFrame, column: str = "text") -> DataFrame:
    n = F.length(F.coalesce(F.col(column).cast("string"), F.lit("")))
    stats = df.agg(
        F.avg(n).alias("avg_length"),
        F.max(n).cast("long").alias("max_length"),
        F.min(n).cast("long").alias("min_length"),
        F.stddev_samp(n).alias("length_std"),
    )
    return stats.withColumn(
        "variance_ratio", F.when(F.col("avg_length") > 0, F.col("length_std") / F.col("avg_length")).otherwise(0.0)
    )


def _sample_skewness(x: Column, n: Column) -> Column:
    g1 = F.skewness(x)
    scaled = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n > 2, F.when(F.stddev_samp(x) == 0, 0.0).otherwise(scaled))


def _sample_kurtosis(x: Column, n: Column) -> Column:
    g2 = F.kurtosis(x)
    scaled = F.try_divide((n - 1), (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.when(F.stddev_samp(x) == 0, 0.0).otherwise(scaled))


def distribution(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column from a single pass: mean, deviation, skew, excess kurtosis, normality."""
    columns = columns or numeric_columns(df)
    packed = []
    for c in columns:
        x = present(F.col(c))
        n = F.count(x).cast("double")
        packed.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                _sample_skewness(x, n).alias("skewness"),
                _sample_kurtosis(x, n).alias("kurtosis"),
            )
        )
    rows = df.agg(F.array(*packed).alias("s")).select(F.inline("s"))
    enough = F.col("n") >= 2
    # a comparison with a missing skew or kurtosis counts as false
    normal = F.coalesce(
        (F.abs("skewness") < fixed.NORMAL_SKEW) & (F.abs("kurtosis") < fixed.NORMAL_KURTOSIS), F.lit(False)
    )
    return rows.select(
        "column",
        "n",
        *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "std", "skewness", "kurtosis")],
        F.when(enough, normal).alias("is_likely_normal"),
        F.when(~enough, "Not enough data").alias("error"),
    )


def strong_correlations(
    df: DataFrame, columns: list[str] | None = None, threshold: float = fixed.STRONG_CORRELATION
) -> DataFrame:
    """Column pairs whose Pearson correlation over complete pairs reaches the threshold.

    One pass: each row is unfolded into its pairs, which are summed up per pair
    before anything is shuffled.
    """
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    clean = df.select(*[present(F.col(c)).alias(c) for c in columns])
    packed = [F.struct(F.lit(i).alias("i"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)]
    long = clean.select(F.inline(F.array(*packed))).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    strong = long.groupBy("i").agg(r.alias("correlation")).filter(F.abs("correlation") >= threshold)
    name = lambda side: F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("i"))
    return strong.select(name(1).alias("col1"), name(0).alias("col2"), "correlation")


def outliers(df: DataFrame, columns: list[str] | None = None, threshold: float = fixed.OUTLIER_Z) -> DataFrame:
    """Rows beyond ``threshold`` sample deviations per column: statistics, then one counting pass."""
    columns = columns or numeric_columns(df)
    stats = scalar_of(
        df,
        *[F.avg(present(F.col(c))).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(present(F.col(c))).alias(f"s_{c}") for c in columns],
    )
    packed = []
    for c in columns:
        x = present(F.col(c))
        mean, std = stats[f"m_{c}"], stats[f"s_{c}"]
        beyond = (std > 0) & (F.abs(F.try_divide(x - mean, std)) > threshold)
        packed.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.coalesce(F.sum(beyond.cast("long")), F.lit(0)).alias("outlier_count"),
            )
        )
    rows = df.agg(F.array(*packed).alias("s")).select(F.inline("s")).filter(F.col("n") >= 2)
    return rows.select("column", "outlier_count", (F.col("outlier_count") / F.col("n")).alias("outlier_ratio"))


def recommendation(df: DataFrame, text_column: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Report rows ``(kind, subject, value)``: training strategy by size, text spread and skew, and the reasons."""
    dist, out = distribution(df, columns), outliers(df, columns)
    size = dataset_size(df)
    strategy = (
        F.when(F.col("row_count") < fixed.SIZE_MEDIUM, "transfer")
        .when(F.col("row_count") <= fixed.SIZE_LARGE, "lora")
        .otherwise("full")
    )
    parts = [
        size.select(F.lit("strategy").alias("kind"), strategy.alias("subject"), F.col("row_count").cast("double").alias("value")),
        dist.filter((F.abs("skewness") > fixed.REASON_SKEW) & ~F.col("is_likely_normal")).select(
            F.lit("reason_skew").alias("kind"), F.col("column").alias("subject"), F.col("skewness").alias("value")
        ),
        out.filter(F.col("outlier_ratio") > fixed.REASON_OUTLIER_RATIO).select(
            F.lit("reason_outliers").alias("kind"), F.col("column").alias("subject"), F.col("outlier_ratio").alias("value")
        ),
        dist.agg(
            F.coalesce(F.sum((F.abs("skewness") > fixed.CONTINUAL_SKEW).cast("double")), F.lit(0.0)).alias("value")
        )
        .filter(F.col("value") > 0)
        .select(F.lit("strategy").alias("kind"), F.lit("continual").alias("subject"), "value"),
    ]
    if text_column:
        parts.append(
            text_lengths(df, text_column)
            .filter(F.col("variance_ratio") > fixed.CURRICULUM_RATIO)
            .select(F.lit("strategy").alias("kind"), F.lit("curriculum").alias("subject"), F.col("variance_ratio").alias("value"))
        )
    return union_all(parts)


def curriculum_order(df: DataFrame, text_column: str = "text", tie: str | None = None, position: str | None = None) -> DataFrame:
    """Shortest text first: a range-partitioned global sort; null is as short as empty.

    ``position`` adds each row's 1-based place as a column, so that the order outlives a later shuffle.
    """
    length = F.length(F.coalesce(F.col(text_column), F.lit("")))
    order = ["_length", *([tie] if tie else [])]
    if position is None:
        return df.withColumn("_length", length).orderBy(*order).drop("_length")
    return positions(df.withColumn("_length", length), order, position).drop("_length")
