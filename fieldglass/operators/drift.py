"""Distribution drift between consecutive rows of a keyed time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import vectors
from fieldglass.operators.ordered import previous_row, time_slice
from fieldglass.operators.profile import numeric_columns

AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def aggregate_time_rows(df: DataFrame, keys: list[str], how: str | list[str] = "mean", columns: list[str] | None = None) -> DataFrame:
    """One row per time (and entity): the chosen aggregate of every numeric column; null keys are dropped.

    Several aggregates come from the same pass, as columns named ``<aggregate>_<column>``.
    """
    chosen = [how] if isinstance(how, str) else how
    for name in chosen:
        if name not in AGGREGATES:
            raise ValueError(f"unsupported aggregate: {name}")
    columns = columns or [c for c in numeric_columns(df) if c not in keys]
    clean = df.dropna(subset=keys)
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    label = (lambda name, c: c) if isinstance(how, str) else "{}_{}".format
    return clean.groupBy(*keys).agg(*[AGGREGATES[name](value(c)).alias(label(name, c)) for name in chosen for c in columns])


def drift_scores(
    df: DataFrame,
    keys: list[str],
    time_col: str,
    bins: list[str],
    method: str = "jensenshannon",
    how: str = "mean",
    slice_grain: str = "month",
) -> DataFrame:
    """Score of each time step against the step before, per entity; the first step scores zero.

    An empty histogram scores zero and still becomes the next baseline. Rows
    arrive pre-aggregated per time step, then only slices of one entity are
    sorted together.
    """
    n = len(bins)
    steps = aggregate_time_rows(df, [*keys, time_col], how, bins).select(
        *keys, time_col, vectors.row_distribution([F.col(b) for b in bins]).alias("dist")
    )
    paired = previous_row(steps, keys, [time_col], ["dist"], time_slice(time_col, slice_grain))
    base = F.col("prev.dist")
    score = F.when(base.isNull(), F.lit(0.0)).otherwise(
        vectors.distribution_change(F.col("dist"), base, n, method)
    )
    return paired.select(*keys, time_col, score.alias("score"))
