"""Distribution distances and vector helpers as Column expressions.

Short sums over a known number of bins are written out term by term, which keeps
them inside generated code. Where written-out terms would repeat long
expressions, lambdas over arrays keep the generated code small instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldglass.functions.text import let

METHODS = ("jensenshannon", "wasserstein", "euclidean")


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _number(col: Column) -> Column:
    """Missing and NaN count as zero."""
    return F.nanvl(F.coalesce(col.cast("double"), F.lit(0.0)), F.lit(0.0))


def row_distribution(bins: list[Column]) -> Column:
    """Bins scaled to sum one; a row without positive mass is returned as it is."""
    values = [_number(b) for b in bins]
    mass = _total(values)
    return F.array(*[F.when(mass > 0, v / mass).otherwise(v) for v in values])


def _items(arr: Column, n: int) -> list[Column]:
    return [F.get(arr, F.lit(i)) for i in range(n)]


def array_mass(arr: Column, n: int | None = None) -> Column:
    if n is not None:
        return _total(_items(arr, n))
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def _scaled(arr: Column) -> Column:
    """Entries divided by their sum, which is computed once."""
    return let(array_mass(arr), lambda mass: F.transform(arr, lambda x: x / mass))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, natural logarithm, inputs rescaled to one."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))

    def term(x: Column, y: Column) -> Column:
        return let((x + y) / 2.0, lambda m: part(x, m) + part(y, m))

    def distance(pair: Column) -> Column:
        total = F.aggregate(F.zip_with(pair["p"], pair["q"], term), F.lit(0.0), lambda a, t: a + t)
        return F.sqrt(F.greatest(total / 2.0, F.lit(0.0)))

    return let(F.struct(_scaled(p).alias("p"), _scaled(q).alias("q")), distance)


def wasserstein_values(p: Column, q: Column) -> Column:
    """First Wasserstein distance of two equal-length arrays taken as samples."""
    diffs = F.zip_with(F.sort_array(p), F.sort_array(q), lambda a, b: F.abs(a - b))
    return F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x) / F.size(p)


def wasserstein_histogram(p: Column, q: Column, n: int) -> Column:
    """First Wasserstein distance of two histograms over the bin positions 0..n-1."""
    sp, sq = array_mass(p, n), array_mass(q, n)
    steps, cum = [], F.lit(0.0)
    for a, b in list(zip(_items(p, n), _items(q, n)))[:-1]:
        cum = cum + a / sp - b / sq
        steps.append(F.abs(cum))
    return _total(steps)


def euclidean(p: Column, q: Column, n: int) -> Column:
    return F.sqrt(_total([(a - b) * (a - b) for a, b in zip(_items(p, n), _items(q, n))]))


def distribution_change(current: Column, baseline: Column, n: int, method: str = "jensenshannon") -> Column:
    """Distance of two bin arrays, zero when either has no mass."""
    if method == "jensenshannon":
        score = js_distance(current, baseline)
    elif method == "wasserstein":
        score = wasserstein_values(current, baseline)
    elif method == "euclidean":
        score = euclidean(current, baseline, n)
    else:
        raise ValueError(f"unknown method: {method}")
    empty = (array_mass(current, n) == 0) | (array_mass(baseline, n) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(score)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector is returned unchanged."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def _finite(x: Column) -> Column:
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def clean_dense(a: Column) -> Column:
    """Drop missing, NaN and infinite entries."""
    return F.transform(F.filter(a, _finite), lambda x: x.cast("double"))


def clean_sparse(m: Column) -> Column:
    """Drop map entries whose weight is missing, NaN or infinite."""
    return F.map_filter(m, lambda _, v: _finite(v))
