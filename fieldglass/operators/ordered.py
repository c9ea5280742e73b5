"""Ordered computations that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts every row of one key in one
task. Here each key is first cut into *slices* of its order (a day, a block of
turns, a value range). Rows are windowed inside ``(key, slice)``; what crosses a
slice border (the last row, the total so far) is a summary of one row per slice,
and only those summaries are windowed over the whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.session import cut_lineage


def time_slice(ts: str | Column, grain: str = "day") -> Column:
    return F.date_trunc(grain, ts)


def number_slice(value: str | Column, width: int) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.floor(col / F.lit(width))


def equal_depth(df: DataFrame, keys: list[str], order: list[str], out: str = "slice", at: str | None = None) -> DataFrame:
    """Rows sorted into ranges of about as many rows each, the range's number added as ``out``.

    Spark's range exchange draws the borders from a sample over key and order, so a key of all rows is cut as
    evenly as many small ones. ``at`` adds the 0-based place inside the range. The sorted rows are written, as
    a second sample could draw other borders.
    """
    number = F.monotonically_increasing_id()  # partition number above 33 bits of row number
    numbered = cut_lineage(df.orderBy(*keys, *order).withColumn(out, number))
    place = [F.col(out).bitwiseAND(F.lit((1 << 33) - 1)).alias(at)] if at else []
    return numbered.select(*df.columns, F.shiftright(out, 33).alias(out), *place)


def positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """1-based position of every row in the order of all rows: place in its range, plus the rows of earlier ranges.

    Rows are sorted once and only the ranges' counts are added up. ``order`` has to tell rows apart for the
    positions to be the same in every run.
    """
    placed = equal_depth(df, [], order, "_slice", "_at")
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(before, "_slice")
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(out))


def _sliced(df: DataFrame, keys: list[str], slice_col: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows with their key packed as ``_k`` and their slice.

    A struct is equal to itself also where a key is null, so the same columns
    serve the windows and the join below and one shuffle is enough for both.
    """
    added = [expr.alias(name) for name, expr in (extra or {}).items()]
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.struct(*keys).alias("_k"), slice_col.alias("_slice"), *rest, *added)


def running_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_col: Column,
    totals: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    previous: list[str] | None = None,
    out: str = "prev",
) -> DataFrame:
    """Add values that depend on the rows before, all from one pass over the sorted rows.

    ``totals``: inclusive running sums. ``lasts``: last non-null value up to and
    including the row. ``previous``: these columns of the row before as struct
    ``out``, null on a key's first row.
    """
    totals, lasts, previous = totals or {}, lasts or {}, previous or []
    values = {**totals, **lasts}
    sliced = _sliced(df, keys, slice_col, {f"_v_{n}": e for n, e in values.items()})
    at = F.struct(*order)
    ordered = Window.partitionBy("_k", "_slice").orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    slices = Window.partitionBy("_k").orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)

    last_of = lambda n: F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at))
    summary = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals] + [last_of(n).alias(f"_t_{n}") for n in lasts]
    carried = [F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in totals]
    carried += [F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts]
    here = [F.sum(f"_v_{n}").over(so_far).alias(n) for n in totals]
    here += [F.last(f"_v_{n}", ignorenulls=True).over(so_far).alias(n) for n in lasts]
    if previous:
        row = F.struct(*previous)
        summary.append(F.max_by(row, at).alias("_t_row"))
        carried.append(F.lag("_t_row").over(slices).alias("_c_row"))
        here += [F.lag(row).over(ordered).alias(out), (F.row_number().over(ordered) == 1).alias("_first")]

    carry = sliced.groupBy("_k", "_slice").agg(*summary).select("_k", "_slice", *carried)
    # rows without an order value form the first slice of their key, which carries nothing in
    stitched = sliced.select("*", *here).join(carry, ["_k", "_slice"], "left")
    result = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in totals}
    result |= {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in lasts}
    if previous:
        result[out] = F.when(F.col("_first"), F.col("_c_row")).otherwise(F.col(out))
    key = {k: F.col(f"_k.{k}") for k in keys}
    return stitched.select(
        *[key.get(c, F.col(c)).alias(c) for c in df.columns], *[e.alias(n) for n, e in result.items()]
    )


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], slice_col: Column, out: str = "prev"
) -> DataFrame:
    """Add struct ``out`` with ``values`` of the row before, null on a key's first row."""
    return running_values(df, keys, order, slice_col, previous=values, out=out)


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column], slice_col: Column
) -> DataFrame:
    """Add one inclusive running sum per entry of ``totals``."""
    return running_values(df, keys, order, slice_col, totals=totals)


def running_last(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], slice_col: Column
) -> DataFrame:
    """Add, per entry of ``values``, its last non-null value up to and including the row."""
    return running_values(df, keys, order, slice_col, lasts=values)


#: Parts a bracket is cut into in one round of ``order_statistics``.
BRACKET_PARTS = 64


def brackets(
    df: DataFrame,
    keys: list[str],
    value: str,
    picks: dict[str, tuple[float, list[Column]]],
    accuracy: int = 10_000,
    sorted_rows: int = 100_000,
) -> DataFrame:
    """Distinct values around the wanted positions: ``(_k, n, _before, _x, _c)``.

    ``_before`` counts a group's rows below the bracket a value lies in and names the bracket; ``_c`` counts
    the value's rows. No bracket holds more than ``sorted_rows`` distinct values: larger ones are cut again
    at quantiles of their own values, and only parts that hold a wanted position stay.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(value).alias("_x"))
    margin = 4.0 / accuracy
    probs = sorted({min(max(q + d, 0.0), 1.0) for q, _ in picks.values() for d in (-margin, margin)})
    counts = rows.groupBy("_k", "_x").agg(F.count(F.lit(1)).alias("_c"))
    bounds = rows.groupBy("_k").agg(F.percentile_approx("_x", probs, accuracy).alias("_b"), F.count(F.lit(1)).alias("n"))
    near = _wanted_parts(counts.join(bounds, "_k").withColumn("_before", F.lit(0).cast("long")), picks)
    steps = [i / BRACKET_PARTS for i in range(1, BRACKET_PARTS)]
    while (near.agg(F.max("_d").alias("d")).head()["d"] or 0) > sorted_rows:
        cuts = near.groupBy("_k", "_before").agg(F.percentile_approx("_x", steps, 10_000).alias("_b"))
        near = _wanted_parts(near.drop("_d").join(cuts, ["_k", "_before"]), picks)
    return near.drop("_d")


def _wanted_parts(rows: DataFrame, picks: dict[str, tuple[float, list[Column]]]) -> DataFrame:
    """Cut brackets at ``_b`` and keep the parts that hold a position, with their number of values ``_d``."""
    placed = rows.withColumn("_slice", F.size(F.filter("_b", lambda b: b < F.col("_x")))).drop("_b")
    part = ["_k", "_before", "_slice"]
    earlier = Window.partitionBy("_k", "_before").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*part, "n").agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_d"))
    totals = totals.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
    positions = [p for _, ps in picks.values() for p in ps]
    holds = reduce(lambda x, y: x | y, [_inside(p, F.col("_start"), F.col("_t")) for p in positions])
    hit = totals.filter(holds).select(*part, "_start", "_d")
    return cut_lineage(placed.join(hit, part).select("_k", "n", F.col("_start").alias("_before"), "_x", "_c", "_d"))


def _inside(position: Column, low: Column, count: Column) -> Column:
    return (position >= low) & (position < low + count)


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    picks: dict[str, tuple[float, list[Column]]],
    accuracy: int = 10_000,
    sorted_rows: int = 100_000,
) -> DataFrame:
    """Exact values at given 0-based positions of each group's sorted values.

    ``picks`` maps an output name to the quantile it is near and to position
    expressions over ``n`` (the group's count); several positions are averaged.

    ``brackets`` narrows each group to at most ``sorted_rows`` distinct values around a position, and only
    those are sorted together. The brackets decide how much is sorted, never the result.
    """
    near = brackets(df, keys, value, picks, accuracy, sorted_rows)
    upto = Window.partitionBy("_k", "_before").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ends = near.withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
    at = lambda p: F.max(F.when(_inside(p, F.col("_end") - F.col("_c"), F.col("_c")), F.col("_x")))
    aggs = [
        (reduce(lambda x, y: x + y, [at(p) for p in ps]) / F.lit(len(ps))).alias(name) for name, (_, ps) in picks.items()
    ]
    found = ends.groupBy("_k").agg(F.max("n").alias("n"), *aggs)
    return found.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", *picks)


def median_position() -> tuple[float, list[Column]]:
    """True median: the mean of the two middle values."""
    return 0.5, [F.expr("(n - 1) div 2"), F.expr("n div 2")]


def upper_median_position() -> tuple[float, list[Column]]:
    return 0.5, [F.expr("n div 2")]


def quantile_position(q: float) -> tuple[float, list[Column]]:
    """Position ``int(n * q)``."""
    return q, [F.floor(F.col("n") * F.lit(float(q)))]


#: Largest k for which Spark limits a window's rows before its shuffle.
MAP_SIDE_K = 1000


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """First ``k`` rows per key.

    Spark keeps at most ``k`` per key in each map task before the shuffle, up to a ``k`` of
    ``MAP_SIDE_K``. Beyond it each key is dealt to ``salts`` parts that are cut to k first.
    """
    cut = df
    if k > MAP_SIDE_K:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if not df.schema[c].dataType.typeName() == "map"]), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        cut = salted.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= k).drop("_salt", rank)
    w = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order`` as a combinable aggregate."""
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: list[str], by, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)
