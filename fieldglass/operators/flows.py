"""Packet flows: filters, inter-arrival times and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import clock_seconds
from fieldglass.operators.ordered import equal_depth, previous_row


def parse_packet_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Packet summary lines to columns; other lines are dropped, the remaining columns stay."""
    part = lambda i: F.regexp_extract(F.col(column), fixed.PACKET_LINE, i)
    return (
        lines.filter(F.col(column).rlike(fixed.PACKET_LINE))
        .select(
            *[c for c in lines.columns if c != column],
            F.nullif(part(1), F.lit("")).try_cast("long").alias("no"),
            clock_seconds(part(2)).alias("time_s"),
            part(6).try_cast("long").alias("size"),
            part(3).alias("src"),
            part(4).alias("dst"),
        )
    )


def filter_flow(packets: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Keep one direction; without both ends everything is kept."""
    if src and dst:
        return packets.filter((F.col("src") == src) & (F.col("dst") == dst))
    return packets


def interarrival(
    packets: DataFrame, keys: list[str], order: list[str], slice_col: Column | None = None, time_col: str = "time_s"
) -> DataFrame:
    """Microseconds since the packet before in the same flow, with the wrap at midnight; first is null.

    Without ``slice_col`` flows are cut into ranges of equal depth, whatever their share of the packets.
    """
    if slice_col is None:
        packets, slice_col = equal_depth(packets, keys, order, "_range"), F.col("_range")
    paired = previous_row(packets, keys, order, [time_col], slice_col).drop("_range")
    t, before = F.col(time_col), F.col(f"prev.{time_col}")
    delta = t - before + F.when(t < before, F.lit(float(fixed.DAY_SECONDS))).otherwise(F.lit(0.0))
    return paired.withColumn("delta_us", F.round(delta * 1e6, 3)).drop("prev")


def flow_statistics(deltas: DataFrame, keys: list[str]) -> DataFrame:
    return deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched"),
        F.count("delta_us").alias("deltas"),
        F.min("delta_us").alias("min_delta"),
        F.max("delta_us").alias("max_delta"),
        F.avg("delta_us").alias("mean_delta"),
        F.sum("size").alias("total_bytes"),
        F.min("size").alias("min_bytes"),
        F.max("size").alias("max_bytes"),
        F.avg("size").alias("mean_bytes"),
    )


def packet_csv_columns(deltas: DataFrame) -> DataFrame:
    """Text columns in the fixed formats of the packet export; missing values are empty."""
    text = lambda c, f: F.coalesce(F.format_string(f, F.col(c)), F.lit(""))
    return deltas.select(
        F.coalesce(F.col("no").cast("string"), F.lit("")).alias("no"),
        text("time_s", "%.6f").alias("time_s"),
        F.when(F.col("delta_us").isNull(), "").otherwise(F.format_string("%.3f", F.col("delta_us"))).alias("delta_us"),
        F.col("size").cast("string").alias("size"),
    )
