"""Stores as tables: run documents, replace-by-source and keyed upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.ordered import last_per_key
from fieldglass.session import cut_lineage

RUN_SCHEMA = """exec_id long, timestamp string, mode string, mock boolean, dummy boolean,
    params map<string,string>, summary struct<totals: struct<tokens: long, wire_bytes: long>>"""


def run_documents(calls: DataFrame, run: str = "run_id", mode: str = "caching") -> DataFrame:
    """One JSON document per run: parameters and totals, as the run store keeps them."""
    totals = calls.groupBy(F.col(run).alias("exec_id")).agg(
        F.sum("total_tokens").alias("tokens"), F.sum(F.col("wire_sent") + F.col("wire_recv")).alias("wire_bytes")
    )
    doc = totals.select(
        "exec_id",
        F.lit("").alias("timestamp"),
        F.lit(mode).alias("mode"),
        F.lit(False).alias("dummy"),
        F.create_map(F.lit("mode"), F.lit(mode)).alias("params"),
        F.struct(F.struct("tokens", "wire_bytes").alias("totals")).alias("summary"),
    )
    return doc.select(F.to_json(F.struct("*")).alias("value"))


def write_runs(documents: DataFrame, path: str) -> None:
    documents.select("value").write.mode("append").text(path)


def read_runs(spark, path: str) -> DataFrame:
    return spark.read.text(path)


def runs_by_time(listed: DataFrame) -> DataFrame:
    return listed.orderBy("timestamp", "exec_id")


def list_runs(documents: DataFrame) -> DataFrame:
    """Projection of id, time, mode, flags and totals; absent flags count as false."""
    d = documents.select(F.from_json("value", RUN_SCHEMA).alias("d"))
    return d.select(
        "d.exec_id",
        "d.timestamp",
        "d.mode",
        F.coalesce("d.mock", F.lit(False)).alias("mock"),
        F.coalesce("d.dummy", F.lit(False)).alias("dummy"),
        F.col("d.summary.totals").alias("totals"),
    )


def replace_by_source(existing: DataFrame, incoming: DataFrame, source: str = "source_doc") -> DataFrame:
    """Rows of every incoming source replace the rows stored for it."""
    kept = existing.join(incoming.select(source).distinct(), source, "left_anti")
    return kept.unionByName(incoming)


def write_replacing(incoming: DataFrame, path: str, partitions: list[str]) -> None:
    """The same on files: only the partitions present in ``incoming`` are rewritten."""
    (
        incoming.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def replace_in_buckets(incoming: DataFrame, path: str, source: str, buckets: int) -> None:
    """Replace-by-source on files without a folder per source.

    Rows are stored by a hash bucket of their source. Only buckets that receive
    rows are read, merged and rewritten; the merge is written down first because
    a folder cannot be overwritten while it is read. Running the same call again
    leaves the same rows.
    """
    new = incoming.withColumn("bucket", F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int"))
    try:
        stored = incoming.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = new
    else:
        touched = stored.join(new.select("bucket").distinct(), "bucket", "left_semi")
        merged = cut_lineage(replace_by_source(touched, new, source))
    write_replacing(merged.repartition("bucket"), path, ["bucket"])


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write per key. Existing rows rank below every change; changes by ``version``."""
    old = existing.withColumn("_gen", F.lit(0)).withColumn("_v", F.lit(None).cast(changes.schema[version].dataType))
    new = changes.withColumn("_gen", F.lit(1)).withColumn("_v", F.col(version))
    both = old.unionByName(new, allowMissingColumns=True)
    return last_per_key(both, keys, ["_gen", "_v"]).drop("_gen", "_v")
