"""A store of rows by source that is only appended to: versions, a manifest of sources, merge on read.

A version is a folder of rows and, written after it, a folder that lists its sources. Rows count
only if the newest list that names their source is that of their own version, so a version that
replaces one source writes that source's rows alone, and one that was interrupted has no list and
is not seen. A writer that comes back with the same name finds its version done. One writer works
on a store at a time. Sources may be null, and repeated rows stay.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, LISTS = "rows", "lists"


def _lists(spark: SparkSession, path: str) -> DataFrame | None:
    """``kind`` (source, removed, version), the source, ``writer`` and ``version`` of all complete versions; null before the first."""
    try:
        return spark.read.parquet(f"{path}/{LISTS}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def written_versions(spark: SparkSession, path: str) -> dict[str, int]:
    """Writer and number of every version, one small row each."""
    lists = _lists(spark, path)
    if lists is None:
        return {}
    return {r["writer"]: int(r["version"]) for r in lists.where("kind = 'version'").select("writer", "version").collect()}


def write_version(incoming: DataFrame, path: str, source: str, writer: str, removed: DataFrame | None = None) -> int:
    """Rows of ``incoming`` replace what is stored for their sources; sources of ``removed`` go. The version's number.

    Work grows with ``incoming``, not with the store. A version of the same ``writer`` is left as it is.
    """
    spark = incoming.sparkSession
    done = written_versions(spark, path)
    if writer in done:
        return done[writer]
    version = max(done.values(), default=-1) + 1
    folder = f"{path}/{ROWS}/version={version}"
    incoming.write.mode("overwrite").parquet(folder)  # what an interrupted writer left there is overwritten
    listed = spark.read.schema(incoming.schema).parquet(folder).select(source).distinct().select(F.lit("source").alias("kind"), source)
    if removed is not None:
        gone = removed.select(F.col(source).cast(incoming.schema[source].dataType)).distinct().join(listed.select(F.col(source).alias("_s")), F.col(source).eqNullSafe(F.col("_s")), "left_anti")
        listed = listed.unionByName(gone.select(F.lit("removed").alias("kind"), source))
    mark = spark.range(1).select(F.lit("version").alias("kind"), F.lit(None).cast(incoming.schema[source].dataType).alias(source))
    listed.unionByName(mark).withColumn("writer", F.lit(writer)).write.mode("overwrite").parquet(f"{path}/{LISTS}/version={version}")
    return version


def live_sources(spark: SparkSession, path: str, source: str, upto: int | None = None) -> DataFrame:
    """Every stored source with the version that holds its rows, as of version ``upto``."""
    lists = _lists(spark, path)
    if lists is None:
        raise ValueError(f"no version in {path}")
    seen = lists.where("kind != 'version'")
    if upto is not None:
        seen = seen.where(F.col("version") <= upto)
    newest = seen.groupBy(source).agg(F.max(F.struct("version", "kind")).alias("_n"))
    return newest.where("_n.kind = 'source'").select(source, F.col("_n.version").alias("version"))


def read_live(spark: SparkSession, path: str, source: str, upto: int | None = None) -> DataFrame:
    """The rows that count, from the folders of versions that still have some."""
    live = live_sources(spark, path, source, upto).select(F.col(source).alias("_source"), F.col("version").alias("_version"))
    numbers = sorted(int(r["_version"]) for r in live.select("_version").distinct().collect())  # as many as batches since the store was compacted
    stored = spark.read.option("basePath", f"{path}/{ROWS}")
    rows = stored.parquet(*[f"{path}/{ROWS}/version={n}" for n in numbers]) if numbers else stored.parquet(f"{path}/{ROWS}").where(F.lit(False))
    own = F.col(source).eqNullSafe(F.col("_source")) & (F.col("version") == F.col("_version"))
    return rows.join(live, own, "left_semi").drop("version")


def compact(spark: SparkSession, path: str, source: str) -> int:
    """Write all rows that count as one version and remove the folders of rows that no longer do."""
    last = max(written_versions(spark, path).values())
    version = write_version(read_live(spark, path, source), path, source, f"compaction after {last}")
    files = spark._jvm.org.apache.hadoop.fs.Path
    system = files(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in range(version):
        system.delete(files(f"{path}/{ROWS}/version={n}"), True)
    return version
