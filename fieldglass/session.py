"""Session helpers: builder, lineage cutting, unions and scalars."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "fieldglass", cores: str = "*", shuffle_partitions: int = 8, checkpoints: str | None = None) -> SparkSession:
    """Local session for tests and benchmarks, with its checkpoint folder; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    if checkpoints is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: on a cluster
    the executors could not read it back.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage so that loops keep short plans."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_down(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: unlike a checkpoint it has a size, so that Spark can broadcast it while it is small."""
    path = f"{checkpoint_folder(df.sparkSession)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def scalar_of(df: DataFrame, *columns) -> "F.Column":
    """One-row aggregate as a scalar subquery (a struct), so that no join is needed."""
    return df.agg(F.struct(*columns).alias("s")).scalar()


def release_memory() -> None:
    """Give freed memory back to the system; a Python worker lives on between tasks and stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
