"""What several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.session import checkpoint_folder, release_memory

#: the six ASCII white space characters
BLANKS = " \t\n\x0b\x0c\r"
#: the same as a class for Java and RE2 patterns
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    The rows survive lost executors, later steps plan with their real size, and
    nothing is computed twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over a partition's batches, with its memory released at the end."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK_CLASS}+"), lambda w: w != "")


def text_key(text: Column) -> Column:
    """A 128-bit name of a text's content; null stays null."""
    return F.md5(text)


def crc32_sql(strings: str) -> str:
    """DuckDB tables for a WITH list: ``checksums`` (``s``, ``crc``) of the column ``s`` of the query ``strings``."""
    return f"""
    crc_steps AS (
        SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS step
        FROM (SELECT unnest(range(256)) AS n)),
    checksums AS (
        SELECT s, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS crc
        FROM ({strings}), crc_steps)"""
