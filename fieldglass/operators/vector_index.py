"""A stored index for vector search: rows filed by their nearest coarse centroid, searched cell by cell.

Centroids come from a bounded sample; every usable row is filed. How many cells a search must probe for
a wanted recall is measured when the index is built: for sample rows taken as queries, the exact
neighbours are found and the places of their cells in the query's order of cells are counted. A
search joins its queries with their cells, so it reads the probed cells alone, as one partition of
the stored table each, and compares blocks of a cell as matrix products. More probes cost more and
miss less; ``retrieval.vector_top_k`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators.ordered import top_per_group
from fieldglass.operators.retrieval import COSINE_DIGITS, QUERY_BLOCK, _best_of_batch, _type_of, _unit_rows, usable_vector, vector_top_k
from fieldglass.session import cut_lineage, write_down

#: Rows that centroids are fitted on, rows taken as queries for the measured recall, and cells, at most about.
SAMPLE, QUESTIONS, MOST_CELLS = 20_000, 256, 4096
#: Rows of a cell that one task compares; larger cells are stored in parts.
PART_ROWS = 4096
ROUNDS = 8
#: Vectors of a batch that are compared with all centroids at once.
SLICE = 256


def coarse_centroids(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit vectors that the unit ``vectors`` gather around; a centroid without rows starts anew at the row served worst."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        dots = vectors @ centres.T
        own = dots.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        worst = iter(np.argsort(dots.max(axis=1)))
        for empty in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
            sums[empty] = vectors[next(worst)]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _cell_order(centres: np.ndarray, most: int) -> Callable:
    """Cells by falling similarity, the first ``most``."""
    @F.pandas_udf("array<int>")
    def order(vectors: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vectors), SLICE):
            dots = np.round(_unit_rows(vectors.iloc[at : at + SLICE]) @ centres.T, COSINE_DIGITS)
            best = dots.argmax(axis=1)[:, None] if most == 1 else np.argsort(-dots, axis=1, kind="stable")[:, :most]
            out.extend(best.astype(np.int32))
        return pd.Series(out, index=vectors.index, dtype=object)

    return order


def _picked(rows: DataFrame, key: str, wanted: int, count: int, salt: str) -> DataFrame:
    """About ``wanted`` of ``count`` rows, by a hash of their id."""
    scale = 1 << 20
    share = min(scale, -(-wanted * scale // max(1, count)))
    return rows.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(scale)) < share)


def build_index(items: DataFrame, path: str, item_id: str = "item_id", vector: str = "embedding", cells: int | None = None, k: int = 10, sample: int = SAMPLE, questions: int = QUESTIONS) -> None:
    """Store the index of ``items`` under ``path``: ``rows`` by cell, ``cells`` and the measured ``recall`` of each number of probes.

    Rows without a usable vector, or with another length than most, are left out. About the square root of the rows is
    the number of cells if none is given.
    """
    spark = items.sparkSession
    rows = items.select(F.col(item_id).alias("item_id"), F.col(vector).cast("array<double>").alias("v")).filter(usable_vector(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    if not sizes:
        raise ValueError("no usable vectors to index")
    dimensions, count = sizes[0]
    rows = rows.filter(F.size("v") == dimensions)
    cells = min(MOST_CELLS, max(1, round(count**0.5))) if cells is None else cells
    picked = _picked(rows, "item_id", sample, count, "fit").orderBy("item_id").select("v").collect() or rows.limit(sample).select("v").collect()
    centres = coarse_centroids(_unit_rows([r["v"] for r in picked]), cells)
    filed = rows.withColumn("cell", F.get(_cell_order(centres, 1)(F.col("v")), F.lit(0)))
    sized = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    vectors = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    vectors.join(sized, "cell", "left").write.mode("overwrite").parquet(f"{path}/cells")
    parts = spark.read.parquet(f"{path}/cells").select("cell", "parts")
    placed = filed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")).drop("parts")
    placed.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    # where the exact neighbours of some rows lie in the order in which those rows would probe the cells
    stored = spark.read.parquet(f"{path}/rows")
    asked = _picked(stored, "item_id", questions, count, "ask").select(F.col("item_id").alias("query_id"), F.col("v").alias("embedding"))
    true = vector_top_k(stored, asked, k, vector="v").join(stored.select("item_id", "cell"), "item_id")
    order = asked.select("query_id", _cell_order(centres, len(centres))("embedding").alias("order"))
    places = true.join(order, "query_id").groupBy(F.array_position("order", F.col("cell")).cast("int").alias("probes")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = np.zeros(len(centres) + 1)
    for probes, n in places:
        found[probes] = n
    share = np.cumsum(found) / max(1, found.sum()) if found.sum() else np.r_[0.0, np.ones(len(centres))]
    measured = [(p, float(share[p])) for p in range(1, len(centres) + 1)]
    spark.createDataFrame(measured, "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/recall")


def probes_for(spark: SparkSession, path: str, recall: float) -> int:
    """Fewest cells whose measured recall is at least ``recall``."""
    return spark.read.parquet(f"{path}/recall").where(F.col("recall") >= recall).agg(F.min("probes")).first()[0]


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, recall: float = 0.95, query_id: str = "query_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """Top-k by cosine among the rows of the probed cells: ``(query_id, item_id, score, rank)``, ties by item id.

    ``recall`` is the share of the true neighbours that is found on average, as measured when the index was built.
    """
    cells = spark.read.parquet(f"{path}/cells")
    table = cells.orderBy("cell").collect()  # at most MOST_CELLS rows
    centres = np.array([r["centroid"] for r in table])
    probes = probes_for(spark, path, recall) if probes is None else probes
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter(usable_vector(F.col("v"), F.lit(centres.shape[1])))
    probed = cut_lineage(asked.withColumn("cell", F.explode(_cell_order(centres, min(probes, len(centres)))("v"))))  # read by both sides of the search
    # the queries of each cell in blocks of their own, so that a part travels once for so many queries of its cell; a row for each cell
    blocks = write_down(probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")))
    right = probed.join(cells.select("cell", "parts"), "cell").join(blocks, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.withColumn("_j", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("query_id", "v", "cell", "part", "_j")
    rows = spark.read.parquet(f"{path}/rows")
    left = rows.join(blocks, "cell").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    schema = f"query_id {_type_of(queries, query_id)}, item_id {_type_of(rows, 'item_id')}, score double"

    def compare(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []}, dtype=object)
        scores = _unit_rows(mine["v"]) @ _unit_rows(asked["v"]).T
        return _best_of_batch(scores, mine["item_id"].to_numpy(), asked["query_id"].tolist(), k, -np.inf, COSINE_DIGITS)

    keys = ["cell", "part", "_j"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
    return top_per_group(best, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id``, ``recall``: the share of each query's exact results that was found."""
    hit = found.select("query_id", "item_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
