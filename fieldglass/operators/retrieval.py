"""Dense and lexical top-k search, fusion, reranking and result merging.

A search deals items and queries into blocks of bounded length and compares each block of
items with each block of queries in a task of its own, as one matrix product that keeps at most
k rows per query. Items and texts are read once for any number of queries, nothing is emitted
per (query, item) pair, and neither side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import word_tokens
from fieldglass.operators.ordered import first_per_key, top_per_group
from fieldglass.session import cut_lineage, union_all, write_down

QUERY_BLOCK, ITEM_BLOCK = 512, 4096
#: Classes that one task compares a vector with; a routing table, not a collection.
MOST_CENTROIDS = 4096


def _unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    length[length == 0] = 1.0
    return m / length


#: Digits after the point to which scores are equal: of cosines, and of sums without a bound.
COSINE_DIGITS, SUM_DIGITS = 12, 9


def _best_of_batch(scores: np.ndarray, ids: np.ndarray, query_ids: list, k: int, floor: float, digits: int) -> pd.DataFrame:
    """At most ``k`` rows per query: best scores first, smaller ids first among equal scores.

    Scores are rounded so that copies of one item tie wherever they are stored and in whatever order their terms are added up.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, scores = ids[by_id], np.round(scores[by_id], digits)
    n = len(ids)
    cut = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(scores.shape[1], -np.inf)
    frames = []
    for j, query_id in enumerate(query_ids):
        s = scores[:, j]
        rows = np.flatnonzero(s > cut[j])
        if n > k:
            rows = np.concatenate([rows, np.flatnonzero(s == cut[j])[: k - len(rows)]])
        rows = rows[s[rows] > floor]
        if len(rows):
            frames.append(pd.DataFrame({"query_id": query_id, "item_id": ids[rows], "score": s[rows]}))
    return pd.concat(frames) if frames else pd.DataFrame({"query_id": [], "item_id": [], "score": []})


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def usable_vector(vector: Column, length: Column | None = None) -> Column:
    """False for null and empty vectors, vectors with a null or NaN entry, and those of another length."""
    plain = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    fits = plain if length is None else plain & (F.size(vector) == length)
    return F.coalesce(fits, F.lit(False))


def unusable_vectors(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Rows that a search over vectors of this many dimensions leaves out."""
    return df.filter(~usable_vector(F.col(vector), F.lit(dimensions)))


def block_join(items: DataFrame, queries: DataFrame, compare: Callable, schema: str, item_rows: int = ITEM_BLOCK, query_rows: int = QUERY_BLOCK) -> DataFrame:
    """``compare(items, queries)`` for every block of items with every block of queries.

    ``items`` have ``item_id``, ``queries`` have ``query_id``. Blocks come from a hash of the id; their
    number from two counts. Each item travels once per block of queries and each query once per
    block of items, so the smaller side pays for the blocks of the larger one.
    """
    n_items = max(1, -(-items.count() // item_rows))
    n_queries = max(1, -(-queries.count() // query_rows))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.withColumn("_i", F.pmod(F.xxhash64("item_id"), F.lit(n_items)).cast("int")).withColumn("_j", other(n_queries))
    right = queries.withColumn("_j", F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int")).withColumn("_i", other(n_items))

    def both(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return compare(mine, asked) if len(mine) and len(asked) else pd.DataFrame({"query_id": [], "item_id": [], "score": []})

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(both, schema)


def vector_top_k(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    item_id: str = "item_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    block_rows: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact cosine top-k: ``(query_id, item_id, score, rank)``, ties by item id.

    Rows without a usable vector are left out; ``unusable_vectors`` names them. A query is
    compared with the items of its own length.
    """
    schema = f"query_id {_type_of(queries, query_id)}, item_id {_type_of(items, item_id)}, score double"
    mine = items.select(F.col(item_id).alias("item_id"), F.col(vector).alias("v")).filter(usable_vector(F.col("v")))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v")).filter(usable_vector(F.col("v")))

    def compare(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size, part in queries.groupby(queries["v"].map(len)):
            same = items[items["v"].map(len) == size]
            if len(same):
                scores = _unit_rows(same["v"]) @ _unit_rows(part["v"]).T
                found.append(_best_of_batch(scores, same["item_id"].to_numpy(), part["query_id"].tolist(), k, -np.inf, COSINE_DIGITS))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "item_id": [], "score": []})

    best = block_join(mine, asked, compare, schema, query_rows=block_rows)
    return top_per_group(best, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def _centroid_scorer(block: list, label_type: str):
    names = [r[0] for r in block]
    matrix = np.stack([np.asarray(r[1], dtype=np.float64) for r in block]).T

    @F.pandas_udf(f"struct<label: {label_type}, score: double>")
    def best(v: pd.Series) -> pd.DataFrame:
        labels, scores = np.full(len(v), None, dtype=object), np.full(len(v), np.nan)
        given = v.notna().to_numpy()
        if given.any():
            dots = _unit_rows(v[given]) @ matrix
            top = dots.argmax(axis=1)
            labels[given] = [names[i] for i in top]
            scores[given] = dots[np.arange(len(top)), top]
        return pd.DataFrame({"label": pd.Series(labels, dtype=object), "score": pd.Series(scores).where(given)})

    return best


def nearest_centroid(
    items: DataFrame,
    centroids: DataFrame,
    vector: str = "embedding",
    label: str = "label",
    centroid: str = "centroid",
    most: int = MOST_CENTROIDS,
) -> DataFrame:
    """Add ``best_label`` and ``best_score``: the centroid with the largest dot product, first label on ties.

    The centroids of a routing table, at most ``most`` rows, go to the tasks; more raise an error.
    """
    table = centroids.select(label, centroid).orderBy(label).limit(most + 1).collect()
    if len(table) > most:
        raise ValueError(f"more than {most} centroids: search them with vector_top_k")
    label_type = _type_of(centroids, label)
    if not table:
        return items.withColumn("best_label", F.lit(None).cast(label_type)).withColumn("best_score", F.lit(None).cast("double"))
    scored = items.withColumn("_b", _centroid_scorer(table, label_type)(F.col(vector)))
    return scored.withColumn("best_label", F.col("_b.label")).withColumn("best_score", F.col("_b.score")).drop("_b")


def centroids(examples: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean of the unit vectors of each class, scaled to length one (a zero mean is left alone)."""
    from fieldglass.functions.vectors import l2_normalise

    parts = examples.select(label, F.posexplode(l2_normalise(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    ordered = means.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("mean")
    )
    return ordered.select(label, l2_normalise(F.col("mean")).alias("centroid"))


def bm25_top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    query_text: str = "query",
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
    block_rows: int = QUERY_BLOCK,
) -> DataFrame:
    """Lexical top-k over whole texts: ``(query_id, item_id, score, rank)``.

    The texts are tokenised once: their tokens are cut to the terms that queries use and counted
    per document, and those counts, written out, give both the document frequencies and the
    vectors that are scored. A null text has no words but counts as a document.
    """
    schema = f"query_id {_type_of(queries, query_id)}, item_id {_type_of(docs, doc_id)}, score double"
    tokens = lambda c: word_tokens(F.coalesce(F.col(c), F.lit("")))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # the empty term, which no text has, stands for the text itself and gives the number of texts and their lengths in the same pass
    wanted = write_down(asked.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct())
    sized = docs.select(F.col(doc_id).alias("item_id"), tokens(text).alias("t")).select("item_id", F.size("t").alias("dl"), "t")
    held = sized.select("item_id", "dl", F.explode(F.concat("t", F.array(F.lit("")))).alias("term")).join(wanted, "term")
    found = cut_lineage(held.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), F.sum("dl").alias("words")))
    corpus = found.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum("words") / F.sum("tf")).alias("avgdl"))
    counts = found.filter("term <> ''")
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = (corpus.select(c).scalar() for c in ("n", "avgdl"))
    idf = F.ln(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(frequency, "term").withColumn("w", F.col("qtf") * idf)
    # terms of one text, in order, so that equal texts add up equal sums
    pack = lambda df, key, value: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("term"), F.col(value).alias("x")))).alias("_p")).select(key, F.col("_p.term").alias("terms"), F.col("_p.x").alias("x"))
    scale = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / avgdl))
    mine = pack(counts.withColumn("s", scale), "item_id", "s")
    wants = pack(weighted, "query_id", "w")

    def compare(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index: dict[str, int] = {}
        for terms in queries["terms"]:
            for w in terms:
                index.setdefault(w, len(index))
        weights = np.zeros((len(index), len(queries)))
        for j, (terms, x) in enumerate(zip(queries["terms"], queries["x"], strict=True)):
            weights[[index[w] for w in terms], j] = x
        scores = np.zeros((len(items), len(queries)))
        for i, (terms, x) in enumerate(zip(items["terms"], items["x"], strict=True)):
            at = np.array([index.get(w, -1) for w in terms])
            scores[i] = np.asarray(x)[at >= 0] @ weights[at[at >= 0]]
        return _best_of_batch(scores, items["item_id"].to_numpy(), queries["query_id"].tolist(), k, 0.0, SUM_DIGITS)

    best = block_join(cut_lineage(mine), wants, compare, schema, query_rows=block_rows)
    return top_per_group(best, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def sparse_top_k(items: DataFrame, queries: DataFrame, k: int, item_id: str = "item_id", vector: str = "sparse", query_id: str = "query_id", query_vector: str = "sparse") -> DataFrame:
    """Top-k by the dot product of sparse vectors (``map<int,double>``): ``(query_id, item_id, score, rank)``.

    Items without a shared dimension are no results; null maps and null values count as empty. The items are written
    down once, as they are counted and then compared.
    """
    schema = f"query_id {_type_of(queries, query_id)}, item_id {_type_of(items, item_id)}, score double"
    flat = lambda df, key, c, name: df.select(F.col(key).alias(name), F.map_keys(c).alias("dims"), F.map_values(c).alias("x")).filter(F.size("dims") > 0)
    clean = lambda df, c: df.withColumn(c, F.map_filter(F.col(c), lambda _, x: x.isNotNull() & ~F.isnan(x)))

    def compare(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index = {d: i for i, d in enumerate(sorted({d for dims in queries["dims"] for d in dims}))}
        weights = np.zeros((len(index), len(queries)))
        for j, (dims, x) in enumerate(zip(queries["dims"], queries["x"], strict=True)):
            weights[[index[d] for d in dims], j] = x
        scores = np.full((len(items), len(queries)), -np.inf)
        for i, (dims, x) in enumerate(zip(items["dims"], items["x"], strict=True)):
            at = np.array([index.get(d, -1) for d in dims])
            rows = weights[at[at >= 0]]
            scores[i] = np.where((rows != 0).any(axis=0), np.asarray(x)[at >= 0] @ rows, -np.inf)
        return _best_of_batch(scores, items["item_id"].to_numpy(), queries["query_id"].tolist(), k, -np.inf, SUM_DIGITS)

    best = block_join(write_down(flat(clean(items, vector), item_id, vector, "item_id")), flat(clean(queries, query_vector), query_id, query_vector, "query_id"), compare, schema)
    return top_per_group(best, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def weighted_rank_fusion(
    hits: DataFrame, k: int, weights: dict[str, float] | None = None, rrf_k: int = fixed.RRF_K, over_fetch: int = 2
) -> DataFrame:
    """Fuse ranked lists ``(query_id, field, item_id, score)``: sum of weight / (rrf_k + rank).

    Each list is cut to ``over_fetch * k`` before fusion; a field without a weight counts one.
    """
    ranked = top_per_group(
        hits, ["query_id", "field"], [F.col("score").desc(), F.col("item_id")], over_fetch * k, "_rk"
    )
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in weights.items()], F.lit(1.0))
    # rounded so that equal sums tie whatever the order of their terms
    score = F.round(F.sum(weight / (F.lit(rrf_k) + F.col("_rk"))), 12)
    fused = ranked.groupBy("query_id", "item_id").agg(score.alias("score"))
    return top_per_group(fused, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def hybrid_search(
    items: DataFrame, docs: DataFrame, queries: DataFrame, k: int, item_id: str, vector: str, doc_id: str, text: str
) -> DataFrame:
    """Dense and lexical rankings of twice the wanted length, fused by reciprocal rank.

    ``queries``: query_id, embedding, query.
    """
    dense = vector_top_k(items, queries, 2 * k, item_id, vector).withColumn("field", F.lit("dense"))
    lexical = bm25_top_k(docs, queries, 2 * k, doc_id, text).withColumn("field", F.lit("sparse"))
    return weighted_rank_fusion(dense.unionByName(lexical).drop("rank"), k)


def cross_collection_top_k(per_collection: list[DataFrame], k: int) -> DataFrame:
    """Results of several collections as one list, best score first."""
    both = union_all(per_collection)
    return top_per_group(both, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Order by a pair scorer's value; the retrieval score stays in its own column."""
    score = F.pandas_udf(scorer, "double")
    scored = candidates.withColumn("rerank_score", score(F.col("query"), F.col("text")))
    return top_rank(scored, "rerank_score")


def top_rank(scored: DataFrame, score: str) -> DataFrame:
    """Rank inside each query's (already cut) candidate list."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("item_id"))
    return scored.withColumn("rank", F.row_number().over(w))


def attach_metadata(ranked: DataFrame, documents: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Metadata back by text after reranking: last document with the text wins, missing is empty."""
    key = F.sha2(F.col("text"), 256)
    meta = (
        documents.groupBy(key.alias("_k"))
        .agg(F.max_by(F.struct(*columns), F.col(order)).alias("_m"))
    )
    joined = ranked.withColumn("_k", key).join(meta, "_k", "left")
    return joined.select(
        *ranked.columns, *[F.coalesce(F.col(f"_m.{c}").cast("string"), F.lit("")).alias(c) for c in columns]
    )


def merge_key(item_id: Column, text: Column, prefix: int | None = None) -> Column:
    """Identity of a result: its id, or its text when it has none; with ``prefix`` the start of the text."""
    whole = F.coalesce(text, F.lit(""))
    named = F.sha2(whole, 256) if prefix is None else F.substring(whole, 1, prefix)
    return F.coalesce(F.concat(F.lit("i"), F.nullif(item_id.cast("string"), F.lit(""))), F.concat(F.lit("t"), named))


def merge_results(results: DataFrame, order: list[str], top_k: int | None = None, by_score: bool = True, prefix: int | None = None) -> DataFrame:
    """Union of result lists keeping each item's first appearance, per query, optionally cut to 2k."""
    keyed = results.withColumn("_key", merge_key(F.col("item_id"), F.col("text"), prefix))
    first = first_per_key(keyed, ["query_id", "_key"], order).drop("_key")
    if top_k is None:
        return first
    by = [F.col("score").desc()] if by_score else []
    return top_per_group(first, ["query_id"], [*by, *[F.col(o) for o in order]], 2 * top_k)


def dedup_text(docs: DataFrame, order: list[str], text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """First row per distinct text; the shuffle key is a hash, texts of equal rows combine before it."""
    keyed = docs.withColumn("_h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return first_per_key(keyed, [*(keys or []), "_h"], order).drop("_h")
