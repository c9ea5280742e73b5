"""A stored inverted index for lexical search with early termination by block bounds.

Postings are rows of a term and a block of documents (by a hash of the id), so that a frequent term is many rows of
bounded length; each knows the largest share of a score that any of its postings gives. A search
reads the postings of its terms alone, never a text, and a task adds up one block for a block of queries, of
which at most k rows per query leave it. It does so twice: partial scores of each query's rarest terms give a
score that its k-th result surely reaches; then the blocks whose bounds together reach that score are scored
in full. The results are those of ``retrieval.bm25_top_k``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import word_tokens
from fieldglass.operators.ordered import top_per_group
from fieldglass.operators.retrieval import QUERY_BLOCK, SUM_DIGITS, _best_of_batch, _type_of
from fieldglass.session import cut_lineage

#: Documents of a block, about, and terms of a query that its sure score comes from.
BLOCK_DOCUMENTS, FIRST_TERMS = 4096, 3
#: Two sums of the same terms differ by less than this share.
SLACK = 1e-9


def build_text_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, block_documents: int = BLOCK_DOCUMENTS) -> None:
    """Store ``postings`` (term, block, its postings and bound), ``terms`` (document frequency, bound) and ``corpus`` under ``path``.

    A null text has no words but counts as a document. Ids are those of one row each.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("item_id"), word_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/corpus")
    n, avgdl = spark.read.parquet(f"{path}/corpus").first()
    blocks = max(1, -(-n // block_documents))
    # a text travels once, to its block; its words are then counted and listed where it lies
    dealt = docs.select(F.col(doc_id).alias("item_id"), F.col(text).alias("text")).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition("block")
    words = dealt.select("item_id", "block", word_tokens(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    counts = words.select("item_id", "block", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("block", "item_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    listed = F.collect_list(F.struct("item_id", "part")).alias("held")  # at most a block's documents
    postings = counts.withColumn("part", part).groupBy("term", "block").agg(listed, F.max("part").alias("most"), F.count(F.lit(1)).alias("n"))
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings").select("term", "most", "n")
    stored.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")).write.mode("overwrite").parquet(f"{path}/terms")


def _best_of_blocks(postings: DataFrame, wants: DataFrame, k: int, blocks: int, query_blocks: int) -> DataFrame:
    """The k best ``(query_id, item_id, score)`` of each query in each block whose bounds reach the query's ``sure`` score.

    ``wants``: query_id, term, w, sure. A posting travels once for each block of queries with its term, a query once for each block.
    """
    wants = wants.withColumn("_j", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    mine = postings.join(wants.select("term", "_j").distinct().toDF("term", "_j"), "term").select("block", "_j", "term", F.col("held.item_id").alias("ids"), F.col("held.part").alias("parts"), "most")
    # terms of one query, in order, so that equal texts add up equal sums
    packed = wants.groupBy("_j", "query_id", "sure").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("p"))
    asked = packed.select("_j", "query_id", "sure", F.col("p.term").alias("terms"), F.col("p.w").alias("w"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    schema = f"query_id {_type_of(wants, 'query_id')}, item_id {postings.schema['held'].dataType.elementType['item_id'].dataType.simpleString()}, score double"

    def compare(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "item_id": [], "score": []}, dtype=object)]
        if len(mine) and len(asked):
            ids, places = np.unique(np.concatenate(mine["ids"].to_numpy()), return_inverse=True)
            ends = mine["ids"].map(len).cumsum()
            held = {t: (places[e - len(p) : e], np.asarray(p), most) for t, p, e, most in zip(mine["term"], mine["parts"], ends, mine["most"], strict=True)}
            for query_id, terms, weights, sure in zip(asked["query_id"], asked["terms"], asked["w"], asked["sure"], strict=True):
                used = [(*held[t], w) for t, w in zip(terms, weights, strict=True) if t in held]
                if sum(w * most for _, _, most, w in used) < sure * (1 - SLACK):
                    continue
                scores = np.zeros(len(ids))
                for at, parts, _, w in used:
                    scores[at] += w * parts
                rows = np.flatnonzero(scores >= sure * (1 - SLACK))
                if len(rows):
                    found.append(_best_of_batch(scores[rows, None], ids[rows], [query_id], k, 0.0, SUM_DIGITS))
        return pd.concat(found[1:]) if len(found) > 1 else found[0]

    return mine.groupBy("block", "_j").cogroup(asked.groupBy("block", "_j")).applyInPandas(compare, schema)


def search_text_index(spark: SparkSession, path: str, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query", first_terms: int = FIRST_TERMS) -> DataFrame:
    """Lexical top-k: ``(query_id, item_id, score, rank)``, ties by item id."""
    postings, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    n = spark.read.parquet(f"{path}/corpus").first()["n"]
    words = queries.select(F.col(query_id).alias("query_id"), F.explode(word_tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("term"))
    asked = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).join(terms, "term")
    idf = F.ln(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.withColumn("w", F.col("qtf") * idf).select("query_id", "term", "df", "w")
    weighted = cut_lineage(weighted)

    blocks = postings.agg(F.max("block")).first()[0]
    blocks = 1 if blocks is None else blocks + 1
    query_blocks = max(1, -(-weighted.select("query_id").distinct().count() // QUERY_BLOCK))
    best = [F.col("score").desc(), F.col("item_id")]

    # a score that k documents of each query reach
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    first = weighted.withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= first_terms).select("query_id", "term", "w", F.lit(0.0).alias("sure"))
    partial = _best_of_blocks(postings, first, k, blocks, query_blocks)
    reached = top_per_group(partial, ["query_id"], best, k).where(F.col("rank") == k)
    sure = cut_lineage(reached.select("query_id", ((F.col("score") - 10.0**-SUM_DIGITS) * (1 - SLACK)).alias("sure")))  # scores are rounded

    # full scores in the blocks that may reach it
    judged = weighted.join(sure, "query_id", "left").select("query_id", "term", "w", F.coalesce("sure", F.lit(0.0)).alias("sure"))
    return top_per_group(_best_of_blocks(postings, judged, k, blocks, query_blocks), ["query_id"], best, k)
