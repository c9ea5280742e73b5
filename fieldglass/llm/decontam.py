"""Benchmark decontamination by a broadcast set of normalised word windows.

Texts are compared as runs of letters and digits: A-Z is lower-cased, and a word is a run of
ASCII letters, ASCII digits and characters above 0x7F. A window is ten words in a row of a
benchmark item, or all words of a shorter item. Null and wordless texts have no words, hold no
hit and are kept; null and wordless items make no window; an item without an id still makes
hits but is not listed. Repeated rows give repeated results, repeated items count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import LOWER, UPPER, ascii_lower, release_memory

WINDOW = 10
#: Most windows that are sent to the tasks; a larger benchmark is joined instead.
MAX_WINDOWS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = str.maketrans(UPPER, LOWER)
FOUND = "struct<n_words:bigint,hits:array<int>,items:array<bigint>>"
#: lower-cases A-Z, keeps what makes words, blanks the rest
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def window_tables(items: list[tuple[int | None, list[bytes]]], window: int) -> tuple[dict[bytes, int], dict[int, dict[tuple, set]]]:
    """A number for each benchmark word, and by length the items of each window of word numbers."""
    ids: dict[bytes, int] = {}
    windows: dict[int, dict[tuple, set]] = {}
    for item, words in items:
        numbers = [ids.setdefault(w, len(ids) + 1) for w in words]
        length = min(window, len(numbers))
        for at in range(len(numbers) - length + 1 if length else 0):
            windows.setdefault(length, {}).setdefault(tuple(numbers[at : at + length]), set()).add(item)
    return ids, windows


def scan_words(words: list[bytes], ids: dict[bytes, int], windows: dict[int, dict[tuple, set]]) -> tuple[list[int], list[int]]:
    """Positions of words in some window, and the ids of the items that have a window here."""
    numbers = [ids.get(w, 0) for w in words]
    known = np.cumsum(np.array([0, *numbers], dtype=np.int64) > 0)
    hits: set[int] = set()
    items: set = set()
    for length, owned in windows.items():
        if len(numbers) < length:
            continue
        # only starts from which every word is one of the benchmark's are looked up
        for at in np.flatnonzero(known[length:] - known[: len(numbers) + 1 - length] == length).tolist():
            owners = owned.get(tuple(numbers[at : at + length]))
            if owners:
                hits.update(range(at, at + length))
                items |= owners
    return sorted(hits), sorted(i for i in items if i is not None)


def _item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return benchmark.select(F.col(item_id).alias("item_id"), words.alias("words")).where(F.size("words") > 0).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
              window: int = WINDOW, max_windows: int = MAX_WINDOWS, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``_found``: number of words, hit word positions, items with a window in the text.

    The benchmark's windows are counted first. Up to ``max_windows`` they go to every task as a
    set and the documents are never shuffled; beyond that, windows of both sides are joined on
    their words.
    """
    items = _item_words(benchmark, item_id, item_text)
    size = items.agg(F.sum(F.greatest(F.size("words") - (window - 1), F.lit(1)))).first()[0] or 0
    if size <= max_windows:
        return _scan(docs, window_tables([(r["item_id"], [w.encode("utf-8", "surrogatepass") for w in r["words"]]) for r in items.collect()], window), doc_text)
    return _join(docs, items, doc_text, window, key)


def _scan(docs: DataFrame, windows: tuple, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                words = word_list(x)
                rows.append((len(words), *scan_words(words, *shared.value)))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])
        release_memory()

    return docs.withColumn("__found", scan(F.col(text)))


def _join(docs: DataFrame, items: DataFrame, text: str, window: int, key: str) -> DataFrame:
    def windows(df: DataFrame, length: Column, *carried: str) -> DataFrame:
        starts = F.sequence(F.lit(0), F.size("words") - length)
        made = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, length), " ").alias("window")))
        return df.where(F.size("words") >= length).select(*carried, F.explode(made).alias("w")).select(*carried, "w.at", "w.window")

    of_items = windows(items.withColumn("length", F.least(F.lit(window), F.size("words"))), F.col("length"), "item_id", "length")
    of_items = of_items.groupBy("length", "window").agg(F.collect_set("item_id").alias("owners")).cache()
    lengths = [r["length"] for r in of_items.select("length").distinct().collect()]
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    texts = docs.select(F.col(key).alias("__key"), F.md5(F.coalesce(text, F.lit(""))).alias("__md5"), words.alias("words"))
    parts = None
    for length in lengths:
        part = windows(texts.withColumn("length", F.lit(length)), F.lit(length), "__key", "__md5", "length")
        parts = part if parts is None else parts.unionByName(part)
    covered = F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)
    hits = parts.join(of_items, ["length", "window"]).groupBy("__key", "__md5").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(covered)))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"))
    left = docs.withColumns({"__md5": F.md5(F.coalesce(text, F.lit(""))), "__n": F.size(words).cast("bigint")}).alias("d")
    joined = left.join(hits.alias("h"), F.col(f"d.{key}").eqNullSafe(F.col("h.__key")) & (F.col("d.__md5") == F.col("h.__md5")), "left")
    found = F.struct(F.col("__n").alias("n_words"), F.coalesce(F.col("h.hits"), F.array().cast("array<int>")).alias("hits"),
                     F.coalesce(F.col("h.items"), F.array().cast("array<bigint>")).alias("items"))
    return joined.select(*[F.col(f"d.{c}") for c in docs.columns], found.alias("__found"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: its words, hit words, items found and a digest of the items' ids."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, **options)
    ids = F.array_join(F.array_sort(F.transform("__found.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("__found.n_words").alias("n_words"), F.size("__found.hits").cast("bigint").alias("n_hit"),
        F.size("__found.items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("__found.hits") > 0).alias("contaminated"))


def cut_words(text: str, hits) -> str:
    """``text`` without the runs of hit words; white space around a cut becomes one blank.

    Words are counted in the lower-cased text, as hits are; it has the same length.
    """
    spans, hit = [], set(hits)
    for at, m in enumerate(re.finditer(WORD, text.translate(LOWERED))):
        if at in hit:
            if spans and at - 1 in hit:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
    out, last = [], 0
    for start, end in spans:
        out.append(text[last:start].rstrip())
        last = end
    return " ".join(x for x in (*out, text[last:].strip()) if x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """``docs`` without benchmark passages.

    Runs of hit words are cut out of a text; a document with more than ``drop_share`` of its
    words hit, or without any word left, is dropped. Clean documents keep their text as it is.
    """
    @F.pandas_udf("string")
    def cut(texts, hits):
        return pd.Series([cut_words(x, h) for x, h in zip(texts, hits, strict=True)], dtype=object)

    found = find_hits(docs, benchmark, doc_text=text, **options)
    n_hit = F.size("__found.hits")
    kept = found.where((n_hit == 0) | (n_hit <= F.col("__found.n_words") * drop_share))
    return kept.withColumn(text, F.when(n_hit == 0, F.col(text)).otherwise(cut(F.coalesce(text, F.lit("")), F.col("__found.hits")))).drop("__found")


def contamination_sql(window: int = WINDOW) -> str:
    """The same rows for the tables ``documents`` and ``benchmark`` in SQL."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
    return f"""
    WITH item AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
    item_at AS (SELECT item_id, w, least({window}, len(w)) AS n, unnest(generate_series(1, len(w) - least({window}, len(w)) + 1)) AS i FROM item WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM item_at),
    doc AS (SELECT doc_id, {words} AS w FROM documents),
    doc_at AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
    hit AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM doc_at) d JOIN win ON d.k = win.k AND d.n = win.n),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""
