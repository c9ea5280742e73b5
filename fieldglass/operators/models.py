"""Hooks for models the caller brings: encoders, judges, extractors, pair scorers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODE_BATCH = 8
#: Words whose places the stand-in encoder remembers, before it starts anew.
CACHED_WORDS = 500_000


def embed(
    docs: DataFrame, encoder: Callable[[list[str]], list], text: str = "text", out: str = "embedding", batch: int = ENCODE_BATCH
) -> DataFrame:
    """Add unit-length vectors from an encoder called on batches of texts; the counts must match."""
    def run(columns):
        for column in columns:
            vectors: list[np.ndarray] = []
            texts = column.fillna("").tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                got = encoder(part)
                if len(got) != len(part):
                    raise ValueError(f"encoder returned {len(got)} vectors for {len(part)} texts")
                for v in got:
                    v = np.asarray(v, dtype=np.float64)
                    length = np.linalg.norm(v)
                    vectors.append(v / length if length > 0 else v)
            yield pd.Series(vectors, dtype=object)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text)))


def hash_encoder(dim: int = 32) -> Callable[[list[str]], list]:
    """Deterministic stand-in: counts of hashed words, each hashed once."""

    class Places(dict):
        def __missing__(self, word: str) -> int:
            self[word] = place = int.from_bytes(hashlib.sha1(word.encode()).digest()[:4], "big") % dim
            return place

    known = Places()

    def encode(texts: list[str]) -> list:
        out = []
        for text in texts:
            words = text.lower().split()
            if len(known) > CACHED_WORDS:
                known.clear()
            places = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            out.append(np.bincount(places, minlength=dim).astype(np.float64))
        return out

    return encode


def ask(rows: DataFrame, client: Callable[[str], str], prompt: str, out: str = "reply", default: str | None = None) -> DataFrame:
    """Add a model's reply to the prompt column; a failed call gives the default."""

    def call(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return client(p)
            except Exception:
                return default

        return prompts.map(one)

    call.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return rows.withColumn(out, F.pandas_udf(call, "string")(F.col(prompt)))


def sub_questions(replies: DataFrame, reply: str = "reply", query: str = "query", most: int = 4) -> DataFrame:
    """Sub-questions of a JSON array reply; none, too many or no array at all means the query itself."""
    parsed = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\[.*\])", 1), "array<string>")
    usable = F.coalesce(F.size(parsed).between(1, most), F.lit(False))
    return replies.withColumn("sub_questions", F.when(usable, parsed).otherwise(F.array(query)))
