import random

import pytest
from pyspark.sql import types as T

SYLLABLES = "an er the on in st re ou nd ha th ing ti ed ea".split()


def prose(seed: int, n: int) -> str:
    """Invented words, in sentences and lines."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = []
    for at, w in enumerate(words):
        out.append(w + ("." if at % 11 == 10 else "") + ("\n" if at % 33 == 32 else " "))
    return "".join(out).strip() + "."


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators also use."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("kept", "spans", "fp", "digest", "rid", "findings", "start", "rank", "_q", "_text")]])

    def make(pairs, lang=None):
        rows = [(i, t, lang[k] if lang else None, "s", None, *["x"] * 10) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, repeated rows, copies, a row without id, a very long text and one very long word."""
    base = prose(1, 120)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (6, "word"), (7, base + " and one more end."), (None, prose(2, 90)),
        (8, prose(3, 40_000)), (9, "x" * 200_000), (10, "Ünïcode 日本語 🙂 text here. next " + prose(4, 60)), (11, "1" * 60_000), (12, None)]
