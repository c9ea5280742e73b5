"""Language identification with bit-sliced Bloom filters over character n-grams.

One filter answers for all languages: a slot holds a bit for each of them, eight to a plane.
Looking up an n-gram's slots and combining them bit by bit gives every language that contains
it; how often each language answers, less the answers its filter would give by chance, decides.

Learned from labelled rows whose id does not fall into the held-out fold, on a sample of at
most about ``SAMPLE`` documents of each language (whole texts). Predictions see the text alone.
A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing
was labelled. A text of unknown n-grams gets the most common language with score 0. Ties go to
the more common language, then to the smaller name. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAMS = (3, 4)
#: Documents of each language that are learned from, on average.
SAMPLE = 2000
#: Slots of the filter, a power of two.
SLOTS = 1 << 20
#: A language contains an n-gram that makes at least this share of its n-grams, and of the highest share any language has of it.
MIN_SHARE, MIN_OF_HIGHEST = 1e-6, 0.2
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_hashes(text: str, letters: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of the n-grams of the lower-cased text, anything but letters counting as one blank; none without a letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    plain = np.where(letters[codes], codes, np.uint32(32))
    kept = plain[np.r_[True, (plain[1:] != 32) | (plain[:-1] != 32)]].astype(np.uint64)
    if len(kept) < 3:
        return np.zeros(0, dtype=np.uint64)
    out = []
    for n in sizes:
        if len(kept) >= n:
            h = np.full(len(kept) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ kept[k : len(kept) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out)


def slots_of(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(31)) & mask).astype(np.int64)


def learn(docs: DataFrame, sample: int = SAMPLE, slots: int = SLOTS, sizes: tuple[int, ...] = GRAMS) -> tuple[list[str], np.ndarray]:
    """Languages, most common first, and the filter's planes (planes x slots, unsigned bytes).

    What comes to the driver is a count for each language and, at most, one byte for each slot and plane.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    planes = np.zeros((max(1, -(-len(languages) // 8)), slots), dtype=np.uint8)
    if not languages:
        return [], planes
    number = {name: i for i, name in enumerate(languages)}
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(scale, -(-sample * scale // counts[name])))])
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share[F.col("lang")]).select("text", "lang")

    def count(frames):
        import pandas as pd

        letters = letter_table()
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                grams, n = np.unique(np.concatenate([gram_hashes(x, letters, sizes) for x in texts]), return_counts=True)
                yield pd.DataFrame({"lang": number[lang], "gram": grams.view(np.int64), "n": n})

    grams = picked.mapInPandas(count, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).cache()
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = grams.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # one row for each language
    highest = F.max("rate").over(Window.partitionBy("gram"))
    members = rates.withColumn("highest", highest).where((F.col("n") > 1) & (F.col("rate") >= MIN_SHARE) & (F.col("rate") >= F.col("highest") * MIN_OF_HIGHEST))

    def place(frames):
        import pandas as pd

        for frame in frames:
            grams, lang = frame["gram"].to_numpy().view(np.uint64), frame["lang"].to_numpy()
            for at in slots_of(grams, slots):
                yield pd.DataFrame({"plane": lang // 8, "slot": at, "bits": 1 << (lang % 8)})

    placed = members.select("lang", "gram").mapInPandas(place, "plane int, slot int, bits int").groupBy("plane", "slot").agg(F.expr("bit_or(bits)").alias("bits"))
    chunks = placed.groupBy("plane", F.shiftright("slot", 10).alias("chunk")).agg(F.collect_list(F.struct("slot", "bits")).alias("rows"))
    for r in chunks.select("plane", "rows.slot", "rows.bits").collect():
        planes[r["plane"], r["slot"]] = r["bits"]
    grams.unpersist()
    return languages, planes


def chance_answers(planes: np.ndarray, n: int) -> np.ndarray:
    """For each language the chance that its filter answers for an n-gram it does not contain."""
    fill = np.concatenate([((plane[:, None] >> np.arange(8)) & 1).mean(axis=0) for plane in planes])[:n]
    return fill**2


def identify(docs: DataFrame, languages: list[str], planes: np.ndarray, sizes: tuple[int, ...] = GRAMS, text: str = "text") -> DataFrame:
    """``docs`` with ``__lang``: the language (``lang_pred``) and its share of all corrected answers (``score``)."""
    chance = chance_answers(planes, max(1, len(languages)))
    shared = docs.sparkSession.sparkContext.broadcast((languages, planes, chance, sizes))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        languages, planes, chance, sizes = shared.value
        letters, bits = letter_table(), (np.arange(256)[:, None] >> np.arange(8)) & 1
        slots, out = planes.shape[1], []
        for x in texts:
            hashes = gram_hashes(x, letters, sizes) if x else ()
            if not len(hashes) or not languages:
                out.append((UNKNOWN, 0.0))
                continue
            a, b = slots_of(hashes, slots)
            answers = np.concatenate([np.bincount(p[a] & p[b], minlength=256) @ bits for p in planes])[: len(languages)]
            own = np.maximum((answers - len(hashes) * chance) / np.maximum(1 - chance, 1e-9), 0)
            best = int(np.argmax(own))
            out.append((languages[best], float(own[best] / own.sum()) if own.sum() > 0 else 0.0))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("__lang", predict(F.col(text)))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    languages, planes = learn(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), languages, planes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang.lang_pred").alias("lang_pred"), F.col("__lang.score").alias("score"))
