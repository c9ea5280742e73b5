"""Removal of word passages that occur more than once, by level-wise doubling.

A window is ``window`` words in a row (35). Levels of 9, 18 and 35 words follow each other: only
windows that are repeated at one length are extended to the next, about twice as long, and what
is repeated at the last is removed.

* Level one looks at one short window for every long one, the least by hash of those within it
  (winnowing). Equal long windows choose equal short ones, so none is missed, and about one
  position in fourteen is shuffled instead of all.
* A repeated short window is extended to both sides; a long window around it holds one of the two.
* Long windows around a repeated extension are counted by two 64-bit hashes of their words. The
  shorter levels only propose, and use one polynomial hash; the last decides, and adds XXH64 of the
  words, as two polynomials modulo 2^64 have collisions in common.

Texts that occur more than once are removed whole (if they hold a window), and one of them
stands for all in later levels. A null text has no words. Repeated rows are copies of each
other. Texts shorter than a window never lose a word; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialise, tidy

WINDOW = 35
#: Bits of a selection key that hold the position, so that of equal short windows the last is chosen.
AT_BITS = 28


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mixing step of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of byte ranges as differences of prefix sums, one odd base and byte table for each seed."""

    def __init__(self, seed: int):
        self.table = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
        self.base = int(splitmix(np.array([seed + 77], dtype=np.uint64))[0]) | 1
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            n = len(data) + 1
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.powers[: len(data)])])

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return splitmix((prefix[end] - prefix[start]) * self.inverse[start])


class Words:
    """Words of a text and the place of each in the text of words joined by one blank."""

    def __init__(self, text: str | None):
        self.words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
        self.data = b" ".join(self.words)
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        blanks = np.flatnonzero(self.bytes == 32)
        self.starts = np.r_[0, blanks + 1] if self.words else np.zeros(0, np.int64)
        self.ends = np.r_[blanks, len(self.data)] if self.words else np.zeros(0, np.int64)

    def windows(self, hasher: Hasher, prefix: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
        return hasher.ranges(prefix, self.starts[first], self.ends[first + length - 1])

    def names(self, first: np.ndarray, length: int) -> np.ndarray:
        """XXH64 of each window's bytes."""
        data, hashed = memoryview(self.data), xxhash.xxh64_intdigest
        ranges = zip(self.starts[first].tolist(), self.ends[first + length - 1].tolist(), strict=True)
        return np.fromiter((hashed(data[a:b]) for a, b in ranges), np.uint64, len(first))


def chosen(short: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` short windows the position of the least, of equal ones the last."""
    low = np.uint64((1 << AT_BITS) - 1)
    least = (short & ~low) | (low - np.arange(len(short), dtype=np.uint64))
    size = 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return (low - (least & low)).astype(np.int64)


def levels(window: int) -> tuple[int, int]:
    """The two shorter lengths: a quarter and a half of the window, rounded up."""
    return -(-window // 4), -(-window // 2)


def sketch(words: Words, hasher: Hasher, window: int) -> tuple[np.ndarray, ...]:
    """Chosen short windows of a text: position, hash, hashes of its extensions to the right and left (0: beyond the text)."""
    n, (first, second) = len(words.words), levels(window)
    if n < window:
        return (np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3)))
    prefix = hasher.prefix(words.bytes)
    short = words.windows(hasher, prefix, np.arange(n - first + 1), first)
    at = np.unique(chosen(short, window - first + 1))
    out = [short[at]]
    for start in (at, at + first - second):
        ok = (start >= 0) & (start + second <= n)
        value = np.zeros(len(at), dtype=np.uint64)
        value[ok] = words.windows(hasher, prefix, start[ok], second) | np.uint64(1)
        out.append(value)
    return (at.astype(np.int32), *(x.view(np.int64) for x in out))


def candidates(words: Words, hasher: Hasher, spots: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and two hashes of the long windows around repeated extensions; a spot is 2 x position + (1 if to the right)."""
    n, (first, second) = len(words.words), levels(window)
    prefix = hasher.prefix(words.bytes)
    own = chosen(words.windows(hasher, prefix, np.arange(n - first + 1), first), window - first + 1)
    wanted = np.zeros(len(own), dtype=bool)
    for spot in spots:
        at, right = divmod(spot, 2)
        # the long windows that choose this short one and hold its extension
        lo, hi = (at + second - window, at) if right else (at + first - window, at + first - second)
        a, b = np.searchsorted(own, at), np.searchsorted(own, at, side="right")
        wanted[max(a, lo, 0) : max(min(b, hi + 1), 0)] = True
    start = np.flatnonzero(wanted)
    return start, words.windows(hasher, prefix, start, window).view(np.int64), words.names(start, window).view(np.int64)


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, written out: one row for each, so that a hot key of a join's other side can be split."""
    return materialise(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: texts (``rid``, ``doc_id``, ``digest``, ``n_words``, ``words_sha256``), copies
    (``rid``, ``first``: whether it stands for its copies, ``copied``), and for texts with a repeated
    window their ``rid``, ``text`` and the ``starts`` of those windows."""
    def outline(frames):
        import pandas as pd

        hasher = Hasher(1)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words = Words(text)
                rows.append((len(words.words), hashlib.sha256(words.data).hexdigest(), *sketch(words, hasher, window)))
            made = pd.DataFrame(rows, columns=["n_words", "words_sha256", "at", "short", "right", "left"])
            yield pd.concat([frame[["rid", "doc_id", "digest"]].reset_index(drop=True), made], axis=1)

    named = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    outlined = named.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(
        tidy(outline), "rid bigint, doc_id bigint, digest string, n_words bigint, words_sha256 string, at array<int>, short array<bigint>, `right` array<bigint>, `left` array<bigint>")
    outlines = materialise(outlined, "outlines")
    groups = materialise(outlines.groupBy("digest").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid")), "texts")
    copies = materialise(outlines.select("rid", "digest").join(groups, "digest").select("rid", (F.col("rid") == F.col("first_rid")).alias("first"), (F.col("n") > 1).alias("copied")), "copies")

    zipped = outlines.select("rid", F.explode(F.arrays_zip("at", "short", "right", "left")).alias("z")).select("rid", "z.*")
    short = materialise(zipped.join(repeated(zipped, "short"), "short").drop("short"), "level")
    sides = F.array(F.struct((F.col("at") * 2 + 1).alias("spot"), F.col("right").alias("half")), F.struct((F.col("at") * 2).alias("spot"), F.col("left").alias("half")))
    halves = short.select("rid", F.explode(sides).alias("s")).select("rid", "s.spot", "s.half").where("half != 0")
    spots = halves.join(repeated(halves, "half"), "half").join(copies.where("first"), "rid").groupBy("rid").agg(F.collect_list("spot").alias("spots"))  # at most two for each chosen window of one text
    wanted = materialise(spots.join(outlines.select("rid", "doc_id", "digest"), "rid"), "wanted").alias("w")

    source = named.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.digest") == F.col("w.digest"))
    texts = materialise(source.join(wanted, same).select("w.rid", "d.text", "w.spots").dropDuplicates(["rid"]), "texts")

    def extend(frames):
        import pandas as pd

        hasher = Hasher(1)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                found = [candidates(Words(x), hasher, s, window) for x, s in zip(part["text"], part["spots"], strict=True)]
                sizes = [len(f[0]) for f in found]
                yield pd.DataFrame({"rid": np.repeat(part["rid"].to_numpy(), sizes), "at": np.concatenate([f[0] for f in found]),
                                    "one": np.concatenate([f[1] for f in found]), "two": np.concatenate([f[2] for f in found])})

    long = texts.mapInPandas(tidy(extend), "rid bigint, at int, one bigint, two bigint")
    starts = long.join(repeated(long, "one", "two"), ["one", "two"]).groupBy("rid").agg(F.collect_list("at").alias("starts"))  # positions of one text
    return outlines.drop("at", "short", "right", "left"), copies, texts.select("rid", "text").join(materialise(starts, "starts"), "rid")


def kept_words(text: str, starts, window: int) -> tuple[list[bytes], int]:
    """Words outside all windows that start at ``starts``, and the number of the others."""
    words = Words(text).words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.asarray(starts), 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [w for w, gone in zip(words, covered, strict=True) if not gone], int(covered.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, and the kept words if ``with_text``."""
    outlines, copies, repeats = repeated_windows(docs, window)

    def cut(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for text, starts in zip(frame["text"], frame["starts"], strict=True):
                words, gone = kept_words(text, starts, window)
                data = b" ".join(words)
                rows.append((gone, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "surrogatepass") if with_text else None))
            yield pd.concat([frame[["rid"]].reset_index(drop=True), pd.DataFrame(rows, columns=["gone", "sha", "left_text"])], axis=1)

    changed = repeats.mapInPandas(tidy(cut), "rid bigint, gone bigint, sha string, left_text string")
    if not with_text:
        changed = changed.drop("left_text")
    whole = F.col("copied") & (F.col("n_words") >= window)
    rows = outlines.join(copies.select("rid", "copied"), "rid").join(materialise(changed, "changed"), "rid", "left")
    out = [
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "words_sha256")).alias("kept_sha256")]
    if with_text:
        own = docs.select(F.col("doc_id").alias("__id"), F.md5(F.coalesce("text", F.lit(""))).alias("__digest"), "text").dropDuplicates(["__id", "__digest"])
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
        plain = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        out.append(F.when(whole, F.lit("")).otherwise(F.coalesce("left_text", plain)).alias("kept_text"))
    return rows.select(*out)


def repeats_sql(window: int = WINDOW) -> str:
    """The same rows for the table ``documents`` in SQL, with every window written out."""
    last = window - 1
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    a AS (SELECT r, w, unnest(generate_series(1, len(w) - {last})) AS i FROM d WHERE len(w) >= {window}),
    k AS (SELECT r, i, array_to_string(w[i:i + {last}], ' ') AS k FROM a),
    t AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
    g AS (SELECT DISTINCT r, unnest(generate_series(i, i + {last})) AS p FROM k JOIN t USING (k)),
    u AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
    l AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.p) AS words, count(*) AS n FROM u LEFT JOIN g ON u.r = g.r AND u.p = g.p WHERE g.p IS NULL GROUP BY u.r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
    FROM d LEFT JOIN l USING (r)"""
