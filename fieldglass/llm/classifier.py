"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are shares and lengths of characters, words, lines and repeats, none of them a word of
its own. Trees are grown level by level on histograms of binned statistics, with the gradients of
the logistic loss; the fitted trees are flattened into arrays, so that a batch of texts walks all
trees together, one step of numpy indexing for each level.

Learned from labelled rows outside the held-out fold, on about ``SAMPLE`` labelled ids at most
(whole texts): their statistics, some 30 numbers for each id, reach the driver. Scores see the
text alone. An id with several labels counts with their mean, one with several texts with one of
them; null labels and ids are not learned from. A null text is an empty one. Without any usable label
every score is 0.5; with labels of one kind all scores are near it. Repeated rows get equal
results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialise, release_memory

#: Labelled ids that trees are fitted on, on average.
SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
CUT = 0.3
TREES, DEPTH, RATE, BINS = 80, 4, 0.15, 64
#: Least sum of second derivatives in a leaf, and what is added to it.
MIN_WEIGHT, SHRINK = 2.0, 1.0
STATISTICS = (
    "words", "chars", "mean_word", "longest_word", "capitals", "digits", "symbols", "other_symbols", "exclamations", "commas", "stops", "quotes", "non_ascii",
    "lines", "mean_line", "lines_with_mark", "lines_from_capital", "repeated_lines", "distinct_words", "top_word", "repeated_windows", "short_words",
    "wordless", "shouted_words", "marked_words", "longest_run", "links")
CLASSES = {
    "capitals": bytes(range(65, 91)), "digits": b"0123456789", "symbols": b"#*$%&|<>", "other_symbols": b"@^_~`\\\\+={}[]/", "exclamations": b"!?", "commas": b",;:",
    "stops": b".", "quotes": b"\"'()", "non_ascii": bytes(range(128, 192))}
BLANKS = b" \t\n\x0b\x0c\r"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def statistics_of(text: str | None) -> list[float]:
    """The numbers named in ``STATISTICS``, over the whole text."""
    from collections import Counter

    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(data, np.uint8)
    seen = np.bincount(codes, minlength=256)
    share = {name: seen[list(members)].sum() / size for name, members in CLASSES.items()}
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in map(bytes.strip, data.split(b"\n")) if x]
    counts = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    run_ends = np.flatnonzero(np.r_[codes[1:] != codes[:-1], True])
    ends = sum(x[-1:] in (b".", b"!", b"?", b":", b";", b",", b'"') for x in lines)
    values = {
        **share, "words": np.log1p(n), "chars": np.log1p(size), "mean_word": lengths.mean(), "longest_word": np.log1p(lengths.max()),
        "lines": len(lines) / n, "mean_line": np.log1p(size / len(lines)), "lines_with_mark": ends / len(lines),
        "lines_from_capital": sum(x[:1].isupper() or x[0] >= 128 for x in lines) / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines),
        "distinct_words": len(counts) / n, "top_word": max(counts.values()) / n, "repeated_windows": sum(c for c in windows.values() if c > 1) / n,
        "short_words": (lengths <= 3).mean(), "wordless": sum(not w.lower().islower() and w.isascii() for w in words) / n,
        "shouted_words": sum(w.isupper() and len(w) > 1 for w in words) / n, "marked_words": sum(w[-1:] in b"#*$%&|<>!" for w in words) / n,
        "longest_run": np.log1p(np.diff(np.r_[-1, run_ends]).max()), "links": (data.count(b"http") + data.count(b"www.")) / n}
    return [float(values[name]) for name in STATISTICS]


def statistics(texts: pd.Series) -> np.ndarray:
    return np.array([statistics_of(x if isinstance(x, str) else None) for x in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


class Trees:
    """Complete trees as arrays: statistic and cut of each inner node in level order, then the values of the leaves."""

    def __init__(self, start: float, statistic: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.start, self.statistic, self.cut, self.value = start, statistic, cut, value

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row."""
        total = np.full(len(rows), self.start)
        count, inner = self.statistic.shape
        if count:
            trees, each = np.arange(count)[None, :], np.arange(len(rows))[:, None]
            at = np.zeros((len(rows), count), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (rows[each, self.statistic[trees, at]] > self.cut[trees, at])
            total = total + self.value[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for ``labels`` between 0 and 1; the best cut of a node is the one that lowers the loss most, first of equals."""
    inner = 2**depth - 1
    if not len(rows):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    mean = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for x in rows.T]
    binned = np.stack([np.searchsorted(e, x) for e, x in zip(edges, rows.T, strict=True)])
    total, out = np.full(len(rows), start), []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, curve = labels - chance, chance * (1 - chance)
        statistic, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(rows), np.int64)
        for level in range(depth):
            nodes = 2**level
            first = nodes - 1
            place = (at - first) * bins
            sums = np.stack([[np.bincount(place + b, x, nodes * bins).reshape(nodes, bins) for b in binned] for x in (slope, curve)])
            left = sums.cumsum(axis=3)
            whole = left[..., -1:]
            right = whole - left
            gain = (left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - whole[0] ** 2 / (whole[1] + SHRINK))
            gain = np.where((left[1] >= MIN_WEIGHT) & (right[1] >= MIN_WEIGHT), gain, 0.0).transpose(1, 0, 2).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for node in np.flatnonzero(gain[np.arange(nodes), best] > 1e-9):
                which, b = divmod(int(best[node]), bins)
                if b < len(edges[which]):
                    statistic[first + node], cut[first + node] = which, edges[which][b]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), statistic[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + SHRINK)
        total = total + value[leaf]
        out.append((statistic, cut, value))
    return Trees(start, *(np.stack(x) for x in zip(*out, strict=True)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **parameters) -> Trees:
    """Trees fitted on labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = usable.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
    scale = 1 << 20
    rate = min(scale, -(-sample * scale // max(1, marks.count())))
    picked = materialise(marks.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(scale)) < rate), "picked")  # about ``sample`` rows
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(texts)), index=texts.index, dtype=object)

    measured = texts.select("doc_id", "label", measure("text").alias("x"))
    rows = measured.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).orderBy("doc_id").select("r.*").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["label"] for r in rows], dtype=np.float64), **parameters)


def scored(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``__score``, the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(statistics(texts)), index=texts.index)
        release_memory()

    return docs.withColumn("__score", score(F.col(text)))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    trees = learn(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    found = scored(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= cut).cast("int").alias("predicted"))
