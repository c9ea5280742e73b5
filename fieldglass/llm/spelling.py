"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

Replacing a letter moves a word's vector of letter counts by two (L1 distance), inserting or
deleting one moves it by one. So a word's near words lie in a small box around its vector. For
each length a skeleton tree, built on a bounded sample, deals all words into cells of near
vectors; a word is filed in its own cell and asked of every cell, of its length and of the next
one, whose box comes near enough. Inside a cell a k-d tree is searched for all questions at
once, leaving out every node whose bounding box is too far away, and what a leaf holds is
verified on the order of the letters. So each pair is found, and exactly once.

A null text has no words, and neither has an empty one; a missing ``doc_id`` counts as empty where
words are picked for a dropped letter. Repeated rows count as often as they occur. Among near
words of the same count the smaller one in code-point order is the form. Very long texts and
words are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import LOWER, UPPER, crc32_sql, materialise, tidy

#: One code point of a dropped letter for each so many words of a document, by checksum.
DROP_EVERY = 97
MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
#: Letters of a word: a to z, then U+00C0 to U+00FF.
DIMENSIONS = 26 + 64
#: Letters of a skeleton cell's own words, about; cells of four times as many are cut into blocks.
CELL_LETTERS = 1 << 15
#: Words that the skeletons are built on, about; every word is filed and asked.
SAMPLE = 100_000
LEAF = 64
#: Bits that a letter's count takes at most where leaves are searched; beyond it the order of letters decides alone.
MOST_BITS = 4
#: Pairs of a question and a leaf's word that are compared at once.
PAIRS_AT_ONCE = 1 << 18
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, drop_every: int = DROP_EVERY) -> DataFrame:
    """``word``, ``n``: words of at least ``min_letters`` code points over whole texts, counted in each batch first."""
    def count(frames):
        import re
        import zlib

        runs = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
        for frame in frames:
            total: Counter = Counter()
            for i, x in zip(frame["i"], frame["t"], strict=True):
                start = zlib.crc32(i.encode() + b":")
                for run, n in Counter(runs.findall(x.encode("utf-8", "surrogatepass").translate(LOWERED))).items():
                    h = zlib.crc32(run, start)
                    if h % drop_every == 0:
                        word = run.decode()
                        at = h % len(word)
                        run = (word[:at] + word[at + 1 :]).encode()
                    total[run] += n
            kept = [(w, n) for w, n in ((b.decode(), n) for b, n in total.items()) if len(w) >= min_letters]
            yield pd.DataFrame(kept, columns=["word", "n"], dtype=object)

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    return rows.mapInPandas(tidy(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter stands in each row."""
    place = np.where(codes >= 0xC0, codes.astype(np.int32) - 0xC0 + 26, codes.astype(np.int32) - ord("a"))
    flat = np.arange(len(codes), dtype=np.int64)[:, None] * DIMENSIONS + place
    return np.bincount(flat.ravel(), minlength=len(codes) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


def best_cut(vectors: np.ndarray) -> tuple[int, int] | None:
    """Axis and largest value of the left part that cut the rows most evenly; none if all rows are alike."""
    found = None
    for value in range(int(vectors.max(initial=0))):
        left = (vectors <= value).sum(axis=0)
        even = np.minimum(left, len(vectors) - left)
        axis = int(np.argmax(even))
        if even[axis] > 0 and (found is None or even[axis] > found[0]):
            found = (int(even[axis]), axis, value)
        if found is not None and found[0] * 3 > len(vectors):
            break
    return None if found is None else found[1:]


class Tree:
    """A k-d tree: an inner node has axis, cut, the borders of its box on that axis and two children; a leaf has its number and rows."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self.grow(vectors, np.arange(len(vectors)), leaf, {})

    def grow(self, vectors, rows, leaf, box) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        own = vectors[rows]
        cut = best_cut(own) if len(rows) > leaf else None
        if cut is None:
            self.nodes[at] = (None, self.leaves, rows)
            self.leaves += 1
            return at
        axis, value = cut
        lo, hi = box.get(axis, (0, 1 << 30))
        goes_left = own[:, axis] <= value
        left = self.grow(vectors, rows[goes_left], leaf, {**box, axis: (lo, value)})
        right = self.grow(vectors, rows[~goes_left], leaf, {**box, axis: (value + 1, hi)})
        self.nodes[at] = ((axis, value, lo, hi), left, right)
        return at

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each row belongs to."""
        out, todo = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            at, rows = todo.pop()
            cut, left, right = self.nodes[at]
            if cut is None:
                out[rows] = left
            else:
                goes_left = vectors[rows, cut[0]] <= cut[1]
                todo += [(left, rows[goes_left]), (right, rows[~goes_left])]
        return out

    def reached(self, vectors: np.ndarray, radius: int):
        """Number and rows of each leaf, and the rows of ``vectors`` whose distance to its box is at most ``radius``.

        A child's box differs from its parent's on one axis alone, so a distance is mended, not computed again.
        """
        columns = np.ascontiguousarray(vectors.T)
        todo = [(0, np.arange(len(vectors)), np.zeros(len(vectors), np.int32))]
        while todo:
            at, rows, far = todo.pop()
            cut, left, right = self.nodes[at]
            if cut is None:
                yield left, right, rows
                continue
            axis, value, lo, hi = cut
            x = columns[axis][rows]
            other = far - np.maximum(np.maximum(lo - x, x - hi), 0)
            for child, low, high in ((left, lo, value), (right, value + 1, hi)):
                now = other + np.maximum(np.maximum(low - x, x - high), 0)
                near = now <= radius
                if near.any():
                    todo.append((child, rows[near], now[near]))


def unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as bits, ``most`` of them for each letter: rows x 64-bit numbers, whose unlike bits are at most the distance."""
    bits = np.concatenate([counts[:, axis][:, None] > np.arange(most[axis])[None, :] for axis in np.flatnonzero(most)], axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view("<u8")


def edited(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of one length differ in one place, or rows of ``long`` are those of ``short`` with one letter put in."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    head = np.cumprod(short == long[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return head + tail >= short.shape[1]


def pairs_in(tree: Tree, held: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], radius: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``asked`` and ``held`` (codes and counts each) that are one edit apart; with ``itself`` each pair once."""
    (codes, counts), (other_codes, other_counts) = held, asked
    most = np.minimum(counts.max(axis=0), MOST_BITS)
    bits, other_bits = unary(counts, most), unary(other_counts, most)
    tails, heads, pending = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []

    def verify() -> None:
        q, r = (np.concatenate(x) for x in zip(*pending, strict=True))
        good = edited(other_codes[q], codes[r])
        tails.append(q[good])
        heads.append(r[good])
        pending.clear()

    for _, rows, questions in tree.reached(other_counts, radius):
        step = max(1, PAIRS_AT_ONCE // max(1, len(rows)))
        for at in range(0, len(questions), step):
            part = questions[at : at + step]
            apart = np.zeros((len(part), len(rows)), np.uint16)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(other_bits[part, k][:, None] ^ bits[rows, k][None, :])
            q, r = np.nonzero(apart <= radius)
            q, r = part[q], rows[r]
            pending.append((q[q < r], r[q < r]) if itself else (q, r))
            if sum(len(q) for q, _ in pending) > PAIRS_AT_ONCE:
                verify()
    if pending:
        verify()
    return np.concatenate(tails), np.concatenate(heads)


def skeletons(words: DataFrame, cell_letters: int = CELL_LETTERS, sample: int = SAMPLE) -> dict[int, Tree]:
    """A tree for each length with more than a cell of words; about ``sample`` words reach the driver."""
    sizes = words.groupBy(F.length("word").alias("letters")).agg(F.count("*").alias("n")).where(F.col("n") * F.col("letters") > cell_letters)
    wanted = {r["letters"]: r["n"] for r in sizes.collect()}
    if not wanted:
        return {}
    scale = 1 << 20
    rate = min(scale, -(-sample * scale // sum(wanted.values())))
    picked = words.where(F.length("word").isin(list(wanted)) & (F.pmod(F.xxhash64("word"), F.lit(scale)) < rate))
    found: dict[int, list[str]] = {}
    for r in picked.select("word").collect():
        found.setdefault(len(r["word"]), []).append(r["word"])
    out = {}
    for letters, rows in found.items():
        cells = -(-wanted[letters] * letters // cell_letters)
        out[letters] = Tree(letter_counts(letter_codes(sorted(rows))), max(1, len(rows) // cells))
    return out


def filed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``cell``, ``asks``, ``word``, ``n``: each word once as held (0), and as a question of its length (1) and of the next one (2)."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def place(frames):
        trees = shared.value

        def own(letters: int, vectors: np.ndarray) -> np.ndarray:
            leaf = trees[letters].leaf_of(vectors) if letters in trees else np.zeros(len(vectors), np.int64)
            return (letters << 24) + leaf

        def near(letters: int, vectors: np.ndarray, radius: int):
            if letters not in trees:
                yield letters << 24, np.arange(len(vectors))
                return
            for leaf, _, rows in trees[letters].reached(vectors, radius):
                yield (letters << 24) + leaf, rows

        for frame in frames:
            for letters, part in frame.groupby(frame["word"].map(len)):
                for at in range(0, len(part), max(1, (1 << 20) // letters)):
                    some = part.iloc[at : at + max(1, (1 << 20) // letters)]
                    vectors = letter_counts(letter_codes(some["word"].tolist()))
                    mine = own(letters, vectors)
                    yield some.assign(cell=mine, asks=0)[["cell", "asks", "word", "n"]]
                    for asks, length, radius in ((1, letters, 2), (2, letters + 1, 1)):
                        for cell, rows in near(length, vectors, radius):
                            rows = rows[mine[rows] < cell] if asks == 1 else rows
                            if len(rows):
                                yield some.iloc[rows].assign(cell=cell, asks=asks)[["cell", "asks", "word", "n"]]

    return words.select("word", "n").mapInPandas(tidy(place), "cell bigint, asks int, word string, n bigint")


def near_words(words: DataFrame, cell_letters: int = CELL_LETTERS, sample: int = SAMPLE) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (count and word of the most frequent near word) of all ``words`` (``word``, ``n``) with one.

    ``words`` are distinct, in lower-case letters a to z and U+00C0 to U+00FF.
    """
    rows = materialise(filed(words, skeletons(words, cell_letters, sample)), "filed-words")
    letters = F.shiftright("cell", 24)
    sizes = rows.where("asks = 0").groupBy("cell").agg(F.count("*").alias("held"))
    large = sizes.withColumn("blocks", F.ceil(F.col("held") * letters / F.lit(4 * cell_letters)).cast("int")).where("blocks > 1").select("cell", "blocks")
    cut = rows.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # a held word is asked of the later blocks of its own cell, any other question of all blocks
    place = lambda j: F.struct(j.alias("block"), F.when((F.col("asks") == 0) & (j > F.col("own")), 1).otherwise(F.col("asks")).alias("asks"))
    first = F.when(F.col("asks") == 0, F.col("own")).otherwise(F.lit(0))
    dealt = cut.withColumn("p", F.explode(F.transform(F.sequence(first, F.col("blocks") - 1), place))).select("cell", "p.block", "p.asks", "word", "n")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        words, n, asks = frame["word"].to_numpy(dtype=object), frame["n"].to_numpy(), frame["asks"].to_numpy()
        sides = {k: np.flatnonzero(asks == k) for k in (0, 1, 2)}
        tails, heads = [], []
        if len(sides[0]):
            parts = {k: (c := letter_codes(words[at].tolist()), letter_counts(c)) for k, at in sides.items() if len(at)}
            tree = Tree(parts[0][1], LEAF)
            for k, part in parts.items():
                a, b = pairs_in(tree, parts[0], part, 1 if k == 2 else 2, k == 0)
                tails += [sides[k][a], sides[0][b]]
                heads += [sides[0][b], sides[k][a]]
        if not sum(map(len, tails)):
            return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}, dtype=object)
        pairs = pd.DataFrame({"word": words[np.concatenate(tails)], "best": words[np.concatenate(heads)], "best_n": n[np.concatenate(heads)]})
        pairs = pairs.sort_values(["word", "best_n", "best"], ascending=[True, False, True], kind="stable")
        by_word = pairs.groupby("word", sort=False)
        return by_word.agg(n_near=("best", "size"), best_n=("best_n", "first"), best=("best", "first")).reset_index()

    found = dealt.groupBy("cell", "block").applyInPandas(search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.struct((-F.col("b.minus")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the end of the chain of forms, for all words with a ``form``; each round doubles the steps taken."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, **parameters) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of all ``words`` (``word``, ``n``)."""
    near = near_words(words, **parameters)
    chosen = words.join(near, "word", "left").withColumn("f", F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")))
    named = chosen.select("word", F.col("f.word").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("f.n").alias("form_n"))
    named = materialise(named, "variants")
    ends = roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, **parameters) -> DataFrame:
    """One row for each word of at least ``MIN_LETTERS`` letters that stands ``min_count`` times in all documents."""
    return variants(materialise(word_counts(docs).where(F.col("n") >= min_count), "words"), **parameters)


def variants_sql() -> str:
    """The same table as DuckDB SQL: near words share what is left when one letter is blotted out or taken away."""
    return f"""
    WITH RECURSIVE runs AS (
        SELECT i, w, count(*) AS n
        FROM (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents)
        GROUP BY ALL),
    {crc32_sql("SELECT DISTINCT i || ':' || w AS s FROM runs")},
    read AS (
        SELECT CASE WHEN k.crc % {DROP_EVERY} = 0 THEN w[1:k.crc % length(w)] || w[k.crc % length(w) + 2:] ELSE w END AS word, n
        FROM runs JOIN checksums k ON k.s = i || ':' || w),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM read WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
    cuts AS (SELECT word, n, word[1:p - 1] || '*' || word[p + 1:] AS blotted, word[1:p - 1] || word[p + 1:] AS shorter FROM places),
    near AS (
        SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.blotted = b.blotted AND a.word != b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.shorter = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.shorter = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS other_n FROM near GROUP BY word),
    formed AS (
        SELECT w.word, CASE WHEN b.other_n >= {RATIO} * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {RATIO} * w.n THEN b.other_n END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word),
    chain AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
    SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends e ON e.word = f.word
    """
