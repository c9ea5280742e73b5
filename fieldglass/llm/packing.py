"""Packing of tokenised documents into fixed-length sequences by their length histogram.

Every document becomes its byte-level BPE ids and one end id. It is cut into full sequences, a
half sequence if more than that is left, and a rest, so that each id lies in exactly one piece.
Only the histogram of piece lengths (at most ``CAPACITY`` rows) reaches the driver, where
lengths are placed longest first, always into the packs with the most room. The outcome is a
table of patterns: the pieces of one length with ranks ``lo`` to ``hi`` lie at ``offset`` of
sequences ``base`` onwards. Pieces find their place by a join on length and rank.

A null text is an empty one: a document of the end id alone. Special tokens written in a text
are ordinary text. Repeated rows are packed as often as they occur; an empty table gives none.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import materialise, tidy

CAPACITY = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Word pieces a task remembers the ids of, before it starts anew.
CACHED_WORDS = 500_000
#: Unseen words that are encoded in one call's text; neither single words nor long texts are as fast.
WORDS_AT_ONCE = 50
#: ASCII characters that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ranges that the ranks of one length are counted in, and rows of one range at most on average.
SALTS, ROWS_PER_SALT = 256, 1_000_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, remembering the ids of words.

    The pre-tokeniser starts a new piece at a blank between two other characters, so the parts
    between such blanks are encoded apart. It does so before a line feed that a
    character other than white space follows, and where letters end and ASCII marks begin: a part is
    cut there if marks end it.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # letters are one piece, so they need no more than a cut at the NUL characters between them
        cuts = [pre_tokenizers.Split("\0", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.encode_special_tokens = True
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(cuts)
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.line = self._encode(["\n"])[0]
        self.unsafe = re.compile(r" (?:\s|\Z)")
        self.lines = re.compile(r"\n(?=\S)")
        self.border = re.compile(r"(?<!\s) (?=\S)")

    def _encode(self, texts: list[str], by=None) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of `` word`` for each word, or of the word alone if it begins with a line feed.

        They are encoded some at a time with a NUL character after each, which only NUL characters make ids of.
        """
        import numpy as np

        def split(texts: list[str], mark: str, by) -> list[bytes]:
            if not texts:
                return []
            ids = np.frombuffer(self._encode([mark], by)[0], dtype="<u4")
            groups = [mark.join([*texts[at : at + WORDS_AT_ONCE], ""]) for at in range(0, len(texts), WORDS_AT_ONCE)]
            data = b"".join(self._encode(groups, by))
            ends = np.flatnonzero(np.frombuffer(data, dtype="<u4") == ids[-1]) + 1
            width = 4 * len(ids)
            return [data[4 * a : 4 * b - width] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

        plain = [w for w in words if w.isalpha()]
        heads = [w for w in words if w[:1] == "\n" and w[1:].isalpha()]
        others = list(set(words).difference(plain, heads))
        made = dict(zip(plain, split([" " + w for w in plain], "\0", self.letters), strict=True))
        made.update(zip(heads, (self.line + ids for ids in split([w[1:] for w in heads], "\0", self.letters)), strict=True))
        made.update(zip(others, split([w if w[:1] == "\n" else " " + w for w in others], " \0", self.tokenizer), strict=True))
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        # no other part begins with a line feed than those of lines
        parts = [self.border.split(x) if self.unsafe.search(x) else self.lines.sub(" \n", x).split(" ") for x in texts]
        heads = self._encode([p[0] for p in parts])
        for p in parts:
            del p[0]
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
            self.tails.clear()
        missing = set().union(*parts).difference(known)
        odd = [w for w in missing if "\0" in w]
        # marks after letters are a piece of their own
        ended = {w: body for w in missing if (body := w.rstrip(MARKS)) != w and body[body[:1] == "\n" :].isalpha()}
        missing.difference_update(odd, ended)
        plain = list(missing.union(ended.values()).difference(known))
        known.update(self._encode_words(plain))
        known.update(zip(odd, self._encode([w if w[:1] == "\n" else " " + w for w in odd]), strict=True))
        tails = list({w[len(body) :] for w, body in ended.items()}.difference(self.tails))
        self.tails.update(zip(tails, self._encode(tails), strict=True))
        known.update({w: known[body] + self.tails[w[len(body) :]] for w, body in ended.items()})
        return [head + b"".join(map(known.__getitem__, p)) for head, p in zip(heads, parts, strict=True)]


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` ids start: full sequences, a half one if the rest is longer, the rest."""
    starts = list(range(0, n, capacity))
    if n - starts[-1] > capacity // 2 and n - starts[-1] < capacity:
        starts.append(starts[-1] + capacity // 2)
    return starts


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document, without its ids but with their checksum."""
    def cut(frames):
        import struct
        import zlib

        import pandas as pd

        encoder, end = Encoder(path), struct.pack("<I", end_id)
        for frame in frames:
            rows = []
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                for doc_id, ids in zip(part["doc_id"].astype(object), encoder.encode([x if isinstance(x, str) else "" for x in part["text"]]), strict=True):
                    ids += end
                    starts = piece_starts(len(ids) // 4, capacity)
                    for a, b in zip(starts, [*starts[1:], len(ids) // 4], strict=True):
                        rows.append((None if pd.isna(doc_id) else doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), len(ids) // 4))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(tidy(cut), PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: rows (length, lo, hi, base, offset), ranks ``lo <= r < hi``.

    A heap entry stands for ``count`` packs alike: how much of each is used and, for each piece
    in them, its length and the rank it has in the first of these packs.
    """
    packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []
    serial = 0

    def push(used: int, count: int, parts: list[tuple[int, int]]) -> None:
        nonlocal serial
        serial += 1
        heapq.heappush(packs, (used, serial, count, parts))

    closed: list[tuple[int, list[tuple[int, int]]]] = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and packs[0][0] + length <= capacity:
                used, _, count, parts = heapq.heappop(packs)
                taken = min(count, left)
                push(used + length, taken, [*parts, (length, rank)])
                if taken < count:
                    push(used, count - taken, [(n, r + taken) for n, r in parts])
                rank, left = rank + taken, left - taken
                continue
            # nothing has room: new packs, each filled with as many pieces of this length as it holds
            fit = capacity // length
            for count, each in ((left // fit, fit), (1 if left % fit else 0, left % fit)):
                if count:
                    parts = [(length, rank + k * count) for k in range(each)]
                    rank, left = rank + count * each, left - count * each
                    if each * length == capacity:
                        closed.append((count, parts))
                    else:
                        push(each * length, count, parts)
    rows, base = [], 0
    for count, parts in [*closed, *((p[2], p[3]) for p in sorted(packs))]:
        offset = 0
        for length, rank in parts:
            rows.append((length, rank, rank + count, base, offset))
            offset += length
        base += count
    return rows


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``rank`` within their length, from 0 without gaps.

    Lengths are split into ranges by a hash of the row, so that a length that a third of all
    rows share is not numbered in one task.
    """
    salts = max(SALTS, -(-total // ROWS_PER_SALT))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    return salted.withColumn("inside", inside).join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside")).drop("salt", "before", "inside")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    made = materialise(pieces(docs, path or tokenizer_path(), capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(shortest_pack_first(histogram, capacity), "p_length bigint, lo bigint, hi bigint, base bigint, p_offset bigint")
    rows = ranked(made, sum(histogram.values()))
    # the pattern table depends on the lengths alone: a few ranges for each of at most ``capacity`` lengths
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = rows.join(F.broadcast(places), here)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("p_offset").alias("offset"))
