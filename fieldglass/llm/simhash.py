"""SimHash near-duplicates, found by a generalised pigeonhole over groups of correlated bits.

A text's fingerprint is the majority vote, bit by bit, of the hashes of its word shingles; two
texts are linked if their fingerprints differ in at most ``RADIUS`` bits. The 64 bits are dealt
into partitions, correlated bits together. With a threshold t for each partition and thresholds
that sum to RADIUS - partitions + 1, two fingerprints within RADIUS differ in at most t bits of
some partition (t = -1: that partition is not used). Number of partitions and thresholds are
those with the fewest candidates, estimated from the counts of partition values over all
fingerprints and found by dynamic programming. Each distinct fingerprint is filed under its
value of each used partition and under all values within that partition's threshold; those
filed together are compared in full.

A null or wordless text has fingerprint zero and is linked like any other. Rows without an id
take part, but never name a component (null if no row of it has an id). Repeated rows give
repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.text import let
from fieldglass.llm.common import materialise, release_memory, tidy

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Rows of one bucket that a task compares at once; larger buckets are split into blocks of this size, taken in pairs.
BLOCK = 2048
#: Near-duplicates by shingle sets have long fingerprints, cut into bands of bits. One band is shared with a chance of 0.99997 at a similarity of 0.8.
BANDS, BAND_BITS = 83, 13
WORDS = -(-BANDS * BAND_BITS // BITS)
#: Standard deviations over the expected bits apart up to which two fingerprints together make a candidate; 0.99997 stay below.
SPREADS = 4.0
#: Rows of a bucket up to which its pairs are tried for all buckets of a batch at once.
MEDIUM = 512
#: Shingles of one component that a task compares at once, about.
BLOCK_SHINGLES = 1 << 19
MOST_PARTITIONS = 8
#: What filing a row costs, in comparisons of two fingerprints.
ROW_COST = 50
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints_of(text: str | None, shingle: int, seeds: tuple[int, ...]) -> list[int]:
    """A fingerprint for each seed of the shingles' hash, as signed 64-bit integers."""
    import xxhash

    words = [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not words:
        return [0] * len(seeds)
    grams = list(map(b" ".join, zip(*[words[k:] for k in range(shingle)]))) if len(words) >= shingle else [b" ".join(words)]
    digest, out = xxhash.xxh64_intdigest, []
    for seed in seeds:
        hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
        votes = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(hashes), 8192):
            part = hashes[at : at + 8192]
            votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return fingerprints_of(text, shingle, (SEED,))[0]


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``docs`` with ``fp`` in place of the text, and with ``more``, the fingerprint of the second seed (0 without one)."""
    @F.pandas_udf("fp bigint, more bigint")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(*fingerprints_of(x, shingle, seeds), 0)[:2] for x in texts], columns=["fp", "more"], dtype="int64")
        release_memory()

    voted = docs.withColumn("__fps", vote(F.col(text)))
    return voted.withColumns({"fp": F.col("__fps.fp"), "more": F.col("__fps.more")}).drop(text, "__fps")


def bit_correlation(values: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all rows; 64 x 64 sums are all that leaves the tasks."""
    def sums(frames):
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for frame in frames:
            bits = np.unpackbits(frame["fp"].to_numpy(dtype="<i8").view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": i, "j": j, "both": total.ravel(), "n": n})

    rows = values.select("fp").mapInPandas(sums, "i int, j int, both bigint, n bigint").groupBy("i", "j").agg(F.sum("both"), F.sum("n")).collect()
    both, n = np.zeros((BITS, BITS)), 1
    for i, j, b, count in rows:
        both[i, j], n = b, max(count, 1)
    mean = np.diag(both) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))


def deal_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of like size, each grown from its strongest pair by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        pair = max(combinations(sorted(left), 2), key=lambda p: (correlation[p], -p[0], -p[1]))
        group = list(pair)
        left -= set(pair)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def value_of(bits: list[int], fp: Column) -> Column:
    """The bits of ``fp`` named, gathered into the low bits of a number."""
    out = F.lit(0).cast("bigint")
    for to, bit in enumerate(bits):
        moved = F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(moved, to))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on, one per partition, that sum to ``total`` at the least cost; ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for t, more in enumerate(cost, start=-1):
                if spent + t not in step or value + more < step[spent + t][0]:
                    step[spent + t] = (value + more, [*chosen, t])
        best = step
    return best[total]


def choose_partitions(values: DataFrame, radius: int = RADIUS, choices: tuple[int, ...] | None = None) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds with the fewest candidates and probes, estimated over all fingerprints."""
    choices = choices or tuple(range(2, min(radius + 1, MOST_PARTITIONS) + 1))
    correlation = bit_correlation(values)
    dealt = {m: deal_bits(correlation, m) for m in choices}
    named = [(m, k, bits) for m in choices for k, bits in enumerate(dealt[m])]
    filed = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), value_of(bits, F.col("fp")).alias("v")) for m, k, bits in named]))
    counts = values.select(filed.alias("x")).groupBy("x.m", "x.k", "x.v").agg(F.count("*").cast("double").alias("n"))
    found = {(r["m"], r["k"]): (r["n"], r["pairs"]) for r in counts.groupBy("m", "k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()}
    plans = []
    for m in choices:
        costs = []
        for k, bits in enumerate(dealt[m]):
            n, pairs = found.get((m, k), (1.0, 1.0))
            balls = [sum(comb(len(bits), d) for d in range(t + 1)) for t in range(radius + 1)]
            # chance pairs grow with the values within the threshold, and so do the rows to file
            costs.append([0.0, *((n * ROW_COST + pairs - n) * ball for ball in balls)])
        cost, thresholds = allocate(costs, radius - m + 1)
        plans.append((cost, -m, thresholds))
    _, m, thresholds = min(plans)
    return dealt[-m], thresholds


def filed_rows(values: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """Each fingerprint under its own and, within the threshold, all near values of every used partition."""
    def near(k: int, bits: list[int], threshold: int) -> Column:
        flips = [sum(1 << b for b in chosen) for d in range(threshold + 1) for chosen in combinations(range(len(bits)), d)]
        masks = F.array(*[F.lit(f).cast("bigint") for f in flips])
        return let(value_of(bits, F.col("fp")), lambda own: F.transform(masks, lambda f: F.struct(F.lit(k).alias("k"), own.bitwiseXOR(f).alias("v"))))

    places = [near(k, bits, t) for k, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    return values.select("*", F.explode(F.concat(*places)).alias("p")).select(*values.columns, "p.k", "p.v")


def rank() -> Column:
    """What makes a document the first of its component."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")


class Near:
    """Whether two rows are linked: few enough bits differ in the first fingerprint, and in both together."""

    def __init__(self, radius: int, total: int):
        self.radius, self.total = radius, total

    def __call__(self, fp: np.ndarray, more: np.ndarray, other_fp, other_more) -> np.ndarray:
        first = np.bitwise_count(fp ^ other_fp)
        return (first <= self.radius) & (first + np.bitwise_count(more ^ other_more) <= self.total)


def local_stars(node: np.ndarray, fp: np.ndarray, more: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Components among the rows as edges between linked nodes, a tree for each; one edge per node at most."""
    order = np.argsort(node, kind="stable")
    node, fp, more = node[order], fp[order], more[order]
    tails, heads = [np.zeros(0, "<i8")], [np.zeros(0, "<i8")]
    while len(node):
        todo = [(node[0], fp[0], more[0])]
        node, fp, more = node[1:], fp[1:], more[1:]
        while todo and len(node):
            from_node, *prints = todo.pop()
            found = near(fp, more, *prints)
            if found.any():
                todo.extend(zip(node[found], fp[found], more[found], strict=True))
                tails.append(node[found])
                heads.append(np.full(int(found.sum()), from_node))
                node, fp, more = node[~found], fp[~found], more[~found]
    return np.concatenate(tails), np.concatenate(heads)


def links(values: DataFrame, radius: int = RADIUS, block: int = BLOCK, total: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly those reachable by steps of linked fingerprints.

    ``values`` has distinct ``fp``, or ``node``, ``fp`` and ``more`` with a ``total`` for both fingerprints.
    """
    if "node" not in values.columns:
        values = values.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("bigint").alias("more"))
    near = Near(radius, radius if total is None else total)
    rows = materialise(filed_rows(values.select("node", "fp", "more"), *choose_partitions(values, radius)), "filed")
    return bucket_links(rows, near, block)


def bucket_links(rows: DataFrame, near: Near, block: int = BLOCK, dense: bool = False) -> DataFrame:
    """Edges (a, b) that connect, bucket by bucket, the ``node`` of ``rows`` filed under the same ``k`` and ``v``.

    Of ``dense`` buckets few hold a single row, so that only those of several blocks are looked up.
    """
    counts = rows.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > (block if dense else 1))
    shared = rows.join(materialise(counts, "buckets"), ["k", "v"], "left" if dense else "inner").withColumn("n", F.coalesce("n", F.lit(1)))
    # a bucket of several blocks is compared by pairs of blocks; a fingerprint goes to all pairs with its block
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("p"), F.greatest(own, j).alias("q")))
    dealt = shared.select("node", "fp", "more", "k", "v", F.explode(pairs).alias("b")).select("node", "fp", "more", "k", "v", "b.p", "b.q")

    def compare(frames):
        kept = None
        key = ["k", "v", "p", "q"]

        def compared(frame):
            keys, node = frame[key].to_numpy(), frame["node"].to_numpy()
            fp, more = (frame[c].to_numpy(dtype="<i8").view("<u8") for c in ("fp", "more"))
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(node)])
            tails, heads = [node[:0]], [node[:0]]
            group, place = np.repeat(np.arange(len(starts)), sizes), np.arange(len(node)) - np.repeat(starts, sizes)
            met = sizes[group] > MEDIUM  # rows that their bucket's stars are looked for among
            later = np.flatnonzero(~met)
            for d in range(1, min(MEDIUM, int(sizes.max(initial=0)))):
                later = later[place[later] >= d]
                if not len(later):
                    break
                linked = later[near(fp[later], more[later], fp[later - d], more[later - d])]
                few = linked[sizes[group[linked]] <= 8]
                tails.append(node[few])
                heads.append(node[few - d])
                met[linked] = met[linked - d] = True
            met &= sizes[group] > 8
            for at in np.unique(group[met]):
                rows = np.arange(starts[at], starts[at] + sizes[at])
                rows = rows[met[rows]]
                t, h = local_stars(node[rows], fp[rows], more[rows], near)
                tails.append(t)
                heads.append(h)
            return pd.DataFrame({"a": np.concatenate(tails), "b": np.concatenate(heads)})

        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame[key] == frame[key].iloc[-1]).all(axis=1)
            kept = frame[last]
            if not last.all():
                yield compared(frame[~last])
        if kept is not None:
            yield compared(kept)

    sorted_rows = dealt.repartition("k", "v", "p", "q").sortWithinPartitions("k", "v", "p", "q")
    return sorted_rows.mapInPandas(tidy(compare), "a bigint, b bigint").where("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of an edge but the roots: the smallest node it is connected with.

    Alternates two steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest node next to it, until all edges lead to a root. Each step is a join with one row
    per node, written to the shared folder, so that Spark can split a node with many edges.
    """
    def nearest(df: DataFrame) -> DataFrame:
        return materialise(df.groupBy("a").agg(F.min("b").alias("m")), "nearest")

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = materialise(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = nearest(both).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a != b").distinct(), "large")
        small = large.join(nearest(large), "a")
        moved = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        step = materialise(moved.where("a != b").distinct(), "edges")
        if now.exceptAll(step).isEmpty() and step.exceptAll(now).isEmpty():
            return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = step


def grouped(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``first``, the document of its component that comes first.

    ``first`` holds an id and a digest of the text; ids go by value, rows without one come last.
    """
    named = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = materialise(fingerprints(named, shingle=shingle).withColumn("node", F.col("fp")), "fingerprints")
    values = materialise(rows.groupBy("node", "fp", "more").agg(F.min(rank()).alias("first")), "values")
    named = first_of_each(values, connected(links(values, radius)))
    return rows.join(materialise(named.select("node", "first"), "named"), "node")


def first_of_each(values: DataFrame, roots: DataFrame) -> DataFrame:
    """``node``, ``root`` and ``first`` of its whole component, for all of ``values``."""
    rooted = values.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "rooted")
    first = materialise(rooted.groupBy("root").agg(F.min("first").alias("first")), "components")
    return rooted.select("node", "root").join(first, "root").select("node", "root", "first")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` in hex, ``component_id``."""
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(docs, radius, shingle).select("doc_id", fingerprint.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def bits_at(similarity: float, bits: int = 2 * BITS, spreads: float = 0.0) -> int:
    """Bits in which fingerprints of texts with this Jaccard similarity of shingles are expected to differ, and ``spreads`` standard deviations more, rounded up."""
    from math import acos, ceil, pi, sqrt

    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + spreads * sqrt(bits * p * (1 - p)))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of what 64-bit hashes stand for."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
    return hashes ^ (hashes >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the set of shingles, in order."""
    import xxhash

    words = [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    grams = set(map(b" ".join, zip(*[words[k:] for k in range(shingle)]))) if len(words) >= shingle else {b" ".join(words)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=len(grams)))


def sketch_of(text: str | None, shingle: int) -> tuple[int, int, int, int, list[int]]:
    """A name of the set of shingles, its size, the first two words of its long fingerprint, and a value for each band of it; no bands for an empty set.

    A bit is the majority of the set's hashes; where as many are for it as against it, a majority of unequal votes decides.
    """
    import xxhash

    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0, 0, 0, 0, []
    factors = (mixed(np.arange(1, WORDS + 1, dtype="<u8")) | np.uint64(1))[None, :]
    votes, unequal = np.zeros((2, WORDS * BITS), dtype=np.int64)
    weights = (hashes >> np.uint64(54)).astype(np.float32) * 2 - 1023
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        bits = np.unpackbits(mixed(hashes[at : at + 255, None] * factors).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint8)
        if len(hashes) % 2 == 0:
            unequal += (weights[at : at + 255] @ bits.astype(np.float32)).astype(np.int64)
    lead = votes * 2 - len(hashes)
    won = np.where(lead == 0, unequal * 2 > int(weights.sum(dtype=np.float64)), lead > 0).astype(np.uint8)
    words = np.packbits(won[: 2 * BITS], bitorder="little").view("<i8")
    bands = won[: BANDS * BAND_BITS].reshape(BANDS, BAND_BITS) @ (1 << np.arange(BAND_BITS))
    name = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return name - (name >> 63 << 64), len(hashes), int(words[0]), int(words[1]), bands.tolist()


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with ``node``, ``size``, ``fp``, ``more`` and ``bands`` in place of the text."""
    @F.pandas_udf("node bigint, size bigint, fp bigint, more bigint, bands array<int>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sketch_of(x, shingle) for x in texts], columns=["node", "size", "fp", "more", "bands"])
        release_memory()

    return docs.withColumn("__sketch", sketch(F.col("text"))).select(*[c for c in docs.columns if c != "text"], "__sketch.*")


def verified_forest(node: np.ndarray, root: np.ndarray, block: np.ndarray | None, fp: np.ndarray, more: np.ndarray, sets: list[np.ndarray], near: Near, similarity: float) -> tuple[list, list]:
    """Edges between rows whose sets are at least so similar, as few as connect those that such links connect; at most one for each row.

    ``root`` names what is connected already; with ``block``, only rows of unlike blocks are compared. Sets that
    similar share one of their rarest shingles, those that remain when the share that must be common is left out.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(seen, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    once = int((seen == 1).sum())  # places before this one belong to a single set
    ends = np.cumsum(sizes)
    parts = [np.sort(place[codes[b - n : b]]) for b, n in zip(ends, sizes, strict=True)]
    rare = [p[: n - int(np.ceil(similarity * n - 1e-9)) + 1] for p, n in zip(parts, sizes, strict=True)]
    rare = [p[np.searchsorted(p, once) :] for p in rare]
    tokens, holder = np.concatenate(rare), np.repeat(np.arange(len(node)), [len(p) for p in rare])
    by_token = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[by_token], holder[by_token]
    root, mark = np.unique(root, return_inverse=True)[1], np.zeros(len(seen), dtype=bool)
    tails, heads = [], []
    for i in range(len(node) - 1):
        lo, hi = np.searchsorted(tokens, rare[i], "left"), np.searchsorted(tokens, rare[i], "right")
        found = np.concatenate([holder[:0], *[holder[a:b] for a, b in zip(lo, hi, strict=True) if b - a > 1]])
        found = np.unique(found[(found > i) & (root[found] != root[i])])
        if block is not None:
            found = found[block[found] != block[i]]
        found = found[np.minimum(sizes[found], sizes[i]) >= similarity * np.maximum(sizes[found], sizes[i]) - 1e-9]
        found = found[near(fp[found], more[found], fp[i], more[i])]
        if not len(found):
            continue
        mark[parts[i]] = True
        both = np.add.reduceat(mark[np.concatenate([parts[j] for j in found])], np.r_[0, np.cumsum(sizes[found])[:-1]], dtype=np.int64)
        mark[parts[i]] = False
        found = found[both >= similarity * (sizes[i] + sizes[found] - both) - 1e-9]
        joined, first = np.unique(root[found], return_index=True)
        tails += [node[i]] * len(first)
        heads += node[found[first]].tolist()
        root[np.isin(root, joined)] = root[i]
    return tails, heads


def similar_links(rows: DataFrame, near: Near, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the similar rows of each (k, v, p, q); ``rows`` have ``node``, ``root``, ``block``, ``fp``, ``more`` and ``hashes``."""
    key = ["k", "v", "p", "q"]

    def compare(frames):
        kept = None

        def compared(frame):
            tails, heads = [], []
            starts = np.flatnonzero(np.r_[True, (frame[key].to_numpy()[1:] != frame[key].to_numpy()[:-1]).any(axis=1)])
            for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
                if b - a > 1:
                    part = frame.iloc[a:b]
                    node, root, block = (part[c].to_numpy() for c in ("node", "root", "block"))
                    fp, more = (part[c].to_numpy(dtype="<i8").view("<u8") for c in ("fp", "more"))
                    across = block if part["p"].iloc[0] != part["q"].iloc[0] else None
                    t, h = verified_forest(node, root, across, fp, more, [np.frombuffer(x, dtype="<u8") for x in part["hashes"]], near, similarity)
                    tails += t
                    heads += h
            return pd.DataFrame({"a": np.array(tails, dtype="<i8"), "b": np.array(heads, dtype="<i8")})

        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame[key] == frame[key].iloc[-1]).all(axis=1)
            kept = frame[last]
            if not last.all():
                yield compared(frame[~last])
        if kept is not None:
            yield compared(kept)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(tidy(compare), "a bigint, b bigint").distinct()


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with the first document of each group of near-duplicates; one row of it if that row is repeated.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is at least
    ``similarity``. SimHash fingerprints find what may be: texts that share a band of their bits and differ in few enough
    of 128 of them are connected, and the similarity is computed on the sets' 64-bit hashes inside each component of those.
    A task compares a block of a component and returns a forest of its links, never all pairs; blocks of one
    component are compared with each other if it is still in several parts.
    """
    named = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = materialise(sketches(named, shingle), "sketches")
    values = materialise(rows.groupBy("node").agg(F.min(rank()).alias("first"), *[F.any_value(c).alias(c) for c in ("size", "fp", "more", "bands")]), "values")
    near = Near(2 * BITS, bits_at(similarity, spreads=SPREADS))
    filed = values.select("node", "fp", "more", F.posexplode("bands").alias("k", "v"))
    alike = connected(bucket_links(filed, near, dense=True))
    alike = alike.unionByName(alike.select(F.col("root").alias("node"), "root").distinct())
    alike = materialise(alike.join(values.select("node", "size"), "node").select("node", F.col("root").alias("k"), F.lit(0).alias("v"), "size"), "alike")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("weight") / block_shingles)).cast("int").alias("blocks")
    parts = materialise(alike.groupBy("k", "v").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).select("k", "v", blocks), "parts")
    dealt = alike.join(parts, ["k", "v"]).select("node", "k", "v", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    dealt = materialise(dealt, "dealt")

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_hashes(x, shingle).tobytes() for x in texts], dtype=object)
        release_memory()

    used = values.join(dealt.select("node").distinct(), "node").select("node", "fp", "more", "first").alias("u")
    same = (F.col("d.digest") == F.col("u.first.digest")) & F.col("d.doc_id").eqNullSafe(F.col("u.first.doc_id"))
    texts = named.alias("d").join(used, same).select("u.node", "u.fp", "u.more", "d.text").dropDuplicates(["node"])
    sets = materialise(texts.select("node", "fp", "more", hashed("text").alias("hashes")), "sets")
    inside = dealt.join(sets, "node").withColumns({"root": F.col("node"), "p": F.col("block"), "q": F.col("block")})
    found = materialise(similar_links(inside, near, similarity), "links")
    roots = connected(found)
    cut = dealt.where("blocks > 1")
    if not cut.isEmpty():
        apart = materialise(cut.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "apart")
        open_ = apart.groupBy("k", "v").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("k", "v")
        other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block"))
        pairs = F.explode(F.transform(other, lambda j: F.struct(F.least("block", j).alias("p"), F.greatest("block", j).alias("q")))).alias("b")
        crossing = apart.join(open_, ["k", "v"]).select("node", "root", "k", "v", "block", pairs).select("node", "root", "k", "v", "block", "b.p", "b.q").join(sets, "node")
        roots = connected(found.unionByName(materialise(similar_links(crossing, near, similarity), "links")))
    first = first_of_each(values, roots).select("first.doc_id", "first.digest").distinct().alias("f")
    named = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.__digest") == F.col("f.digest"))
    return named.join(first, same, "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")
