"""Quality classifier, conversation repair and spelling variants: against brute force and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import classifier, conversations, spelling

from .conftest import prose

# ---- spelling variants


def words_by_rule(pairs):
    counts = Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_rule(counts):
    near = {w: [x for x in counts if x != w and one_edit(w, x)] for w in counts}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéÿ×") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    out = []
    for w in words:
        out += [w] * rng.randint(3, 60)
        for _ in range(rng.randint(0, 5)):
            at, letter = rng.randrange(len(w)), rng.choice("abcé")
            out += [rng.choice([w[:at] + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :]])] * rng.randint(2, 20)
    rng.shuffle(out)
    return [(k, " ".join(out[at : at + 40])) for k, at in enumerate(range(0, len(out), 40))]


def test_spelling_variants(make_docs, odd_texts, misspelt):
    pairs = [*odd_texts, *((1000 + k, t) for k, t in misspelt), (None, "Wordy WORDY wordy words")]
    docs = make_docs(pairs)
    expected = variants_by_rule(words_by_rule(pairs))
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == expected and any(r[1] for r in expected) and any(r[1] != r[2] for r in expected if r[1])
    # many cells, cut into blocks, on a small sample
    small = spelling.spelling_variants(docs, cell_letters=40, sample=60)
    assert {tuple(r) for r in small.collect()} == expected
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_blocks_of_one_cell(spark):
    """Words whose letters are alike cannot be cut by counts; blocks still compare each with each."""
    words = sorted({"".join(p) for p in itertools.permutations("aabbcd")} | {"".join(p) for p in itertools.permutations("aabbce")})
    df = spark.createDataFrame([(w, 1 + k % 7) for k, w in enumerate(words)], "word string, n bigint")
    got = {tuple(r) for r in spelling.variants(df, cell_letters=100, sample=50).collect()}
    assert got == variants_by_rule({w: 1 + k % 7 for k, w in enumerate(words)})


def test_tree_leaves_out_only_what_is_far():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(6)) for _ in range(400)})
    vectors = spelling.letter_counts(spelling.letter_codes(words))
    tree = spelling.Tree(vectors, 8)
    met = defaultdict(set)
    for _, rows, asked in tree.reached(vectors, 2):
        for q in asked:
            met[int(q)] |= set(rows.tolist())
    near = np.abs(vectors[:, None] - vectors[None]).sum(axis=2) <= 2
    assert all(set(np.flatnonzero(near[q])) <= met[q] for q in range(len(words)))
    assert sum(map(len, met.values())) < len(words) ** 2 / 2 and tree.leaves > 20


# ---- conversations


def cheapest(rows):
    """Least (cost, audit, turns) over all edits of (initial, must go, extra), by trying every sequence of them."""
    found = []

    def walk(at, cost, audit, turns):
        if cost > limit:
            return
        out = turns.replace("-", "")
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit, turns))
        if len(audit) < 2 * len(rows) + 2:
            for s in "ua":
                walk(at, cost + 3, audit + "I", turns + s)
        if at < len(rows):
            initial, must_go, extra = rows[at]
            walk(at + 1, cost + 4, audit + "D", turns + "-")
            if not must_go:
                walk(at + 1, cost + extra, audit + "K", turns + (initial or "?"))
                for s in "ua":
                    walk(at + 1, cost + 3 + extra, audit + "R", turns + s)

    limit = min(4 * len(rows), 14)
    walk(0, 0, "", "")
    return min(found) if found else None


def test_parse_is_the_cheapest_edit():
    rng, stacks = random.Random(8), conversations.Stacks()
    for _ in range(250):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.15, rng.choice([0, 0, 3])) for _ in range(rng.randint(0, 4))]
        expected = cheapest(rows)
        if expected is not None:
            assert conversations.best_end(stacks, conversations.parse(stacks, 0, rows)) == expected, rows
    assert stacks.accepts(0) and [s for s in ("ua", "sua", "uaua", "u", "s", "au", "suas") if any(map(stacks.accepts, read(stacks, s)))] == ["ua", "sua", "uaua"]


def read(stacks, turns):
    nodes = [0]
    for s in turns:
        nodes = [to for node in nodes for to in stacks.after(node, s)]
    return nodes


def report_by_rule(rows):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 and text is not None else text
        groups[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out, stacks = {}, conversations.Stacks()
    for c, part in groups.items():
        digest = lambda x: hashlib.md5(("" if x is None else "t" + x).encode()).hexdigest()
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", digest(r[2])))
        faults, seen = [], set()
        for _, role, text in part:
            end = (text or "").rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
            seen.add((role, text))
        initials = [(role or "")[:1] for _, role, _ in part]
        turns = [t for t, _, _ in part if t is not None]
        shapes = [(i, f in ("blank", "duplicate"), 3 if f == "truncated" else 0) for i, f in zip(initials, faults, strict=True)]
        cost, audit, kept = conversations.best_end(stacks, conversations.parse(stacks, 0, shapes))
        lines, at = [], iter(part)
        for edit, s in zip(audit, kept, strict=True):
            name = {"u": "user", "a": "assistant"}.get(s)
            if edit == "I":
                lines.append(f"{name}:")
                continue
            _, role, text = next(at)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else name}:{text}")
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks(spark):
    rng, rows = random.Random(2), []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "assistant" if t % 2 else "user", "system" if t == 0 else "user", None, "tool", ""])
            rows.append((c, None if rng.random() < 0.04 else t + (t > 3) * rng.randint(0, 2), role, rng.choice([None, "", " \t", "same text.", f"one {c} {t}.", f"cut {t}", f"odd {t}! \n"])))
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 50}.") for t in range(700)]
    rows += [(77, 1, "user", "again.")] * 30 + [(78, 1, "user", "x" * 50_000 + "."), (78, 2, "assistant", "y")]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string, c string")


@pytest.mark.parametrize("piece", [512, 5])
def test_conversation_repair(talks, piece):
    rows, df = talks
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_report(df.repartition(4), piece).collect()}
    assert got == report_by_rule(rows)
    assert conversations.repair_report(df.limit(0)).count() == 0


def test_repaired_turns_are_well_formed(talks):
    """The rows that repair gives back, whatever the pieces, with no damage done before."""
    _, df = talks
    seen = []
    for piece in (512, 6):
        turns = conversations.Repairs(df, piece).turns
        by = turns.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("number", "at", "role", "text"))).alias("x")).collect()
        assert all(re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["x"])) for r in by)
        seen.append({r["c"]: [(t["role"], t["text"]) for t in r["x"]] for r in by})
    assert seen[0] == seen[1] and len(seen[0]["i99"]) < 120


# ---- classifier


def test_classifier_on_held_out_labels(spark, make_docs, odd_texts):
    rng = random.Random(6)
    pairs, marks = [], []
    for k in range(400):
        text = prose(9000 + k, rng.randint(60, 200))
        good = k % 4 != 0
        pairs.append((k, text if good else " ".join(w + "$$$" for w in text.split()) if k % 8 else text.upper()))
        marks.append((k, int(good)))
    docs = make_docs([*pairs, *((10_000 + (i or 0), t) for i, t in odd_texts), (None, "no id here.")])
    labels = spark.createDataFrame([*((*m, 0) for m in marks), (1, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = classifier.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = dict(marks)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, classifier.quality_scores(docs, flipped).collect())) == sorted(map(str, rows))
    none = classifier.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_flattened_trees_walk_as_nodes_do():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    trees = classifier.fit(x, y, trees=30, depth=3)

    def walk(row):
        total = trees.start
        for s, c, v in zip(trees.statistic, trees.cut, trees.value, strict=True):
            at = 0
            while at < len(s):
                at = 2 * at + (2 if row[s[at]] > c[at] else 1)
            total += v[at - len(s)]
        return 1 / (1 + np.exp(-total))

    scores = trees.scores(x)
    assert np.allclose(scores, [walk(r) for r in x]) and ((scores > 0.5) == y).mean() > 0.97
    assert len(classifier.statistics_of(None)) == len(classifier.STATISTICS) == len(classifier.statistics_of("a b\n" * 9))
