"""Quality rules, benchmark passages, URL rules, language: against plain versions on small tables."""

import hashlib
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldglass.llm import decontam, langid, quality, url_rules

from .conftest import prose


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeat = len({p for i, w in enumerate(windows) if n[w] > 1 for p in (i, i + 1, i + 2)})
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed


def test_quality_counts(make_docs, odd_texts):
    texts = [*odd_texts, (20, "a b c a b c d e f\nx\nx\n\n \nx"), (21, "the end. " * 60), (22, "a b a b a")]
    got = quality.quality_report(make_docs(texts)).collect()
    assert len(got) == len(texts)
    key = lambda i, row: (i is None, i or 0, row)
    assert sorted(key(r["doc_id"], tuple(r[1:7])) for r in got) == sorted(key(i, plain_quality(t)) for i, t in texts)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_verdicts_and_cleaning(make_docs):
    good = prose(5, 150)
    menu = "\n".join(" | ".join(f"item{k}{j}" for j in range(9)) for k in range(12))
    signs = " ".join(f"{w}***" for w in prose(6, 80).split())
    notice = "All rights reserved."
    docs = make_docs([(1, good), (2, menu), (3, signs), (4, good + "\n" + notice), (5, None), (1, good)])
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs).collect()}
    assert verdicts == {1: True, 2: False, 3: False, 4: True, 5: False}
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in cleaned.collect()) == [(1, good), (1, good), (4, good)]
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_wrapped_prose_and_unmarked_scripts_stay(make_docs):
    sentence = "the river that had been low since the end of a dry spring rose again in the night and carried away the wooden bridge below the mill"
    more = "It was rebuilt, in the years after the war by people from the villages on both banks who needed it to reach their fields and the old market. Nobody knows who paid"
    wrapped = "\n".join(textwrap.wrap(f"{sentence}. {more}", 60)) + "."
    thai = "\n".join(" ".join("ภาษาไทยเขียนติดกัน" + "กขคง"[k % 4] * (k + j + 1) for k in range(9)) for j in range(7))
    salad = "\n".join(f"Home news sport weather travel culture money list number {k}" for k in range(12))
    docs = make_docs([(1, wrapped), (2, thai), (3, salad), (4, wrapped + "\n" + salad.split("\n")[0])])
    got = {r["doc_id"]: (r["kept"], r["lost_chars"]) for r in quality.quality_report(docs).collect()}
    assert got[1] == (True, 0) and got[2] == (True, 0) and not got[3][0]
    assert got[4] == (True, len(salad.split("\n")[0].replace(" ", "")))
    assert {r["doc_id"]: r["text"] for r in quality.clean(docs).collect()} == {1: wrapped, 2: thai, 4: wrapped}


def test_quality_sql(make_docs, odd_texts, tmp_path):
    import duckdb

    lines = ["one two three four five six seven eight nine", "ten, it was told;", "ends here.", "small letters go on and on without a single mark", "Ünd weiter «so» geht es über viele Zeilen ohne", "", " indented line of eight or more words in all", "a\u061b b c d e f g h i"]
    texts = [*odd_texts, *((100 + k, "\n".join(lines[(k * j) % 7] for j in range(1, 12))) for k in range(30)), (200, "\n".join(lines)), (201, "x y z 'a b' c/d e@f g h"), (202, "end.\nsmall after a stop and eight more words here")]
    docs = make_docs(texts)
    docs.select("doc_id", "text").toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM '{tmp_path}/d.parquet'")
    got = quality.quality_report(docs)
    want = con.sql(quality.quality_sql())
    pick = ", ".join(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, con.sql(f"SELECT {pick} FROM ({quality.quality_sql()})").fetchall())), want


def test_quality_is_row_local_and_native(make_docs):
    plan = quality.quality_report(make_docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def plain_hits(text, items):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, content in items:
        own = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), content or ""))
        n = min(10, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == own[a : a + n]:
                    hit |= set(range(b, b + n))
                    if item is not None:
                        found.add(item)
    ids = sorted(map(str, found))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


ITEMS = [(1, prose(50, 30)), (2, "Three short WORDS"), (10, prose(51, 12)), (3, None), (4, "--"), (None, prose(52, 11)), (1, prose(50, 30))]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.fixture(scope="module")
def leaks(odd_texts):
    shout = re.sub(" ", " - ", prose(50, 30)).upper()
    short = [x for x in odd_texts if x[0] not in (8, 9, 11)]
    return [*short, (30, prose(7, 40) + " " + prose(50, 30) + " " + prose(8, 40)), (31, "see three  short\nwords, " + prose(9, 30)), (32, shout), (33, prose(52, 11) + " " + prose(10, 50))]


@pytest.mark.parametrize("most", [decontam.MAX_WINDOWS, 3])
def test_decontamination(make_docs, benchmark, leaks, most):
    """Both ways of finding windows, the set and the join, against all pairs."""
    got = decontam.contamination(make_docs(leaks), benchmark, max_windows=most).collect()
    key = lambda i, row: (i is None, i or 0, row)
    assert sorted(key(r["doc_id"], tuple(r[1:])) for r in got) == sorted(key(i, plain_hits(t, ITEMS)) for i, t in leaks)


def test_passages_are_cut(make_docs, benchmark, leaks, spark):
    docs = make_docs(leaks)
    out = decontam.decontaminate(docs, benchmark)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    clean = {i: t for i, t in leaks if not plain_hits(t, ITEMS)[1]}
    assert out.columns == docs.columns and {i: rows[i] for i in clean} == clean
    assert 32 not in rows
    assert rows[30] == prose(7, 40).rstrip(".") + " " + prose(8, 40) or not plain_hits(rows[30], ITEMS)[1]
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(docs, empty).where("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("most", [decontam.MAX_WINDOWS, 3])
def test_capitals_do_not_shift_the_cut(make_docs, benchmark, most):
    """Exact texts left: 'I', acronyms and camel case before the passage, and a passage in capitals."""
    before, after, passage = prose(60, 60), prose(61, 60), prose(50, 30)
    mixed = "I saw that NASA and the EU use myCamelCase and A B C D E F G H, as I said. " + before
    cases = {40: (mixed, passage), 41: (before, passage.upper()), 42: (mixed, passage.title())}
    docs = make_docs([(k, f"{a} {p} {after}") for k, (a, p) in cases.items()])
    left = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, benchmark, max_windows=most).collect()}
    assert left == {k: f"{a} . {after}" for k, (a, _) in cases.items()}


def test_url_rules(spark):
    rows = [
        (1, "http://a.example.com/en/1"), (2, "http://www.example.com/en/1"), (3, "https://x.net/es/"), (4, "https://x.net/fr/2?q=/es/"), (5, "HTTP://X.NET/de/"), (6, None),
        (7, "no scheme"), (8, "http://casino.example.org"), (9, "http://online-casino.example.org/x"), (10, "http://com"), (11, "http://com/"), (12, "http://ex.org/wp-login.php"),
        (13, "http://a.example.com/en/1"), (13, "http://a.example.com/en/1"), (14, "http://Free-Bets.example.org:80#x"), (15, "http://better-free.example.org/casinos"), (16, "http://notexample.com/en/"), (17, "")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id bigint, url string, rule string, _host string")
    out = url_rules.judge_urls(pages)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4] == ("x.net", "/fr/2", "net/fr/", "block") and got[5] == ("x.net", "/de/", None, "allow")
    assert got[6] == got[7] == got[17] == ("", "", None, "allow")
    assert got[8] == ("casino.example.org", "", None, "block") and got[9][3] == "block" and got[12][3] == "block"
    assert got[10] == ("com", "", None, "allow") and got[11] == ("com", "/", "com/", "allow")
    assert got[14] == ("free-bets.example.org:80", "", None, "block") and got[15][3] == "allow" and got[16][2] == "com/"
    for r in out.collect():  # the index must lose no rule
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["host"] + r["path"])
        plain = next((p.verdict for p in url_rules.PATTERN_RULES if re.search(p.pattern, text)), "allow")
        assert r["rule"] is not None or r["verdict"] == plain
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_language(spark, make_docs, odd_texts):
    words = {"aa": "der die und ein nicht schön über", "bb": "the and of that with which", "cc": "les des une dans pour être"}
    pairs, langs = [], []
    for k, (lang, own) in enumerate(words.items()):
        for n in range(40 if lang != "bb" else 60):
            own_words = own.split()
            pairs.append((1000 * k + n, " ".join(own_words[(n * j + j * j) % len(own_words)] for j in range(30))))
            langs.append(lang)
    docs = make_docs(pairs, langs)
    truth = dict(zip([i for i, _ in pairs], langs, strict=True))
    got = langid.predicted_languages(docs).collect()
    assert len(got) == len(pairs) and any(r["held_out"] for r in got)
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in got)
    fold = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("h")).collect()}
    assert all(r["held_out"] == fold[r["doc_id"]] for r in got)
    languages, planes = langid.learn(docs)
    assert languages[0] == "bb"
    odd = make_docs([*odd_texts, (40, "123 !?"), (41, "Ω"), (42, "the and of der")])
    found = [(r["doc_id"], r["__lang"]["lang_pred"], r["__lang"]["score"]) for r in langid.identify(odd, languages, planes).collect()]
    by = {i: (x, s) for i, x, s in found}
    assert all(by[i] == ("und", 0.0) for i in (3, 4, 5, 11, 40)) and by[41][0] in languages and by[42][0] == "bb"
    # labels of the held-out fold, and everything but the text, are never read
    hidden = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, langid.predicted_languages(hidden).collect())) == sorted(map(tuple, got))
    assert {r["lang_pred"] for r in langid.predicted_languages(odd).collect()} == {"und"}
    assert langid.predicted_languages(docs.limit(0)).count() == 0


def test_more_than_eight_languages(make_docs):
    letters = "abcdefghijkl"
    pairs = [(100 * k + n, " ".join([c * 3 + letters[(k + 1) % 12], c * 4, c + letters[k - 1] + c]) * 3) for k, c in enumerate(letters) for n in range(8)]
    truth = {i: letters[i // 100] for i, _ in pairs}
    got = langid.predicted_languages(make_docs(pairs, [truth[i] for i, _ in pairs])).collect()
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got)
