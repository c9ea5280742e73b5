"""Acronyms by context and the composed ingest, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import acronyms, ingest, models
from fieldglass.plans import Tables, load_all
from fieldglass.sources import versions

FOLDER = "/root/testdata/sf0.001"
MEANINGS = "acronym string, expansion string, variants array<string>, candidates array<string>"
KNOWN = [
    ("UE", "User Equipment", [], None),
    ("CA", None, ["c.a"], ["Carrier Aggregation", "Certificate Authority"]),
    ("BW", None, None, ["Bandwidth", "Bandwidth"]),
]


def words(text):
    return set(re.findall(r"\w+", text.lower()))


def brute_choice(acronym, candidates, context):
    scored = sorted((-len(words(c) & words(context)), c) for c in set(candidates))
    if scored[0][0] < 0 and (len(scored) == 1 or scored[0][0] < scored[1][0]):
        return scored[0][1]
    return None


def brute_expand(text, dictionary, choice=brute_choice):
    """Unambiguous entries first; contexts are those of the text they leave."""
    if text is None:
        return None
    put = lambda t, form, gloss: re.sub(rf"\b{re.escape(form)}\b(?!\()", lambda m: f"{form}({gloss})", t)
    for a, meaning, variants, candidates in sorted(dictionary, key=lambda d: d[0]):
        if candidates is None:
            for form in [a, *(variants or [])]:
                text = put(text, form, meaning)
    found = [(d, re.search(rf"\b{re.escape(d[0])}\b", text)) for d in sorted(dictionary, key=lambda d: d[0]) if d[3] is not None]
    contexts = [(d, text[max(0, m.start() - 200) : m.end() + 200]) for d, m in found if m]
    for (a, _, variants, candidates), context in contexts:
        chosen = choice(a, candidates, context)
        gloss = chosen if chosen in candidates else "|".join(candidates)
        for form in [a, *(variants or [])]:
            text = put(text, form, gloss)
    return text


TEXTS = [
    "the carrier of CA and CA(x) c.a UE", "a certificate from the authority, CA", "CA alone", "authority of a carrier CA", "ca CAs carrier", "", None,
    "CA, certificate." + " z" * 300 + " carrier aggregation CA", "carrier aggregation" + " z" * 300 + " CA", "bandwidth of BW UE(x)", "BW", "the carrier of CA and CA(x) c.a UE",
    "CA carrier 캐리어CA를 CA", "$1 \\ CA carrier",
]


@pytest.mark.parametrize("given", ["overlap", "model"])
def test_meaning_by_context(spark, given):
    pick = lambda a, c, context: {"CA": "Certificate Authority", "BW": "none of them"}[a]
    column = F.udf(lambda a, c, x: pick(a, c, x), "string")
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(TEXTS)], "i int, text string, gloss string")
    known = spark.createDataFrame(KNOWN, MEANINGS)
    got = acronyms.expand_by_context(docs, known, choose=column if given == "model" else None)
    assert got.columns == ["i", "text", "gloss", "expanded"]
    want = {i: brute_expand(t, KNOWN, pick if given == "model" else brute_choice) for i, t in enumerate(TEXTS)}
    assert {r.i: r.expanded for r in got.collect()} == want
    assert acronyms.expand_by_context(docs.filter("false"), known).count() == 0


def test_acronym_choice_on_whole_documents(spark):
    t = Tables(spark, FOLDER)
    from fieldglass.plans.text import ambiguous_acronyms

    known = [(r.acronym, None, None, r.candidates) for r in ambiguous_acronyms(t).collect()]
    want = {r.doc_id: brute_expand(r.text, known) for r in t.documents.collect()}
    got = {r.doc_id: r.expanded for r in load_all()["acronym_choice"][0](t).collect()}
    assert got == want and any(v != r for v, r in zip(want.values(), (r.text for r in t.documents.collect())))


DOCS = [
    ("a.md", "spec", "# 1 Scope\nthe UE moves\n## 2 Abbreviations\n\nHO Handover\n\n# 3 Rest\nHO of the UE, Radio Link"),
    ("b.md", "mop", "HO here " + "w " * 600),
    ("c.md", "mop", None), ("d.md", "mop", "  "), (None, "mop", "x"), ("a/b.md", "mop", "radio link radio"),
]


def test_ingest_replaces_by_source(spark, tmp_path, rows):
    docs = spark.createDataFrame(DOCS, "source_doc string, doc_type string, text string")
    known = spark.createDataFrame([("UE", "User Equipment")], "acronym string, expansion string")
    terms = spark.createDataFrame([("Radio Link",), ("handover",), ("link",)], "term string")
    target = str(tmp_path / "store")
    assert ingest.ingest(docs, target, "one", known, terms, models.hash_encoder(8)) == 0
    first = versions.read_live(spark, target, "source_doc")
    got = {(r.source_doc, r.chunk_index): r for r in first.collect()}
    assert {k[0] for k in got} == {"a.md", "b.md", "a/b.md"} and sum(k[0] == "b.md" for k in got) == 2
    assert "HO(Handover) here" in got["b.md", 0].text and got["b.md", 0].keywords == ["handover"]
    assert got["a/b.md", 0].keywords == ["Radio Link", "link"] and got["a/b.md", 0].n_keywords == 2
    assert got["b.md", 1].keywords == [] and got["b.md", 1].n_keywords == 0
    assert any("HO(Handover) of the UE(User Equipment), Radio Link" in r.text for k, r in got.items() if k[0] == "a.md")
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in got.values())
    # the same writer changes nothing, another replaces one source and leaves those that give no chunk
    assert ingest.ingest(docs.filter("false"), target, "one", known, terms, models.hash_encoder(8)) == 0
    update = spark.createDataFrame([("b.md", "mop", "short UE"), ("a.md", "spec", None)], docs.schema)
    assert ingest.ingest(update, target, "two", known, terms, models.hash_encoder(8), most=1) == 1
    after = {(r.source_doc, r.chunk_index): r.text for r in versions.read_live(spark, target, "source_doc").collect()}
    assert after == {k: r.text for k, r in got.items() if k[0] != "b.md"} | {("b.md", 0): "short UE(User Equipment)"}
    assert rows(ingest.rejected(docs, "source_doc")) == [("c.md", "no text"), ("d.md", "empty text"), (None, "no source")]


def test_composed_ingest_on_whole_documents(spark):
    import hashlib

    t = Tables(spark, FOLDER)
    from fieldglass.plans.text import document_acronyms, long_words

    known = [(r.acronym, r.expansion, None, None) for r in document_acronyms(t).collect()]
    terms = {}
    for r in long_words(t).collect():
        terms.setdefault(r.term.lower(), set()).add(r.term)
    want = {}
    for r in t.documents.collect():
        assert not re.search(r"(?m)^#{1,6}\s", r.text)  # so specifications are cut by size too
        parts = brute_expand(r.text, known).split()
        for i in range(0, len(parts), 500):
            chunk = " ".join(parts[i : i + 500])
            tags = sorted(set().union(*(terms.get(w, set()) for w in words(chunk))))
            want[str(r.doc_id), i // 500] = ("spec" if r.lang == "en" else "mop", hashlib.sha256(chunk.encode()).hexdigest(), "|".join(tags), 32)
    got = load_all()["composed_ingest"][0](t).collect()
    assert len(got) == len(want) == len({r.chunk_id for r in got})
    assert {(r.source_doc, r.chunk_index): (r.doc_type, r.text_sha256, r.keywords, r.dims) for r in got} == want


def test_ingest_reads_each_text_once_for_a_step(spark):
    """Chunks and the dictionary are written down, and the rows of both are not made again for tags."""
    docs = spark.createDataFrame(DOCS, "source_doc string, doc_type string, text string")
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    read = F.udf(seen, "string").asNondeterministic()
    known = docs.select(F.explode(F.split(read(F.coalesce("text", F.lit("none"))), "\\s+")).alias("acronym")).filter("acronym = 'UE'").distinct().withColumn("expansion", F.lit("User Equipment"))
    terms = spark.createDataFrame([("link",)], "term string")
    got = ingest.prepare_chunks(docs, known, terms, models.hash_encoder(8))
    rows = {(r.source_doc, r.chunk_index): (r.text, r.keywords) for r in got.collect()}
    assert made.value == len(DOCS) and rows["a/b.md", 0] == ("radio link radio", ["link"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "posexplode" not in plan  # neither expanded nor cut again for tags


def test_words_are_hashed_once_by_the_encoder(monkeypatch):
    import hashlib

    encode, hashed = models.hash_encoder(8), []
    sha1 = hashlib.sha1
    monkeypatch.setattr(hashlib, "sha1", lambda b: hashed.append(b) or sha1(b))
    got = encode(["b a B", "", "a é\x1cb"])
    place = lambda w: int.from_bytes(sha1(w.encode()).digest()[:4], "big") % 8
    for v, text in zip(got, (["b", "a", "b"], [], ["a", "é", "b"]), strict=True):
        assert v.tolist() == [float(sum(place(w) == i for w in text)) for i in range(8)]
    assert sorted(hashed) == [b"a", b"b", "é".encode()]


def test_candidate_words_miss_none(spark):
    """Rules whose words begin with many characters or few, with letters beyond the BMP and inside other words."""
    texts = ["AB xAB AB_ 가나 \U00010400A AB(x)", "(AB)AB", "áAB AB́ AB.", "AB", "", None, "\U00010400\U00010401 B1 ÉA", "가나다 가나", "$AB -B1- AB-B1"]
    forms = ["AB", "B1", "가나", "\U00010400A", "\U00010400\U00010401", "ÉA", "AB-B1", "-B1", "$AB"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    few = [(f, f"long {i}") for i, f in enumerate(forms)]
    many = few + [(chr(0x4E00 + i) + "x", "none") for i in range(80)]
    for known in (few, many):
        got = acronyms.expand_text(docs, spark.createDataFrame(known, "acronym string, expansion string"))
        old = F.col("text")
        for form, gloss in sorted(known, key=lambda k: k[0].encode()):
            put = f"{form}({gloss})".replace("$", "\\$")
            old = F.regexp_replace(old, F.lit(rf"(?U)\b\Q{form}\E\b(?!\()"), F.lit(put))
        assert {r.i: r.expanded for r in got.collect()} == {r.i: r.x for r in docs.select("i", old.alias("x")).collect()}
