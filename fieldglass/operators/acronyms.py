"""Acronym dictionaries: extraction, merging, expansion in texts and queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import let, strip
from fieldglass.operators.terms import match_terms, quoted
from fieldglass.session import cut_lineage, write_down


#: Characters that words are sought by in a pattern; for more, texts are split into all their words.
MOST_STARTS = 64


def abbreviation_section(text: Column) -> Column:
    """Body of the abbreviations section up to the next heading, null when there is none."""
    return F.when(text.contains(fixed.ACRONYM_TITLE) & text.rlike(fixed.ACRONYM_SECTION), F.regexp_extract(text, fixed.ACRONYM_SECTION, 1))


def likely_acronym(token: Column) -> Column:
    return (
        F.length(token).between(2, 20)
        & token.rlike("[A-Z]")
        & ~token.rlike("^[A-Z][a-z]+$")
        & ~token.rlike(r"[_-]n?[XYZ](?:[_-]|$)")
    )


def clean_expansion(raw: Column, acronym: Column) -> Column:
    """Markup and remarks removed, emphasised capitals of the first word lowered; null when nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(raw, r"\*([^*]+)\*", "$1"), "_([^_]+)_", "$1")
    plain = strip(F.substring_index(strip(F.regexp_replace(plain, r"[\s>\\|]+$", "")), ";", 1))
    first = F.regexp_extract(plain, r"^(\S+)", 1)
    capitals = F.regexp_replace(first, r"[^\p{Lu}]", "")
    styled = first.rlike(r"[^-]\p{Lu}") & (capitals == F.translate(acronym, "_-", ""))
    lowered = F.concat(
        F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, F.length(first))),
        F.substring(plain, F.length(first) + 1, F.length(plain)),
    )
    return F.nullif(F.when(styled, lowered).otherwise(plain), F.lit(""))


def section_entries(section: Column) -> Column:
    """Array of (acronym, raw expansion) in line order; unmatched lines continue the entry above."""
    entry_type = "array<struct<acronym:string,raw:string>>"
    start = F.struct(
        F.array().cast(entry_type).alias("done"),
        F.lit(None).cast("string").alias("acronym"),
        F.lit("").alias("raw"),
    )

    def closed(s: Column) -> Column:
        return F.when(s.acronym.isNull(), s.done).otherwise(
            F.array_append(s.done, F.struct(s.acronym.alias("acronym"), s.raw.alias("raw")))
        )

    def step(s: Column, line: Column) -> Column:
        token = F.regexp_replace(F.regexp_extract(line, fixed.ACRONYM_ENTRY, 1), r"\\([_\-])", "$1")
        opens = line.rlike(fixed.ACRONYM_ENTRY) & likely_acronym(token)
        blank = strip(line) == ""
        return F.struct(
            F.when(blank | opens, closed(s)).otherwise(s.done).alias("done"),
            F.when(blank, F.lit(None)).when(opens, token).otherwise(s.acronym).alias("acronym"),
            F.when(blank, F.lit(""))
            .when(opens, F.regexp_extract(line, fixed.ACRONYM_ENTRY, 2))
            .otherwise(F.concat_ws(" ", s.raw, strip(line)))
            .alias("raw"),
        )

    lines = F.split(section, r"\r?\n")
    return F.aggregate(lines, start, step, closed)


def extract_entries(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Acronym entries of every document with their place: ``(path, line, acronym, expansion)``."""
    rows = docs.select(F.col(path).alias("path"), F.posexplode(section_entries(abbreviation_section(F.col(text)))).alias("line", "e"))
    return rows.select(
        "path", "line", "e.acronym", clean_expansion(F.col("e.raw"), F.col("e.acronym")).alias("expansion")
    ).filter(F.col("expansion").isNotNull())


def build_dictionary(entries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First expansion per acronym in path and line order; entries of ``existing`` always stay."""
    found = entries.select("acronym", "expansion", F.lit(1).alias("p"), "path", "line")
    if existing is not None:
        old = existing.select(
            "acronym", "expansion", F.lit(0).alias("p"),
            F.lit(None).cast(entries.schema["path"].dataType).alias("path"), F.lit(0).alias("line"),
        )
        found = found.unionByName(old)
    return found.groupBy("acronym").agg(F.min_by("expansion", F.struct("p", "path", "line")).alias("expansion"))


def ordered_forms(dictionary: DataFrame) -> DataFrame:
    """Rewriting rules ``(pos, form, gloss)`` in order of application.

    Unambiguous acronyms come first, then conflicts with all candidates; each
    acronym is followed by its variants. ``dictionary``: acronym, expansion,
    variants, candidates (null unless ambiguous).
    """
    has = lambda c, kind: F.col(c) if c in dictionary.columns else F.lit(None).cast(kind)
    d = dictionary.select(
        "acronym",
        F.coalesce(F.array_join(has("candidates", "array<string>"), "|"), has("expansion", "string")).alias("gloss"),
        has("candidates", "array<string>").isNotNull().cast("int").alias("conflict"),
        F.coalesce(has("variants", "array<string>"), F.array().cast("array<string>")).alias("variants"),
    )
    return d.select(
        "conflict", "acronym", "gloss", F.posexplode(F.concat(F.array("acronym"), F.col("variants"))).alias("v", "form")
    )


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, f"{fixed.NON_WORD_CLASS}+"), lambda w: w != ""))


def _words_from(text: Column, starts: list[str]) -> Column:
    """At least the words of ``_words`` that begin with one of ``starts``; from inside another word also its rest."""
    if len(starts) > MOST_STARTS:
        return _words(text)
    if not starts:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{''.join(starts)}]{fixed.WORD_CLASS}*+"), F.lit(0)))


def _form_pattern(form: Column) -> Column:
    """A written form as a whole word that no bracket follows; the form comes first, as a border is slow to seek."""
    return F.concat(F.lit("(?U)"), quoted(form), F.lit(r"(?<=\b"), quoted(form), F.lit(r")\b(?!\()"))


def _form_put(form: Column, gloss: Column) -> Column:
    return F.regexp_replace(F.concat(form, F.lit("("), gloss, F.lit(")")), r"[\\$]", r"\\$0")


def rewriting_rules(dictionary: DataFrame) -> DataFrame:
    """``(rule, word, brings)``: place, pattern and replacement of each rule, the first word of its form and the words of its gloss."""
    forms = ordered_forms(dictionary).filter("form IS NOT NULL AND gloss IS NOT NULL")
    form, gloss = F.col("form"), F.col("gloss")
    rule = F.struct("conflict", "acronym", "v", _form_pattern(form).alias("pattern"), _form_put(form, gloss).alias("put"))
    return forms.select(rule.alias("rule"), F.coalesce(F.get(_words(F.col("form")), F.lit(0)), F.lit("")).alias("word"), _words(F.col("gloss")).alias("brings"))


def rules_of_texts(texts: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """``(_key, rules)``: for each different text, by its MD5, the rules that may change it, in order.

    A rule may apply if the first word of its form stands in the text or in the gloss of an
    earlier rule that may apply. The closure is semi-naive: only pairs new in the last round are
    joined with the rules that glosses bring; a rule brings later ones only, so rounds end.
    """
    brought = rules.select("rule", F.explode("brings").alias("word")).join(rules.select(F.col("rule").alias("later"), "word"), "word").filter(F.col("later") > F.col("rule")).select("rule", "later").distinct()
    steps = cut_lineage(brought)
    # a form without a word is tried on every text
    # the key is made before the words are exploded, once for a text
    starts = [r[0] for r in rules.filter("word != ''").select(F.substring("word", 1, 1)).distinct().collect()]  # as many as letters
    keyed = texts.select(F.md5(text).alias("_key"), F.array_append(_words_from(F.col(text), starts), F.lit("")).alias("words"))
    words = keyed.select("_key", F.explode("words").alias("word"))
    newest = cut_lineage(words.join(rules.select("rule", "word"), "word").select("_key", "rule").distinct())
    found = newest
    while not newest.isEmpty():
        following = newest.join(steps, "rule").select("_key", F.col("later").alias("rule")).distinct()
        newest = cut_lineage(following.join(found, ["_key", "rule"], "left_anti"))
        found = found.unionByName(newest)
    return found.groupBy("_key").agg(F.array_sort(F.collect_list("rule")).alias("rules"))  # of one text's own words and their glosses


def expand_text(texts: DataFrame, dictionary: DataFrame, text: str = "text", out: str = "expanded") -> DataFrame:
    """``HO`` -> ``HO(Handover)`` unless a bracket follows, rule after rule.

    A rule sees the text as the rules before left it. Each text meets only the rules that its
    words, or glosses put into it, can start; they are applied by one fold in its row. A null text
    stays null, and rules without a gloss are none.
    """
    rules = write_down(rewriting_rules(dictionary))
    if rules.isEmpty():
        return texts.withColumn(out, F.col(text))
    own = rules_of_texts(texts, rules, text).select(F.col("_key").alias("_k"), F.col("rules").alias("_rules"))
    done = F.aggregate("_rules", F.col(text), lambda t, r: F.regexp_replace(t, r["pattern"], r["put"]))
    joined = texts.join(own, F.md5(text) == F.col("_k"), "left")
    return joined.withColumn(out, F.when(F.col("_rules").isNull(), F.col(text)).otherwise(done)).drop("_k", "_rules")


def choose_by_overlap(acronym: Column, candidates: Column, context: Column) -> Column:
    """The candidate with most words in the context, null unless one has more than every other."""

    def score(seen: Column) -> Column:
        shared = lambda c: -F.size(F.array_intersect(_words(F.lower(c)), seen))
        return F.array_sort(F.transform(F.array_distinct(candidates), lambda c: F.struct(shared(c).alias("s"), c.alias("c"))))

    def first(scored: Column) -> Column:
        best, next_ = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
        return F.when((best["s"] < 0) & (next_.isNull() | (best["s"] < next_["s"])), best["c"])

    return let(let(_words(F.lower(context)), score), first)


def _plain(term: Column) -> Column:
    return F.coalesce(term.rlike("^[A-Za-z0-9_]+$"), F.lit(False))


def _whole_word(text: Column, term: Column) -> Column:
    """The rule of ``match_terms`` for a plain term."""
    return F.rlike(F.lower(text), F.concat(F.lit(f"(?<!{fixed.WORD_CLASS})"), quoted(F.lower(term)), F.lit(f"(?!{fixed.WORD_CLASS})")))


def _standing(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of text and term; a plain term's are those with the term in the text as it is written, others those of ``match_terms``."""
    plain = _plain(F.col("term"))
    runs = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+"), F.lit(0)))
    found = texts.select(key, F.explode(runs).alias("term")).join(terms.filter(plain), "term").select(key, "term")
    other = terms.filter(~plain)
    return found if other.isEmpty() else found.unionByName(match_terms(texts, other, key, text))


def resolved_conflicts(
    texts: DataFrame, conflicts: DataFrame, key: str, text: str = "text", choose: Callable[[Column, Column, Column], Column] | None = None, chars: int = 200
) -> DataFrame:
    """``(key, acronym, variants, gloss)``: what each ambiguous acronym of a text stands for, by its first context.

    ``choose`` maps acronym, candidates and context to the chosen candidate and may wrap a model as a UDF; any other reply, null
    included, means unsure, and all candidates are kept. ``conflicts``: acronym, variants, candidates. Texts with the
    same key are taken as one. A text is split only at acronyms that stand in it as written.
    """
    wanted = cut_lineage(conflicts.select("acronym", "variants", "candidates"))
    one = texts.select(key, text).dropDuplicates([key])
    pairs = _standing(one, wanted.select(F.col("acronym").alias("term")).distinct(), key, text)
    entry = F.struct("acronym", "variants", "candidates")
    asked = pairs.join(wanted, F.col("term") == F.col("acronym")).groupBy(key).agg(F.collect_list(entry).alias("_e"))  # ambiguous acronyms of one text
    head = lambda a: F.split(F.col(text), F.concat(F.lit(r"(?U)\b"), quoted(a), F.lit(r"\b")), 2)

    def context(before: Column, width: Column) -> Column:
        low = F.greatest(F.length(before) - chars, F.lit(0))
        return F.substring(F.col(text), low + 1, F.length(before) + width + chars - low)

    found = one.join(asked, key).select(key, F.explode(F.transform("_e", lambda e: F.struct(e.alias("e"), let(head(e["acronym"]), lambda p: F.when((F.size(p) > 1) & (~_plain(e["acronym"]) | _whole_word(F.col(text), e["acronym"])), context(p[0], F.length(e["acronym"])))).alias("context")))).alias("f"))
    found = found.select(key, "f.e.*", "f.context").filter(F.col("context").isNotNull())
    chosen = (choose or choose_by_overlap)(F.col("acronym"), F.col("candidates"), F.col("context"))
    decided = found.withColumn("_c", chosen)
    gloss = F.when(F.array_contains("candidates", F.col("_c")), F.col("_c")).otherwise(F.array_join("candidates", "|"))
    return decided.select(key, "acronym", "variants", gloss.alias("gloss"))


def expand_by_context(
    texts: DataFrame, dictionary: DataFrame, text: str = "text", out: str = "expanded", choose: Callable[[Column, Column, Column], Column] | None = None
) -> DataFrame:
    """``expand_text`` for unambiguous acronyms; then each ambiguous one that stands in the text, in order of acronyms, by its context.

    A text without ambiguous acronyms is as ``expand_text`` leaves it; null stays null.
    """
    if "candidates" not in dictionary.columns:
        return expand_text(texts, dictionary, text, out)
    plain = expand_text(texts, dictionary.filter("candidates IS NULL"), text, out).withColumn("_key", F.md5(out))
    variants = F.coalesce(F.col("variants"), F.array().cast("array<string>")) if "variants" in dictionary.columns else F.array().cast("array<string>")
    conflicts = dictionary.filter("acronym IS NOT NULL AND candidates IS NOT NULL").select("acronym", variants.alias("variants"), "candidates")
    glosses = resolved_conflicts(plain.filter(F.col(out).isNotNull()), conflicts, "_key", out, choose)
    forms = glosses.select("_key", "acronym", "gloss", F.posexplode(F.concat(F.array("acronym"), "variants")).alias("v", "form"))
    rule = F.struct("acronym", "v", _form_pattern(F.col("form")).alias("pattern"), _form_put(F.col("form"), F.col("gloss")).alias("put"))
    own = forms.groupBy("_key").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))  # of one text's own acronyms
    done = F.aggregate("_rules", F.col(out), lambda t, r: F.regexp_replace(t, r["pattern"], r["put"]))
    joined = plain.join(own, "_key", "left")
    return joined.select(*texts.columns, F.when(F.col("_rules").isNull(), F.col(out)).otherwise(done).alias(out))


def reverse_forms(dictionary: DataFrame) -> DataFrame:
    """Every written form of an expansion or variant with its acronym, the last acronym per form."""
    d = dictionary.filter(F.col("expansion").isNotNull())
    variants = F.col("variants") if "variants" in d.columns else F.array().cast("array<string>")
    base = d.select("acronym", F.posexplode(F.concat(F.array("expansion"), F.coalesce(variants, F.array().cast("array<string>")))).alias("i", "b"))
    forms = base.select(
        "acronym", F.explode(F.array(F.col("b"), F.lower("b"), F.lower(F.replace("b", F.lit("-"), F.lit(""))))).alias("form")
    )
    return forms.groupBy("form").agg(F.max("acronym").alias("acronym"))


def expand_queries(queries: DataFrame, dictionary: DataFrame, query_id: str, query: str = "query") -> DataFrame:
    """Forward expansion, then acronyms of single words that name an expansion, in word order, if still missing."""
    expanded = expand_text(queries, dictionary, query)
    token = F.posexplode(F.filter(F.split(F.col(query), r"\s+"), lambda w: w != "")).alias("pos", "w")
    words = expanded.select(query_id, "expanded", token)
    clean = F.regexp_replace("w", r"^[.,;:?!()]+|[.,;:?!()]+$", "")
    forms = reverse_forms(dictionary)
    exact = words.withColumn("form", clean).join(forms, "form", "left")
    lower = forms.select(F.col("form").alias("lform"), F.col("acronym").alias("lacr"))
    both = exact.withColumn("lform", F.lower("form")).join(lower, "lform", "left")
    named = both.select(query_id, "expanded", "pos", F.coalesce("acronym", "lacr").alias("a"))
    missing = named.filter(F.col("a").isNotNull() & ~F.col("expanded").contains(F.col("a")))
    extra = missing.groupBy(query_id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda s: s.a), " ").alias("extra")
    )
    return expanded.join(extra, query_id, "left").withColumn("expanded", F.concat_ws(" ", "expanded", "extra")).drop("extra")


def conflict_contexts(docs: DataFrame, conflicts: DataFrame, doc_id: str, text: str = "text", chars: int = 200) -> DataFrame:
    """Every case-sensitive whole-word match of an ambiguous acronym with the characters around it."""
    pairs = match_terms(docs, conflicts.select(F.col("acronym").alias("term")), doc_id, text)
    rows = pairs.join(docs.select(doc_id, F.col(text).alias("_t")), doc_id)
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.col("term"), F.lit(r"\E\b"))
    rows = rows.withColumn("_p", F.split(F.col("_t"), quoted)).filter(F.size("_p") > 1)
    width = F.length("term")
    starts = F.transform(
        F.sequence(F.lit(1), F.size("_p") - 1),
        lambda i: F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s)) + (i - 1) * width,
    )
    at = F.explode(starts).alias("start")
    low = F.greatest(F.col("start") - chars, F.lit(0))
    return rows.select(doc_id, "term", "_t", at).select(
        doc_id, F.col("term").alias("acronym"), "start",
        F.substring(F.col("_t"), low + 1, F.col("start") + F.length("term") + chars - low).alias("context"),
    )
