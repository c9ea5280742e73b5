"""Terms of a dictionary in texts, and the vocabulary itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import simple_upper, strip, word_tokens
from fieldglass.operators.predicates import is_noise_term
from fieldglass.session import union_all, write_down

#: Characters at the start of a term that texts are joined on.
GRAM = 3


def quoted(term: Column) -> Column:
    """Term as a literal inside a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _spans(text: Column, sizes: list[int]) -> Column:
    """Distinct stretches of the lower-cased text from the start of a word to the end of a word, for each number of words in ``sizes``."""
    word, gap = f"{fixed.WORD_CLASS}++", f"{fixed.NON_WORD_CLASS}++"
    # a look-ahead at the start of every word, as stretches overlap; single words are what a split leaves, empty ones at an end too
    pattern = lambda m: f"(?<!{fixed.WORD_CLASS})(?=({word}(?:{gap}{word}){{{m - 1}}}))"
    found = [F.split(F.lower(text), gap) if m == 1 else F.regexp_extract_all(F.lower(text), F.lit(pattern(m)), F.lit(1)) for m in sizes]
    return F.array_distinct(F.concat(*found))


def match_terms(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``(doc_id, term)`` where the term stands in the text as a whole word, ignoring case.

    A text is read once into its stretches of as many words as some term has, separators included,
    and those are joined with the lower-cased terms: no text is searched for a term and none is
    joined back. Only terms that begin or end with something else than a letter, digit or underscore
    are looked for by pattern, in the texts that hold their longest word. A term without any letter or
    digit never matches.
    """
    edges = F.col("term").rlike(f"^{fixed.WORD_CLASS}") & F.col("term").rlike(f"{fixed.WORD_CLASS}$")
    wanted = terms.select("term").distinct().withColumn("_m", F.size(word_tokens(F.col("term")))).filter("_m > 0")
    wanted = write_down(wanted.select("term", "_m", F.lower("term").alias("_w"), edges.alias("_plain")))
    sizes = sorted(wanted.filter("_plain").select("_m").distinct().toPandas()["_m"])  # one row for each length of a term
    none = docs.select(doc_id, F.lit(None).cast("string").alias("term")).limit(0)
    found = [none]
    if sizes:
        spans = docs.select(doc_id, F.explode(_spans(F.col(text), sizes)).alias("_w"))
        found.append(spans.join(wanted.filter("_plain").select("term", "_w"), "_w").select(doc_id, "term"))
    others = wanted.filter("NOT _plain").select("term")
    if not others.isEmpty():
        found.append(_by_pattern(docs, others, doc_id, text))
    return union_all(found)


def _by_pattern(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The same pairs for terms with other characters at an end, which word borders alone do not settle."""
    longest = F.array_max(F.transform(word_tokens(F.col("term")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = docs.select(doc_id, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("_w"))
    open_ = words.join(terms.select("term", longest.alias("_w")), "_w").groupBy(doc_id).agg(F.collect_set("term").alias("_open"))  # such terms with a word of one text
    pattern = lambda term: F.concat(F.lit(r"(?iuU)\b"), quoted(term), F.lit(r"\b"))
    return docs.join(open_, doc_id).select(doc_id, F.explode(F.filter("_open", lambda t: F.rlike(F.col(text), pattern(t)))).alias("term"))


def tag_keywords(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """Matching terms per text in alphabetical order, the first ``most`` of them if given, and how many matched."""
    tags = match_terms(docs, terms, doc_id, text).groupBy(doc_id).agg(F.array_sort(F.collect_set("term")).alias("_k"))
    shown = F.col("_k") if most is None else F.slice("_k", 1, most)
    return tags.select(doc_id, shown.alias("keywords"), F.size("_k").alias("n_keywords"))


def contained_terms(texts: DataFrame, terms: DataFrame, text_id: str, text: str = "text") -> DataFrame:
    """Pairs where the upper-cased term is a substring of the upper-cased text, no word border needed.

    Upper case is taken character by character. A text holds a term only if it holds its first
    characters, so both sides are joined on runs of up to ``GRAM`` characters, as long as some
    term's start; the texts are then searched for the terms so found.
    """
    wanted = terms.filter(F.col("term") != "").select("term", simple_upper(F.col("term")).alias("_u")).distinct()
    wanted = wanted.withColumn("_g", F.substring("_u", 1, GRAM))
    sizes = F.coalesce(wanted.agg(F.collect_set(F.length("_g"))).scalar(), F.array().cast("array<int>"))
    rows = texts.select(F.col(text_id), simple_upper(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # a look-ahead of n characters at every place
    runs = [F.when(F.array_contains("_n", n), F.regexp_extract_all("_t", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    starts = rows.withColumn("_n", sizes).select(text_id, F.explode(F.array_distinct(F.concat(*runs))).alias("_g"))
    asked = starts.join(wanted, "_g").groupBy(text_id).agg(F.collect_set(F.struct("term", "_u")).alias("_a"))  # terms that start in one text
    held = rows.join(asked, text_id).select(text_id, F.explode(F.filter("_a", lambda a: F.contains(F.col("_t"), a["_u"]))).alias("_a"))
    return held.select(text_id, "_a.term").distinct()


def query_context(history: DataFrame, acronyms: DataFrame, key: str) -> DataFrame:
    """Context block of a query: its history text, then the acronyms found in it, whichever are present.

    ``history``: key, history. ``acronyms``: key, term, expansion, as many as one text mentions.
    """
    line = F.concat(F.lit("- "), F.col("term"), F.lit(": "), F.col("expansion"))
    lines = acronyms.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("_a"))
    joined = history.join(lines, key, "full")
    part = lambda head, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c)))
    return joined.select(
        key, F.concat_ws("\n\n", part("Conversation history:\n", "history"), part("Relevant acronyms:\n", "_a")).alias("context")
    )


def vocabulary(acronyms: DataFrame, names: DataFrame) -> DataFrame:
    """Acronyms and entity names without noise terms (digits only, or two characters and less)."""
    clean = names.select("term").filter((F.col("term") != "") & ~is_noise_term(F.col("term")))
    return acronyms.select("term").unionByName(clean).distinct()


def glossary(records: DataFrame, key: str, attributes: list[str], order: list[str]) -> DataFrame:
    """One row per name: the last record in file and row order, noise names dropped."""
    name = strip(F.col(key))
    rows = records.withColumn(key, name).filter((F.col(key) != "") & ~is_noise_term(F.col(key)))
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*[F.coalesce(strip(F.col(a)), F.lit("")).alias(a) for a in attributes]), F.struct(*order)).alias("r"))
    return picked.select(key, "r.*")


def merge_glossary(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries win over existing ones."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_deprecated(entries: DataFrame, deprecated: DataFrame, key: str) -> DataFrame:
    return entries.join(deprecated.select(key).distinct(), key, "left_anti")


def repeated_lines(pages: DataFrame, doc: str, page: str, text: str, ratio: float, keep: Column | None = None) -> DataFrame:
    """Lines that stand on at least ``max(2, ceil(pages * ratio))`` pages of a document.

    A line counts once per page because each page's lines are made distinct in
    the row, so the shuffle carries partial counts per (document, line) only.
    """
    from fieldglass.functions.text import collapse_spaces, words

    normal = F.transform(F.split(F.col(text), "\n"), lambda l: F.lower(collapse_spaces(l)))
    source = pages if keep is None else pages.filter(keep)
    lines = source.select(doc, F.explode(F.array_distinct(normal)).alias("line"))
    alnum = F.length(F.regexp_replace("line", r"[^\p{L}\p{Nd}]", ""))
    plausible = (
        F.length("line").between(fixed.REPEAT_MIN_CHARS, fixed.REPEAT_MAX_CHARS)
        & (alnum >= fixed.REPEAT_MIN_ALNUM)
        & (F.size(words(F.col("line"))) <= fixed.REPEAT_MAX_WORDS)
    )
    counts = lines.filter(plausible).groupBy(doc, "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    enough = F.greatest(F.lit(2), F.ceil(F.col("_n") * F.lit(float(ratio))))
    return counts.join(totals, doc).filter(F.col("pages") >= enough).select(doc, "line", "pages")
