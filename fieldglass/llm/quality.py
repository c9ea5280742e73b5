"""Line-first quality rules, in built-in expressions only.

Every line is judged by punctuation, navigation, symbol and boilerplate rules; failing lines are
removed, and a document that loses too much of its text is rejected. All rules are row-local, so
nothing is shuffled. A line without a sentence mark passes if it carries on a sentence over a line
break (no stop before the break, a small letter behind it) in prose with enough marks, or is in a
script that writes none. Very long texts are judged whole. An empty table gives an empty one. A null text has no words, no lines and fails; lines without a word neither
fail nor count. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.text import let
from fieldglass.llm.common import BLANK_CLASS, blank_words

MIN_WORDS = 50
#: Percent of the words that may lie in repeated windows of three words.
MAX_REPEAT_PERCENT = 50
#: Share of a text's word characters that may go with failing lines.
MAX_LOST = 0.3
SYMBOLS = r"[#*$%&|<>]"
#: Symbols for each word from which a line is decoration or code.
MAX_SYMBOLS_PER_WORD = 0.5
#: Lines from this many words on need some mark that ends or joins a sentence.
PUNCTUATION_FROM = 8
#: Exclamation marks for each word from which a line is shouting.
MAX_SHOUTS_PER_WORD = 0.5
#: Separators for each word from which a line is a menu.
MAX_BARS_PER_WORD = 0.25

#: Marks that end or join a sentence in any script: other punctuation without these signs.
SENTENCE_MARK, SIGNS = r"\p{Po}", "\"#%&'*/@\\"
#: Letters of Thai and Lao, Burmese, and Khmer, which write blanks where others have marks.
UNMARKED_SCRIPTS = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]"
#: A line break between two sentences: after a stop or an empty line, or before anything but a small letter.
HARD_BREAK = r"(?<![^\n.!?])\n|\n(?![\x20\t]*\p{Ll})"
#: Prose over several lines has a mark for so many words.
WORDS_PER_MARK = 40
SEPARATORS = r"[|»›→]"
#: Fixed phrases of notices and page furniture, in lower case.
BOILERPLATE = (
    r"all rights reserved|licensed under|released under the|creative commons|public license|terms of (?:use|service)|privacy policy"
    r"|cookie policy|uses cookies|enable javascript|sign in to|log in to|subscribe to our|click here|back to top|skip to content|share this"
)
#: A notice is short: longer lines are prose that mentions one.
BOILERPLATE_WORDS = 20


def marks(text: Column) -> Column:
    """Number of sentence marks."""
    return let(F.translate(text, SIGNS, ""), lambda t: F.length(t) - F.length(F.regexp_replace(t, SENTENCE_MARK, "")))


def line_fails(line: Column, passage: Column) -> Column:
    """Whether a line breaks a rule; false for a line without a word. ``passage``: the lines it shares sentences with, itself included."""
    def judge(parts: Column) -> Column:
        n, text = parts["n"], parts["line"]
        bars = F.length(text) - F.length(F.regexp_replace(text, SEPARATORS, ""))
        shouts = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
        symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
        return (
            (symbols > n * MAX_SYMBOLS_PER_WORD)
            | (bars > n * MAX_BARS_PER_WORD)
            | (shouts > n * MAX_SHOUTS_PER_WORD)
            | ((n >= PUNCTUATION_FROM) & ~F.translate(text, SIGNS, "").rlike(SENTENCE_MARK) & ~text.rlike(UNMARKED_SCRIPTS)
               & (marks(passage) * WORDS_PER_MARK < F.size(blank_words(passage))))
            | ((n <= BOILERPLATE_WORDS) & F.lower(text).rlike(BOILERPLATE))
        )

    return let(F.struct(line.alias("line"), F.size(blank_words(line)).alias("n")), judge)


def lines_that(text: Column, keep) -> Column:
    """Lines of a text in order for which ``keep``, of whether the line fails, holds."""
    of_passage = lambda p: F.filter(F.split(p, "\n"), lambda line: keep(line_fails(line, p)))
    return F.flatten(F.transform(F.split(text, HARD_BREAK), of_passage))


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words in windows of ``window`` words that the text holds twice or more.

    A window is named by a 64-bit hash. Texts without a repeated window, most of them, end
    there; the others sort their windows and mark equal neighbours.
    """
    def names(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked))

    def marked(s: Column) -> Column:
        def twice(e: Column, k: Column) -> Column:
            return (F.get(s, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(e["h"]))

        starts = F.filter(s, twice)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda e: F.transform(F.array(*[F.lit(k) for k in range(window)]), lambda k: e["i"] + k)))))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(names(words), count))


def measures(text: str = "text") -> Column:
    """All counts of a text and its judged lines, as one struct."""
    content = F.coalesce(F.col(text), F.lit(""))

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w)))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            repeated_words(words).cast("bigint").alias("n_repeat_words"),
        )

    failed = lines_that(content, lambda fails: fails)
    return F.struct(
        let(blank_words(content), of_words).alias("words"),
        (F.length(content) - F.length(F.regexp_replace(content, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(F.split(content, "\n"), of_lines).cast("bigint").alias("n_dup_lines"),
        F.length(F.regexp_replace(F.array_join(failed, ""), BLANK_CLASS, "")).cast("bigint").alias("lost_chars"),
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__quality``: the counts, ``base_failed`` and ``kept``."""
    m, w = F.col("__measures"), F.col("__measures.words")
    failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])
    kept = ~failed & (m["lost_chars"] <= w["word_chars"] * MAX_LOST)
    named = F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"), m["lost_chars"].alias("lost_chars"))
    return docs.withColumn("__measures", measures(text)).withColumn("__quality", named).drop("__measures")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and the verdict."""
    return judge(docs.select("doc_id", "text")).select("doc_id", "__quality.*")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Kept documents with their failing lines removed; a text without any such line stays as it is."""
    left = F.array_join(lines_that(F.col(text), lambda fails: ~fails), "\n")
    return judge(docs, text).where("__quality.kept").withColumn(text, F.when(F.col("__quality.lost_chars") > 0, left).otherwise(F.col(text))).drop("__quality")


def quality_sql() -> str:
    """The same report for the table ``documents`` in SQL."""
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    bars, signs = r"[|\x{00BB}\x{203A}\x{2192}]", SIGNS.replace("'", "''")
    gone = lambda col, cls: f"length({col}) - length(regexp_replace({col}, '{cls}', '', 'g'))"
    return f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    word AS (SELECT *, regexp_extract_all(text, '{word}+') AS w FROM doc),
    win_at AS (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM word WHERE len(w) >= 3),
    win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM win_at),
    twice AS (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1),
    rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice ON win.r = twice.r AND win.k = twice.k) GROUP BY r),
    line_at AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM doc),
    joins AS (SELECT *, regexp_matches(line, '^[\\x20\\t]*\\p{{Ll}}') AND coalesce(regexp_matches(right(lag(line) OVER (PARTITION BY r ORDER BY i), 1), '[^.!?]'), false) AS joined FROM line_at),
    line_of AS (SELECT r, i, line, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS p FROM joins),
    passage_of AS (SELECT r, p, string_agg(line, chr(10) ORDER BY i) AS passage FROM line_of GROUP BY r, p),
    passage AS (SELECT r, p, {gone(f"translate(passage, '{signs}', '')", SENTENCE_MARK)} AS marks, len(regexp_extract_all(passage, '{word}+')) AS words FROM passage_of),
    line AS (SELECT r, line, len(regexp_extract_all(line, '{word}+')) AS n, marks, words FROM line_of JOIN passage USING (r, p) WHERE regexp_matches(line, '{word}')),
    judged AS (
      SELECT r, line, {gone('line', SYMBOLS)} > n * {MAX_SYMBOLS_PER_WORD} OR {gone('line', bars)} > n * {MAX_BARS_PER_WORD}
        OR {gone('line', '!')} > n * {MAX_SHOUTS_PER_WORD}
        OR (n >= {PUNCTUATION_FROM} AND NOT regexp_matches(translate(line, '{signs}', ''), '{SENTENCE_MARK}') AND NOT regexp_matches(line, '{UNMARKED_SCRIPTS}') AND marks * {WORDS_PER_MARK} < words)
        OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{BOILERPLATE}')) AS fails FROM line),
    lines AS (SELECT r, count(*) - count(DISTINCT line) AS dups, coalesce(sum(CASE WHEN fails THEN length(regexp_replace(line, '{blank}', '', 'g')) END), 0) AS lost FROM judged GROUP BY r),
    m AS (
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
             CAST({gone('text', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
      FROM word LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
           NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_chars <= word_chars * {MAX_LOST} AS kept, lost_chars
    FROM m"""
