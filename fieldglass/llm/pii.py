"""Personal data: fixed patterns, and terms that the corpus shows to disclose what they match.

Entities are the values that the base patterns find. A term near mentions of an entity discloses
it as far as the term's information about the entity, log2 p(t, e) / (p(t) p(e)), comes up to
the entity's own, log2 1 / p(e). Counts are taken over all documents: contexts of mentions (a
passage that is copied counts once) against documents that hold the term anywhere. Terms from
``DISCLOSURE`` on, seen in at least ``SUPPORT`` contexts of the entity, are spans wherever they
occur; sanitising replaces a match by its kind and a disclosing term by a general word.

Built-in expressions only. A null text is an empty one. Spans are in code points, end exclusive.
Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.text import let
from fieldglass.llm.common import materialise

#: Fixed base patterns. Runs are possessive, and a match may only start where a run of its first class starts
#: (or the last match ended), which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
KINDS = (*PATTERNS, TERM)
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
#: Words on each side of a mention, sought in so many characters.
CONTEXT_WORDS, CONTEXT_CHARS = 5, 160
#: Letters of a term, contexts it must share with the entity, share of the entity's information it must carry.
TERM_LETTERS, SUPPORT, DISCLOSURE = 4, 3, 0.9
#: Disclosing terms that are sent to every task; more are joined.
MAX_TERMS = 200_000
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[DETAIL]"}


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def weight(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    from_right = F.filter(F.split(F.reverse(number), ""), lambda d: d != "")
    return F.aggregate(F.transform(from_right, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    n = F.length(digits(match))
    return (
        F.when(kind == "ip", match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
        .when(kind == "card", n.between(*CARD_DIGITS) & F.when(n.between(*CARD_DIGITS), luhn(digits(match))).otherwise(False))
        .when(kind == "phone", n.between(*PHONE_DIGITS))
        .otherwise(True)
    )


MENTION = "array<struct<kind:string,i:int,gap:int,size:int,value:string,before:string,after:string>>"


def mentions_of(kind: Column | str, text: Column, pattern: Column | str, possible: Column) -> Column:
    """Matches in order: what lies between them (``gap``), their size and value, the text next to them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def pair(both: Column) -> Column:
        gap = lambda i: F.get(both["gaps"], i)
        return F.transform(both["hits"], lambda hit, i: F.struct(
            kind.alias("kind"), i.alias("i"), F.length(gap(i)).alias("gap"), F.length(hit).alias("size"), hit.alias("value"),
            F.right(gap(i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(gap(i + 1), F.lit(CONTEXT_CHARS)).alias("after")))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return F.when(possible, let(parts, pair)).otherwise(F.array().cast(MENTION))


def placed(mentions: DataFrame) -> DataFrame:
    """Mentions with ``start`` and ``end``, from the gaps and sizes before them in their document."""
    one_text = Window.partitionBy("doc_id", "digest", "kind", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(one_text).cast("int")
    return mentions.dropDuplicates(["doc_id", "digest", "kind", "pattern", "i"]).withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def base_mentions(named: DataFrame) -> DataFrame:
    """Every valid match of the base patterns in ``doc_id``, ``digest``, ``text``."""
    text = F.col("text")
    number = text.rlike("[0-9]")
    possible = {"email": text.contains("@"), "ip": number, "card": number, "phone": text.contains("+")}
    every = F.concat(*[mentions_of(kind, text, pattern, possible[kind]) for kind, pattern in PATTERNS.items()])
    found = named.select("doc_id", "digest", F.explode(every).alias("m")).select("doc_id", "digest", "m.*", F.col("m.kind").alias("pattern"))
    return placed(found).where(passes(F.col("kind"), F.col("value"))).drop("pattern", "gap", "size", "i")


def terms_of(text: Column) -> Column:
    """Runs of letters in lower case, long enough to be a term."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= TERM_LETTERS)


def context_terms(mentions: DataFrame) -> DataFrame:
    """``kind``, ``value``, ``context`` and ``term`` for the words on both sides of each mention."""
    words = lambda text: F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = lambda side: F.length(side) < CONTEXT_CHARS  # noqa: E731  else its outermost word may be cut
    before = let(words(F.col("before")), lambda w: F.slice(F.when(whole(F.col("before")), w).otherwise(F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))), F.greatest(F.lit(1), F.size(w) - CONTEXT_WORDS + F.when(whole(F.col("before")), 1).otherwise(0)), CONTEXT_WORDS))
    after = let(words(F.col("after")), lambda w: F.slice(F.when(whole(F.col("after")), w).otherwise(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))), 1, CONTEXT_WORDS))
    around = F.concat_ws(" ", F.array_join(before, " "), F.array_join(after, " "))
    rows = mentions.select("kind", F.lower("value").alias("value"), around.alias("around"))
    return rows.select("kind", "value", F.md5("around").alias("context"), F.explode(F.array_distinct(terms_of(F.col("around")))).alias("term"))


def disclosing_terms(named: DataFrame, mentions: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Terms that disclose some entity, one row each."""
    near = context_terms(mentions)
    shared = near.groupBy("kind", "value", "term").agg(F.countDistinct("context").alias("n_both")).where(F.col("n_both") >= support)
    entities = near.groupBy("kind", "value").agg(F.countDistinct("context").alias("n_entity"))
    pairs = materialise(shared.join(entities, ["kind", "value"]), "pairs")
    total = named.agg(F.count("*").cast("double").alias("n_docs"))
    held = named.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counted = pairs.join(held, "term").withColumn("n_docs", total.scalar())
    both = F.least("n_both", "n_term")
    information = F.log2(F.col("n_docs") / F.col("n_entity"))
    shared_information = F.log2(both * F.col("n_docs") / (F.col("n_term") * F.col("n_entity")))
    return counted.where((information > 0) & (shared_information >= information * disclosure)).select("term").distinct()


def term_mentions(named: DataFrame, terms: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Every occurrence of the terms, in any case, as whole runs of letters."""
    held = lambda *kept: named.select(*kept, F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    if terms.count() <= max_terms:
        rows = held("doc_id", "digest", "text").join(F.broadcast(terms), "term")
    else:
        pairs = held("doc_id", "digest").join(terms, "term").distinct().alias("p")
        same = F.col("n.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("n.digest") == F.col("p.digest"))
        rows = named.alias("n").join(pairs, same).select("n.doc_id", "n.digest", "n.text", "p.term")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})"))
    found = rows.select("doc_id", "digest", F.col("term").alias("pattern"), F.explode(mentions_of(TERM, F.col("text"), pattern, F.lit(True))).alias("m"))
    return placed(found.select("doc_id", "digest", "pattern", "m.*")).select("doc_id", "digest", "kind", "start", "end")


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) and ``spans``: structs of ``at`` (place of the kind), ``start``, ``end``, ``kind``, in that order."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    mentions = materialise(base_mentions(named), "mentions")
    terms = materialise(disclosing_terms(named, mentions, **options), "terms")
    every = mentions.select("doc_id", "digest", "kind", "start", "end").unionByName(term_mentions(named, terms))
    at = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])[F.col("kind")]
    span = F.struct(at.alias("at"), "start", "end", "kind")
    found = materialise(every.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(span)).alias("spans")), "spans").alias("s")  # spans of one text
    rows = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.__digest") == F.col("s.digest"))
    spans = F.coalesce("s.spans", F.array().cast(found.schema["spans"].dataType))
    return rows.join(found, same, "left").select(*[F.col(f"d.{c}") for c in docs.columns if c != "spans"], spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans."""
    found = find_personal_data(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with matches replaced by their kind and disclosing terms generalised; of overlapping spans the first one counts."""
    found = find_personal_data(docs, **options)
    names = F.create_map(*[F.lit(x) for pair in REPLACEMENTS.items() for x in pair])
    by_start = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        put = F.concat(acc["out"], F.substring(F.col("text"), acc["last"] + 1, s["start"] - acc["last"]), names[s["kind"]])
        return F.when(s["start"] >= acc["last"], F.struct(put.alias("out"), end.alias("last"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["last"], end).alias("last")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("last"))
    text = F.aggregate(by_start, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["last"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).drop("spans")
