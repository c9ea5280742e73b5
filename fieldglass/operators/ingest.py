"""Documents to stored chunks: acronyms collected, texts expanded, cut by type, tagged, embedded, replaced by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators import acronyms, chunks, models, terms
from fieldglass.session import write_down
from fieldglass.sources.versions import write_version


def known_acronyms(docs: DataFrame, source: str, text: str, dictionary: DataFrame) -> DataFrame:
    """The dictionary and what the documents' own abbreviation sections add; known entries stay as they are."""
    dictionary = write_down(dictionary)  # it may be drawn from all texts, and is read twice
    found = acronyms.build_dictionary(acronyms.extract_entries(docs, source, text))
    new = found.join(dictionary.select("acronym").distinct(), "acronym", "left_anti")
    return dictionary.unionByName(new, allowMissingColumns=True)


def rejected(docs: DataFrame, source: str, text: str = "text") -> DataFrame:
    """``(source, reason)`` of documents that give no chunk: without a text or without a name to store them under."""
    reason = F.when(F.col(source).isNull(), "no source").when(F.col(text).isNull(), "no text").when(F.trim(text) == "", "empty text")
    return docs.select(F.col(source).cast("string").alias("source"), reason.alias("reason")).filter("reason IS NOT NULL")


def prepare_chunks(
    docs: DataFrame,
    dictionary: DataFrame,
    keywords: DataFrame,
    encoder: Callable[[list[str]], list],
    source: str = "source_doc",
    doc_type: str = "doc_type",
    text: str = "text",
    choose: Callable[[Column, Column, Column], Column] | None = None,
    most: int | None = None,
) -> DataFrame:
    """Chunk rows with ``keywords``, ``n_keywords`` and ``embedding``, from texts with expanded acronyms.

    All documents' abbreviation sections are collected before any text is expanded, so an acronym one document
    defines is expanded in the others too. Documents of ``rejected`` give no rows. ``keywords`` has a column ``term``;
    ``most`` of them are kept for a chunk, all if not given; a chunk without one has an empty list.
    """
    named = docs.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(source).alias("source"), F.col(doc_type).alias("type"), F.col(text).alias("text"))
    known = known_acronyms(named, "source", "text", dictionary)
    expanded = acronyms.expand_by_context(named, known, choose=choose).select("source", "type", F.col("expanded").alias("text"))
    cut = write_down(chunks.chunk_by_type(expanded, "source", "type"))  # tags and rows are of the same chunks
    tags = terms.tag_keywords(cut, keywords, "chunk_id", most=most)
    none = F.array().cast("array<string>")
    tagged = cut.join(tags, "chunk_id", "left").withColumns({"keywords": F.coalesce("keywords", none), "n_keywords": F.coalesce("n_keywords", F.lit(0))})
    return models.embed(tagged, encoder)


def ingest(docs: DataFrame, target: str, writer: str, dictionary: DataFrame, keywords: DataFrame, encoder: Callable[[list[str]], list], **options) -> int:
    """Store the documents' chunks in ``target`` as one version named ``writer``; the version's number.

    They replace what is stored for the same sources. A source whose document gives no chunk keeps what it has, and a
    writer that comes back changes nothing. Read with ``versions.read_live(spark, target, "source_doc")``.
    """
    return write_version(prepare_chunks(docs, dictionary, keywords, encoder, **options), target, "source_doc", writer)
