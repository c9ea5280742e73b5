"""Document chunking as row-local expressions: a document never leaves its row until it is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions import text as tx
from fieldglass.session import release_memory

#: Characters that a table function's worker reads before it gives freed memory back to the system.
MOST_CHARS = 1 << 24
# private-use characters that mark a header found outside fenced code
_OPEN, _CLOSE = "\ue000", "\ue001"
_S = fixed.SPACE_CLASS
_FENCE_OR_HEADER = rf"(?md)((?s:```.*?```|~~~.*?~~~))|^(#{{1,6}})({_S}+)(#+|(?=[^\n]))"


def _piece(doc_type: Column, section: Column, num: Column, title: Column, key: Column, depth: Column,
           parents: Column, sub: Column, words: Column) -> Column:
    return F.struct(
        doc_type.alias("doc_type"),
        section.alias("section"),
        num.alias("section_num"),
        title.alias("section_title"),
        key.alias("key"),
        depth.cast("int").alias("section_depth"),
        parents.alias("parent_sections"),
        sub.cast("int").alias("chunk_index_in_section"),
        F.array_join(words, " ").alias("text"),
    )


def fixed_pieces(text: Column, doc_type: Column, size: int = fixed.CHUNK_WORDS) -> Column:
    """Every ``size`` words one piece; a text without words gives none."""
    blank = F.lit("")
    none = F.array().cast("array<string>")
    windows = lambda words: F.filter(tx.overlap_windows(words, size), lambda w: F.size(w) > 0)
    return F.transform(
        tx.let(tx.words(text), windows),
        lambda w: _piece(doc_type, blank, blank, blank, blank, F.lit(0), none, F.lit(0), w),
    )


def header_sections(text: Column) -> Column:
    """``##<close> title line, body`` of every header outside fences; text before the first one is dropped."""
    clean = F.translate(text, _OPEN + _CLOSE, "")
    marked = F.regexp_replace(clean, _FENCE_OR_HEADER, f"$1{_OPEN}$2{_CLOSE}$3$4")
    marked = F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit(""))
    cut = tx.let(F.split(marked, _OPEN), lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))
    return F.when(~F.contains(text, F.lit("#")), F.array().cast("array<string>")).otherwise(cut)


def _parsed(section: Column) -> Column:
    def fields(rest: Column) -> Column:
        at = F.instr(rest, "\n")
        body = F.when(at > 0, F.substring(rest, at + 1, F.length(rest))).otherwise("")
        return F.struct(tx.strip(F.substring_index(rest, "\n", 1)).alias("raw"), tx.words(body).alias("words"))

    split = tx.let(F.regexp_replace(F.substring_index(section, _CLOSE, -1), f"^{_S}+", ""), fields)
    return tx.let(
        split,
        lambda s: F.struct(
            F.length(F.substring_index(section, _CLOSE, 1)).alias("depth"),
            s["raw"].alias("raw"),
            tx.section_number(s["raw"]).alias("num"),
            tx.section_title(s["raw"]).alias("title"),
            s["words"].alias("words"),
        ),
    )


def section_pieces(text: Column, size: int = fixed.CHUNK_WORDS, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Sections cut into overlapping windows; a text without headers falls back to fixed pieces."""
    def of_section(s: Column) -> Column:
        numbered = s["num"] != ""
        return F.transform(
            tx.overlap_windows(s["words"], size, overlap),
            lambda w, i: _piece(
                F.lit("spec"),
                F.when(numbered, tx.strip(F.concat_ws(" ", s["num"], s["title"]))).otherwise(s["title"]),
                s["num"],
                s["title"],
                F.when(numbered, s["num"]).otherwise(s["raw"]),
                s["depth"],
                tx.parent_sections(s["num"]),
                i,
                w,
            ),
        )

    def of_sections(sections: Column) -> Column:
        filled = F.filter(F.transform(sections, _parsed), lambda s: F.size(s["words"]) > 0)
        pieces = F.flatten(F.transform(filled, of_section))
        return F.when(F.size(sections) > 0, pieces).otherwise(fixed_pieces(text, F.lit("spec"), size))

    return tx.let(header_sections(text), of_sections)


def _explode(docs: DataFrame, pieces: Column, source: str) -> DataFrame:
    rows = docs.select(F.col(source).cast("string").alias("source_doc"), F.posexplode(pieces).alias("chunk_index", "p"))
    return rows.select(
        tx.chunk_id(F.col("source_doc"), F.col("chunk_index"), F.col("p.key")).alias("chunk_id"),
        "source_doc",
        "p.doc_type",
        "p.section",
        "p.section_num",
        "p.section_title",
        "p.section_depth",
        "p.parent_sections",
        "chunk_index",
        "p.chunk_index_in_section",
        "p.text",
    )


def chunk_fixed(docs: DataFrame, source: str, doc_type: str, text: str = "text", size: int = fixed.CHUNK_WORDS) -> DataFrame:
    return _explode(docs, fixed_pieces(F.col(text), F.lit(doc_type), size), source)


def chunk_sections(
    docs: DataFrame, source: str, text: str = "text", size: int = fixed.CHUNK_WORDS, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    return _explode(docs, section_pieces(F.col(text), size, overlap), source)


def chunk_by_type(docs: DataFrame, source: str, doc_type: str = "doc_type", text: str = "text") -> DataFrame:
    """Specifications by section, everything else by size, in one pass."""
    kind = F.col(doc_type)
    pieces = F.when(kind == "spec", section_pieces(F.col(text))).otherwise(fixed_pieces(F.col(text), kind))
    return _explode(docs, pieces, source)


def chunk_records(records: DataFrame, source: str, index: str, section: str, text: Column, doc_type: str, mo_name: Column) -> DataFrame:
    """One record, one chunk."""
    return records.select(
        tx.chunk_id(F.col(source), F.col(index), F.col(section)).alias("chunk_id"),
        F.col(source).alias("source_doc"),
        F.lit(doc_type).alias("doc_type"),
        F.col(section).alias("section"),
        mo_name.alias("mo_name"),
        F.col(index).alias("chunk_index"),
        text.alias("text"),
    )


def chunk_rows_udtf():
    """Table function ``(text, size, overlap) -> (pos, text)`` for use in SQL with LATERAL; rows travel in Arrow batches.

    The windows are those of ``fixed_pieces``. A null or blank text gives no row; an overlap that is not below
    the size fails, as windows would not move on. Freed memory goes back to the system during and after a task.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, text string", useArrow=True)
    class WordWindows:
        def __init__(self):
            self.chars = 0

        def eval(self, text: str, size: int, overlap: int):
            if not 0 <= overlap < size:
                raise ValueError(f"overlap {overlap} is not below the size {size}")
            words = (text or "").split()
            for pos, start in enumerate(range(0, max(len(words) - overlap, min(len(words), 1)), size - overlap)):
                yield pos, " ".join(words[start : start + size])
            self.chars += len(text or "")
            if self.chars > MOST_CHARS:
                self.cleanup()

        def cleanup(self):
            self.chars = 0
            release_memory()

    return WordWindows


def context_text(chunks: DataFrame, keys: list[str], rank: str, first: int = 5, chars: int | None = None, glue: str = "\n\n") -> DataFrame:
    """Text of the first ranked chunks joined, each optionally cut to its leading characters."""
    piece = F.col("text") if chars is None else F.substring("text", 1, chars)
    top = chunks.filter(F.col(rank) <= first).select(*keys, F.struct(F.col(rank), piece.alias("t")).alias("s"))
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.t), glue).alias("context")
    )
