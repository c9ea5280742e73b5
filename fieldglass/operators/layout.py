"""Layout tables: one row per text line, table or element of a page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import let, strip
from fieldglass.operators.ordered import (
    first_per_key,
    number_slice,
    running_values,
    top_per_group,
)

ELEMENTS_PER_SLICE = 4096


def style_profile(lines: DataFrame, keys: list[str], page: str = "page", line: str = "line", samples: int = 3) -> DataFrame:
    """Lines, pages and first sample texts per (font size, colour)."""
    styled = lines.withColumn("font_size", F.round("size", 2)).filter(F.col("font_size") > 0)
    group = [*keys, "font_size", "color"]
    stats = styled.groupBy(*group).agg(
        F.count(F.lit(1)).alias("line_count"), F.countDistinct(page).alias("page_count"), F.min(page).alias("sample_page")
    )
    texts = styled.select(*group, strip(F.coalesce("text", F.lit(""))).alias("t"), F.struct(page, line).alias("at")).filter(F.col("t") != "")
    firsts = texts.groupBy(*group, "t").agg(F.min("at").alias("at"))
    kept = top_per_group(firsts, group, [F.col("at")], samples, "_r")
    joined = kept.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "t"))), lambda s: s.t).alias("sample_texts")
    )
    return stats.join(joined, group, "left")


def rotation_axis(rotation: Column) -> Column:
    return F.when((rotation % 180) == 90, "x").otherwise("y")


def is_watermark_rotation(rotation: Column) -> Column:
    """Within the tolerance of the watermark angle, measured around the circle."""
    angle = F.pmod(F.coalesce(rotation, F.lit(0)).cast("int"), F.lit(360))
    gap = F.abs(F.pmod(angle - fixed.WATERMARK_ANGLE + 180, F.lit(360)) - 180)
    return gap <= fixed.WATERMARK_TOLERANCE


def region(x0, y0, x1, y1, rotation, width, height, header: float = fixed.HEADER_RATIO, footer: float = fixed.FOOTER_RATIO) -> Column:
    """Header, footer or body by the position of the box centre along the reading axis."""
    across = rotation_axis(rotation) == "x"
    centre = F.when(across, (x0 + x1) / 2).otherwise((y0 + y1) / 2)
    size = F.when(across, width).otherwise(height)
    return (
        F.when((size <= 0) | size.isNull(), "body")
        .when(centre <= size * header, "header")
        .when(centre >= size * (1 - footer), "footer")
        .otherwise("body")
    )


def region_statistics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, size and baseline spread, rotations, box union and most frequent fonts per region.

    ``lines``: location, removed, size, baseline, ratio, axis, rotation, x0, y0, x1, y1, font.
    """
    group = [*keys, "location"]
    size = F.when(F.col("size") != 0, F.col("size"))
    spread = lambda c, n: [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.avg(c).alias(f"{n}_avg")]
    stats = lines.groupBy(*group).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum((~F.col("removed")).cast("long")).alias("kept_count"),
        F.sum(F.col("removed").cast("long")).alias("removed_count"),
        *spread(size, "size"),
        *spread(F.col("baseline"), "baseline"),
        *spread(F.col("ratio"), "ratio"),
        F.sum((F.col("axis") == "x").cast("long")).alias("axis_x"),
        F.sum((F.col("axis") == "y").cast("long")).alias("axis_y"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    rotations = (
        lines.groupBy(*group, "rotation").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("rotation").cast("string"), "c")))).alias("rotations"))
    )
    fonts = lines.filter(F.coalesce("font", F.lit("")) != "").groupBy(*group, "font").agg(F.count(F.lit(1)).alias("c"))
    top = top_per_group(fonts, group, [F.col("c").desc(), F.col("font")], 3, "_r")
    top = top.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "font"))), lambda s: s.font).alias("top_fonts")
    )
    return stats.join(rotations, group, "left").join(top, group, "left")


def page_anomalies(
    pages: DataFrame, lines: DataFrame, keys: list[str], header: float = fixed.HEADER_RATIO, footer: float = fixed.FOOTER_RATIO
) -> DataFrame:
    """Rule-based findings per page: ``(keys, anomaly)``. ``pages`` lists all pages, also empty ones."""
    of = lambda loc: F.col("location") == loc
    at = lambda loc, v: F.when(of(loc), v)
    first_axis = F.min_by(rotation_axis(F.col("rotation")), "line")
    stats = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.min_by("rotation", "line").alias("rotation"),
        first_axis.alias("axis0"),
        *[F.count(at(l, F.lit(1))).alias(l) for l in ("header", "footer")],
        *[F.collect_set(at(l, F.col("axis"))).alias(f"{l}_axes") for l in ("header", "footer")],
        F.max(at("header", F.col("ratio"))).alias("header_max"),
        F.min(at("footer", F.col("ratio"))).alias("footer_min"),
        F.count(at("header", F.col("ratio"))).alias("header_ratios"),
        F.count(at("footer", F.col("ratio"))).alias("footer_ratios"),
        F.sum((F.col("removed_as") == "watermark").cast("long")).alias("watermarks"),
    )
    s = pages.select(*keys).join(stats, keys, "left")
    total = F.coalesce("total", F.lit(0))
    mixed = lambda l: F.size(F.filter(f"{l}_axes", lambda a: a != F.col("axis0"))) > 0
    rules = [
        (total == 0, "empty-page"),
        (~F.col("rotation").isin(fixed.PAGE_ROTATIONS), "rotation-unsupported"),
        ((F.col("header") == 0) & (total >= 2), "no-header-detected"),
        ((F.col("footer") == 0) & (total >= 2), "no-footer-detected"),
        (mixed("header"), "header-rotation-axis-mixed"),
        (mixed("footer"), "footer-rotation-axis-mixed"),
        ((F.col("header") > 0) & (F.col("header_ratios") == 0), "header-baseline-missing"),
        (F.col("header_max") > header * 2, "header-unexpected-baseline"),
        ((F.col("footer") > 0) & (F.col("footer_ratios") == 0), "footer-baseline-missing"),
        (F.col("footer_min") < 1 - footer * 2, "footer-unexpected-baseline"),
        (
            (total >= 4) & (F.coalesce("watermarks", F.lit(0)) >= F.greatest(F.lit(1), F.ceil(total * 0.5))),
            "aggressive-watermark-filter",
        ),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return s.select(*keys, F.explode(found).alias("anomaly"))


def heading_depth(style: Column, sizes: Column, style_map: dict[str, int], size_map: dict[int, int], body_styles: list[str]) -> Column:
    """Depth by style name first; body styles never; else by the largest run size."""
    by_style = F.coalesce(*[F.when(style == n, F.lit(d)) for n, d in style_map.items()], F.lit(None).cast("int"))
    largest = F.floor(F.array_max(F.filter(sizes, lambda s: s.isNotNull()))).cast("int")
    by_size = F.coalesce(*[F.when(largest == k, F.lit(d)) for k, d in size_map.items()], F.lit(None).cast("int"))
    return F.when(by_style.isNotNull(), by_style).when(~style.isin(body_styles), by_size)


def heading_paths(elements: DataFrame, doc: str, pos: str, split_depth: int) -> DataFrame:
    """Folder numbers, file heading and file number in force at every element.

    ``elements``: doc, pos, depth (null for body), text. Headings above the split
    depth are folders, numbered over the document per level; a heading clears all
    deeper folders. Elements before any heading belong to the cover ``000``.
    """
    depth = F.col("depth")
    folder = depth < split_depth
    marks = {f"last_{d}": F.when(depth == d, F.struct(pos, "text")) for d in range(1, split_depth)}
    marks["any_folder"] = F.when(folder, F.col(pos))
    marks["file"] = F.when(depth == split_depth, F.struct(pos, "text"))
    is_depth = lambda d: (F.coalesce(depth, F.lit(0)) == d).cast("int")
    totals = {f"n_{d}": is_depth(d) for d in range(1, split_depth)} | {"file_no": is_depth(split_depth)}
    counted = running_values(elements, [doc], [pos], number_slice(pos, ELEMENTS_PER_SLICE), totals, marks)
    slugs, titles = [], []
    for d in range(1, split_depth):
        here = F.col(f"last_{d}")
        shallower = [F.col(f"last_{s}")[pos] for s in range(1, d)]
        valid = here.isNotNull()
        for s in shallower:
            valid = valid & (s.isNull() | (s < here[pos]))
        slugs.append(F.when(valid, F.lpad(F.col(f"n_{d}").cast("string"), 3, "0")))
        titles.append(F.when(valid, here["text"]))
    path = F.array_compact(F.array(*slugs)) if slugs else F.array().cast("array<string>")
    in_file = F.col("file").isNotNull() & (F.col("any_folder").isNull() | (F.col("file")[pos] > F.col("any_folder")))
    return counted.select(
        doc, pos, "depth", "text",
        F.when(F.size(path) == 0, F.array(F.lit("000"))).otherwise(path).alias("folders"),
        (F.array_compact(F.array(*titles)) if titles else F.array().cast("array<string>")).alias("folder_headings"),
        F.when(in_file, F.col("file")["text"]).otherwise("").alias("heading"),
        F.col("file_no").cast("long").alias("file_no"),
    )


def merge_tables(elements: DataFrame, doc: str, pos: str) -> DataFrame:
    """Tables that continue over page breaks joined two by two; other elements stay.

    ``elements``: doc, pos (consecutive), kind, is_page_break, col_count, rows. A
    table follows another when only page breaks stand between and the column
    counts agree; a repeated header row is dropped. A joined table is not joined
    again, so a run of tables pairs up first with second, third with fourth.
    """
    slice_of = number_slice(pos, ELEMENTS_PER_SLICE)
    solid = elements.filter(~F.coalesce(F.col("is_page_break"), F.lit(False)))
    seq = running_values(solid, [doc], [pos], slice_of, {"_n": F.lit(1)}, previous=[pos, "kind", "col_count"])
    follows = F.coalesce(
        (F.col("kind") == "table")
        & (F.col("prev.kind") == "table")
        & (F.col("prev.col_count") == F.col("col_count"))
        & (F.col(pos) - F.col(f"prev.{pos}") > 1),
        F.lit(False),
    )
    starts = {"_run": F.when(~follows, F.struct(F.col(pos).alias("at"), F.col("_n").alias("n")))}
    placed = running_values(seq, [doc], [pos], slice_of, lasts=starts).withColumn(
        "_pair", F.floor((F.col("_n") - F.col("_run.n")) / 2)
    )
    # at most two tables share a pair
    row = F.struct(pos, "kind", "col_count", "rows")
    pairs = placed.groupBy(doc, "_run", "_pair").agg(F.array_sort(F.collect_list(row)).alias("t"))
    a, b = F.get(F.col("t"), F.lit(0)), F.get(F.col("t"), F.lit(1))
    same_head = F.coalesce(F.get(b.rows, F.lit(0)) == F.get(a.rows, F.lit(0)), F.lit(False))
    tail = F.when(same_head, F.slice(b.rows, F.lit(2), F.greatest(F.size(b.rows) - 1, F.lit(0)))).otherwise(b.rows)
    return pairs.select(
        doc, a[pos].alias(pos), a.kind.alias("kind"), a.col_count.alias("col_count"),
        F.when(b.isNotNull(), F.concat(a.rows, tail)).otherwise(a.rows).alias("rows"),
        b.isNotNull().alias("merged"),
    )


def merge_split_rows(rows: Column) -> Column:
    """Fold fragments of a table row into the row above, below the header.

    A row with a blank first cell and one filled cell appends that cell; one that
    repeats the second cell of the row above appends its third. Blank rows go.
    """
    filled = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    glue = lambda a, b: strip(F.when(filled(a), F.concat(a, F.lit("\n"), b)).otherwise(b))

    def step(acc: Column, row: Column) -> Column:
        used = F.filter(F.transform(row, lambda c, i: F.when(filled(c), i)), lambda i: i.isNotNull())
        return let(F.struct(used.alias("used"), F.element_at(acc, -1).alias("prev")), lambda s: place(acc, row, s["used"], s["prev"]))

    def place(acc: Column, row: Column, used: Column, prev: Column) -> Column:
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        below = (F.size(acc) > 1) & ~filled(F.get(row, F.lit(0)))
        one = below & (F.size(used) == 1)
        second = strip(F.coalesce(F.get(prev, F.lit(1)), F.lit("")))
        repeat = (
            below & (F.size(used) >= 2) & F.array_contains(used, 1) & F.array_contains(used, 2)
            & (second != "") & (strip(F.coalesce(F.get(row, F.lit(1)), F.lit(""))) == second)
        )
        put = lambda k: F.transform(prev, lambda c, i: F.when(i == k, glue(c, F.get(row, k))).otherwise(c))
        return (
            F.when(F.size(used) == 0, acc)
            .when(one, F.array_append(head, put(F.get(used, F.lit(0)))))
            .when(repeat, F.array_append(head, put(F.lit(2))))
            .otherwise(F.array_append(acc, row))
        )

    rest = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.when(F.size(rows) == 0, rows).otherwise(F.aggregate(rest, F.slice(rows, 1, 1), step))


def text_blocks(lines: DataFrame, page_keys: list[str], line: str = "line") -> DataFrame:
    """Lines of a page joined into blocks of one kind.

    Paragraph and heading lines continue a block when kind, colour (and heading
    level) agree and the gap to the line above is small for the font. A hyphen
    at a line's end joins the next line without a space. Windows cover one page.
    """
    w = Window.partitionBy(*page_keys).orderBy(line)
    gap = F.col("top") - F.lag("bottom").over(w)
    size = F.coalesce("size", F.lit(0.0))
    limit = F.when(size <= 0, fixed.PARAGRAPH_GAP_FALLBACK).otherwise(
        F.greatest(F.lit(fixed.PARAGRAPH_GAP_MIN), size * fixed.PARAGRAPH_GAP_RATIO)
    )
    before = lambda c: F.lag(c).over(w)
    agrees = (before("color").isNull() | F.col("color").isNull() | (before("color") == F.col("color"))) & (
        (F.col("kind") != "heading") | F.coalesce(before("level") == F.col("level"), F.lit(False))
    )
    joins = (before("kind") == F.col("kind")) & F.col("kind").isin("paragraph", "heading") & ((gap <= 0) | (agrees & (gap <= limit)))
    marked = lines.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    numbered = marked.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = numbered.groupBy(*page_keys, "block").agg(
        F.first("kind").alias("kind"),
        F.min(line).alias("first_line"),
        F.count(F.lit(1)).alias("lines"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(line), "text"))), lambda s: strip(F.coalesce(s.text, F.lit("")))).alias("t"),
    )
    return blocks.select(*page_keys, "block", "kind", "first_line", "lines", join_lines(F.col("t")).alias("text"))


def join_lines(lines: Column) -> Column:
    """Lines as one text: blanks dropped, a space between, none after a hyphen."""
    used = F.filter(lines, lambda l: l != "")
    joined = F.aggregate(
        used, F.lit(""),
        lambda acc, l: F.when(acc == "", l).when(acc.endswith("-"), F.concat(acc, l)).otherwise(F.concat(acc, F.lit(" "), l)),
    )
    return strip(joined)


def document_ids(lines: DataFrame, doc: str, order: str) -> DataFrame:
    """Id of a document: first ten characters of the first word of its first level-two heading."""
    name = F.regexp_extract(F.trim("text"), r"^##\s+(\S+)", 1)
    named = lines.select(doc, order, F.substring(name, 1, 10).alias("document_id")).filter(F.col("document_id") != "")
    return first_per_key(named, [doc], [order]).select(doc, safe_id(F.col("document_id")).alias("document_id"))


def safe_id(col: Column) -> Column:
    clean = F.regexp_replace(F.trim(col), r"[^A-Za-z0-9._-]", "_")
    return F.when(clean == "", "output").otherwise(clean)

