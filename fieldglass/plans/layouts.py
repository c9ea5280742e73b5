"""Layout queries: document lines with made-up but deterministic geometry."""

from pyspark.sql import functions as F

from fieldglass.operators import layout
from fieldglass.plans.registry import register


def text_lines(t):
    """Every line of every document; the source is the document, the doc_id the page."""
    rows = t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    n = F.length("text")
    i = F.col("line")
    return rows.select(
        "doc", "page", "line", "text",
        (F.lit(8.0) + n % 3).alias("size"),
        F.when(n % 4 == 0, "red").otherwise("black").alias("color"),
        F.when(n % 5 == 0, "heading").otherwise("paragraph").alias("kind"),
        (n % 2).cast("int").alias("level"),
        (i * 12.0 + F.when(i % 3 == 2, 6.0).otherwise(0.0)).alias("top"),
        (i * 12.0 + 10.0).alias("bottom"),
        F.when(n % 11 == 0, 90).when(n % 13 == 0, 55).otherwise(0).alias("rotation"),
        F.when(n % 2 == 0, "Arial").when(n % 3 == 0, "Times").otherwise("").alias("font"),
    )


_L = """WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
 g AS (SELECT *, length(text) AS n FROM l), x AS (SELECT *, 8.0::DOUBLE+n%3 AS size, CASE WHEN n%4=0 THEN 'red' ELSE 'black' END AS color,
  CASE WHEN n%5=0 THEN 'heading' ELSE 'paragraph' END AS kind, n%2 AS level, line*12.0::DOUBLE + CASE WHEN line%3=2 THEN 6 ELSE 0 END AS top, line*12.0::DOUBLE+10 AS bottom,
  CASE WHEN n%11=0 THEN 90 WHEN n%13=0 THEN 55 ELSE 0 END AS rotation, CASE WHEN n%2=0 THEN 'Arial' WHEN n%3=0 THEN 'Times' ELSE '' END AS font FROM g)
"""


@register(
    "style_profile",
    _L
    + r""", s AS (SELECT doc, size, color, count(*) AS line_count, count(DISTINCT page) AS page_count, min(page) AS sample_page FROM x GROUP BY 1,2,3),
    f AS (SELECT doc, size, color, trim(text) AS t, min((page, line)) AS p1 FROM x WHERE trim(text)<>'' GROUP BY 1,2,3,4),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc, size, color ORDER BY p1) AS k FROM f),
    j AS (SELECT doc, size, color, string_agg(t, '|' ORDER BY k) AS samples FROM r WHERE k<=3 GROUP BY 1,2,3)
    SELECT s.doc, s.size AS font_size, s.color, line_count, page_count, sample_page, samples FROM s LEFT JOIN j ON s.doc=j.doc AND s.size=j.size AND s.color=j.color""",
)
def style_profile(t):
    p = layout.style_profile(text_lines(t), ["doc"])
    return p.select("doc", "font_size", "color", "line_count", "page_count", "sample_page", F.array_join("sample_texts", "|").alias("samples"))


def placed_lines(t):
    """Lines with a box, a region and a removal mark on a page of 40 lines."""
    l = text_lines(t)
    h, w = F.lit(480.0), F.lit(600.0)
    x0, x1 = F.lit(50.0), F.lit(50.0) + F.length("text")
    loc = layout.region(x0, F.col("top"), x1, F.col("bottom"), F.col("rotation"), w, h)
    return l.select(
        "doc", "page", "line", "size", "rotation", "font", F.lit(50.0).alias("x0"), F.col("top").alias("y0"), x1.alias("x1"), F.col("bottom").alias("y1"),
        loc.alias("location"), layout.rotation_axis(F.col("rotation")).alias("axis"), F.col("bottom").alias("baseline"), (F.col("bottom") / h).alias("ratio"),
        layout.is_watermark_rotation(F.col("rotation")).alias("removed"),
        F.when(layout.is_watermark_rotation(F.col("rotation")), "watermark").alias("removed_as"),
    )


_P = (
    _L
    + """, p AS (SELECT *, 50.0 AS x0, 50.0+n AS x1, CASE WHEN rotation=90 THEN CASE WHEN (100+n)/2.0<=600*0.08 THEN 'header' WHEN (100+n)/2.0>=600*0.92 THEN 'footer' ELSE 'body' END
  ELSE CASE WHEN (top+bottom)/2<=480*0.08 THEN 'header' WHEN (top+bottom)/2>=480*0.92 THEN 'footer' ELSE 'body' END END AS location,
  CASE WHEN rotation=90 THEN 'x' ELSE 'y' END AS axis, bottom/480.0 AS ratio, rotation=55 AS removed FROM x)
"""
)


@register("line_regions", _P + "SELECT location, axis, count(*) AS n, sum(removed::INT)::BIGINT AS removed FROM p GROUP BY 1,2")
def line_regions(t):
    return placed_lines(t).groupBy("location", "axis").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("removed").cast("long")).alias("removed"))


@register(
    "region_statistics",
    _P
    + """, s AS (SELECT doc, location, count(*) AS "count", sum((NOT removed)::INT)::BIGINT AS kept_count, sum(removed::INT)::BIGINT AS removed_count, min(size) AS size_min, max(size) AS size_max,
    round(avg(size),6) AS size_avg, min(bottom) AS baseline_min, max(bottom) AS baseline_max, round(avg(ratio),6) AS ratio_avg, sum((axis='x')::INT)::BIGINT AS axis_x, max(x1)::DOUBLE AS x1, min(top) AS y0 FROM p GROUP BY 1,2),
    f AS (SELECT doc, location, font, count(*) AS c FROM p WHERE font<>'' GROUP BY 1,2,3), fr AS (SELECT doc, location, string_agg(font,'|' ORDER BY c DESC, font) AS fonts FROM f GROUP BY 1,2),
    r AS (SELECT doc, location, rotation::VARCHAR AS r, count(*) AS c FROM p GROUP BY 1,2,3), rr AS (SELECT doc, location, string_agg(r || '=' || c, ',' ORDER BY r) AS rotations FROM r GROUP BY 1,2)
    SELECT s.*, coalesce(fonts,'') AS fonts, rotations FROM s LEFT JOIN fr USING (doc, location) LEFT JOIN rr USING (doc, location)""",
)
def region_statistics(t):
    s = layout.region_statistics(placed_lines(t), ["doc"])
    rot = F.array_join(F.transform(F.map_entries("rotations"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select(
        "doc", "location", "count", "kept_count", "removed_count", "size_min", "size_max", F.round("size_avg", 6).alias("size_avg"),
        "baseline_min", "baseline_max", F.round("ratio_avg", 6).alias("ratio_avg"), "axis_x", "x1", "y0",
        F.coalesce(F.array_join("top_fonts", "|"), F.lit("")).alias("fonts"), rot.alias("rotations"),
    )


@register(
    "page_anomalies",
    _P
    + """, u AS (SELECT * FROM p WHERE page%50<>0), a AS (SELECT page, count(*) AS total, arg_min(rotation, line) AS r0, arg_min(axis, line) AS a0, count(*) FILTER (WHERE location='header') AS h, count(*) FILTER (WHERE location='footer') AS f,
    max(ratio) FILTER (WHERE location='header') AS hm, min(ratio) FILTER (WHERE location='footer') AS fm, sum(removed::INT) AS wm,
    count(*) FILTER (WHERE location='header' AND axis='x') AS hx, count(*) FILTER (WHERE location='header' AND axis='y') AS hy, count(*) FILTER (WHERE location='footer' AND axis='x') AS fx, count(*) FILTER (WHERE location='footer' AND axis='y') AS fy FROM u GROUP BY 1),
    z AS (SELECT doc_id AS page, a.* EXCLUDE (page) FROM documents LEFT JOIN a ON a.page=doc_id)
    SELECT page, 'empty-page' AS anomaly FROM z WHERE coalesce(total,0)=0
    UNION ALL SELECT page, 'rotation-unsupported' FROM z WHERE r0 NOT IN (0,90,180,270)
    UNION ALL SELECT page, 'no-header-detected' FROM z WHERE h=0 AND total>=2 UNION ALL SELECT page, 'no-footer-detected' FROM z WHERE f=0 AND total>=2
    UNION ALL SELECT page, 'header-rotation-axis-mixed' FROM z WHERE CASE WHEN a0='x' THEN hy ELSE hx END>0
    UNION ALL SELECT page, 'footer-rotation-axis-mixed' FROM z WHERE CASE WHEN a0='x' THEN fy ELSE fx END>0
    UNION ALL SELECT page, 'header-unexpected-baseline' FROM z WHERE hm>0.16 UNION ALL SELECT page, 'footer-unexpected-baseline' FROM z WHERE fm<0.84
    UNION ALL SELECT page, 'aggressive-watermark-filter' FROM z WHERE total>=4 AND wm>=greatest(1, ceil(total*0.5))""",
)
def page_anomalies(t):
    pages = t.documents.select(F.col("doc_id").alias("page"))
    return layout.page_anomalies(pages, placed_lines(t).filter(F.col("page") % 50 != 0), ["page"])


@register(
    "text_blocks",
    _L
    + """, o AS (SELECT *, lag(kind) OVER w AS pk, lag(color) OVER w AS pc, lag(level) OVER w AS pl, top-lag(bottom) OVER w AS gap FROM x WINDOW w AS (PARTITION BY page ORDER BY line)),
    b AS (SELECT *, sum(CASE WHEN pk=kind AND (gap<=0 OR ((pc=color) AND (kind<>'heading' OR pl=level) AND gap<=greatest(4.0, size*0.45))) THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line) AS block FROM o)
    SELECT page, block::BIGINT AS block, any_value(kind) AS kind, min(line)::INTEGER AS first_line, count(*) AS lines FROM b GROUP BY 1,2""",
)
def text_blocks(t):
    return layout.text_blocks(text_lines(t), ["page"]).select("page", "block", "kind", "first_line", "lines")


def element_table(t):
    """Order lines as document elements: headings of depth 1 and 2, file headings of depth 3, body."""
    from fieldglass.operators.ordered import running_totals, number_slice

    k = F.col("o_orderkey")
    style = F.when(k % 41 == 0, "H1").when(k % 13 == 0, "H2").when(k % 7 == 0, "odd").otherwise("Body")
    depth = layout.heading_depth(style, F.array(F.lit(9.5), F.when(k % 5 != 0, F.lit(14.2))), {"H1": 1, "H2": 2}, {14: 3}, ["Body"])
    return t.orders.select(F.col("o_orderpriority").alias("doc"), k.alias("pos"), depth.alias("depth"), k.cast("string").alias("text"))


_H = """WITH e AS (SELECT o_orderpriority AS doc, o_orderkey AS pos, CASE WHEN o_orderkey%41=0 THEN 1 WHEN o_orderkey%13=0 THEN 2 WHEN o_orderkey%7=0 AND o_orderkey%5<>0 THEN 3 END AS depth FROM orders),
 m AS (SELECT *, max(CASE WHEN depth=1 THEN pos END) OVER w AS p1, max(CASE WHEN depth=2 THEN pos END) OVER w AS p2, max(CASE WHEN depth=3 THEN pos END) OVER w AS p3,
  count(CASE WHEN depth=1 THEN 1 END) OVER w AS c1, count(CASE WHEN depth=2 THEN 1 END) OVER w AS c2, count(CASE WHEN depth=3 THEN 1 END) OVER w AS c3 FROM e WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))
"""


@register(
    "heading_paths",
    _H
    + """SELECT doc, pos, CASE WHEN p1 IS NULL AND p2 IS NULL THEN '000' WHEN p1 IS NULL THEN lpad(c2::VARCHAR,3,'0') WHEN p2 IS NULL OR p2<p1 THEN lpad(c1::VARCHAR,3,'0')
    ELSE lpad(c1::VARCHAR,3,'0') || '/' || lpad(c2::VARCHAR,3,'0') END AS folders, CASE WHEN p3 > coalesce(greatest(p1,p2),-1) THEN p3::VARCHAR ELSE '' END AS heading, c3 AS file_no FROM m""",
)
def heading_paths(t):
    out = layout.heading_paths(element_table(t), "doc", "pos", 3)
    return out.select("doc", "pos", F.array_join("folders", "/").alias("folders"), "heading", "file_no")


def table_elements(t):
    """Orders in key order as a run of tables, page breaks and paragraphs per priority."""
    from fieldglass.operators.ordered import number_slice, running_totals

    numbered = running_totals(t.orders, ["o_orderpriority"], ["o_orderkey"], {"pos": F.lit(1)}, number_slice("o_orderkey", 100000))
    kind = F.when(F.col("pos") % 2 == 0, "break").when(F.col("pos") % 15 == 1, "paragraph").otherwise("table")
    head = F.array(F.lit("h"), F.when(F.col("pos") % 7 == 0, "other").otherwise("x"))
    return numbered.select(
        F.col("o_orderpriority").alias("doc"), "pos", kind.alias("kind"), (F.col("pos") % 2 == 0).alias("is_page_break"),
        F.when(kind == "table", F.lit(2) + (F.col("pos") % 11 == 0).cast("int")).alias("col_count"),
        F.when(kind == "table", F.array(head, F.array(F.col("o_orderkey").cast("string")))).alias("rows"),
    )


@register(
    "table_continuation",
    """WITH n AS (SELECT o_orderpriority AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pos FROM orders),
       e AS (SELECT doc, pos, k, CASE WHEN pos%15=1 THEN 'paragraph' ELSE 'table' END AS kind, CASE WHEN pos%15<>1 THEN 2+(pos%11=0)::INT END AS cc, (pos%7=0) AS oh FROM n WHERE pos%2=1),
       f AS (SELECT *, coalesce(kind='table' AND lag(kind) OVER w='table' AND lag(cc) OVER w=cc, false) AS fl FROM e WINDOW w AS (PARTITION BY doc ORDER BY pos)),
       r AS (SELECT *, sum((NOT fl)::INT) OVER (PARTITION BY doc ORDER BY pos) AS run FROM f),
       i AS (SELECT *, row_number() OVER (PARTITION BY doc, run ORDER BY pos)-1 AS ix FROM r)
       SELECT doc, min(pos) AS pos, any_value(kind) AS kind, count(*)=2 AS merged,
       CASE WHEN any_value(kind)='table' THEN 2*count(*) - CASE WHEN count(*)=2 AND min(oh::INT)=max(oh::INT) THEN 1 ELSE 0 END END AS n_rows FROM i GROUP BY doc, run, ix//2""",
)
def table_continuation(t):
    m = layout.merge_tables(table_elements(t), "doc", "pos")
    return m.select("doc", "pos", "kind", "merged", F.when(F.col("kind") == "table", F.size("rows")).cast("long").alias("n_rows"))


@register(
    "split_rows",
    """SELECT o_orderkey, 'h1|h2|h3/' || o_custkey || '|b' || chr(10) || 'more|c' || chr(10) || 'again/z|b2|' AS rows FROM orders""",
)
def split_rows(t):
    """Table rows broken into fragments and put together again."""
    a = lambda *v: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v])
    rows = F.array(
        a("h1", "h2", "h3"), a(F.col("o_custkey").cast("string"), "b", "c"), a("", "more", " "), a(" ", "", ""), a("", "b\nmore", "again"), a("z", "b2", ""),
    )
    fixed_rows = layout.merge_split_rows(rows)
    return t.orders.select("o_orderkey", F.array_join(F.transform(fixed_rows, lambda r: F.array_join(r, "|")), "/").alias("rows"))


@register(
    "paragraph_join",
    r"""SELECT doc_id, length(replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x<>''), ' '), '- ', '-'))::INTEGER AS n FROM documents WHERE NOT regexp_matches(text, '- ') AND NOT regexp_matches(text,'-[\t ]*\n\s*\n')""",
)
def paragraph_join(t):
    d = t.documents.filter(~F.col("text").contains("- ") & ~F.col("text").rlike(r"-[\t ]*\n\s*\n"))
    lines = F.transform(F.split("text", "\n"), lambda l: F.trim(l))
    return d.select("doc_id", F.length(layout.join_lines(lines)).alias("n"))


@register(
    "document_ids",
    """SELECT source AS doc, regexp_replace(substr('D#'||min(doc_id)||'-heading',1,10),'[^A-Za-z0-9._-]','_','g') AS document_id FROM documents GROUP BY 1""",
)
def document_ids(t):
    lines = t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("line"), F.concat(F.lit("## D#"), F.col("doc_id").cast("string"), F.lit("-heading of page")).alias("text"))
    return layout.document_ids(lines, "doc", "line")


@register(
    "page_headings",
    r"""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title, regexp_replace(trim(regexp_replace(lower(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)),'[^a-z0-9]+','_','g'),'_'),'$','') AS slug FROM pages""",
)
def page_headings(t):
    from fieldglass.functions.text import slug

    title = F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)
    return t.pages.select("page_id", title.alias("title"), slug(title).alias("slug"))
