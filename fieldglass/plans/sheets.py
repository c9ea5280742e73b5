"""Reference-sheet queries: cells printed from the part table, parsed back into records."""

from pyspark.sql import functions as F

from fieldglass.functions import text as tx
from fieldglass.operators import chunks, records, terms
from fieldglass.plans.registry import register
from fieldglass.session import union_all


def _cells(rows, sheet, row, values):
    """Cells of table rows in one scan: ``values`` maps a column number to its text."""
    packed = F.array(*[F.struct(F.lit(c).alias("col"), v.cast("string").alias("value")) for c, v in values.items()])
    return rows.select(sheet.alias("sheet"), row.alias("row"), F.inline(packed))


def _title_rows(sheets, rows):
    """Cells of the leading rows of each sheet: ``(row, col, text)`` triples."""
    packed = F.array(*[F.struct(r.cast("long").alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in rows])
    return sheets.select("sheet", F.inline(packed))


def alarm_cells(t):
    """One sheet per brand. The header stands in row 2 or 3; parts follow; some miss a name."""
    p = t.part
    sheets = p.select(F.col("p_brand").alias("sheet")).distinct()
    at = F.when(F.length("sheet") % 2 == 0, 2).otherwise(3)
    code = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" a"), F.lpad((F.col("p_partkey") % 10000000).cast("string"), 7, "0"), F.lit("R "))).otherwise(
        F.concat(F.lit("H"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.when(F.col("p_size") % 3 == 0, "X").otherwise("D"))
    )
    heads = [(F.lit(1), 1, "Alarm reference")] + [
        (at, i + 1, v) for i, v in enumerate(["Alarm Code", " NAME ", "Level", "Category", "Group"])
    ]
    body = {
        1: code,
        2: F.when(F.col("p_partkey") % 17 != 0, F.col("p_name")),
        3: F.col("p_type"),
        4: F.when(F.col("p_size") > 20, F.col("p_brand")),
        5: F.lit("ignored"),
    }
    return _title_rows(sheets, heads).unionByName(_cells(p, F.col("p_brand"), F.col("p_partkey") + 20, body))


_A = """WITH a AS (SELECT p_brand AS sheet, p_partkey+20 AS row, CASE WHEN p_size%2=0 THEN 'A'||lpad((p_partkey%10000000)::VARCHAR,7,'0')||'R'
  ELSE 'H'||lpad((p_partkey%1000)::VARCHAR,3,'0')||CASE WHEN p_size%3=0 THEN 'X' ELSE 'D' END END AS alarm_id,
  CASE WHEN p_partkey%17<>0 THEN p_name ELSE '' END AS alarm_name, p_type AS severity, CASE WHEN p_size>20 THEN p_brand ELSE '' END AS g,
  CASE WHEN p_size%2=0 THEN 'RAN' WHEN p_size%3=0 THEN 'UNKNOWN' ELSE 'NON_RAN' END AS alarm_type FROM part), b AS (SELECT * FROM a WHERE alarm_name<>'')
"""


@register("alarm_records", _A + 'SELECT sheet, row, alarm_id, alarm_name, severity, g AS "group", alarm_type FROM b')
def alarm_records(t):
    return records.alarm_records(alarm_cells(t))[0]


@register("alarm_rejects", _A + "SELECT sheet, row, 'empty: alarm_name' AS reason FROM a WHERE alarm_name=''")
def alarm_rejects(t):
    return records.alarm_records(alarm_cells(t))[1]


@register(
    "alarm_chunks",
    _A
    + """SELECT row, substr(sha1(sheet || '::' || row || '::' || alarm_id),1,24) AS chunk_id, 'Alarm: ' || alarm_id || ' — ' || alarm_name ||
    CASE WHEN alarm_type<>'UNKNOWN' THEN chr(10) || 'Type: ' || alarm_type ELSE '' END || chr(10) || 'Severity: ' || severity ||
    CASE WHEN g<>'' THEN chr(10) || 'Group: ' || g ELSE '' END AS text FROM b""",
)
def alarm_chunks(t):
    good = records.alarm_records(alarm_cells(t))[0]
    out = chunks.chunk_records(good, "sheet", "row", "alarm_id", records.alarm_text(), "alarm_ref", F.lit(""))
    return out.select(F.col("chunk_index").alias("row"), "chunk_id", "text")


@register(
    "alarm_keywords",
    _A + "SELECT row, alarm_id || '|' || alarm_name || '|' || severity || CASE WHEN g<>'' THEN '|' || g ELSE '' END || '|' || alarm_type AS keywords FROM b",
)
def alarm_keywords(t):
    good = records.alarm_records(alarm_cells(t))[0]
    return good.select("row", F.array_join(records.alarm_keywords(), "|").alias("keywords"))


@register(
    "alarm_lookup",
    _A
    + """SELECT l_orderkey, l_linenumber, l_extendedprice AS x, alarm_id, arg_name AS alarm_name FROM lineitem JOIN
    (SELECT alarm_id, arg_max(alarm_name, row) AS arg_name FROM b GROUP BY 1) ON alarm_id='H'||lpad((l_partkey%1000)::VARCHAR,3,'0')||'D'""",
)
def alarm_lookup(t):
    good = records.alarm_records(alarm_cells(t))[0]
    code = F.concat(F.lit(" h"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit("d"))
    asked = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), code.alias("code"))
    return records.alarm_lookup(asked, good, "code", ["row"]).select("l_orderkey", "l_linenumber", "x", "alarm_id", "alarm_name")


@register("alarm_name_search", _A + "SELECT row, alarm_id FROM b WHERE contains(lower(alarm_name),'red')")
def alarm_name_search(t):
    return records.search_by_name(records.alarm_records(alarm_cells(t))[0], " ReD ").select("row", "alarm_id")


@register("code_classes", """SELECT CASE WHEN p_size%2=0 THEN 'RAN' WHEN p_size%3=0 THEN 'UNKNOWN' ELSE 'NON_RAN' END AS kind, count(*) AS n FROM part GROUP BY 1""")
def code_classes(t):
    code = F.when(F.col("p_size") % 2 == 0, "a0000001r ").when(F.col("p_size") % 3 == 0, "A12D4").otherwise("h001D")
    return t.part.groupBy(tx.alarm_type(code).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def counter_cells(t):
    """Counter sheets: the group cell is merged over each run of ten parts; ranges come in one column."""
    p = t.part.withColumn("row", F.col("p_partkey") + 20)
    sheets = t.region.select(F.col("r_name").alias("sheet"), F.col("r_regionkey").alias("k"))
    keyed = p.withColumn("k", F.floor(F.col("p_partkey") / 10) % 5).join(sheets, "k")
    heads = ["Layer", "카운터명", "Value Range", "Unit", "Feature ID", "Sub Group", "No"]
    first = F.col("p_partkey") % 10 == 0
    size = F.col("p_size").cast("string")
    span = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("0 ~ "), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("1-"), size)).otherwise(size)
    body = {
        1: F.when(first, F.col("p_type")),
        2: F.concat(F.col("p_name"), F.lit("."), F.col("p_partkey").cast("string")),
        3: span,
        4: F.lit("ms"),
        6: F.col("p_brand"),
        7: F.concat(F.lit("G-"), size),
    }
    cells = _title_rows(sheets, [(F.lit(4), i + 1, v) for i, v in enumerate(heads)]).unionByName(
        _cells(keyed, F.col("sheet"), F.col("row"), body).filter(F.col("value").isNotNull())
    )
    merges = keyed.filter(first).select(
        "sheet", F.col("row").alias("row0"), (F.col("row") + 9).alias("row1"), F.lit(1).alias("col0"), F.lit(1).alias("col1")
    )
    return cells, merges


_C = """WITH c AS (SELECT p_partkey+20 AS row, r_name AS sheet, p_partkey, p_name || '.' || p_partkey AS counter_name, p_size, p_brand,
  (SELECT any_value(q.p_type) FROM part q WHERE q.p_partkey = p.p_partkey - p.p_partkey%10) AS large_group FROM part p JOIN region ON r_regionkey=(p_partkey//10)%5),
 d AS (SELECT *, coalesce(large_group,'') AS lg, CASE p_size%3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE p_size::VARCHAR END AS min_val,
  CASE WHEN p_size%3<2 THEN p_size::VARCHAR ELSE '' END AS max_val FROM c)
"""


@register("counter_records", _C + "SELECT sheet, row, counter_name, lg AS large_group, p_brand AS mid_group, min_val, max_val, 'ms' AS unit FROM d")
def counter_records(t):
    cells, merges = counter_cells(t)
    good = records.counter_records(cells, merges)[0]
    return good.select("sheet", "row", "counter_name", "large_group", "mid_group", "min_val", "max_val", "unit")


@register(
    "counter_texts",
    _C
    + """SELECT row, 'Counter: ' || counter_name || chr(10) || 'Group: ' || CASE WHEN lg<>'' THEN lg || ' > ' ELSE '' END || p_brand || ' [ID: G-' || p_size || ']' || chr(10) || 'Unit: ms' || chr(10)
    || 'Value Range: ' || min_val || CASE WHEN max_val<>'' THEN ' ~ ' || max_val ELSE '' END AS text FROM d""",
)
def counter_texts(t):
    cells, merges = counter_cells(t)
    return records.counter_records(cells, merges)[0].select("row", records.counter_text().alias("text"))


def parameter_cells(t):
    """One parameter sheet per product type."""
    p = t.part
    sheets = p.select(F.col("p_type").alias("sheet")).distinct()
    heads = ["Hierarchy", "Parameter", "Default", "Range", "Unit", "Unit", "Feature"]
    body = {
        0: F.concat(F.lit("/root/"), F.col("p_brand"), F.lit("/cell")),
        1: F.when(F.col("p_size") != 7, F.concat(F.col("p_name"), F.lit("Timer"))),
        2: F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")),
        3: F.lit("0..9"),
        4: F.lit("first"),
        5: F.lit("dB"),
        6: F.col("p_brand"),
    }
    titles = _title_rows(sheets, [(F.lit(1), i, v) for i, v in enumerate(heads)])
    return titles.unionByName(_cells(p, F.col("p_type"), F.col("p_partkey") + 2, body))


@register(
    "parameter_texts",
    """SELECT p_partkey+2 AS row, 'cell' AS mo_name, 'Parameter: ' || p_name || 'Timer' || chr(10) || 'Hierarchy: /root/' || p_brand || '/cell' || chr(10) || 'Value: ' ||
       CASE WHEN p_size%2=0 THEN 'default=' || p_size || ', ' ELSE '' END || 'range=0..9' || chr(10) || 'Units: dB' || chr(10) || 'Feature: ' || p_brand AS text FROM part WHERE p_size<>7""",
)
def parameter_texts(t):
    good = records.parameter_records(parameter_cells(t))[0]
    return good.select("row", records.leaf_object(F.col("yang_path")).alias("mo_name"), records.parameter_text().alias("text"))


@register(
    "value_ranges",
    """SELECT l_orderkey, l_linenumber, l_extendedprice AS x, CASE WHEN l_linenumber%3=0 THEN '' ELSE l_quantity::BIGINT::VARCHAR END AS low,
       CASE WHEN l_linenumber%3=0 THEN l_quantity::BIGINT::VARCHAR WHEN l_linenumber%3=1 THEN l_suppkey::VARCHAR ELSE '' END AS high FROM lineitem""",
)
def value_ranges(t):
    q, s = F.col("l_quantity").cast("long").cast("string"), F.col("l_suppkey").cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("-"), q)).when(F.col("l_linenumber") % 3 == 1, F.concat(q, F.lit(" ~ "), s)).otherwise(q)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), tx.range_low(raw).alias("low"), tx.range_high(raw).alias("high")
    )


@register(
    "counter_triples",
    """WITH p AS (SELECT p_name || p_partkey AS n, p_partkey, p_brand, p_size FROM part WHERE p_size<>3)
       SELECT n AS subject, 'CATEGORY_OF' AS predicate, p_brand AS object, 'CATEGORY::' || p_brand || '::' || n AS object_node_key FROM p WHERE p_size<>5
       UNION ALL SELECT n, 'COUNTERS_OF', 'F' || x, 'FEATURE:F' || x FROM p, (SELECT unnest([1,2]) AS x) WHERE p_size%2=0""",
)
def counter_triples(t):
    rows = t.part.select(
        F.when(F.col("p_size") != 5, F.col("p_brand")).alias("category"),
        F.concat(F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") != 3, F.col("p_partkey").cast("double")).alias("counter_id"),
        F.when(F.col("p_size") % 2 == 0, " F1 ;, F2|").otherwise("").alias("system_ids"),
    )
    return records.counter_triples(rows).select("subject", "predicate", "object", "object_node_key")


@register(
    "parameter_triples",
    """SELECT p_name AS subject, 'F' || x AS object, 'PARAMETER:' || p_brand || ':' || p_name AS subject_node_key, p_size::VARCHAR AS dv FROM part, (SELECT unnest([1,2]) AS x)""",
)
def parameter_triples(t):
    rows = t.part.select(
        F.col("p_brand").alias("hierarchy"), F.col("p_name").alias("parameter"), F.lit(None).cast("string").alias("range"),
        F.col("p_size").cast("double").alias("default_value"), F.lit("F1\nF2").alias("system_ids"),
    )
    return records.parameter_triples(rows).select(
        "subject", "object", "subject_node_key", F.col("subject_properties")["default_value"].alias("dv")
    )


@register(
    "parameter_rows",
    "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_retailprice AS range_max, NULL::DOUBLE AS range_min FROM part",
)
def parameter_rows(t):
    s = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" "))
    rows = t.part.select(
        s("p_partkey").alias("id"), s("p_name").alias("name"), F.lit("int").alias("data_type"), F.lit("").alias("default_value"),
        F.lit("dB").alias("unit"), F.lit(None).cast("string").alias("description"), F.col("p_brand").alias("linked_feature_id"),
        F.when(F.col("p_size") % 2 == 0, "low").otherwise(" ").alias("range_min"), s("p_retailprice").alias("range_max"),
    )
    return records.parameter_rows(rows).select("id", "name", "range_max", "range_min")


@register(
    "glossary",
    r"""SELECT name, arg_max(f, k) AS feature_id FROM (SELECT p_name AS name, p_partkey AS k, p_brand AS f FROM part UNION ALL SELECT p_type, p_partkey, '' FROM part) GROUP BY 1
        UNION ALL SELECT n_name, 'old' FROM nation""",
)
def glossary(t):
    """Names of parts and types, last one wins, merged over nation names kept from before."""
    rows = union_all(
        [
            t.part.select(F.concat(F.col("p_name"), F.lit(" ")).alias("name"), F.col("p_brand").alias("feature_id"), F.col("p_partkey").alias("k")),
            t.part.select(F.col("p_type").alias("name"), F.lit(None).cast("string").alias("feature_id"), F.col("p_partkey").alias("k")),
            t.part.select(F.substring("p_name", 1, 2).alias("name"), F.lit("noise").alias("feature_id"), F.col("p_partkey").alias("k")),
        ]
    )
    new = terms.glossary(rows, "name", ["feature_id"], ["k"])
    old = t.nation.select(F.col("n_name").alias("name"), F.lit("old").alias("feature_id"))
    return terms.merge_glossary(old, new, "name")


@register("glossary_cleanup", "SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size=1)")
def glossary_cleanup(t):
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    return terms.without_deprecated(names, t.part.filter("p_size = 1").select(F.col("p_name").alias("name")), "name")


@register(
    "feature_documents",
    """SELECT o_orderkey, 'F' || o_orderkey AS feature_id, 'Order ' || o_custkey AS name, o_orderstatus AS gen, 'first second' AS description FROM orders""",
)
def feature_documents(t):
    return feature_texts(t).select("o_orderkey", records.feature_header(F.col("text")).alias("h")).select(
        "o_orderkey", "h.feature_id", "h.name", "h.gen", "h.description"
    )


def feature_texts(t):
    """Orders printed as feature documents with a table of their values."""
    s = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("# Feature: Order "), s("o_custkey"), F.lit("\n**Feature ID**: F"), s("o_orderkey"), F.lit("\n**Generation**: "), F.col("o_orderstatus"),
        F.lit(" \n\n## Description\n first\n\nsecond\n## KPI Impact\n\n| KPI ID | Direction | Magnitude |\n|---|---|---|\n| k1 | + | "), F.col("o_orderpriority"),
        F.lit(" |\n| k2 | - |\n\n## Notes\n| KPI ID |\n|---|\n| no |\n"),
    )
    return t.orders.select("o_orderkey", text.alias("text"))


@register(
    "feature_impacts",
    """SELECT o_orderkey, 'k1' AS kpi_id, '+' AS direction, o_orderpriority AS magnitude FROM orders UNION ALL SELECT o_orderkey, 'k2', '-', '' FROM orders""",
)
def feature_impacts(t):
    cols = {"kpi_id": "KPI ID", "direction": "Direction", "magnitude": "Magnitude"}
    return records.feature_tables(feature_texts(t), "o_orderkey", "text", "KPI Impact", cols).drop("pos")
