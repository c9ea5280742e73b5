"""Reference sheets as cell tables ``(sheet, row, col, value)``: headers, records, texts, triples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import alarm_type, range_high, range_low, strip

#: Parts that the rows of one sheet are dealt into when they meet its header.
SHEET_SLICES = 64


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Copy the top value of each merge range ``(sheet, row0, row1, col0, col1)`` to all its cells.

    Ranges are unfolded into cell coordinates, which makes the lookup an equi-join.
    """
    covered = merges.select(
        "sheet", "row0", "col0",
        F.explode(F.sequence("row0", "row1")).alias("row"), "col1",
    ).select("sheet", "row0", "col0", "row", F.explode(F.sequence("col0", "col1")).alias("col"))
    top = cells.select("sheet", F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("value").alias("_top"))
    filled = covered.join(top, ["sheet", "row0", "col0"], "left").select("sheet", "row", "col", "_top", F.lit(True).alias("_in"))
    merged = cells.join(filled, ["sheet", "row", "col"], "full")
    value = F.when(F.col("_in"), F.col("_top")).otherwise(F.col("value"))
    return merged.select("sheet", "row", "col", value.alias("value")).filter(F.col("value").isNotNull())


def header_columns(cells: DataFrame, aliases: dict[str, str], required: list[str], last: bool = False, header_rows: int | None = fixed.HEADER_ROWS) -> DataFrame:
    """Header row and fields of each sheet: ``(sheet, header_row, fields)``, ``fields`` a map of column to field.

    The header is the first of the leading ``header_rows`` rows (of all, if None) whose cells name
    all required fields. When two columns name a field the first one counts (``last``: the last).
    """
    names = cells.sparkSession.createDataFrame(list(aliases.items()), "alias string, field string")
    head = cells.filter(F.col("value").isNotNull())
    if header_rows is not None:
        head = head.filter(F.col("row") <= header_rows)
    named = head.withColumn("alias", F.lower(strip(F.col("value")))).join(F.broadcast(names), "alias")  # the aliases are a fixed list
    pick = F.max("col") if last else F.min("col")
    fields = named.groupBy("sheet", "row", "field").agg(pick.alias("col"))
    rows = fields.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "field"))).alias("fields"))
    need = F.array(*[F.lit(r) for r in required])
    complete = rows.filter(F.size(F.array_except(need, F.map_values("fields"))) == 0)
    return complete.groupBy("sheet").agg(F.min("row").alias("header_row"), F.min_by("fields", "row").alias("fields"))


def headerless_rejects(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """A reject without a row for each sheet that has no header."""
    return sheets_without_header(cells, columns).select("sheet", F.lit(None).cast(cells.schema["row"].dataType).alias("row"), F.lit("no header row").alias("reason"))


def sheets_without_header(cells: DataFrame, columns: DataFrame) -> DataFrame:
    return cells.select("sheet").distinct().join(columns.select("sheet"), "sheet", "left_anti")


def sheet_records(cells: DataFrame, columns: DataFrame, fields: list[str]) -> DataFrame:
    """Rows below the header as one column per field, trimmed, missing cells empty; blank rows dropped.

    The rows of a sheet are dealt into slices and the header, one row per sheet, is copied to each. The header
    is named as the side that is hashed: by its estimates Spark would send all cells through the driver.
    """
    slice_ = F.pmod(F.xxhash64("row"), F.lit(SHEET_SLICES)).cast("int")
    present = cells.filter(F.col("value").isNotNull()).withColumn("_slice", slice_)
    heads = columns.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SHEET_SLICES - 1))))
    body = present.join(heads.hint("shuffle_hash"), ["sheet", "_slice"]).filter(F.col("row") > F.col("header_row"))
    placed = body.select("sheet", "_slice", "row", F.col("fields")[F.col("col")].alias("field"), strip(F.col("value")).alias("v"))
    # dealt by sheet and slice already, so the rows need no other shuffle
    return placed.groupBy("sheet", "_slice", "row").agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("v"))), F.lit("")).alias(f) for f in fields]
    ).drop("_slice")


def split_rejects(records: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Usable records, and rows that lack a required value with the reason."""
    lacking = F.array_compact(F.array(*[F.when(F.col(r) == "", F.lit(r)) for r in required]))
    marked = records.withColumn("_l", lacking)
    good = marked.filter(F.size("_l") == 0).drop("_l")
    bad = marked.filter(F.size("_l") > 0).select("sheet", "row", F.concat(F.lit("empty: "), F.array_join("_l", ", ")).alias("reason"))
    return good, bad


def alarm_records(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    columns = header_columns(cells, fixed.ALARM_HEADERS, fixed.ALARM_REQUIRED)
    good, bad = split_rejects(sheet_records(cells, columns, ["alarm_id", "alarm_name", "severity", "group"]), fixed.ALARM_REQUIRED)
    return good.withColumn("alarm_id", F.upper("alarm_id")).withColumn("alarm_type", alarm_type(F.col("alarm_id"))), bad.unionByName(headerless_rejects(cells, columns))


COUNTER_FIELDS = [
    "large_group", "mid_group", "mid_group_id", "counter_name", "description",
    "period", "unit", "min_val", "max_val", "value_range", "feature_id",
]


def counter_records(cells: DataFrame, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Counter sheets with merged cells filled and a combined range column split when min and max are empty."""
    full = cells if merges is None else fill_merged(cells, merges)
    columns = header_columns(full, fixed.COUNTER_HEADERS, fixed.COUNTER_REQUIRED)
    good, bad = split_rejects(sheet_records(full, columns, COUNTER_FIELDS), fixed.COUNTER_REQUIRED)
    split = (F.col("min_val") == "") & (F.col("max_val") == "") & (F.col("value_range") != "")
    raw = F.col("value_range")
    out = good.withColumn("_lo", F.when(split, range_low(raw)).otherwise(F.col("min_val"))).withColumn(
        "max_val", F.when(split, range_high(raw)).otherwise(F.col("max_val"))
    )
    return out.withColumn("min_val", F.col("_lo")).drop("_lo", "value_range"), bad.unionByName(headerless_rejects(full, columns))


def parameter_records(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = list(dict.fromkeys(fixed.PARAMETER_HEADERS.values()))
    columns = header_columns(cells, fixed.PARAMETER_HEADERS, fixed.PARAMETER_REQUIRED, last=True)
    good, bad = split_rejects(sheet_records(cells, columns, fields), fixed.PARAMETER_REQUIRED)
    return good, bad.unionByName(headerless_rejects(cells, columns))


def leaf_object(path: Column) -> Column:
    """Last container of a slash-separated path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))


def _line(label: str, column: str) -> Column:
    return F.when(F.col(column) != "", F.concat(F.lit(f"{label}: "), F.col(column)))


def alarm_text() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Alarm: "), F.col("alarm_id"), F.lit(" — "), F.col("alarm_name")),
        F.when(F.col("alarm_type") != "UNKNOWN", F.concat(F.lit("Type: "), F.col("alarm_type"))),
        _line("Severity", "severity"),
        _line("Group", "group"),
    )


def alarm_keywords() -> Column:
    return F.filter(F.array("alarm_id", "alarm_name", "severity", "group", "alarm_type"), lambda v: v != "")


def counter_text() -> Column:
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    group = F.concat_ws(" > ", some("large_group"), some("mid_group"))
    suffix = F.when(F.col("mid_group_id") != "", F.concat(F.lit(" [ID: "), F.col("mid_group_id"), F.lit("]"))).otherwise("")
    span = F.concat_ws(" ~ ", some("min_val"), some("max_val"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Counter: "), F.col("counter_name")),
        F.when(group != "", F.concat(F.lit("Group: "), group, suffix)),
        _line("Description", "description"),
        _line("Period", "period"),
        _line("Unit", "unit"),
        F.when(span != "", F.concat(F.lit("Value Range: "), span)),
    )


def parameter_text() -> Column:
    part = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}="), F.col(c)))
    value = F.concat_ws(", ", part("default", "default"), part("range", "range"), part("min", "min"), part("max", "max"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Parameter: "), F.col("param_name")),
        F.concat(F.lit("Hierarchy: "), F.col("yang_path")),
        _line("Description", "description"),
        _line("Attribute", "attribute"),
        _line("Status", "status"),
        _line("Type", "type"),
        _line("Pattern", "pattern"),
        F.when(value != "", F.concat(F.lit("Value: "), value)),
        _line("Units", "units"),
        _line("Mandatory", "mandatory"),
        _line("Family", "param_family"),
        _line("Related Feature", "related_feature_id"),
        _line("Feature", "feature_name"),
    )


def alarm_lookup(codes: DataFrame, records: DataFrame, code: str, order: list[str]) -> DataFrame:
    """Records by trimmed upper-case id; the last record of a repeated id counts."""
    latest = records.groupBy(F.upper("alarm_id").alias("_k")).agg(
        F.max_by(F.struct("alarm_name", "severity", "group", "alarm_type"), F.struct(*order)).alias("_r")
    )
    keyed = codes.withColumn("_k", F.upper(strip(F.col(code))))
    return keyed.join(latest, "_k").select(*codes.columns, F.col("_k").alias("alarm_id"), "_r.*")


def search_by_name(records: DataFrame, query: str, column: str = "alarm_name") -> DataFrame:
    wanted = query.strip().lower()
    if not wanted:
        return records.limit(0)
    return records.filter(F.lower(column).contains(wanted))


def cell_text(value: Column) -> Column:
    """Cell as text: whole floats without decimals, blanks as null."""
    text = strip(value.cast("string"))
    whole = F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")
    return F.nullif(whole, F.lit(""))


def split_ids(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value.cast("string"), F.lit("")), r"[;,|\n\r]+"), strip)
    return F.filter(parts, lambda p: p != "")


def _triple(subject: Column, predicate: str, obj: Column, labels: tuple[str, str], keys: tuple[Column, Column], props: Column):
    return F.struct(
        subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"),
        F.lit(labels[0]).alias("subject_label"), F.lit(labels[1]).alias("object_label"),
        keys[0].alias("subject_node_key"), keys[1].alias("object_node_key"), props.alias("subject_properties"),
    )


def counter_triples(rows: DataFrame) -> DataFrame:
    """``(category, name, counter_id, system_ids)`` rows to a category triple and one per system id."""
    c, n, i = cell_text(F.col("category")), cell_text(F.col("name")), cell_text(F.col("counter_id"))
    base = rows.select(c.alias("c"), n.alias("n"), i.alias("i"), split_ids(F.col("system_ids")).alias("ids"))
    base = base.filter(F.col("n").isNotNull() & F.col("i").isNotNull())
    props = F.create_map(F.lit("counter_id"), F.col("i"))
    family = F.concat(F.lit("FAMILY:"), F.col("n"))
    cat = F.when(
        F.col("c").isNotNull(),
        F.array(_triple(F.col("n"), "CATEGORY_OF", F.col("c"), ("FAMILY", "CATEGORY"), (family, F.concat(F.lit("CATEGORY::"), F.col("c"), F.lit("::"), F.col("n"))), props)),
    )
    of = F.transform(
        "ids", lambda s: _triple(F.col("n"), "COUNTERS_OF", s, ("FAMILY", "FEATURE"), (family, F.concat(F.lit("FEATURE:"), s)), props)
    )
    return base.select(F.explode(F.concat(F.coalesce(cat, F.slice(of, 1, 0)), of)).alias("t")).select("t.*")


def parameter_triples(rows: DataFrame) -> DataFrame:
    """``(hierarchy, parameter, range, default_value, system_ids)`` rows to one triple per system id."""
    col = lambda c: cell_text(F.col(c)).alias(c)
    base = rows.select(col("hierarchy"), col("parameter"), col("range"), col("default_value"), F.explode(split_ids(F.col("system_ids"))).alias("s"))
    base = base.filter(F.col("parameter").isNotNull() & F.col("hierarchy").isNotNull())
    props = F.create_map(F.lit("hierarchy"), F.col("hierarchy"), F.lit("range"), F.col("range"), F.lit("default_value"), F.col("default_value"))
    key = F.concat_ws(":", F.lit("PARAMETER"), F.col("hierarchy"), F.col("parameter"))
    return base.select(
        _triple(F.col("parameter"), "RELATED_TO", F.col("s"), ("PARAMETER", "FEATURE"), (key, F.concat(F.lit("FEATURE:"), F.col("s"))), props).alias("t")
    ).select("t.*")


def parameter_rows(rows: DataFrame) -> DataFrame:
    """Parameter table rows with trimmed text and range ends as numbers or null."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    number = lambda c: F.nullif(text(c), F.lit("")).try_cast("double")
    return rows.select(
        *[text(c).alias(c) for c in ("id", "name", "data_type", "default_value", "unit", "description", "linked_feature_id")],
        number("range_min").alias("range_min"),
        number("range_max").alias("range_max"),
    )


def feature_header(text: Column) -> Column:
    """Fields of a feature document: id, name, generation, category, description."""
    mark = lambda name: F.regexp_extract(text, rf"\*\*{name}\*\*:\s*(\S+)", 1)
    about = F.transform(section_lines(text, "Description"), strip)
    return F.struct(
        mark("Feature ID").alias("feature_id"),
        strip(F.regexp_extract(text, r"(?d)^#\s+Feature:\s+(.+)", 1)).alias("name"),
        mark("Generation").alias("gen"),
        mark("Category").alias("category"),
        F.array_join(F.filter(about, lambda l: l != ""), " ").alias("description"),
    )


def section_lines(text: Column, name: str) -> Column:
    """Lines of the first ``##`` section whose heading contains the name."""
    body = F.regexp_extract(text, rf"(?smd)^## (?iu:[^\n]*{re.escape(name)}[^\n]*)\n(.*?)(?=^## |\z)", 1)
    return F.split(body, r"\r?\n")


def table_lines(lines: Column) -> Column:
    """Pipe-table lines without the rule below the header."""
    return F.filter(lines, lambda l: l.startswith("|") & ~l.rlike(r"^\|[-| ]+\|"))


def table_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)


def feature_tables(docs: DataFrame, doc_id: str, text: str, section: str, columns: dict[str, str]) -> DataFrame:
    """Rows of one table section of every document: impacts, parameters or dependencies."""
    tables = docs.select(doc_id, table_lines(section_lines(F.col(text), section)).alias("_l"))
    heads = tables.filter(F.size("_l") > 1).select(
        doc_id, table_cells(F.get("_l", F.lit(0))).alias("_h"), F.posexplode(F.slice("_l", F.lit(2), F.size("_l"))).alias("pos", "_r")
    )
    cells = heads.select(doc_id, "pos", "_h", table_cells(F.col("_r")).alias("_c"))
    cell = lambda head: F.get("_c", F.array_position("_h", head).cast("int") - 1)
    return cells.select(
        doc_id,
        "pos",
        *[
            F.coalesce(F.when(F.array_position("_h", head) > 0, cell(head)), F.lit("")).alias(name)
            for name, head in columns.items()
        ],
    )
