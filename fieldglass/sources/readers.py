"""Readers: dated parquet, typed files, corpora, JSON lines, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

GOLD_SCHEMA = (
    "query_id string, query string, answer string, type string, section string, source_doc string, "
    "spec_number string, release string, expected_route string, needs_decomposition boolean"
)
ANSWER_SCHEMA = "query_id string, question string, answer string, contexts array<string>, ground_truth string"
ANSWER_REQUIRED = ["query_id", "question", "answer", "contexts"]
TRIPLE_SCHEMA = (
    "subject string, predicate string, object string, subject_label string, object_label string, "
    "subject_node_key string, object_node_key string, subject_key string, object_key string, meta string"
)


def dated_parquet(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """Files ``*YYYYmmDD*.parquet`` of an inclusive day range, with the day as ``file_date``.

    Missing days are skipped. Of several files of one day the one with the
    smallest name counts. The day filter is on file metadata, so files outside
    the range are listed but not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    chosen = dated_files(files.select("path"), start, end)
    paths = [r[0] for r in chosen.select("path").collect()]  # at most one file name per day of the range
    if not paths:
        raise FileNotFoundError(f"no file for {start}..{end} in {folder}")
    data = spark.read.parquet(*paths)
    return data.withColumn("file_date", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1))


def dated_files(files: DataFrame, start: str, end: str) -> DataFrame:
    """One path per day of the range from a listing: the smallest name that carries the day."""
    name = F.element_at(F.split("path", "/"), -1)
    day = F.regexp_extract(name, r"(\d{8})", 1)
    dated = files.select("path", name.alias("name"), day.alias("day"))
    wanted = dated.filter((F.col("day") != "") & F.col("day").between(start, end))
    return wanted.groupBy("day").agg(F.min_by("path", "name").alias("path"))


def load_typed(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Parquet or CSV. A missing path gives an empty frame, another kind is an error."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unsupported file type: {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        if kind == "parquet":
            return reader.parquet(path)
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], T._parse_datatype_string(schema) if schema else T.StructType([]))


def corpus(spark: SparkSession, path: str, text_column: str = "text") -> DataFrame:
    """CSV, JSON or parquet by extension, with one ``text`` column."""
    ext = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if ext == "csv":
        df = spark.read.option("header", True).csv(path)
    elif ext in ("json", "jsonl"):
        df = spark.read.json(path)
    elif ext == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported corpus format: {ext}")
    return with_text(df, text_column)


def with_text(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Rename the text column, or build ``name: value | name: value`` from all columns."""
    if text_column in df.columns:
        return df.withColumnRenamed(text_column, "text")
    if "text" in df.columns:
        return df
    cell = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    return df.withColumn("text", F.concat_ws(" | ", *[cell(c) for c in df.columns]))


def json_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON object; nulls are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def csv_json_records(spark: SparkSession, path: str) -> DataFrame:
    return json_records(spark.read.option("header", True).csv(path))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole files with their position: ``(path, line, value)``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def split_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of large logs with their 0-based position: ``(path, line, value)``; a log is read by as many tasks as it has splits.

    Positions come from the splits' line counts: rows of a split are numbered where they are read, and only one
    row for each split is windowed over its file. Lines themselves are not shuffled while the splits' rows fit a
    broadcast. Unlike ``log_lines`` there is no row behind the last line's end. A compressed log is one split.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"), "value",
    )
    splits = read.groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("path", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return read.join(before, ["path", "_split"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line"), "value")


def document_file_rows(spark: SparkSession, folder: str, pattern: str = "*.md") -> tuple[DataFrame, DataFrame]:
    """One row per matching file under a folder tree, and the files that are no UTF-8 text (``path``, ``reason``)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = reader.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("source_doc"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    good = files.filter(F.col("text").isNotNull())
    return good, files.filter(F.col("text").isNull()).select("path", F.lit("not UTF-8 text").alias("reason"))


def document_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """One row per readable file; ``document_file_rows`` also names the others."""
    return document_file_rows(spark, folder, pattern)[0]


def release_of(path: Column) -> Column:
    """First path part that starts with ``Rel-``, or the default release."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda p: p.startswith("Rel-")), F.lit(0)), F.lit("Rel-18"))


def is_json_object(text: Column) -> Column:
    """Whether the whole text is one JSON object.

    The parser stops after a complete value. Text left over is found by wrapping:
    inside an array it can only start with ``]`` or ``,``, inside an object only
    with ``}`` or ``,``, and a comma makes the array longer.
    """
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.coalesce(F.size(in_array) == 1, F.lit(False))
    return F.ltrim(text).startswith("{") & one & in_object.isNotNull()


def numbered_json(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed objects of non-blank lines ``(line, value)``, and the lines that are not JSON objects."""
    used = lines.filter(F.trim("value") != "")
    with_bad = schema + ", _corrupt_record string"
    parsed = used.select(
        "line", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"), "value"
    )
    bad = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull() | ~is_json_object(F.col("value"))
    return parsed.filter(~bad).select("line", "j.*").drop("_corrupt_record"), parsed.filter(bad).select("line", "value")


def triple_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples of JSON lines with node keys taken from their alternative names, and bad lines."""
    good, bad = numbered_json(lines, TRIPLE_SCHEMA)
    keyed = good.withColumn("subject_node_key", F.coalesce("subject_node_key", "subject_key")).withColumn(
        "object_node_key", F.coalesce("object_node_key", "object_key")
    )
    meta = F.from_json("meta", "subject_properties map<string,string>, object_properties map<string,string>, subject_label string, object_label string, subject_node_key string, object_node_key string")
    m = keyed.withColumn("_m", meta)
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_m.{c}")).alias(c)
    return (
        m.select(
            "line", "subject", "predicate", "object", pick("subject_label"), pick("object_label"),
            pick("subject_node_key"), pick("object_node_key"),
            F.col("_m.subject_properties").alias("subject_properties"), F.col("_m.object_properties").alias("object_properties"), "meta",
        ),
        bad,
    )


def require_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail on the first row that lacks a required field, naming the fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(r).isNull(), F.lit(r)) for r in required]))
    message = F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))
    checked = F.when(F.size(missing) > 0, F.raise_error(message)).otherwise(F.col(required[0]))
    return df.withColumn(required[0], checked.cast(df.schema[required[0]].dataType))


def gold_question_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good questions, and the lines that are no JSON object or lack an id (``line``)."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", f"{GOLD_SCHEMA}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("q"))
    good = F.col("q._broken").isNull() & F.col("q.query_id").isNotNull()
    return lines.filter(good).select("q.*").drop("_broken"), lines.filter(~F.coalesce(good, F.lit(False))).select(F.col("value").alias("line"))


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions; a broken line fails the read, as it would go missing from every score."""
    lines, broken = gold_question_rows(spark, path)
    first = broken.head()
    if first is not None:
        raise ValueError(f"broken gold line: {first['line'][:200]}")
    return lines


def answer_samples(spark: SparkSession, path: str) -> DataFrame:
    return require_fields(spark.read.schema(ANSWER_SCHEMA).json(path), ANSWER_REQUIRED)


def control_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Control groups of a nested hierarchy file, one row each."""
    schema = (
        "control_groups array<struct<id:string,name:string,functions:array<struct<id:string,name:string,kpis:array<string>,"
        "features:array<struct<id:string,name:string,layer:string,kpis:array<string>>>>>>>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("control_groups"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
