"""Physical plans: what reaches the scan, what is shuffled, what never happens."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from fieldglass.operators import chunks, terms
from fieldglass.operators.ordered import previous_row, time_slice, top_per_group
from fieldglass.operators.retrieval import vector_top_k
from fieldglass.plans import Tables
from fieldglass.plans.text import benchmark_terms

FOLDER = "/root/testdata/sf0.001"
# eager parts (checkpoints, bounded collects) make these slow to plan; their operators are tested elsewhere
LAZY = ["drift_js", "interarrival", "running_traffic", "retrieval_metrics", "suite_summary", "classification_metrics",
        "chunk_sections", "keyword_tags", "repeated_lines", "alarm_records", "counter_records", "triple_nodes", "additive_merge",
        "unblocked_tasks", "tree_ancestors", "commit_approved", "style_profile", "heading_paths", "table_continuation", "upsert_latest"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_products(spark, name):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(entry_points.queries()["entity_filter"](spark, FOLDER))
    assert "EqualTo(user_id,7)" in text
    scan = next(l for l in plan(entry_points.queries()["outliers"](spark, FOLDER)).splitlines() if "ReadSchema" in l)
    assert "l_shipdate" not in scan and "l_comment" not in scan


def test_chunking_needs_no_shuffle(spark):
    docs = Tables(spark, FOLDER).documents
    assert "Exchange" not in plan(chunks.chunk_sections(docs, "doc_id"))
    assert "Exchange" not in plan(chunks.chunk_fixed(docs, "doc_id", "mop"))


def test_slices_shuffle_the_rows_once(spark):
    """Without any broadcast the rows move once; the second shuffle carries slice summaries."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        events = Tables(spark, FOLDER).events
        text = plan(previous_row(events, ["user_id"], ["ts", "event_id"], ["value", "props"], time_slice("ts")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [l for l in text.splitlines() if "Exchange hashpartitioning" in l]
    # rows by (key, slice); summaries by (key, slice), by key, and back by (key, slice)
    assert len(moved) == 4, text


def test_tags_combine_before_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    text = plan(terms.tag_keywords(t.documents, benchmark_terms(t)))
    assert "partial_collect_set" in text and "Python" not in text and "CartesianProduct" not in text


def test_items_of_a_search_are_scanned_once(spark):
    """However many queries there are: no scan or plan branch for each block of them."""
    items = Tables(spark, FOLDER).embeddings
    queries = spark.range(5000).select(F.col("id").alias("query_id"), F.array(*[F.lit(float(k)) for k in range(64)]).alias("embedding"))
    text = plan(vector_top_k(items, queries, 3, "vec_id"))
    assert text.count("Scan parquet") == 1 and text.count("FlatMapCoGroupsInPandas") == 1


def test_map_side_limit_beyond_a_thousand(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), F.col("id"))
    assert "WindowGroupLimit" in plan(top_per_group(df, ["g"], [F.col("id")], 999))
    big = top_per_group(df, ["g"], [F.col("id").desc()], 2000)
    got = big.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("rank").alias("r")).orderBy("g").collect()
    assert [tuple(r) for r in got] == [(0, 2000, 26_000, 2000), (1, 2000, 26_001, 2000)]
    assert plan(big).count("_salt") > 0


def test_flow_windows_are_cut_into_slices(spark):
    text = plan(entry_points.queries()["interarrival"](spark, FOLDER))
    windows = [l for l in text.splitlines() if "Window [" in l and "lag(struct(time_s" in l.replace("named_struct", "struct")]
    assert all("_slice" in l for l in windows)


def test_library_keeps_out_of_unsafe_calls():
    banned = {"localCheckpoint", "crossJoin", "toPandas", "rdd"}
    for path in Path(entry_points.__file__).parent.joinpath("fieldglass").rglob("*.py"):
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            if isinstance(node, ast.Attribute):
                assert node.attr not in banned, f"{path}: {node.attr}"


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    from fieldglass.session import checkpoint_folder

    assert spark.conf.get("spark.checkpoint.dir") in checkpoint_folder(spark)
    assert spark.range(3).withColumn("x", F.lit(1)).count() == 3
