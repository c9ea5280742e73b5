"""Plans and results that only larger or odd tables would show to be wrong."""

import pytest
from pyspark.sql import functions as F

from fieldglass.plans import Tables, load_all

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["parameter_texts", "alarm_lookup", "alarm_chunks", "alarm_keywords", "alarm_name_search", "alarm_records", "alarm_rejects"])
def test_sheet_cells_are_never_broadcast(spark, name):
    plan = plan_of(load_all()[name][0](Tables(spark, FOLDER)))
    assert "ShuffledHashJoin [sheet" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [sheet" in line or ("BroadcastHashJoin" in line and "BuildLeft" in line and "alias" in line)]


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_contained_terms_takes_upper_case_character_by_character(spark, tmp_path):
    long = [("Massgabeü",), ("maßgabeü",), ("ᾳlongword",)]
    written(spark, tmp_path, "benchmark", [(" ".join(w for w, in long),)], "text string")
    texts = [(1, 0, "user", "MAẞGABEÜ"), (2, 0, "user", "massgabeü"), (3, 0, "user", "xᾼlongwords"), (4, 0, "user", "ΑΙlongword")]
    written(spark, tmp_path, "conversations", texts, "conv_id long, turn long, role string, text string")
    got = load_all()["contained_terms"][0](Tables(spark, str(tmp_path))).collect()
    assert sorted((r.id, r.term) for r in got) == [("1-0", "maßgabeü"), ("2-0", "Massgabeü"), ("3-0", "ᾳlongword")]
    context = {r.conv_id: r.context for r in load_all()["query_context"][0](Tables(spark, str(tmp_path))).collect()}
    assert context[2].endswith("Relevant acronyms:\n- Massgabeü: massgabeü")


def test_chunk_dispatch_counts_no_marks_of_documents_cut_by_size(spark, tmp_path):
    line = "a b c d e"  # 85 lines of 5 words and 21 headings of 3: 488 words, with their marks 509
    written(spark, tmp_path, "documents", [(0, "\n".join([line] * 106))], "doc_id long, text string")
    got = load_all()["chunk_dispatch"][0](Tables(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [("mop", 1)]


def test_text_index_adds_up_blocks_in_tasks(spark):
    """No row for each candidate and term of a query: a block's postings meet a block of queries in one task."""
    plan = plan_of(load_all()["text_index_topk"][0](Tables(spark, FOLDER)))
    assert "FlatMapCoGroupsInPandas" in plan and "map_keys" not in plan and "element_at" not in plan


def test_graph_nodes_explodes_properties_after_combining(spark):
    from fieldglass.operators import ontology

    triple = "subject string, object string, subject_label string, object_label string, subject_node_key string, object_node_key string, subject_properties map<string,string>, object_properties map<string,string>, line int"
    rows = [("s", "o", "l", None, None, None, p, None, at) for at, p in ((1, {"a": "1", "b": "1"}), (2, {"a": "2"}), (0, {"b": "0", "c": "0"}), (5, None), (4, {"d": None}), (3, {"d": "3"}))]
    nodes = ontology.graph_nodes(spark.createDataFrame(rows, triple))
    assert {r.name: r.properties for r in nodes.collect()} == {"s": {"a": "2", "b": "1", "c": "0", "d": None}, "o": {}}
    lines = plan_of(ontology.graph_nodes(spark.createDataFrame(rows, triple))).splitlines()
    steps = [w for line in lines for w in ("Generate inline", "Generate explode", "Exchange hashpartitioning") if w in line]
    assert steps[-3:] == ["Generate explode", "Exchange hashpartitioning", "Generate inline"]


def test_acronyms_are_sought_as_written(spark):
    from fieldglass.operators import acronyms

    texts = spark.createDataFrame([(1, "the at"), (2, "THE at"), (3, "THE\u00b2 AT"), (4, "the THE\u00b2"), (5, "at R&D r&d")], "k int, t string")
    terms = spark.createDataFrame([("THE",), ("AT",), ("R&D",)], "term string")
    assert sorted(map(tuple, acronyms._standing(texts, terms, "k", "t").collect())) == [(2, "THE"), (3, "AT"), (3, "THE"), (4, "THE"), (5, "R&D")]
    conflicts = terms.selectExpr("term AS acronym", "array() AS variants", "array('x', 'y') AS candidates")
    got = acronyms.resolved_conflicts(texts, conflicts, "k", "t").collect()
    assert sorted((r.k, r.acronym) for r in got) == [(2, "THE"), (3, "AT"), (4, "THE"), (5, "R&D")]


def test_subgraph_ids_are_written_once(spark):
    """Each edge table is read once and meets the written ids of the nodes near, which are broadcast while they are small."""
    plan = plan_of(load_all()["subgraph_generation"][0](Tables(spark, FOLDER)))
    assert plan.count("FileScan parquet [o_orderkey") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin [" in plan
