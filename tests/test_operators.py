"""Retrieval, evaluation, graph, records, layout and review operators on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import (
    causal, evaluate, flows, graph, layout, models, ontology, predicates, profile, records, retrieval, review, routing, traffic, tree,
)


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, float("nan")), (2.0, 5.0, 1.0), (4.0, 5.0, None), (9.0, 5.0, None)], "a double, c double, n double")
    got = {r["column"]: r for r in profile.distribution(df).collect()}
    s = pd.Series([1.0, 2.0, 4.0, 9.0])
    assert got["a"].skewness == pytest.approx(s.skew()) and got["a"].kurtosis == pytest.approx(s.kurt())
    assert (got["c"].skewness, got["c"].kurtosis, got["c"].is_likely_normal) == (0.0, 0.0, True)
    assert got["n"].error == "Not enough data" and got["n"].mean is None
    assert {r["column"]: r.outlier_count for r in profile.outliers(df).collect()} == {"a": 0, "c": 0}
    assert profile.strong_correlations(df, ["a", "c"]).count() == 0


def test_text_lengths_of_nulls(spark):
    r = profile.text_lengths(spark.createDataFrame([("abcd",), (None,)], "text string")).first()
    assert (r.avg_length, r.max_length, r.min_length) == (2.0, 4, 0)


def test_interarrival_wraps_at_midnight(spark):
    df = spark.createDataFrame([(1, 86399.5), (2, 0.25), (3, 0.25)], "no int, time_s double").withColumn("f", F.lit("a"))
    got = flows.interarrival(df, ["f"], ["no"], F.lit(0)).orderBy("no").collect()
    assert [r.delta_us for r in got] == [None, 750000.0, 0.0]


def test_packet_lines(spark):
    lines = ["1 00:00:01.5 10.0.0.1 10.0.0.2 TCP 60 info", "0.25 10.0.0.1 10.0.0.2 UDP 61", "header", "7 1.5 10.0.0 10.0.0.2 TCP 60"]
    got = flows.parse_packet_lines(spark.createDataFrame([(l,) for l in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [(1, 1.5, 60, "10.0.0.1", "10.0.0.2"), (None, 0.25, 61, "10.0.0.1", "10.0.0.2")]
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert flows.filter_flow(df, "a", None).count() == 2 and flows.filter_flow(df, "a", "b").count() == 1


def test_running_series_known_values(spark):
    calls = spark.createDataFrame([("r", i, t, t, 1, 1, 1, 1) for i, t in enumerate([15, 25, 35, 45, 55], 1)],
        "run_id string, turn int, total_tokens long, prompt_tokens long, wire_sent long, wire_recv long, req_payload_bytes long, resp_payload_bytes long")
    got = traffic.running_series(calls).orderBy("turn").collect()
    assert [r.cum_tokens for r in got] == [15, 40, 75, 120, 175]


def test_vector_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    items, queries = rng.normal(size=(200, 8)), rng.normal(size=(23, 8))
    items[50] = items[10]  # a tie, the smaller id first
    i = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(items)], "item_id int, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(queries)], "query_id int, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.item_id for r in retrieval.vector_top_k(i, q, 5, block_rows=4).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(queries) @ unit(items).T
    for n in range(23):
        order = sorted(range(200), key=lambda k: (-scores[n, k], k))[:5]
        assert [got[(n, r)] for r in range(1, 6)] == order


def test_vector_search_without_queries(spark):
    i = spark.createDataFrame([(1, [1.0])], "item_id int, embedding array<double>")
    q = spark.createDataFrame([], "query_id int, embedding array<double>")
    assert retrieval.vector_top_k(i, q, 3).count() == 0


def test_bm25_blocks_agree(spark, rows):
    docs = spark.createDataFrame([(i, "a " * (i % 4) + "b c " + ("rare" if i == 5 else "")) for i in range(20)], "doc_id int, text string").repartition(5)
    q = spark.createDataFrame([(1, "a rare"), (2, "c"), (3, "zzz"), (4, "")], "query_id int, query string")
    one, many = retrieval.bm25_top_k(docs, q, 4), retrieval.bm25_top_k(docs, q, 4, block_rows=1)
    assert rows(one, "query_id", "item_id", "rank") == rows(many, "query_id", "item_id", "rank")
    assert one.filter("query_id = 1 AND rank = 1").first().item_id == 5
    assert one.filter("query_id = 2").count() == 4 and one.filter("query_id > 2").count() == 0


def test_fusion_of_missing_list(spark):
    hits = spark.createDataFrame([(1, "meta_sparse", 7, 0.9), (1, "other", 7, 0.1), (1, "other", 8, 0.5)], "query_id int, field string, item_id int, score double")
    got = retrieval.weighted_rank_fusion(hits, 5, {"meta_sparse": 0.4}).collect()
    scores = {r.item_id: r.score for r in got}
    assert scores[7] == pytest.approx(0.4 / 61 + 1 / 62) and scores[8] == pytest.approx(1 / 61)


def test_centroids_keep_zero(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "label string, embedding array<double>")
    got = {r.label: r.centroid for r in retrieval.centroids(df).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["z"] == [0.0, 0.0]


def test_merge_results(spark, rows):
    df = spark.createDataFrame([(1, None, "same", 0.1, 1), (1, None, "same", 0.9, 2), (1, "i", "x", 0.5, 3), (1, "i", "y", 0.7, 4)], "query_id int, item_id string, text string, score double, pos int")
    assert rows(retrieval.merge_results(df, ["pos"], 1), "pos") == [(1,), (3,)]


def test_attach_metadata(spark, rows):
    ranked = spark.createDataFrame([(1, "t"), (2, "u")], "r int, text string")
    docs = spark.createDataFrame([("t", "old", 1), ("t", "new", 2)], "text string, feature_id string, n int")
    assert rows(retrieval.attach_metadata(ranked, docs, ["feature_id"], "n"), "r", "feature_id") == [(1, "new"), (2, "")]


def test_rule_order(spark):
    cases = {
        "ALM-12 alarm 3": ("structured_lookup", "ALM-12"),
        "Alarm 3": ("structured_lookup", "ALM-3"),
        "NRCellDU G-123": ("structured_lookup", "NRCellDU"),
        "LTE vs NR TS 38.331": ("comparative", None),
        "TS 38331": ("definition_explain", "38.331"),
        "maxTxPower": ("structured_lookup", "maxTxPower"),
        "hello": (None, None),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", routing.rule_route(F.col("q")).alias("r"))
    for row in df.collect():
        assert ((row.r.route, row.r.value) if row.r else (None, None)) == cases[row.q]


def test_doc_types_priority(spark):
    m = F.create_map(F.lit("mo_name"), F.lit("x"), F.lit("alarm_code"), F.lit("y"))
    r = spark.range(1).select(
        routing.doc_types_of_entities(F.lit("structured_lookup"), m).alias("a"),
        routing.doc_types_of_entities(F.lit("diagnostic"), m).alias("b"),
        routing.doc_types(F.lit("nope"), F.lit(None).cast("string")).alias("c"),
    ).first()
    assert (r.a, r.b, r.c) == (["alarm_ref"], ["alarm_ref", "feature_desc"], ["feature_desc"])


def test_section_prefix_hits(spark):
    gold = spark.createDataFrame([(1, "d.md", "3.1", "t"), (2, "d", "9", None)], "query_id int, source_doc string, section string, type string")
    hits = spark.createDataFrame([(1, 1, "e", "3.1"), (1, 2, "d", "3.10"), (2, 1, "d", None)], "query_id int, rank int, source_doc string, section_num string")
    got = {r.query_id: r.hit_rank for r in evaluate.hit_ranks(hits, gold).collect()}
    assert got == {1: 2, 2: None}


def test_classification_of_nothing(spark):
    empty = spark.createDataFrame([], "expected string, predicted string")
    got = evaluate.classification_metrics(empty, ["a"]).first()
    assert (got.accuracy, got.tp, got.f1, got.support) == (0.0, 0, 0.0, 0)


def test_precision_divides_by_k(spark):
    ranked = spark.createDataFrame([(1, 1, "a")], "query_id int, rank int, item string")
    assert evaluate.precision_at_k(ranked, ranked, 3).first().precision == pytest.approx(1 / 3)


def test_faithfulness_without_claims(spark):
    s = spark.createDataFrame([("q",), ("r",)], "query_id string")
    v = spark.createDataFrame([("r", " YES."), ("r", "no")], "query_id string, verdict string")
    assert {r.query_id: r.faithfulness for r in evaluate.faithfulness(s, v).collect()} == {"q": 1.0, "r": 0.5}


def test_delta_uses_first_without_baseline(spark, rows):
    s = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "preset string, m double")
    assert rows(evaluate.delta_vs_baseline(s, "preset", ["m"])) == [("b", 1.0)]
    s = spark.createDataFrame([("baseline", 2.0), ("a", 1.0)], "preset string, m double")
    assert rows(evaluate.delta_vs_baseline(s, "preset", ["m"])) == [("a", -1.0)]


def test_paths_in_a_graph_with_a_cycle(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "t"), ("a", "t"), ("t", "a"), ("c", "a"), ("c", "c")], "from_id string, to_id string")
    got = graph.simple_paths_to(e, "t")
    assert rows(got.select(F.array_join("path", ""))) == [("abt",), ("at",), ("bat",), ("bt",), ("cabt",), ("cat",)]
    with pytest.raises(ValueError):
        graph.simple_paths_to(e, "t", 2)


def test_neighbourhood_stops_early(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "from_id string, to_id string")
    seeds = spark.createDataFrame([("a",), ("nowhere",)], "id string")
    assert rows(graph.neighbourhood(e, seeds, 9)) == [("a", 0), ("b", 1), ("c", 2)]


def test_unblocked(spark, rows):
    t = spark.createDataFrame([(1, "true", []), (2, "exceeded", []), (3, "false", [1, 2]), (4, "false", [3]), (5, "false", [9]), (6, None, [])], "id int, verdict string, dependencies array<int>")
    assert rows(graph.unblocked(t), "id") == [(3,), (6,)]


def test_transitions_both_ways(spark, rows):
    text = "RRC_IDLE to RRC_CONNECTED; from RRC_CONNECTED to RRC_IDLE. a\nthe UE enters RRC_INACTIVE\nmove to RRC_IDLE"
    got = graph.transitions(spark.createDataFrame([(1, text)], "id int, text string"), "id")
    # "RRC_CONNECTED to RRC_IDLE" and "RRC_IDLE ... to RRC_CONNECTED" both hold in the first sentence
    assert rows(got, "from_state", "to_state") == [("OTHER/ANY", "RRC_IDLE"), ("RRC_CONNECTED", "RRC_IDLE"), ("RRC_IDLE", "RRC_CONNECTED")]


def test_merge_properties_containment(spark, rows):
    data = [("n", 1, {"a": "long value"}), ("n", 2, {"a": "value"}), ("n", 3, {"a": "x", "b": "1"}), ("n", 4, {"a": "long value"})]
    df = spark.createDataFrame(data, "name string, i int, properties map<string,string>")
    assert rows(ontology.merge_properties(df, ["name"], ["i"])) == [("n", "a", "long value | x"), ("n", "b", "1")]
    d = spark.createDataFrame([("n", 1, None), ("n", 2, "d"), ("n", 3, ""), ("m", 1, "q")], "name string, i int, description string")
    assert rows(ontology.merge_descriptions(d, ["name"], ["i"])) == [("m", "q"), ("n", " / d")]


def test_null_like(spark):
    df = spark.createDataFrame([("None ",), ("",), ("n/a",), (None,), ("ok",)], "o string")
    assert [r[0] for r in df.filter(~predicates.null_like(F.col("o"))).collect()] == ["", "ok"]


def test_clean_properties(spark):
    got = spark.range(1).select(ontology.clean_properties(F.create_map(F.lit("a-b"), F.lit("1"), F.lit("ab"), F.lit("2"), F.lit(""), F.lit("3"))).alias("p")).first().p
    assert got == {"ab": "2"}


def test_stringify(spark):
    r = spark.range(1).select(ontology.stringify(F.array(F.lit(1), F.lit(2))).alias("a"), ontology.stringify(F.lit(True)).alias("b")).first()
    assert (r.a, r.b) == ("[1,2]", "true")


TYPES = "node_id string, type_info struct<base:string, range:array<struct<min:bigint,max:bigint>>, pattern:array<string>, enum:array<string>>"


@pytest.mark.parametrize("base,value,ok", [
    ("uint8", "255", True), ("uint8", "256", False), ("uint64", "18446744073709551615", True), ("uint64", "18446744073709551616", False),
    ("int8", "x", False), ("int8", " 7 ", True), ("boolean", "true", True), ("boolean", "True", False), ("enumeration", "up", True), ("enumeration", "on", False),
    ("string", "ab", True), ("string", "ab1", False), ("leafref", "anything", True),
])
def test_validation(spark, base, value, ok):
    nodes = spark.createDataFrame([("n", (base, [], ["[a-z]+", ".{1,3}"], ["up", "down"]))], TYPES)
    assert tree.validate(spark.createDataFrame([("n", value)], "node_id string, value string"), nodes).first().valid is ok


def test_validation_ranges_and_unknown(spark):
    nodes = spark.createDataFrame([("n", ("int32", [(1, 3), (7, 9)], [], []))], TYPES)
    v = spark.createDataFrame([("n", "8"), ("n", "5"), ("m", "1")], "node_id string, value string")
    assert {r.value: (r.valid, r.error) for r in tree.validate(v, nodes).collect()} == {"8": (True, None), "5": (False, "out of range"), "1": (False, "node not found")}


def test_merged_cells(spark, rows):
    cells = spark.createDataFrame([("s", 1, 1, "top"), ("s", 2, 1, "hidden"), ("s", 1, 2, "x")], "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([("s", 1, 3, 1, 1)], "sheet string, row0 int, row1 int, col0 int, col1 int")
    assert rows(records.fill_merged(cells, merges)) == [("s", 1, 1, "top"), ("s", 1, 2, "x"), ("s", 2, 1, "top"), ("s", 3, 1, "top")]


def test_sheet_without_header(spark, rows):
    cells = spark.createDataFrame([("a", 1, 1, "Alarm ID"), ("a", 1, 2, "Name"), ("a", 2, 1, "x"), ("a", 3, 3, "stray"), ("b", 1, 1, "Code"), ("c", 11, 1, "Code"), ("c", 11, 2, "Name")], "sheet string, row int, col int, value string")
    from fieldglass import fixed_values as fixed

    cols = records.header_columns(cells, fixed.ALARM_HEADERS, fixed.ALARM_REQUIRED)
    assert rows(records.sheets_without_header(cells, cols)) == [("b",), ("c",)]
    good, bad = records.alarm_records(cells)
    assert good.count() == 0
    assert rows(bad) == [("a", 2, "empty: alarm_name"), ("a", 3, "empty: alarm_id, alarm_name"), ("b", None, "no header row"), ("c", None, "no header row")]
    assert rows(records.sheets_without_header(cells, records.header_columns(cells, fixed.ALARM_HEADERS, fixed.ALARM_REQUIRED, header_rows=None))) == [("b",)]


def test_counter_range_columns(spark):
    cells = [("s", 1, i, v) for i, v in enumerate(["Counter Name", "Min", "Max", "Range"], 1)]
    cells += [("s", 2, 1, "c1"), ("s", 2, 2, "5"), ("s", 2, 4, "0~9"), ("s", 3, 1, "c2"), ("s", 3, 4, "0~9")]
    good, _ = records.counter_records(spark.createDataFrame(cells, "sheet string, row int, col int, value string"))
    assert {r.counter_name: (r.min_val, r.max_val) for r in good.collect()} == {"c1": ("5", ""), "c2": ("0", "9")}


def test_feature_document(spark):
    text = "# Feature: Fast HO\n\n**Feature ID**: FGR-1\n**Category**: mobility\n## description of it\n a\n b \n## Controlling Parameters\n| Parameter ID | Effect When Increased |\n|---|---|\n| p1 | up |\nnot a row\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    h = df.select(records.feature_header(F.col("text")).alias("h")).first().h
    assert tuple(h) == ("FGR-1", "Fast HO", "", "mobility", "a b")
    got = records.feature_tables(df, "id", "text", "Controlling Parameters", {"param_id": "Parameter ID", "effect": "Effect When Increased", "none": "None"})
    assert [tuple(r) for r in got.collect()] == [(1, 0, "p1", "up", "")]


def test_cell_text(spark):
    df = spark.createDataFrame([("3.0",), ("3.5",), ("  ",), (" a ",), (None,)], "v string").select(records.cell_text(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == ["3", "3.5", None, "a", None]


def test_tables_pair_up(spark):
    e = lambda pos, kind, cols=None, rows=None: ("d", pos, kind, kind == "break", cols, rows)
    t = lambda *cells: [["h", "k"], list(cells)]
    data = [e(1, "table", 2, t("1", "a")), e(2, "break"), e(3, "table", 2, t("2", "b")), e(4, "break"), e(5, "table", 2, t("3", "c")), e(6, "table", 2, t("4", "d")), e(7, "break"), e(8, "paragraph")]
    df = spark.createDataFrame(data, "doc string, pos int, kind string, is_page_break boolean, col_count int, rows array<array<string>>")
    got = layout.merge_tables(df, "doc", "pos").orderBy("pos").collect()
    assert [(r.pos, r.kind, r.merged) for r in got] == [(1, "table", True), (5, "table", False), (6, "table", False), (8, "paragraph", False)]
    assert got[0].rows == [["h", "k"], ["1", "a"], ["2", "b"]]


def test_heading_cover_and_reset(spark):
    data = [(1, None, "intro"), (2, 1, "A"), (3, 2, "A1"), (4, 3, "file"), (5, None, "body"), (6, 1, "B"), (7, None, "loose"), (8, 3, "f2")]
    df = spark.createDataFrame([("d", *r) for r in data], "doc string, pos int, depth int, text string")
    got = {r.pos: (r.folders, r.heading) for r in layout.heading_paths(df, "doc", "pos", 3).collect()}
    assert got[1] == (["000"], "")
    assert got[5] == (["001", "001"], "file")
    assert got[7] == (["002"], "") and got[8] == (["002"], "f2")


def test_heading_depth(spark):
    d = lambda style, *sizes: spark.range(1).select(layout.heading_depth(F.lit(style), F.array(*[F.lit(float(s)) for s in sizes]).cast("array<double>"), {"H1": 1}, {14: 2}, ["Body"]).alias("d")).first().d
    assert (d("H1"), d("Body", 14), d("x", 9, 14.9), d("x", 20), d("x")) == (1, None, 2, None, None)


def test_text_blocks_rules(spark):
    l = lambda n, kind, top, bottom, text, color="k", size=10.0, level=1: ("p", n, kind, top, bottom, text, color, size, level)
    data = [l(0, "paragraph", 0.0, 10.0, "a hy-"), l(1, "paragraph", 12.0, 22.0, "phen"), l(2, "paragraph", 40.0, 50.0, "far"), l(3, "paragraph", 51.0, 61.0, "red", "r"), l(4, "heading", 62.0, 70.0, "H"), l(5, "heading", 71.0, 80.0, "h2", level=2)]
    df = spark.createDataFrame(data, "page string, line int, kind string, top double, bottom double, text string, color string, size double, level int")
    got = layout.text_blocks(df, ["page"]).orderBy("first_line").collect()
    assert [r.text for r in got] == ["a hy-phen", "far", "red", "H", "h2"]


def test_regions(spark):
    r = lambda y, rot: spark.range(1).select(layout.region(F.lit(0.0), F.lit(float(y)), F.lit(10.0), F.lit(float(y)), F.lit(rot), F.lit(100.0), F.lit(1000.0)).alias("r")).first().r
    assert (r(80, 0), r(81, 0), r(919, 0), r(920, 180), r(500, 90)) == ("header", "body", "body", "footer", "header")
    w = lambda a: spark.range(1).select(layout.is_watermark_rotation(F.lit(a)).alias("w")).first().w
    assert [w(55), w(57), w(58), w(415), w(-305), w(0)] == [True, True, False, True, True, False]


def test_state_reducers(spark, rows):
    df = spark.createDataFrame([("r", "a", 0, 1, True, "x"), ("r", "a", 1, 2, False, "y"), ("r", "a", 0, 3, True, "z"), ("r", "b", 2, 4, True, "w")], "run string, id string, attempt int, seq int, verdict boolean, v string")
    merged = review.merge_attempts(df, ["run"], "seq")
    assert rows(merged, "id", "attempt", "v", "position") == [("a", 0, "z", 1), ("a", 1, "y", 2), ("b", 2, "w", 4)]
    assert rows(review.latest_successful(merged, ["run"]), "id", "attempt", "v") == [("a", 0, "z"), ("b", 2, "w")]


def test_review_queue(spark, rows):
    q = spark.createDataFrame([(1, "pending", 0.9, ""), (2, "pending", None, ""), (3, "pending", 0.1, "")], "id int, status string, confidence double, reject_reason string")
    auto = review.auto_approve(q)
    assert rows(auto, "id", "status") == [(1, "approved"), (2, "pending"), (3, "pending")]
    d = spark.createDataFrame([(3, "rejected", "bad")], "id int, decision string, reason string")
    assert rows(review.decide(auto, d), "id", "status", "reject_reason") == [(1, "approved", ""), (2, "pending", ""), (3, "rejected", "bad")]


def test_intervention_only_changes_descendants(spark):
    m = causal.order_model()
    noise = spark.createDataFrame([tuple(0.5 for _ in m.parents)], ", ".join(f"u_{v} double" for v in m.parents))
    a, b = causal.evaluate(noise, m).first(), causal.evaluate(noise, m, {"Handling": 0.4}).first()
    assert b.Handling == 0.4 and a.Demand == b.Demand
    assert b.Margin - a.Margin == pytest.approx(a.Handling - 0.4)


def test_embedding_counts_must_match(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "text string")
    got = models.embed(df, models.hash_encoder(8)).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-9 for r in got)
    with pytest.raises(Exception, match="returned 0 vectors"):
        models.embed(df, lambda texts: []).collect()


def test_search_survives_odd_rows(spark, rows):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.6, 0.8])], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0, 0.0])], "query_id long, embedding array<double>")
    assert rows(retrieval.vector_top_k(items, queries, 2), "query_id", "item_id", "rank") == [(1, 1, 1), (1, 7, 2), (3, 4, 1)]
    assert rows(retrieval.vector_top_k(items, queries, 2, block_rows=1), "query_id", "item_id", "rank") == [(1, 1, 1), (1, 7, 2), (3, 4, 1)]
    assert rows(retrieval.unusable_vectors(items, "embedding", 2), "item_id") == [(2,), (3,), (4,), (6,)]
    assert retrieval.vector_top_k(items.limit(0), queries, 2).count() == 0
    docs = spark.createDataFrame([(1, "red car"), (2, None), (3, "red red bus"), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red"), (2, None), (3, "unknown")], "query_id long, query string")
    assert rows(retrieval.bm25_top_k(docs, asked, 5), "query_id", "item_id", "rank") == [(1, 1, 2), (1, 3, 1)]


def read_once(spark, df, column, kind):
    """``df`` with a column that counts its evaluations, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(same, kind).asNondeterministic()(column)), seen


def test_lexical_search_reads_each_text_once(spark, rows):
    docs, seen = read_once(spark, spark.createDataFrame([(1, "red car"), (2, None), (3, "red red bus"), (4, "")], "doc_id long, text string"), "text", "string")
    asked = spark.createDataFrame([(1, "red"), (2, None)], "query_id long, query string")
    assert rows(retrieval.bm25_top_k(docs, asked, 5), "query_id", "item_id", "rank") == [(1, 1, 2), (1, 3, 1)]
    assert seen.value == 4


def test_sparse_search_reads_each_item_once(spark, rows):
    items, seen = read_once(spark, spark.createDataFrame([(1, {1: 1.0}), (2, {1: 2.0}), (3, None)], "item_id long, sparse map<int,double>"), "sparse", "map<int,double>")
    queries = spark.createDataFrame([(1, {1: 1.0})], "query_id long, sparse map<int,double>")
    assert rows(retrieval.sparse_top_k(items, queries, 3), "query_id", "item_id", "rank") == [(1, 1, 2), (1, 2, 1)]
    assert seen.value == 3


def test_sparse_search(spark, rows):
    items = spark.createDataFrame([(1, {1: 1.0, 5: 2.0}), (2, {5: 1.0}), (3, {9: 1.0}), (4, None), (5, {})], "item_id long, sparse map<int,double>")
    queries = spark.createDataFrame([(1, {5: 1.0, 1: -1.0}), (2, None)], "query_id long, sparse map<int,double>")
    assert rows(retrieval.sparse_top_k(items, queries, 3), "query_id", "item_id", "score", "rank") == [(1, 1, 1.0, 1), (1, 2, 1.0, 2)]


def test_precision_counts_questions_without_results(spark, rows):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2)], "query_id string, item string, rank int")
    expected = spark.createDataFrame([("q1", "a"), ("q2", "c")], "query_id string, item string")
    assert rows(evaluate.precision_at_k(ranked, expected, 2)) == [("q1", 0.5), ("q2", 0.0)]


def test_one_parent_for_a_path_of_two_modules(spark, rows):
    raw = spark.createDataFrame([("m1", "/a", None), ("m2", "/a", None), ("m1", "/a/b", "/a"), ("m3", "/a/c", "/a")], "module string, schema_path string, parent_path string")
    nodes = tree.with_ids(raw)
    ids = {(r.module, r.schema_path): (r.node_id, r.parent_id) for r in nodes.collect()}
    assert nodes.count() == 4 and ids["m1", "/a/b"][1] == ids["m1", "/a"][0] and ids["m3", "/a/c"][1] == ids["m2", "/a"][0]
    assert tree.path_nodes(nodes.filter("schema_path = '/a/b'"), nodes).count() == 2


def test_identities_are_whole_texts(spark):
    head = "x" * 150
    results = spark.createDataFrame([("q", None, head + "1", 1.0, 1), ("q", None, head + "2", 1.0, 2)], "query_id string, item_id string, text string, score double, pos int")
    assert retrieval.merge_results(results, ["pos"]).count() == 2
    assert retrieval.merge_results(results, ["pos"], prefix=120).count() == 1
    history = spark.createDataFrame([("r", "s", head + "1", 1), ("r", "s", head + "2", 2)], "run string, subtask_id string, query string, seq int")
    assert review.merge_history(history, ["run"], "seq").count() == 2 and review.merge_history(history, ["run"], "seq", 100).count() == 1


def test_cells_of_a_batch_take_bounded_memory(spark):
    """A batch is compared with the centroids by slices, and the order of cells is that of the whole product."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from fieldglass.operators import vector_index

    rng = np.random.default_rng(3)
    centres = vector_index._unit_rows(rng.normal(size=(1024, 8)))
    batch = rng.normal(size=(5000, 8))
    whole = np.argsort(-(vector_index._unit_rows(batch) @ centres.T), axis=1, kind="stable")
    vectors = pd.Series(list(batch))
    for most in (1, 3):
        tracemalloc.start()
        got = vector_index._cell_order(centres, most).func(vectors)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(np.stack(got), whole[:, :most])
        assert peak < 16e6  # a product of the whole batch is 41 MB


def test_vector_index_against_exact_search(spark, rows, tmp_path):
    """Recall of the wanted size, the index read again without its source, hot cells in parts, all probes exact."""
    import numpy as np

    from fieldglass.operators import vector_index

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    which = np.r_[np.zeros(700, int), rng.integers(0, 12, 800)]
    vectors = centres[which] + 0.4 * rng.normal(size=(1500, 16))
    data = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(vectors)] + [(9001, None, "x", 1), (9002, [], "x", 1), (9003, [1.0, 2.0], "x", 1), (9004, [float("nan")] * 16, "x", 1)]
    items = spark.createDataFrame(data, "item_id long, embedding array<double>, cell string, part int")
    queries = items.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    path = str(tmp_path / "index")
    old, vector_index.PART_ROWS = vector_index.PART_ROWS, 100
    try:
        vector_index.build_index(items, path, cells=24)
    finally:
        vector_index.PART_ROWS = old
    exact = retrieval.vector_top_k(items, queries, 10)
    found = vector_index.search_index(spark, path, queries, 10, recall=0.95)
    reached = vector_index.recall_against(found, exact)
    assert reached.count() == 75 and reached.agg(F.avg("recall")).first()[0] >= 0.95
    assert vector_index.probes_for(spark, path, 0.95) < 24
    stored = spark.read.parquet(path + "/rows")
    assert stored.count() == 1500 and stored.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 300
    everywhere = vector_index.search_index(spark, path, queries, 10, probes=24)
    assert rows(everywhere, "query_id", "item_id", "rank") == rows(exact, "query_id", "item_id", "rank")
    assert vector_index.search_index(spark, path, queries.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        vector_index.build_index(items.filter("item_id > 9000 AND item_id != 9003"), str(tmp_path / "none"))


def test_text_index_equals_the_scan(spark, rows, tmp_path):
    """Equal to the exact search for any k and block size, with hot terms, empty texts and queries, from the stored files alone."""
    import random

    from fieldglass.operators import text_index

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(["the"] * rng.randint(1, 9) + [vocabulary[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randint(1, 25))]) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, texts[0]), (903, texts[0])], "doc_id int, text string")
    asked = [(q, " ".join(rng.choice([*vocabulary, "the", "absent"]) for _ in range(rng.randint(1, 8)))) for q in range(40)] + [(50, "the the"), (51, ""), (52, None), (53, "nowhere")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    for k, block in ((3, 4096), (10, 20), (400, 7)):
        path = str(tmp_path / f"index-{k}")
        text_index.build_text_index(docs, path, block_documents=block)
        exact = retrieval.bm25_top_k(docs, queries, k)
        got = text_index.search_text_index(spark, path, queries, k)
        assert rows(got, "query_id", "item_id", "rank") == rows(exact, "query_id", "item_id", "rank")
        assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(rows(got, "query_id", "item_id", "score"), rows(exact, "query_id", "item_id", "score"), strict=True))
    postings = spark.read.parquet(str(tmp_path / "index-10") + "/postings")
    assert postings.where("term = 'the'").count() > 10 and postings.agg(F.max(F.size("held"))).first()[0] < 60
    empty = str(tmp_path / "empty")
    text_index.build_text_index(docs.limit(0), empty)
    assert text_index.search_text_index(spark, empty, queries, 3).count() == 0
