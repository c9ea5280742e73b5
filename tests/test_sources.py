"""Readers and stores over real files."""

import json

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import ontology
from fieldglass.plans import Tables
from fieldglass.plans.traffic import calls
from fieldglass.sources import readers, stores, versions


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_dated_parquet(spark, tmp_path, rows):
    for name, v in [("data_20240101", 1), ("data_20240103", 3), ("b_20240103", 4), ("data_20240109", 9)]:
        spark.range(1).select(F.lit(v).alias("v")).coalesce(1).write.parquet(str(tmp_path / "w" / name))
        part = next((tmp_path / "w" / name).glob("part-*.parquet"))
        (tmp_path / "d").mkdir(exist_ok=True)
        part.rename(tmp_path / "d" / f"{name}.parquet")
    got = readers.dated_parquet(spark, str(tmp_path / "d"), "20240101", "20240105")
    assert rows(got, "v", "file_date") == [(1, "20240101"), (4, "20240103")]
    with pytest.raises(FileNotFoundError):
        readers.dated_parquet(spark, str(tmp_path / "d"), "20250101", "20250105")


def test_typed_load(spark, tmp_path):
    path = write(tmp_path, "a.csv", "x,y\n1,a\n")
    assert readers.load_typed(spark, path, "csv").first().asDict() == {"x": 1, "y": "a"}
    assert readers.load_typed(spark, str(tmp_path / "none"), "parquet").count() == 0
    assert readers.load_typed(spark, str(tmp_path / "none"), "csv", "x int").columns == ["x"]
    with pytest.raises(ValueError):
        readers.load_typed(spark, path, "xml")


def test_corpus(spark, tmp_path, rows):
    csv = write(tmp_path, "a.csv", "x,y\n1,a\n2,\n")
    assert rows(readers.corpus(spark, csv), "text") == [("x: 1 | y: a",), ("x: 2 | y: None",)]
    js = write(tmp_path, "a.jsonl", '{"body": "hi"}\n')
    assert rows(readers.corpus(spark, js, "body"), "text") == [("hi",)]
    with pytest.raises(ValueError):
        readers.corpus(spark, "x.txt")


def test_csv_records(spark, tmp_path):
    path = write(tmp_path, "p.csv", "Project,Status,Date\nA,open,2024\n")
    assert json.loads(readers.csv_json_records(spark, path).first().record) == {"Project": "A", "Status": "open", "Date": "2024"}


def test_documents_and_lines(spark, tmp_path, rows):
    write(tmp_path, "Rel-17/38331-i40.md", "# a\nb\n")
    write(tmp_path, "x/deep/b.md", "c")
    write(tmp_path, "x/skip.txt", "no")
    docs = readers.document_files(spark, str(tmp_path))
    assert rows(docs, "source_doc", "text") == [("38331-i40.md", "# a\nb\n"), ("b.md", "c")]
    assert rows(docs.select(readers.release_of(F.col("path")))) == [("Rel-17",), ("Rel-18",)]
    lines = readers.log_lines(spark, str(tmp_path / "Rel-17"))
    assert rows(lines, "line", "value") == [(0, "# a"), (1, "b"), (2, "")]


def test_triples_from_lines(spark, tmp_path, rows):
    text = "\n".join([
        '{"subject": "s", "predicate": "p", "object": "o", "subject_key": "K", "meta": {"subject_properties": {"a": "1"}, "object_label": "L"}}',
        "", "not json", '{"subject": "s"}{', '["x"]', '{"subject": "s", "predicate": "p", "object": "None"}',
    ])
    lines = readers.log_lines(spark, write(tmp_path, "t.jsonl", text))
    good, bad = readers.triple_lines(lines)
    assert rows(bad, "line") == [(2,), (3,), (4,)]
    usable, rejects = ontology.clean_triples(good)
    assert rows(usable, "line", "subject_node_key", "object_label", "subject_properties") == [(0, "K", "L", {"a": "1"})]
    assert rows(rejects, "line", "reason") == [(5, "object is null-like")]


def test_required_fields(spark, tmp_path):
    ok = write(tmp_path, "ok.jsonl", '{"query_id":"1","question":"q","answer":"a","contexts":["c"]}\n')
    assert readers.answer_samples(spark, ok).count() == 1
    bad = write(tmp_path, "bad.jsonl", '{"query_id":"1","question":"q","contexts":["c"]}\n')
    with pytest.raises(Exception, match="missing fields: answer"):
        readers.answer_samples(spark, bad).collect()
    gold = write(tmp_path, "g.jsonl", '{"query_id":"1","query":"q","needs_decomposition":true}\n')
    assert readers.gold_questions(spark, gold).first().needs_decomposition is True


def test_hierarchy_file(spark, tmp_path, rows):
    doc = {"version": "1", "control_groups": [{"id": "cg", "name": "G", "functions": [
        {"id": "fn", "name": "F", "kpis": ["k1"], "features": [{"id": "ft", "name": "T", "layer": "MAC", "kpis": ["k1", "k2"]}]}]}]}
    nodes, edges = ontology.hierarchy(readers.control_hierarchy(spark, write(tmp_path, "h.json", json.dumps(doc, indent=1))))
    assert rows(nodes, "id", "node_type") == [("cg", "control_group"), ("fn", "function"), ("ft", "feature"), ("k1", "kpi"), ("k2", "kpi")]
    assert rows(edges) == [
        ("cg", "fn", "INCLUDES"), ("fn", "ft", "REALIZED_BY"), ("fn", "k1", "MEASURED_BY"), ("ft", "MAC", "IMPLEMENTED_IN"),
        ("ft", "k1", "MEASURED_BY"), ("ft", "k2", "MEASURED_BY")]


def test_run_store(spark, tmp_path):
    docs = stores.run_documents(calls(Tables(spark, "/root/testdata/sf0.001")))
    stores.write_runs(docs, str(tmp_path / "runs"))
    listed = stores.list_runs(stores.read_runs(spark, str(tmp_path / "runs")))
    assert listed.count() == docs.count() > 0
    assert listed.filter("mock OR totals.tokens IS NULL").count() == 0


def test_replacing_write_keeps_other_sources(spark, tmp_path, rows):
    path = str(tmp_path / "chunks")
    schema = "doc_type string, source_doc string, n int"
    stores.write_replacing(spark.createDataFrame([("spec", "a", 1), ("spec", "b", 2)], schema), path, ["doc_type", "source_doc"])
    again = spark.createDataFrame([("spec", "a", 3)], schema)
    for _ in range(2):
        stores.write_replacing(again, path, ["doc_type", "source_doc"])
    assert rows(spark.read.parquet(path), "source_doc", "n") == [("a", 3), ("b", 2)]


def test_upsert(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", None, 1)], "id string, v int, seq int")
    assert rows(stores.upsert(old, new, ["id"], "seq"), "id", "v") == [("a", 3), ("b", 1), ("c", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "", "x")], "a string, b string, c string")
    readers.write_csv(df.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*.csv")).read_text()
    assert text == "a,b,c\n1,,x\n"
    readers.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("part-*.json")).read_text()) == {"a": "1", "b": "", "c": "x"}


def test_broken_gold_lines_are_not_lost(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"query_id": "q1", "query": "x"}\nnot json\n\n{"query": "no id"}\n', encoding="utf-8")
    good, broken = readers.gold_question_rows(spark, str(path))
    assert [r.query_id for r in good.collect()] == ["q1"] and sorted(r.line for r in broken.collect()) == ["not json", '{"query": "no id"}']
    with pytest.raises(ValueError, match="broken gold line"):
        readers.gold_questions(spark, str(path))


def test_unreadable_files_are_named(spark, tmp_path):
    (tmp_path / "a.md").write_text("fine", encoding="utf-8")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe\xff")
    good, bad = readers.document_file_rows(spark, str(tmp_path))
    assert [(r.source_doc, r.text) for r in good.collect()] == [("a.md", "fine")]
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["b.md"]


def test_versions_replace_sources_and_survive_restarts(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    make = lambda data: spark.createDataFrame(data, "source_doc string, text string")
    live = lambda upto=None: rows(versions.read_live(spark, path, "source_doc", upto), "source_doc", "text")
    first = [("a", "1"), ("a", "1"), ("b", "2"), (None, "3")]
    assert versions.write_version(make(first), path, "source_doc", "w0") == 0
    # an interrupted writer leaves rows without a list
    make([("a", "broken")]).write.parquet(f"{path}/rows/version=1")
    assert live() == rows(make(first), "source_doc", "text")
    size = lambda n: len(list((tmp_path / "store" / "rows" / f"version={n}").glob("*.parquet")))
    assert versions.write_version(make([("a", "4"), (None, "5")]).coalesce(1), path, "source_doc", "w1") == 1
    assert versions.write_version(make([("a", "other")]), path, "source_doc", "w1") == 1 and size(1) == 1
    second = rows(make([("a", "4"), ("b", "2"), (None, "5")]), "source_doc", "text")
    assert live() == second and live(0) == rows(make(first), "source_doc", "text")
    versions.write_version(make([]), path, "source_doc", "w2", removed=make([("b", "")]))
    assert live() == rows(make([("a", "4"), (None, "5")]), "source_doc", "text")
    assert versions.compact(spark, path, "source_doc") == 3 and size(0) == size(1) == 0
    assert live() == rows(make([("a", "4"), (None, "5")]), "source_doc", "text")
    versions.write_version(make([]), path, "source_doc", "w4", removed=make([("a", ""), (None, "")]))
    assert live() == []


def test_one_log_is_read_by_many_tasks(spark, tmp_path, rows):
    lines = [f"{i} {'x' * (i % 97)}" for i in range(20_000)]
    (tmp_path / "logs").mkdir()
    write(tmp_path, "logs/a.log", "\n".join(lines) + "\n")
    write(tmp_path, "logs/b.log", "one\r\n\r\nthree")
    write(tmp_path, "logs/empty.log", "")
    conf = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(conf, "65536")
    try:
        got = readers.split_log_lines(spark, str(tmp_path / "logs")).cache()
        assert got.select(F.spark_partition_id()).distinct().count() > 4
        numbered = {r["line"]: r["value"] for r in got.filter("path like '%a.log'").collect()}
        assert numbered == dict(enumerate(lines))
        assert rows(got.filter("path not like '%a.log'"), "line", "value") == [(0, "one"), (1, ""), (2, "three")]
    finally:
        spark.conf.unset(conf)
