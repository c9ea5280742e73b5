"""The pipeline's contract, and each stage on a small corpus."""

import corpus_pipeline
from fieldglass.llm import quality, simhash
from fieldglass.llm.queries import ORACLES, QUERIES

from .conftest import prose


def test_stages(spark, make_docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
    passage = prose(700, 24)
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = prose(701, 120)
    pairs = [(1, good), (2, good), (3, prose(702, 90) + " " + passage + " " + prose(703, 60)), (4, "too short"), (5, None), (6, prose(704, 120) + " password=abcdefghijkl0 " + prose(705, 20)), (7, "a | b | c | d\n" * 30)]
    docs = make_docs(pairs)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(sorted({r["doc_id"] for r in docs.select("doc_id").collect()}))
        if name != names[-1]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept == [[1, 2, 3, 6], [1, 3, 6], [1, 3, 6], [1, 3, 6], [1, 3, 6]]
    assert texts[1] == good and passage.rstrip(".") not in texts[3] and "[secret]" in texts[6] and "abcdefghijkl0" not in texts[6]
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_run_reads_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = quality.clean(docs)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in simhash.one_of_each(clean).select("doc_id").collect()}
