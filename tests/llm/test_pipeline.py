import re

import corpus_pipeline
from tallyfin.llm import decontam

from .conftest import ODD
from .conftest_llm import brute_components


def test_pipeline(spark, frame, corpus, tmp_path):
    junk = [(1000 + i, re.sub(r"(\w+)", r"\1###", t)) for i, t in corpus]
    bench = [(1, corpus[44][1] + " " + corpus[46][1]), (2, corpus[50][1])]
    rows = corpus + junk + ODD
    d = str(tmp_path)
    frame(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in corpus] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{d}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{d}/stage{k}")
        sizes.append(docs.count())
        if name == "near_dedup":
            had = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
            comp = brute_components(had, 5)
            assert {r.doc_id for r in docs.collect() if r.doc_id is not None} == {i for i, _ in had if comp[i] == i}
        if name == "decontamination":
            assert decontam.find_contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    assert sizes[0] < len(rows) and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    assert corpus_pipeline.run(spark, d).count() == sizes[-1]


def test_near_stage_repeated_rows_and_null_ids(spark, frame):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long + " end"), (3, other), (3, other), (3, "a third text"), (None, long + " more"), (None, "alone here"), (None, "alone here"), (None, ""), (None, None), (4, ""), (5, None)]
    got = corpus_pipeline.near_stage(spark, frame(rows), "").select("doc_id", "text").collect()
    want = [(1, long), (3, other), (3, "a third text"), (None, "alone here"), (None, ""), (None, None), (4, ""), (5, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_stage_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", "b", 1), (2, text + " more", "c", "d", 2), (3, None, "e", "f", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, _key string, OTHER int")
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_line_stage_of_one_long_document(spark, frame):
    lines = [f"line {k} of one long document, each more than forty characters" for k in range(200_000)]
    got = corpus_pipeline.line_stage(spark, frame([(k, "\n".join(lines[: 200_000 if k == 0 else 3])) for k in range(5)]), "")
    assert {r.doc_id: r.text.count("\n") + 1 for r in got.collect() if r.text} == {0: 199_997, 4: 3}
