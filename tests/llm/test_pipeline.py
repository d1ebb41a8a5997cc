"""The pipeline against brute-force versions of its stages, one after another."""

import pytest
from llm_helpers import DATA, clash, documents
from pyspark.sql import functions as F
from test_boilerplate import brute as brute_lines
from test_decontaminate import brute as brute_hits
from test_jaccard import brute as brute_classes
from test_tokens import check_packing

import corpus_pipeline


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_stages(spark, tmp_path, scale):
    directory = f"{DATA}/{scale}"
    from tastemap.llm import QUERIES

    docs = spark.read.parquet(f"{directory}/documents.parquet")
    columns, docs_in = docs.columns, docs
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in QUERIES["op9_quality"](spark, directory).collect() if r.predicted}
    texts = brute_lines([(d, rows[d].text, rows[d].source) for d in good], 0.1, 2)
    texts = {d: t for d, t, *_ in texts}
    single = {d for d, n, c in brute_classes(list(texts.items())) if d == c or not n}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{directory}/benchmark.parquet").collect()]
    clean = {d for d, *_, hit in brute_hits([(d, texts[d]) for d in single], bench) if not hit}
    expected = [
        {d: rows[d].text for d in good}, texts, {d: texts[d] for d in single}, {d: texts[d] for d in clean}
    ]
    for (name, stage), kept in zip(corpus_pipeline.STAGES, expected):
        out = stage(spark, docs, directory)
        assert out.columns == columns and dict(out.dtypes) == dict(docs_in.dtypes)
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        found = docs.collect()
        assert {r.doc_id: r.text for r in found} == kept and len(found) == len(kept), name
        for r in found:
            whole = rows[r.doc_id]
            assert (r.lang, r.source) == (whole.lang, whole.source)
            assert r.n_chars == (whole.n_chars if r.text == whole.text else len(r.text))
    assert len(rows) > len(good) > len(single) > len(clean) > len(rows) / 3
    final = corpus_pipeline.STAGES[-1][1](spark, docs, directory)
    check_packing(final, list(expected[-1].items()), 2048)


def test_run(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_keep_columns_of_any_name_and_nulls(spark):
    rows = [(1, "a plain text of a few words here"), (2, None), (3, ""), (None, "one without an id at all")]
    docs = clash(documents(spark, rows)).withColumns({"n_lines": F.lit("mine"), "n_dropped": F.lit("mine")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        for r in out.collect():
            assert (r.doc_id, r.text) in rows and r.score == r.hits == "clash" and r.n_lines == "mine"
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()} == {1, 2, 3, None}


def test_no_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{DATA}/sf0.001").collect() == []
