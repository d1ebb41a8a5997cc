"""op9: its parts against plain formulas, its scores against held-out labels."""

import numpy as np
from llm_helpers import DATA, clash, documents

from tastemap.llm import nbsvm


def test_shapes_of_words():
    shapes = nbsvm._Shapes()
    assert shapes[b"HELLO!!"] == shapes[b"AB!"] != shapes[b"hello!!"]
    assert shapes["é1".encode()] == shapes[b"a22"]


def test_long_shapes_differ_after_their_start():
    shapes = nbsvm._Shapes()
    assert shapes[b"a1" * 9 + b"#"] != shapes[b"a1" * 9 + b"%"]


def test_a_rare_shape_has_a_feature():
    plain, one, two = (set(nbsvm.features(b"word " * 10_000 + x).tolist()) for x in (b"", b"Qab#7", b"Rcd#8"))
    assert (one & two) - plain


def test_features_are_sets_and_cover_empty_texts():
    assert nbsvm.features(b"").tolist() == [0]
    one = nbsvm.features(b"a b c " * 50)
    assert len(set(one.tolist())) == len(one) and one[0] == 0 and one.max() < nbsvm.SIZE


def test_log_count_ratio():
    got = nbsvm.log_count_ratio(np.array([0, 3.0, 0]), np.array([0, 0, 1.0]))
    assert np.allclose(got[1:], [np.log(4 / 6) - np.log(1 / 4), np.log(1 / 6) - np.log(2 / 4)])


def test_descent_reaches_the_optimum():
    """Against subgradients of the same objective at the solution's neighbourhood."""
    rng = np.random.default_rng(1)
    ratio = np.append(1.0, rng.normal(size=11))
    rows = [np.append(0, 1 + np.flatnonzero(rng.random(11) < 0.4)) for _ in range(60)]
    labels = np.where([r.sum() + rng.integers(0, 20) > 30 for r in rows], 1, -1)
    cost = 0.1
    w = nbsvm.dual_coordinate_descent(rows, labels, ratio, cost, epochs=3000) / ratio
    share = np.where(labels > 0, (labels > 0).sum(), (labels < 0).sum())
    bound = cost * len(labels) / (2 * share)

    def objective(w):
        margin = np.array([(w[r] * ratio[r]).sum() for r in rows]) * labels
        return 0.5 * w @ w + (bound * np.maximum(0, 1 - margin)).sum()

    best = objective(w)
    for _ in range(300):
        assert objective(w + rng.normal(scale=0.01, size=12)) >= best - 1e-3


def train(spark, rows):
    return nbsvm.train(spark.createDataFrame(rows, "doc_id bigint, text string, label int"))


def test_small_and_one_sided_training(spark):
    assert train(spark, []).score(b"x") == 0.5
    only = train(spark, [(i, "a b", 1) for i in range(9)])
    assert only.score(b"") > 0.7 and only.score(b"zzz") > 0.7
    both = train(spark, [(i, "good text here", 1) for i in range(20)] + [(i, "BAD!! BAD!!", 0) for i in range(20)]
                 + [(5, None, 1), (6, "odd", None), (7, "odd", 3)])
    assert both.score(b"good text") > both.score(b"BAD!!")


def test_score_keeps_rows_and_columns(spark):
    df = clash(documents(spark, [None, "", "a b", "a b", "word " * 30_000]))
    model = train(spark, [(1, "a b", 1), (2, "C!! D!!", 0)])
    got = nbsvm.score(df, model)
    assert sorted(got.columns) == sorted(df.columns)
    scores = [r.score for r in got.orderBy("doc_id").collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert scores[0] == scores[1] and scores[2] == scores[3]
    assert nbsvm.score(documents(spark, []), model).collect() == []


def test_held_out_accuracy(spark):
    from tastemap.llm import QUERIES

    directory = f"{DATA}/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, directory).collect()
    assert len(rows) == spark.read.parquet(f"{directory}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    for kind in (0, 1):
        mine = [r for r in rows if r.held_out and labels.get(r.doc_id) == kind]
        right = sum(r.predicted == kind for r in mine)
        assert right >= 0.97 * len(mine), (kind, right, len(mine))


def test_labelled_sample(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(i, f"t{i}") for i in range(2000)] + [(5, "other"), (5, "t5"), (None, "x")])
    rows = [(i, i % 2, 0) for i in range(1000)] + [(7, 0, 0), (8, 1, 0), (9, 1, 0), (9, 1, 0), (10, None, 0), (5000, 1, 0), (None, 1, 0), (11, 7, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    held_out = F.col("doc_id") % 10 == 3
    got = {r.doc_id: (r.text, r.label) for r in nbsvm.labelled_sample(docs, labels, held_out, 10**6).collect()}
    expected = {i: (f"t{i}", i % 2) for i in range(1000) if i % 10 != 3}
    expected[5] = ("other", 1)
    del expected[7], expected[8]  # one label each way
    assert got == expected
    some = nbsvm.labelled_sample(docs, labels, held_out, 200).count()
    assert 120 < some < 280
