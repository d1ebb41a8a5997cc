"""op10 against scores of all pairs."""

import math

import numpy as np
import pytest
from llm_helpers import DATA

from tastemap.llm import balltree

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], VECTORS)


def brute(rows, k, every):
    fit = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in fit if i % every == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fit if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def search(spark, rows, k, every=5, **sizes):
    vectors = balltree.quantised(frame(spark, rows), "vec_id", "embedding", 256)
    got = balltree.top_k(vectors, vectors.where(f"id % {every} = 0"), k, **sizes)
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in got.collect())


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 90}])
def test_equals_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(balltree, "LEAF", 8)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))]
    rows += [(500 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # ties
    rows += [(600, None), (605, [float("nan")] * 6), (610, [None] * 6), (615, [float("inf")] + [0.0] * 5), (None, [0.0] * 6)]
    rows += [(700, [0.0] * 6), (-5, [-1.0] * 6)]
    assert search(spark, rows, 7, **sizes) == brute(rows, 7, 5)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [0.5, 0.1]), (5, [0.1, 0.2]), (7, [0.3, 0.3])]
    assert search(spark, rows, 9, shard_rows=1) == brute(rows, 9, 5)
    assert search(spark, rows[:1], 3) == []
    assert search(spark, [], 3) == []


def test_tree_prunes_without_losing(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 300
    vectors = np.floor(np.concatenate([c + rng.normal(size=(200, 16)) * 9 for c in centres]))
    tree = balltree.BallTree(vectors, 32)
    ids = np.arange(len(vectors))[tree.order]
    for q in vectors[::157]:
        score, at = tree.search(q, 5, -(1 << 62), np.zeros(len(ids), bool), ids)
        every = vectors @ q
        best = np.lexsort((np.arange(len(vectors)), -every))[:5]
        assert ids[at].tolist() == best.tolist() and score.tolist() == every[best].tolist()


def test_large_finite_components_are_candidates(spark):
    rows = [(0, [0.01, 0.0]), (1, [2e15, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 0.0])]
    assert search(spark, rows, 3) == brute(rows, 3, 5)
    assert search(spark, rows, 3)[0] == (0, 1, 1, 2 * 256 * int(np.float32(2e15)))


@pytest.mark.parametrize("x", [3e7, 2e15, 1e30])
def test_a_product_beyond_a_long_is_an_error(spark, x):
    with pytest.raises(Exception, match="does not fit a long"):
        search(spark, [(0, [x, 0.0]), (1, [x, 0.0])], 1)


def test_query(spark):
    from tastemap.llm import QUERIES

    table = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()
    got = QUERIES["op10_balltree"](spark, f"{DATA}/sf0.001").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in table]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 50)


def test_sql(spark):
    import duckdb

    from tastemap.llm import ORACLE_SQL

    path = f"{DATA}/sf0.01/embeddings.parquet"
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS FROM '{path}'")
        found = c.sql(ORACLE_SQL["op10_balltree"])
        assert [str(t) for t in found.types] == ["BIGINT", "INTEGER", "BIGINT", "BIGINT"]
        rows = sorted(found.fetchall())
    table = spark.read.parquet(path).collect()
    assert rows == brute([(r.vec_id, list(r.embedding)) for r in table], 5, 50)


def test_one_tree_for_each_shard(spark, monkeypatch, tmp_path):
    """Built once, however many queries there are."""
    whole, log = balltree.build, str(tmp_path / "built")

    def counted(rows):
        with open(log, "a") as file:
            file.write(f"{rows['shard'][0]}\n")
        return whole(rows)

    monkeypatch.setattr(balltree, "build", counted)
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    assert search(spark, rows, 3, every=1, shard_rows=30) == brute(rows, 3, 1)
    built = (tmp_path / "built").read_text().split()
    assert len(built) == len(set(built)) == 10


def test_repeated_ids(spark):
    """A query of several rows is asked once; rows with one id are candidates each."""
    rows = [(0, [1.0, 0.0])] * 2 + [(i, [i / 16, 0.0]) for i in (5, 6, 7, 8, 9)]
    got = search(spark, rows, 5, every=50)
    assert [(i, s) for _, _, i, s in got] == [(i, i * 16 * 256) for i in (9, 8, 7, 6, 5)]
    rows += [(0, [-1.0, 0.0]), (9, [9 / 16, 0.0])]
    assert [(i, s) for _, _, i, s in search(spark, rows, 2, every=50)] == [(5, -5 * 16 * 256), (6, -6 * 16 * 256)]


def test_empty_vectors_take_no_part(spark):
    rows = [(0, [1.0]), (5, []), (7, [0.5]), (10, None)]
    assert search(spark, rows, 3) == brute([r for r in rows if r[1]], 3, 5)


def test_sql_says_the_same_of_repeated_ids_and_empty_vectors(spark, tmp_path):
    import duckdb

    from tastemap.llm import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 3)))]
    rows += [rows[0], rows[50], (100, [-1.0, 0.5, 0.0]), (300, []), (301, None), (350, [None] * 3)]
    frame(spark, rows).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op10_balltree"](spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(c.sql(ORACLE_SQL["op10_balltree"]).fetchall()) == got
    assert {r[0] for r in got} == {0, 50, 100}
