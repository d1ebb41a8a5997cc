"""op11: the kernel against all subsequences, the folded model against the landmarks,
and held-out labels."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from llm_helpers import DATA, clash, documents

from tastemap.llm import nbsvm
from tastemap.llm import stringkernel as sk
from tastemap.llm.queries import QUERIES

WORDS = ["idiot", "idxiot", "studio", "a", "ab", "aaaaaaa", "élan", "vequté", "vequju", "disgusting", "abcabcabcabc"]


def brute(span):
    text, found = f"\n{span}\r", Counter()
    for places in itertools.combinations(range(len(text)), sk.LENGTH):
        stretch = places[-1] - places[0] + 1
        if stretch <= sk.LENGTH + sk.GAPS:
            found["".join(text[p] for p in places)] += sk.DECAY**stretch
    return found


def kernel(a, b):
    x, y = brute(a), brute(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / max(1e-300, (dot(x, x) * dot(y, y)) ** 0.5)


def test_kernel_equals_all_subsequences():
    row, key, weight = sk.subsequences(WORDS)
    table = {}
    for r, k, w in zip(row.tolist(), key.tolist(), weight.tolist()):
        assert k not in table.setdefault(r, {})
        table[r][k] = w
    norm = sk.norms(len(WORDS), row, weight)
    for i, a in enumerate(WORDS):
        assert sorted(table.get(i, {}).values()) == pytest.approx(sorted(brute(a).values()))
        for j, b in enumerate(WORDS):
            same = sum(w * table.get(j, {}).get(k, 0) for k, w in table.get(i, {}).items()) / norm[i] / norm[j]
            assert same == pytest.approx(kernel(a, b), abs=1e-12)


def test_landmark_features_are_the_kernel_among_landmarks():
    landmarks = sk.Landmarks(WORDS)
    x = landmarks.features(WORDS)
    want = np.array([[kernel(a, b) for b in WORDS] for a in WORDS])
    assert np.allclose(x @ x.T, want, atol=1e-7)


def test_folded_model_equals_features():
    landmarks = sk.Landmarks(WORDS[:6])
    w = np.random.default_rng(0).normal(size=landmarks.root.shape[1])
    model = sk.Model.folded(landmarks, w)
    assert np.allclose(model.margins(WORDS), landmarks.features(WORDS) @ w + sk.UNLIKE)


def test_squared_hinge_is_at_its_least():
    rng = np.random.default_rng(1)
    x, y, cost = rng.normal(size=(80, 5)), np.where(rng.random(80) < 0.5, 1.0, -1.0), rng.random(80)
    w = sk.squared_hinge(x, y, cost)
    short = np.maximum(0, 1 - y * (x @ w + sk.UNLIKE))
    assert np.allclose(w, 2 * x.T @ (cost * y * short), atol=1e-6)


def test_spans():
    assert sk.spans("You i-d-i-o-t, m o r o n!! 12 id10t") == {"you", "idiot", "moron", "idt", "m", "o", "r", "n"}
    assert sk.spans("") == sk.spans(" .. 12 ") == set()
    long = sk.spans("x" * 100_000 + "ab")
    assert all(len(s) <= sk.WINDOW for s in long) and any(s.endswith("ab") for s in long)


def corpus(n, seed):
    """Texts of invented words; toxic ones hold forms of two invented insults."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeginorstu") for _ in range(r.randint(2, 8)))
    common = [word() for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = int(r.random() < 0.3)
        words = [r.choice(common) if r.random() < 0.9 else word() for _ in range(r.randint(3, 60))]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["zorvak", "plimquex"]))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return sk.train(spark.createDataFrame(corpus(900, 1), "doc_id bigint, text string, label int"))


def test_gapped_and_inserted(model):
    say = lambda text: model.scores(model.largest([text]))[0]
    for text in ("zorvak", "Zorvak!", "z.o.r.v.a.k", "so z o r v a k", "zorrvak", "zorxvak", "plim-quex", "plimqquex"):
        assert say(text) >= 0.5, text
    for text in ("", "zor", "the vase", "plum", "1234", None):
        assert say(text) < 0.5, text


def test_scores_of_whole_texts(spark, model):
    rows = corpus(400, 2)
    long = " ".join(t for _, t, toxic in rows if not toxic)
    frame = documents(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, long), (903, long + " zorvak"), (903, long + " zorvak")])
    got = clash(frame).drop("score").withColumn("extra", frame["text"])
    scored = sk.score(got, model)
    assert scored.columns == [*got.columns, "score"]
    by_id = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert scored.count() == len(rows) + 5
    assert all((by_id[i] >= 0.5) == bool(toxic) for i, _, toxic in rows)
    assert by_id[900] == by_id[901] < 0.5 and by_id[902] < 0.5 <= by_id[903]


def test_without_labels_or_with_one_class(spark):
    schema = "doc_id bigint, text string, label int"
    assert sk.train(spark.createDataFrame([], schema)).scores(np.array([0.0]))[0] == pytest.approx(1 / 3)
    one = sk.train(spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "c", 7)], schema))
    assert one.scores(one.largest(["a", None]))[0] == pytest.approx(1 / 5)


def test_query_on_held_out_labels(spark):
    """English insults: the other languages' toxic words of this table occur in clean
    documents, too."""
    directory = f"{DATA}/sf0.1"
    got = QUERIES["op11_toxicity"](spark, directory)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{directory}/documents.parquet").count()
    names = spark.read.parquet(f"{directory}/documents.parquet").where("lang = 'en'").select("doc_id")
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    rows = got.where("held_out").join(names, "doc_id").join(labels, "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert len(toxic) > 30 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.02
    assert nbsvm.SAMPLE == 8_000
