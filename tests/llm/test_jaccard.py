"""op3 against comparing all pairs."""

import random

import numpy as np
import pytest
from llm_helpers import DATA, clash, documents, space_words

from tastemap.llm import jaccard
from tastemap.tasks import recorded


def shingles(text, size):
    words = space_words(text)
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, size=5, percent=75):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return sorted(
        ((d, len(s), smallest.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str
    )


def as_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def texts(n=150, seed=1, longest=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(30)]
    out = [None, "", " \t", "one", "One", "one two", "a b c d e", "A b c d e", "a b c d e f", "a b c d e f g", "a b c d e f g h"]
    while len(out) < n:
        kind = r.random()
        if kind < 0.55:
            base = (r.choice(out) or "").split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                base = base or ["z"]
                at = r.randrange(len(base))
                base[at : at + 1] = r.choice([[], [r.choice(words)], [base[at], r.choice(words)]])
            out.append(" ".join(base))
        else:
            body = [r.choice(words) for _ in range(r.randint(1, longest))]
            out.append(" ".join(body + passage * (kind < 0.7)))
    return out


@pytest.mark.parametrize("boundary", [None, 12, 1000])
def test_equals_all_pairs(spark, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(jaccard, "sample", lambda *_: (jaccard.Order(*[np.zeros(0, np.uint64)] * 2), boundary))
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    longest = 25 if boundary == 1000 else 60
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts(160, 2, longest))]
    rows += [(rows[40][0], rows[40][1]), (rows[50][0], rows[60][1]), (None, rows[70][1]), (None, "lonely null id")]
    got = as_rows(jaccard.join(clash(documents(spark, rows).repartition(3))))
    assert got == brute(rows)
    assert len({c for *_, c in got}) < len(got) - 20


@pytest.mark.parametrize("size,percent", [(1, 30), (3, 90)])
def test_other_parameters(spark, size, percent):
    rows = list(enumerate(texts(90, 7, 20)))
    assert as_rows(jaccard.join(documents(spark, rows), size, percent)) == brute(rows, size, percent)


def test_many_rounds_of_a_large_group(spark, monkeypatch):
    """Near copies of one text that are often too far from each other."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(60)])) for i in range(60)]
    calls = []
    whole = jaccard.rekeyed
    monkeypatch.setattr(jaccard, "rekeyed", lambda *a: calls.append(1) or whole(*a))
    monkeypatch.setattr(jaccard, "ROUNDS", (1,))
    monkeypatch.setattr(jaccard, "CORE", 5)
    assert as_rows(jaccard.join(documents(spark, rows))) == brute(rows)
    assert calls


def edited_copies(n, seed=6):
    """Copies of one text with two words replaced: most pairs are just not linked."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in r.sample(range(120), 2):
            words[at] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_compared_pairs_grow_with_the_rows(spark, monkeypatch):
    counts = {}
    for n in (300, 1500):
        found = []
        whole = jaccard.likely
        monkeypatch.setattr(jaccard, "likely", lambda pairs, *a: found.append(pairs.count()) or whole(pairs, *a))
        rows = edited_copies(n)
        got = as_rows(jaccard.join(documents(spark, rows)))
        monkeypatch.setattr(jaccard, "likely", whole)
        assert got == brute(rows)
        counts[n] = sum(found)
    assert counts[1500] <= 8 * counts[300], counts


def test_few_pairs_move_few_sets(spark, settings):
    """Sets and sketches that no pair of a round asks for stay where they are."""
    settings(spark__sql__autoBroadcastJoinThreshold="256k")
    rng = np.random.default_rng(2)
    found = [np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64)) for _ in range(2000)]
    found[7] = found[5]
    sets = spark.createDataFrame([(i, len(f), jaccard.sketch(f), f.tobytes()) for i, f in enumerate(found)],
                                 "vertex bigint, n int, sketch binary, shingles binary")
    sets = jaccard.keep(sets, "sets")
    pairs = jaccard.keep(spark.createDataFrame([(5, 7), (5, 9)], "a bigint, b bigint"), "pairs")
    for compare, facts in ((jaccard.likely, sets.drop("shingles")), (jaccard.linked, sets.select("vertex", "shingles"))):
        out = []
        stages = recorded(spark, lambda: out.extend(compare(pairs, facts, 75).collect()))
        assert [tuple(row) for row in out] == [(5, 7)]
        assert max(s.largest_shuffle for s in stages) <= 8


def test_differences_find_all_links(spark, monkeypatch):
    """Keyed anew at once, before any hub: unequal sizes, groups that overlap."""
    monkeypatch.setattr(jaccard, "CORE", 3)
    turns = iter([()] + [(1,)] * 50)  # the first list is keyed anew, later ones have hubs, too
    whole = jaccard.opened
    monkeypatch.setattr(jaccard, "opened", lambda *a: setattr(jaccard, "ROUNDS", next(turns)) or whole(*a))
    rows = list(enumerate(texts(150, 11, 40))) + [(1000 + i, t) for i, t in edited_copies(60)]
    assert as_rows(jaccard.join(documents(spark, rows))) == brute(rows)


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, m = rng.integers(1, 400, 2)
        pool = np.unique(rng.integers(0, 2**63, int(max(n, m) * rng.uniform(1, 2)), dtype=np.uint64))
        x, y = (np.sort(rng.choice(pool, min(k, len(pool)), replace=False)) for k in (n, m))
        bound = jaccard.most_common(jaccard.sketch(x), jaccard.sketch(y), len(x), len(y))
        common = len(np.intersect1d(x, y))
        assert common <= bound
    same = np.arange(500, dtype=np.uint64)
    assert jaccard.most_common(jaccard.sketch(same), jaccard.sketch(same), 500, 500) == 500
    x, y = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(2))
    assert jaccard.most_common(jaccard.sketch(x), jaccard.sketch(y), 500, 500) < 400


def test_components_of_chains(spark):
    r = random.Random(3)
    names = list(range(200))
    r.shuffle(names)
    chain = [(names[i], names[i + 1]) for i in range(120)] + [(names[150 + i], names[150]) for i in range(1, 40)]
    got = {x.vertex: x.component for x in jaccard.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {got[n] for n in names[:121]} == {min(names[:121])}
    assert {got[n] for n in names[150:190]} == {min(names[150:190])}


def test_no_rows(spark):
    assert jaccard.join(documents(spark, [])).collect() == []
    assert as_rows(jaccard.join(documents(spark, [None, "", "x"]))) == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def test_representatives(spark):
    rows = list(enumerate(texts(60, 9, 30)))
    df = documents(spark, rows)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    expected = sorted(d for d, n, c in brute(rows) if d == c or not n)
    assert sorted(r.doc_id for r in kept.collect()) == expected


def test_rows_without_words_all_stay(spark):
    rows = [(None, None)] * 3 + [(1, "")] * 2 + [(2, " \t\r\n"), (2, " \t\r\n"), (3, "a b"), (3, "a b"), (4, "\u00a0")]
    got = [(r.doc_id, r.text) for r in jaccard.representatives(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([*rows[:7], (3, "a b"), (4, "\u00a0")], key=str)


def test_query(spark):
    from tastemap.llm import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = as_rows(QUERIES["op3_jaccard"](spark, f"{DATA}/sf0.001"))
    assert got == brute(rows) and any(d != c for d, _, c in got)
