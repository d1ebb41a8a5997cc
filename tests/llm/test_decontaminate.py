"""op8 against every window compared with every position."""

import hashlib
import tracemalloc

import numpy as np
import pytest
from llm_helpers import DATA, alnum_words, clash, documents, sample_texts

from tastemap.llm import decontaminate

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute(rows, bench, window=10):
    index = {}
    for item, text in bench:
        words = alnum_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            index.setdefault(tuple(words[i : i + n]), set()).add(item)
    sizes = {len(w) for w in index}
    out = []
    for doc, text in rows:
        words, hit, items = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if found := index.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        ids = sorted(str(i) for i in items)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def bench_frame(spark, bench):
    return spark.createDataFrame(bench, "item_id bigint, text string")


def planted():
    texts = sample_texts(80, seed=5, vocabulary=60, longest=120)
    bench = [(i, " ".join((t or "").split()[3:40])) for i, t in enumerate(texts[:20])]
    bench += [(100, None), (101, ""), (102, "x"), (103, "the the"), (104, bench[9][1]), (7, "b c d e")]
    bench += [(200 + i, " ".join((t or "").split()[:n])) for i, (t, n) in enumerate(zip(texts[20:40], range(1, 21)))]
    rows = list(enumerate(texts + [(t or "").upper().replace(" ", "\x00- ") for t in texts[:20]]))
    return rows + [(3, texts[3]), (3, texts[3]), (None, texts[9])], bench


@pytest.mark.parametrize("limit", [8_000_000, 700])
def test_equals_every_window(spark, limit):
    rows, bench = planted()
    got = decontaminate.report(
        clash(documents(spark, rows).repartition(3)), bench_frame(spark, bench), 10, limit=limit
    )
    expected = brute(rows, bench)
    assert as_rows(got) == expected
    assert 10 < sum(r[-1] for r in expected) < len(expected)


def test_clean_keeps_the_others(spark):
    rows, bench = planted()
    for limit in (8_000_000, 700):
        df = documents(spark, rows)
        kept = decontaminate.clean(df, bench_frame(spark, bench), 10, limit=limit)
        assert kept.columns == df.columns
        expected = [r[0] for r in brute(rows, bench) if not r[-1]]
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_memory_does_not_grow_with_items_of_one_passage():
    """Peak memory of a batch of 500 documents with the preamble of 20,000 items."""
    preamble = " ".join(f"p{i}" for i in range(30))
    peaks = {}
    for n in (200, 20_000):
        items = [(i, f"{preamble} q{i}".encode()) for i in range(n)] + [(n, f"{preamble} z".encode())]
        index = decontaminate.Index(items, 10)
        words = [decontaminate.WORDS.of(decontaminate.alnum_words(f"a b {preamble} z{i} c".encode())) for i in range(500)]
        owner = np.repeat(np.arange(500), [len(w) for w in words])
        words = np.concatenate(words)
        tracemalloc.start()
        found = decontaminate.matches(index, words, owner)
        peaks[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        (windows, at, which), = found
        assert len(at) == 500 * 21  # the windows within the preamble
        assert all(windows.bounds[w + 1] - windows.bounds[w] == n + 1 for w in set(which.tolist()))
    assert peaks[20_000] < 2 * peaks[200] + 1_000_000 and peaks[20_000] < 50_000_000, peaks


def test_items_of_one_passage(spark):
    preamble = " ".join(f"p{i}" for i in range(12))
    bench = [(i, f"{preamble} q{i}") for i in range(20_000)]
    rows = [(1, f"x {preamble} q7 y"), (2, "p0 p1 p2"), (3, preamble), (4, None)]
    assert as_rows(decontaminate.report(documents(spark, rows), bench_frame(spark, bench), 10)) == brute(rows, bench)
    kept = decontaminate.clean(documents(spark, rows), bench_frame(spark, bench), 10)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_items_without_id(spark):
    bench = [(None, " ".join("abcdefghijkl")), (1, "z y")]
    got = as_rows(decontaminate.report(documents(spark, [" ".join("abcdefghijkl"), "z y"]), bench_frame(spark, bench), 10))
    assert [(r[2], r[3], r[5]) for r in got] == [(12, 0, True), (2, 1, True)]


def test_empty_sides(spark):
    none = bench_frame(spark, [])
    assert as_rows(decontaminate.report(documents(spark, ["a b", None]), none, 10)) == brute(
        [(0, "a b"), (1, None)], []
    )
    assert decontaminate.report(documents(spark, []), none, 10).collect() == []


def test_query(spark):
    from tastemap.llm import QUERIES

    read = lambda t: spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet").collect()
    expected = brute(
        [(r.doc_id, r.text) for r in read("documents")], [(r.item_id, r.text) for r in read("benchmark")]
    )
    assert as_rows(QUERIES["op8_decontaminate"](spark, f"{DATA}/sf0.001")) == expected
    assert any(r[-1] for r in expected)
