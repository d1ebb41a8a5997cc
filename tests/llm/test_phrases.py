"""op12 against counts in dictionaries, and its SQL."""

import re
from collections import Counter

import duckdb
import pytest
import xxhash
from llm_helpers import DATA, clash, lower, sample_texts
from pyspark.sql import functions as F

from tastemap.llm import phrases, queries

SCHEMA = "doc_id bigint, text string, lang string"
SMALL = {"support": 3, "longest": 3, "top": 200, "covered": 50}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, support, longest, top, covered):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    inside = {}
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = lang, w[i : i + m]
                inside[key] = max(inside.get(key, 0), a)
    out = []
    for lang in totals:
        found = []
        for (of, w), a in candidates.items():
            if of != lang or 100 * inside.get((lang, w), 0) >= covered * a:
                continue
            cuts = [(counts[lang, w[:k]], counts[lang, w[k:]], k) for k in range(1, len(w))]
            score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for x, y, k in cuts)
            found.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def mined(df, **options):
    got = phrases.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("options", [
    {}, {"shard": 300, "bits": 64}, {"support": 7, "longest": 4, "shard": 2000, "bits": 4096}, {"longest": 2, "top": 5},
])
def test_equals_dictionaries(spark, options):
    texts = sample_texts(90, seed=5, vocabulary=25, longest=120)
    texts += ["Ab cd,ab cd. AB CD!ef\x0bef gh\tgh  gh", "é ü é ü é ü é ü", "x " * 3000, "a." * 50]
    rows = [(t, [None, "en", "fr", "en", ""][i % 5]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    options = SMALL | options
    want = brute(rows, *(options[k] for k in SMALL))
    assert want
    assert mined(clash(frame).repartition(4), **options) == want


def test_one_shard_lowers_nothing_and_rest_is_counted(spark):
    """Local supports above one: phrases below them in a shard still count there."""
    rows = [("a b c " * 9, "en")] + [("a b. d e. " * 2, "en")] * 4 + [("f g " * 40, "en")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).coalesce(1)
    options = SMALL | {"support": 10, "shard": 20}
    docs = frame.select("lang", "text")
    words = {"en": sum(len(w) for t, _ in rows for w in pieces(t))}
    local = phrases.mine(docs, 1, [], 10, words, 20)
    assert local.where("NOT frequent").count() > 0
    assert mined(frame, **options) == brute(rows, *(options[k] for k in SMALL))


def test_local_support_loses_nothing():
    for support in (1, 2, 10, 37):
        for parts in ([1] * 50, [10, 1, 1, 30], [100], [3, 3, 4]):
            misses = sum(phrases.local_support(support, p, sum(parts)) - 1 for p in parts)
            assert misses < support


def test_bitmap_places_are_sparks(spark):
    rows = ["the é", "ü x", "x the", "é é"]
    frame = spark.createDataFrame([("en", w) for w in rows], "lang string, phrase string")
    bitmap = phrases.Bitmap(frame, 2, 1 << 20)
    hashes = lambda lang, texts: [phrases.word_hashes(lang, [t.split()[i].encode() for t in texts]) for i in (0, 1)]
    assert bitmap.has(hashes(b"en", rows)).all()
    assert not bitmap.has(hashes(b"fr", rows)).any()
    assert not bitmap.has(hashes(b"en", ["é the", "x ü", "the x"])).any()
    got = frame.select(F.xxhash64(F.concat_ws("\t", "lang", F.lit("the"))).alias("h")).first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"en\tthe", 42)


def test_large_counts_are_exact(spark):
    """Products of counts beyond 64 bits."""
    big = 3_000_000_000_000
    one = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big)], "lang string, phrase string, n bigint")
    two = spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, n bigint")
    row = phrases.scored([one, two]).first()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // ((big + 1) * big)


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty, **SMALL) == []
    blank = spark.createDataFrame([(None, None, None), (1, "", "en"), (1, " .. ", "en")], SCHEMA)
    assert mined(blank, **SMALL) == []


def test_query_equals_sql(spark):
    directory = f"{DATA}/sf0.01"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{directory}/documents.parquet'")
        want = con.sql(queries.ORACLE_SQL["op12_phrases"])
        names, rows = want.columns, want.fetchall()
    got = queries.QUERIES["op12_phrases"](spark, directory)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    assert len(rows) > 1000
