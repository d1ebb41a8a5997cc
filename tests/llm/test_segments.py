"""op4 against encoding the edited text from the start."""

import random

import pytest
from llm_helpers import DATA, clash, documents, sample_texts

from tastemap.llm import segments
from tastemap.llm.tokens import Encoder, public_path

PATHS = [public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")]
encoders: dict[str, Encoder] = {}


def whole(path, text):
    from tokenizers import Tokenizer

    if path not in encoders:
        encoders[path] = Tokenizer.from_file(path)
        encoders[path].encode_special_tokens = True
    return len(encoders[path].encode(text, add_special_tokens=False).ids)


def test_leaves_join_to_the_text():
    for text in sample_texts() + ["a " * 500, "  a  b  " * 40]:
        for size in (1, 3, 32):
            parts = segments.leaves(text or "", size)
            assert "".join(parts) == (text or "")


@pytest.mark.parametrize("path", PATHS)
def test_random_edits(path, monkeypatch):
    monkeypatch.setattr(segments, "LEAF", 3)
    monkeypatch.setattr(segments.leaves, "__defaults__", (3,))
    r, encode = random.Random(6), Encoder(path)
    pieces = ["", " ", "  ", "x", "it's", " new words here ", "\n", "é", ".", "'s", "\n\n z"]
    for text in [t or "" for t in sample_texts(30, seed=9, longest=60)]:
        parts = segments.leaves(text, 3)
        tree = segments.SegmentTree([len(p) for p in parts], [segments.count(encode, p) for p in parts])
        assert tree.total == (len(text), whole(path, text))
        for _ in range(25):
            start = r.randint(0, len(text) + 2)
            end = min(start + r.choice([0, 0, 1, 2, 7, 40]), len(text) + 5)
            new = r.choice(pieces)
            a, b = min(start, len(text)), min(max(end, start), len(text))
            expected = text[:a] + new + text[b:]
            text, _ = segments.apply(text, tree, [(start, end, new)], encode)
            assert text == expected
            assert tree.total == (len(text), whole(path, text))


def test_one_edit_encodes_a_few_leaves():
    encode = Encoder(PATHS[0])
    text = " ".join(f"word{i}" for i in range(5000))
    parts = segments.leaves(text)
    tree = segments.SegmentTree([len(p) for p in parts], [segments.count(encode, p) for p in parts])
    _, again = segments.apply(text, tree, [(20_000, 20_010, "X")], encode)
    assert again < len(text) / 50


def test_edit_in_spark(spark):
    from pyspark.sql import functions as F

    texts = sample_texts(40)
    df = clash(documents(spark, texts))
    tree = segments.build(df, PATHS[0])
    assert set(tree.columns) == {*df.columns, "tree"}
    steps = [(0, 3, "Z z"), (5, 5, None), (2, 100, " q"), (9999, 10000, "end")]
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in steps])
    first = tree.withColumn("edits", F.when(F.col("doc_id") % 3 > 0, edits))
    once = segments.edit(first, PATHS[0])
    twice = segments.edit(once.select(*df.columns, "tree", "edits"), PATHS[0])
    for df, turns in ((once, 1), (twice, 2)):
        rows = df.collect()
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.doc_id]
            if r.doc_id % 3:
                for a, b, new in steps * turns:
                    text = (text or "")[:a] + (new or "") + (text or "")[b:]
            assert r.text == text
            assert r.tokens_after == whole(PATHS[0], text or "") == sum(r.tree.tokens)
            assert sum(r.tree.chars) == len(text or "")


def test_no_rows(spark):
    assert segments.counts(documents(spark, []), PATHS[0]).collect() == []


def test_query(spark):
    from tastemap.llm import QUERIES

    got = {r.doc_id: r for r in QUERIES["op4_edit_counts"](spark, f"{DATA}/sf0.001").collect()}
    edited = 0
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        masked, n = segments.PRIVATE.subn("<PRIVATE>", r.text)
        x = got[r.doc_id]
        assert (x.n_edits, x.tokens_before, x.tokens_after) == (n, whole(PATHS[0], r.text), whole(PATHS[0], masked))
        edited += n > 0
    assert len(got) and edited
