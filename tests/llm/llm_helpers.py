"""Inputs shared by the tests of the pipeline operators."""

import random
import re

DATA = "/root/testdata"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return SPACE_WORD.findall(lower(text))


def alnum_words(text):
    return ALNUM_WORD.findall(lower(text))


def documents(spark, texts, first=0, source="s"):
    """A documents table; ``texts``: texts, or (doc_id, text) or (doc_id, text, source)."""
    rows = []
    for i, x in enumerate(texts, first):
        doc, text, host = (i, x, source) if not isinstance(x, tuple) else (*x, source)[:3]
        rows.append((doc, text, "en", host, None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCUMENTS)


def clash(df):
    """Adds columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    names = (
        "row", "shard", "length", "hash", "size", "n_words", "hits", "items", "score", "block",
        "part", "line", "host", "count", "piece", "component_id", "offset", "sequence_id",
    )
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def sample_texts(n=60, seed=1, vocabulary=400, longest=300):
    """Invented prose with copies, near copies, blanks, marks and odd white space."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(vocabulary)]
    texts = [None, "", " ", "\n", "x", "  a  b ", "A\tb\r\nc d", "the the the the the the the"]
    while len(texts) < n:
        if texts and r.random() < 0.25:
            base = (r.choice(texts) or "").split(" ")
            if len(base) > 3 and r.random() < 0.7:
                base[r.randrange(len(base))] = r.choice(words)
            texts.append(" ".join(base))
        else:
            some = [r.choice(words) for _ in range(r.randint(1, longest))]
            texts.append(r.choice([" ", " ", "\n", ". "]).join(some).capitalize())
    r.shuffle(texts)
    return texts
