"""op6 against an alignment without bands or fingerprints."""

import random

from llm_helpers import DATA, alnum_words, clash, documents

from tastemap.llm import licenses
from tastemap.llm.common import WORDS, alnum_words as fast_words

WORD = ["lorem", "ipsum", "software", "license", "the", "of", "granted", "public", "x1"]


def brute(template, words):
    """Best score of any local alignment."""
    above, best = [0] * (len(words) + 1), 0
    for t in template:
        row = [0]
        for j, w in enumerate(words):
            row.append(max(0, above[j] + (1 if t == w else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, max(row)), row
    return best


def hashes(words):
    return WORDS.of([w.encode() for w in words])


def test_words_agree():
    text = "A-b_C\x00d é ÀB 1.2"
    assert [w.decode() for w in fast_words(text.encode())] == alnum_words(text)


def test_alignment_in_a_full_band_is_the_best():
    r = random.Random(2)
    for _ in range(150):
        a = [r.choice("abcd") for _ in range(r.randint(1, 12))]
        b = [r.choice("abcd") for _ in range(r.randint(1, 15))]
        score, equal, i, j, k, m = licenses.align(hashes(a), hashes(b), -len(a), len(b))
        assert score == brute(a, b)
        if score:
            assert brute(a[k:m], b[i:j]) == score and 0 < equal <= min(m - k, j - i)


def test_planted_notices_are_found_with_their_spans():
    r = random.Random(3)
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        notice = alnum_words(text)
        for changes in (0, len(notice) // 20):
            changed = list(notice)
            for _ in range(changes):
                at = r.randrange(len(changed))
                changed[at : at + 1] = r.choice([[], ["other"], [changed[at], "more"]])
            before, after = ([r.choice(WORD) for _ in range(r.randint(0, 40))] for _ in range(2))
            words = before + changed + after
            found = {index.names[m[0]]: m for m in licenses.find(index, hashes(words))}
            assert name in found, (name, changes)
            _, equal, start, end, first, last = found[name]
            assert equal >= len(notice) - 2 * changes
            assert abs(start - len(before)) <= 2 + changes and abs(end - len(before) - len(changed)) <= 2 + changes
            if not changes:
                assert (equal, last - first) == (len(notice),) * 2


def test_plain_text_has_no_match():
    r = random.Random(4)
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for _ in range(50):
        assert licenses.find(index, hashes([r.choice(WORD) for _ in range(300)])) == []


def test_scan(spark):
    notice = "RELEASED under the\nMIT license!"
    texts = [None, "", "x", notice, notice, f"{'a b ' * 9}{notice} {notice}", "word " * 40_000 + notice, "Released under"]
    got = licenses.scan(clash(documents(spark, texts))).collect()
    spans = sorted((r.doc_id, r.word_start, r.word_end) for r in got if r.license == "MIT" and r.coverage == 1.0)
    assert spans == [(3, 0, 5), (4, 0, 5), (5, 18, 23), (5, 23, 28), (6, 40_000, 40_005)]
    assert licenses.scan(documents(spark, [])).collect() == []
    assert licenses.scan(documents(spark, [notice]), {}).collect() == []


def test_query_finds_every_whole_notice(spark):
    from tastemap.llm import QUERIES

    got = QUERIES["op6_licenses"](spark, f"{DATA}/sf0.001").collect()
    found = {(r.doc_id, r.license) for r in got if r.coverage == 1.0}
    expected = set()
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        text = f" {' '.join(alnum_words(r.text))} "
        expected |= {(r.doc_id, n) for n, t in licenses.TEMPLATES.items() if f" {' '.join(alnum_words(t))} " in text}
    assert expected and found == expected
    assert all(0.6 <= r.coverage <= 1 and r.word_start < r.word_end for r in got)


def names_in(text, index=licenses.TemplateIndex(licenses.TEMPLATES)):
    return {index.names[m[0]]: m[1] / len(index.words[m[0]]) for m in licenses.find(index, hashes(alnum_words(text)))}


def test_sibling_licenses_are_told_apart():
    start = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for name, values in {
        "GPL-2.0-header": ("program", "General Public License", "2"),
        "GPL-3.0-header": ("program", "General Public License", "3"),
        "LGPL-2.1-header": ("library", "Lesser General Public License", "2.1"),
        "AGPL-3.0-header": ("program", "Affero General Public License", "3"),
    }.items():
        assert names_in(f"x y {start.format(*values)} z") == {name: 1.0}
    work = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    assert names_in(work.format("")) == {"CC-BY-4.0": 1.0}
    assert names_in(work.format("-ShareAlike")) == {"CC-BY-SA-4.0-notice": 1.0}
    assert names_in("Licensed under CC BY-NC-SA 4.0.") == {"CC-BY-NC-SA-4.0-short": 1.0}
    for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-1.1", "GPL-2.0"):
        assert names_in(licenses.TEMPLATES[f"{name}-text"]) == {f"{name}-text": 1.0}


def test_a_text_without_its_warranty_is_still_found():
    for name in ("MIT-grant", "ISC-grant", "BSD-grant"):
        assert names_in(licenses.TEMPLATES[name]).get(name) == 1.0


def test_neighbours_both_stand():
    assert names_in("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == {
        "MIT": 1.0, "Apache-2.0": 1.0,
    }
