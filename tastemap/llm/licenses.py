"""License scans: winnowed template fingerprints, then banded alignment.

Each template's words are winnowed: of every ``WINDOW`` consecutive ``K``-grams the
one with the smallest hash is kept, so five equal words in a row share one. The
fingerprints of all templates form an inverted index, which is as large as the
templates and goes to every task; documents do not move. Hits of one template
that lie near each other and near one diagonal make a candidate region, which is
aligned with the template word by word in a band around that diagonal, unless it has
too few of the template's words for a match in any order. Of the templates that match
one place, the one that fits it best stands.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tastemap.llm.common import WORDS, alnum_words, ngrams, pieces_of, utf8
from tastemap.llm.notices import TEMPLATES

K, WINDOW = 3, 3
#: Words that the alignment may stray from a region's diagonals.
BAND = 8
#: Of templates of more words, grams that repeat in the template count for nothing,
#: and a diagonal needs ``size // LONG`` hits nearby, lest chance hits widen the band.
LONG = 400
#: Least share of a template's words that a match holds.
COVERAGE = 0.6


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the smallest of each ``WINDOW`` n-grams; equal ones all count."""
    if len(grams) <= WINDOW:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    least = views.min(axis=1)
    found = np.zeros(len(grams), bool)
    for i in range(WINDOW):
        found[i : i + len(least)] |= grams[i : i + len(least)] == least
    return np.flatnonzero(found)


class TemplateIndex:
    """Words of the templates and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [WORDS.of(alnum_words(templates[n].encode())) for n in self.names]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            grams = ngrams(words, K)
            at = winnowed(grams)
            if len(words) > LONG:
                value, count = np.unique(grams, return_counts=True)
                at = at[count[np.searchsorted(value, grams[at])] == 1]
            for p in at.tolist():
                postings[int(grams[p])].append((t, p))
        self.postings = dict(postings)
        self.marks = np.array(sorted(postings), np.uint64)
        #: Each template's distinct words, in order, and how often it has them.
        self.bags = [np.unique(words, return_counts=True) for words in self.words]

    def bound(self, t: int, words: np.ndarray) -> int:
        """Words of the template that ``words`` has in any order: no alignment has more."""
        own, count = self.bags[t]
        if not len(own):
            return 0
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == words], minlength=len(own)), count).sum())

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(template, first and last word of the region, lowest and highest diagonal)."""
        if len(words) < K or not len(self.marks):
            return []
        grams = ngrams(words, K)
        at = winnowed(grams)
        near = np.minimum(np.searchsorted(self.marks, grams[at]), len(self.marks) - 1)
        hits: dict[int, list[int]] = defaultdict(list)
        for p in at[self.marks[near] == grams[at]].tolist():
            for t, q in self.postings[int(grams[p])]:
                hits[t].append(p - q)
        regions = []
        for t, found in hits.items():
            size = len(self.words[t])
            diagonals = np.sort(np.array(found))
            apart = BAND
            if size > LONG:
                near = np.searchsorted(diagonals, diagonals + BAND, "right") - np.searchsorted(diagonals, diagonals - BAND)
                diagonals = diagonals[near >= size // LONG]
                apart = max(BAND, size // 50)
            groups: list[list[int]] = []  # [low, high]
            for diagonal in diagonals.tolist():
                if groups and diagonal - groups[-1][1] <= apart:
                    groups[-1][1] = diagonal
                else:
                    groups.append([diagonal, diagonal])
            for low, high in groups:
                start, end = max(0, low - BAND), min(len(words), high + size + BAND)
                regions.append((t, start, end, low, high))
        return regions


def align(template: np.ndarray, words: np.ndarray, low: int, high: int):
    """Best local alignment with word positions minus template positions in [low, high].

    Equal words count 1, unequal and skipped ones -1. Returns (score, equal words,
    first and end word, first and end template word); of equal scores the one that
    ends first wins.
    """
    width = high - low + 1
    place = np.arange(width)
    # A column of zeros on each side; where a score is positive, the first word, the
    # first template word and the equal words of its alignment.
    score, source = np.zeros(width + 2, np.int64), np.zeros((3, width + 2), np.int64)
    best = (0, 0, 0, 0, 0, 0)
    for i in range(len(template)):
        # Offset d stands for word i + low + d; the row above is one word further left.
        first = i + low
        a, b = max(0, -first), min(width, len(words) - first)
        row, origin = np.zeros(width + 2, np.int64), np.zeros((3, width + 2), np.int64)
        if a < b:
            at = place[a:b]
            same = words[first + a : first + b] == template[i]
            step = score[a + 1 : b + 1] + np.where(same, 1, -1)
            skip = score[a + 2 : b + 2] - 1  # a template word skipped
            old = source[:, a + 1 : b + 1].copy()
            fresh = score[a + 1 : b + 1] == 0
            old[0, fresh], old[1, fresh], old[2, fresh] = first + at[fresh], i, 0
            old[2] += same
            by_skip = skip > step
            value = np.maximum(np.maximum(step, skip), 0)
            old[:, by_skip] = source[:, a + 2 : b + 2][:, by_skip]
            # Words skipped: the value of a cell further left, less the distance.
            reach = np.maximum.accumulate(value + at)
            come = np.maximum.accumulate(np.where(value + at == reach, at - a, 0))
            row[a + 1 : b + 1], origin[:, a + 1 : b + 1] = reach - at, old[:, come]
            top = int(row[a + 1 : b + 1].argmax())
            if row[a + 1 + top] > best[0]:
                word, begin, equal = origin[:, a + 1 + top].tolist()
                best = (int(row[a + 1 + top]), equal, word, first + a + top + 1, begin, i + 1)
        score, source = row, origin
    return best


def find(index: TemplateIndex, words: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(template, equal words, first and end word, first and end template word).

    Of matches that overlap, the one that fits best stands: that with the most equal
    words less the other words of its span and the template's words that it lacks.
    Matches of several templates overlap if they share more than half of the shorter
    one, and all that fit equally well stand.
    """
    found = []
    regions = index.candidates(words)
    while regions:
        t, start, end, low, high = regions.pop()
        least = COVERAGE * len(index.words[t])
        if end - start < least or index.bound(t, words[start:end]) < least:
            continue
        _, equal, a, b, c, d = align(
            index.words[t], words[start:end], low - start - BAND, high - start + BAND
        )
        if equal < least:
            continue
        found.append((t, equal, a + start, b + start, c, d))
        # Notices close to each other share a region: look before and after the match.
        regions += [(t, start, start + a, low, high), (t, start + b, end, low, high)]

    def fit(m) -> int:
        return 3 * m[1] - (m[3] - m[2]) - len(index.words[m[0]])

    kept: list[tuple[int, int, int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-fit(m), m[0], m[2])):
        for o in kept:
            shared = min(m[3], o[3]) - max(m[2], o[2])
            if m[0] == o[0]:
                if shared > 0:
                    break
            elif 2 * shared > min(m[3] - m[2], o[3] - o[2]) and fit(o) > fit(m):
                break
        else:
            kept.append(m)
    return sorted(kept, key=lambda m: (m[0], -m[1], m[2]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each match: doc_id, license, matched, coverage, word_start, word_end,
    template_start, template_end (ends are exclusive; words as in ``alnum_words``).

    Null and empty texts match nothing; repeated rows are reported each. Templates
    of fewer than ``K`` words are never found. Other columns are ignored.
    """
    index_of = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(index_of)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), *[pa.int32()] * 4]
        for batch in pieces_of(batches, 500):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                for t, equal, a, b, c, d in find(index, WORDS.of(alnum_words(text))):
                    rows.append((doc, index.names[t], equal, equal / len(index.words[t]), a, b, c, d))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, SCHEMA)


SCHEMA = (
    "doc_id bigint, license string, matched int, coverage double, "
    "word_start int, word_end int, template_start int, template_end int"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
