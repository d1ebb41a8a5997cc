"""Toxicity: a support vector machine on a gapped subsequence kernel, by Nyström landmarks.

The kernel of two strings sums, over all subsequences of ``LENGTH`` letters that both
hold within ``LENGTH + GAPS`` signs, ``DECAY`` to the power of the two stretches; it is
divided by the strings' norms. Both ends of a string count as letters. Signs that are no
letters are left out, so marks, digits or blanks put into a word change nothing, and a
letter more or less leaves it near its plain form.

A text is judged by its spans: its lower-case words, and runs of three or more words
of one letter each (words that are spelled out). It is as toxic as the most toxic one.
Labels belong to whole texts or sentences, so training looks for the spans that they
are about: all spans that are more frequent in toxic texts than chance allows among so
many, and, of each toxic text without such a span, the one with the largest log ratio
of toxic to other texts, and in a second round the one with the largest margin. Spans
of other texts are the other class: a bounded draw by hash, and in the second round
those of the largest margins.

The landmarks are the spans with the largest ratios and spans drawn from other texts.
Kernel values at the landmarks, made orthonormal by the landmarks' own kernel matrix
(Nyström), are the features of a linear model with squared hinge loss. The model's
value is linear in the kernel's subsequences, too, so in the end all landmarks fold
into one table of a weight for each subsequence, and a span costs the same for any
number of landmarks.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastemap.llm.common import keep, mix, pieces_of
from tastemap.llm.nbsvm import sigmoid_fit

LENGTH, GAPS, DECAY = 4, 2, 0.5
#: Longer spans are looked at in windows of so many signs, half a window apart.
WINDOW = 32
#: Landmarks, half of each kind.
LANDMARKS = 512
#: Spans of texts that are not toxic, of each kind, that a round is fitted on at most.
OTHERS = 15_000
#: Cost of a margin that is missed, over all spans of a class.
COST = 5_000.0
#: Margin of a span that is like no landmark.
UNLIKE = -1.0
#: Margins beyond it, well above the loss's aim of 1, say no more.
MOST = 2.0

_SPELLED = re.compile(r"(?<!\S)[^\w\s]*\w[^\w\s]*(?:\s+[^\w\s]*\w[^\w\s]*){2,}(?!\S)")
#: Both ends of a span; blanks, so that no span holds them itself.
_FIRST, _LAST = "\n", "\r"


def spans(text: str) -> set[str]:
    """The distinct spans of a text, their letters only."""
    text = text.lower()
    found = set()
    for word in set(text.split()).union(_SPELLED.findall(text)):
        if not word.isalpha():
            word = "".join(filter(str.isalpha, word))
        if len(word) <= WINDOW:
            found.add(word)
        else:
            step = WINDOW // 2
            found.update(word[i : i + WINDOW] for i in range(0, len(word) - step, step))
    found.discard("")
    return found


def subsequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, key, weight), each key of a span once, sorted by span. A key is exact for
    letters of the basic plane, 16 bits each; rarer ones share keys."""
    width = max(max(map(len, texts), default=0) + 2, LENGTH + GAPS)
    raw = "".join([(_FIRST + t + _LAST).ljust(width, "\0") for t in texts])
    code = np.frombuffer(raw.encode("utf-32-le"), np.uint32).reshape(len(texts), width)
    code = (code & np.uint32(0xFFFF)).astype(np.uint64)
    rows, keys, weights = [], [], []
    for places in itertools.combinations(range(1, LENGTH + GAPS), LENGTH - 1):
        size = width - places[-1]
        key = code[:, :size]
        for p in places:
            key = key << np.uint64(16) | code[:, p : p + size]
        full = code[:, places[-1] :] != 0  # the span goes on to the last letter
        rows.append(np.nonzero(full)[0])
        keys.append(key[full])
        weights.append(np.full(len(keys[-1]), DECAY ** (places[-1] + 1)))
    row, key, weight = map(np.concatenate, (rows, keys, weights))
    # Repeated subsequences of a span add up.
    both = mix(key) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, number = np.unique(both, return_index=True, return_inverse=True)
    weight = np.bincount(number.reshape(-1), weight, minlength=len(first))
    order = np.argsort(row[first], kind="stable")
    return row[first][order], key[first][order], weight[order]


def norms(n: int, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(row, weight**2, minlength=n), 1e-300))


class Landmarks:
    """The landmarks' subsequences, and the orthonormal features of other spans."""

    def __init__(self, texts: list[str]):
        row, key, weight = subsequences(texts)
        self.keys, place = np.unique(key, return_inverse=True)
        self.table = np.zeros((len(self.keys) + 1, len(texts)))  # the last row: not there
        self.table[place, row] = weight / norms(len(texts), row, weight)[row]
        value, vector = np.linalg.eigh(self.table.T @ self.table)
        good = value > 1e-9 * max(1.0, value[-1] if len(value) else 1.0)
        self.root = vector[:, good] / np.sqrt(value[good])

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.root.shape[1]))
        for start in range(0, len(texts), 500):
            some = texts[start : start + 500]
            row, key, weight = subsequences(some)
            near = np.zeros((len(some), self.table.shape[1]))
            place = _places(self.keys, key)
            hit = place < len(self.keys)
            row_hit, part = row[hit], self.table[place[hit]] * weight[hit, None]
            if len(row_hit):
                starts = np.flatnonzero(np.diff(row_hit, prepend=-1))
                near[row_hit[starts]] = np.add.reduceat(part, starts, axis=0)
            out[start : start + len(some)] = (near / norms(len(some), row, weight)[:, None]) @ self.root
        return out


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``; ``len(keys)`` for none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The w of the least |w|^2 / 2 + sum of cost max(0, 1 - y f)^2 for f = x w + ``UNLIKE``."""
    w = np.zeros(x.shape[1])
    loss = lambda w: w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w + UNLIKE)) ** 2
    for _ in range(50):
        short = 1 - y * (x @ w + UNLIKE)
        on = short > 0
        gradient = w - 2 * x[on].T @ (cost[on] * y[on] * short[on])
        hessian = np.eye(len(w)) + 2 * (x[on].T * cost[on]) @ x[on]
        step, now, size = np.linalg.solve(hessian, gradient), loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * (gradient @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max(initial=0) < 1e-8:
            break
    return w


class Model:
    """A weight for each subsequence, and the sigmoid."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, a: float = 1.0, b: float = 0.0):
        self.keys, self.weights, self.a, self.b = keys, weights, a, b
        self.known: dict[str, float] = {}

    @classmethod
    def folded(cls, landmarks: Landmarks, w: np.ndarray) -> Model:
        return cls(landmarks.keys, np.append((landmarks.table[:-1] @ (landmarks.root @ w)), 0.0))

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        # By length, so that a long span does not widen the others' arrays.
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for start in range(0, len(texts), 5000):
            part = order[start : start + 5000]
            row, key, weight = subsequences([texts[i] for i in part])
            value = np.bincount(row, weight * self.weights[_places(self.keys, key)], minlength=len(part))
            out[part] = value / norms(len(part), row, weight)
        return out + UNLIKE

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """The largest margin of each text's spans; ``UNLIKE`` without spans."""
        each = [spans(t or "") for t in texts]
        if len(self.known) > 300_000:
            self.known.clear()
        new = list({s for found in each for s in found if s not in self.known})
        self.known.update(zip(new, self.margins(new).tolist()))
        return np.array([max(map(self.known.__getitem__, found), default=UNLIKE) for found in each])

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * np.minimum(margins, MOST) + self.b, -700, 700)))


def altered(span: str) -> list[str]:
    """The span with a letter more, at places drawn by a hash."""
    places = [1 + xxhash.xxh64_intdigest(span, seed) % max(1, len(span) - 1) for seed in range(2)]
    return [span[:at] + letter + span[at:] for at in places for letter in (span[at - 1], "x")]


def fit(landmarks: Landmarks, toxic: dict[str, float], others: list[str]) -> Model:
    """A round's model. ``toxic``: spans and how many texts have them, of which the root
    counts, and half as much in altered forms; both classes weigh the same."""
    texts, cost = [], []
    for span, n in toxic.items():
        more = altered(span)
        texts += [span, *more]
        cost += [n**0.5] + [n**0.5 / 2 / len(more)] * len(more)
    y = np.repeat([1.0, -1.0], [len(texts), len(others)])
    share = np.concatenate([np.array(cost) / sum(cost), np.full(len(others), 1 / max(1, len(others)))])
    return Model.folded(landmarks, squared_hinge(landmarks.features(texts + others), y, COST * share))


def _exploded(labelled: DataFrame) -> DataFrame:
    """doc_id, label, held, span of the distinct spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 200):
            found = [sorted(spans(t or "")) for t in batch.column("text").to_pylist()]
            many = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            names = ["doc_id", "label", "held"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(many)) for c in names), pa.array(list(itertools.chain(*found)), pa.string())],
                [*names, "span"],
            )

    held = (F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(5)) == 0).alias("held")
    rows = labelled.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"), held, "text")
    return rows.mapInArrow(run, "doc_id bigint, label int, held boolean, span string")


def _margins(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (span and others) with ``margin``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("margin", pa.array(sent.value.margins(batch.column("span").to_pylist())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, margin double")


def train(labelled: DataFrame) -> Model:
    """Fits on rows with ``doc_id``, ``text`` and ``label`` (0 or 1; others are left out).

    ``labelled`` is a bounded sample (see ``nbsvm.labelled_sample``); one text in five
    only sets the sigmoid. Spans are counted and scored in tasks; what a round is fitted
    on is bounded by the sample's toxic texts, ``OTHERS`` and ``LANDMARKS``. Without
    toxic texts, or without others, every score is the toxic texts' smoothed share.
    """
    labelled = labelled.where("label IN (0, 1)")
    own = keep(_exploded(labelled), "spans")
    sizes = {r["label"]: r["n"] for r in own.where("NOT held").groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    fitted, judged = own.where("NOT held"), own.where("held")
    if len(sizes) < 2:  # too few to spare any
        sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
        fitted = judged = own
    if len(sizes) < 2:
        n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 3)
        return Model(np.zeros(0, np.uint64), np.zeros(1), 0.0, float(np.log(share / (1 - share))))
    counts = fitted.groupBy("span").agg(
        F.sum("label").cast("double").alias("toxic"), F.sum(1 - F.col("label")).cast("double").alias("other")
    )
    ratio = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("other") + 0.5) / (sizes[0] + 1.0))
    # The divergence of the span's share of toxic texts from that of all texts.
    usual = sizes[1] / (sizes[0] + sizes[1])
    part = lambda n, q: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col("toxic") + F.col("other")) / q)).otherwise(0.0)
    counts = counts.withColumn("ratio", ratio).withColumn("more", part("toxic", usual) + part("other", 1 - usual))
    counts = keep(counts, "counts")
    sure = (F.col("ratio") > 0) & (F.col("more") > float(np.log(counts.count() + 1)))
    drawn = F.xxhash64("span", F.lit(6))
    others = counts.where((F.col("other") > 0) & ~sure)
    some = [r["span"] for r in others.orderBy(drawn, "span").limit(OTHERS).collect()]
    leading = counts.where(sure).orderBy(F.desc("more"), "span").limit(OTHERS).collect()
    known = {r["span"]: r["toxic"] for r in leading}
    rest = counts.where(~sure & (F.col("toxic") > 1)).orderBy(F.desc("ratio"), "span").limit(LANDMARKS // 2).collect()
    marks = list(dict.fromkeys([*known, *(r["span"] for r in rest)]))[: LANDMARKS // 2]
    landmarks = Landmarks(list(dict.fromkeys(marks + some[: LANDMARKS // 2])))
    toxic_rows = fitted.where("label = 1").join(counts.select("span", "ratio", sure.alias("sure")), "span")
    toxic_rows = toxic_rows.withColumn("known", F.max("sure").over(W.partitionBy("doc_id"))).where("NOT known")
    toxic_rows = keep(toxic_rows.select("doc_id", "span", "ratio"), "unexplained")

    def most(rows: DataFrame, value: str) -> dict[str, float]:
        """Known spans, and the other toxic texts' of the largest ``value``; and of how
        many texts."""
        place = W.partitionBy("doc_id").orderBy(F.desc(value), "span")
        first = rows.withColumn("place", F.row_number().over(place)).where("place = 1")
        return known | {r["span"]: float(r["count"]) for r in first.groupBy("span").count().orderBy("span").collect()}

    model = fit(landmarks, most(toxic_rows, "ratio"), some)
    hard = _margins(others.select("span"), model).orderBy(F.desc("margin"), "span").limit(OTHERS).collect()
    toxic = most(_margins(toxic_rows, model), "margin")
    model = fit(landmarks, toxic, [s for s in dict.fromkeys([r["span"] for r in hard] + some) if s not in toxic])
    final = _margins(judged, model).groupBy("doc_id", "label").agg(F.max("margin").alias("margin")).collect()
    labels = np.array([2 * r["label"] - 1 for r in final])
    model.a, model.b = sigmoid_fit(np.minimum([r["margin"] for r in final], MOST), labels)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and ``score``, 0 to 1.

    A null text is scored as empty; a text without letters has the score of no evidence.
    Rows may repeat; a column ``score`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 500):
            model = sent.value
            scores = model.scores(model.largest(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(scores, pa.float64())], [*carried, "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score")
    return docs.select(*carried).mapInArrow(run, f"{schema}, score double")
