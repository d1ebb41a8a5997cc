"""Quality classifier: naive Bayes support vectors on n-gram indicators.

A text's features are indicators of its word n-grams (one and two lower-case
words) and of the n-grams of its words' shapes (one to three), hashed to ``SIZE``
places. A shape writes upper case as X, lower case as x, digits as 9, other signs
as they are, and repeats once. A shape n-gram has one indicator for being there and
one for each power of two that its share of the text reaches, so that a habit of the
whole text is told from a single slip. Nothing else of the row is looked at.

The model is fitted on a sample of about ``SAMPLE`` labelled documents, drawn by a
hash of the id. Their ids and labels are few enough to go to every task, so no text
moves for their sake but their own. Class counts of the features give log-count
ratios, which scale the indicators; the linear hinge-loss model on them is fitted by
dual coordinate descent. Every fifth row of the sample only sets the sigmoid that
turns margins into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import WORDS, keep, mix, pieces_of, utf8

#: Places of the hashed features; 0 is the constant one.
SIZE = 1 << 18
#: Bound of the rows that the hinge-loss model is fitted on.
SAMPLE = 8_000
#: Smallest share of a text's shape n-grams that has an indicator of its own: 2 ** -LEVELS.
LEVELS = 6

_RUN = re.compile(rb"(.)\1+", re.S)
_TO_SHAPE = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c
    for c in range(256)
)


class _Shapes(dict):
    """Number of each word's shape; holds at most ``limit`` words."""

    limit = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_TO_SHAPE))
        value = self[word] = xxhash.xxh64_intdigest(shape, 1)
        return value


_SHAPES = _Shapes()


def _seeded(seed: int) -> np.uint64:
    return np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)


def features(text: bytes) -> np.ndarray:
    """The text's features, each once, in order. An empty text has the constant one."""
    words = text.split()
    found = [np.zeros(1, np.uint64)]
    if words:
        n = len(words)
        w = WORDS.of([word.lower() for word in words])
        s = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, n)
        found.append(mix(w ^ _seeded(1)))
        found.append(mix(mix(w[:-1] ^ _seeded(2)) ^ w[1:]))
        gram = np.zeros(n, np.uint64)
        for k in range(1, min(3, n) + 1):
            gram = mix(gram[: n - k + 1] ^ s[k - 1 :])
            value, count = np.unique(gram, return_counts=True)
            share = count / (n - k + 1)
            found.append(mix(value ^ _seeded(10 * k + LEVELS + 101)))
            for level in range(LEVELS + 1):
                found.append(mix(value[share >= 0.5**level] ^ _seeded(10 * k + level + 100)))
    places = np.concatenate(found[1:]) if len(found) > 1 else found[0][:0]
    places = places % np.uint64(SIZE - 1) + np.uint64(1)
    return np.unique(np.append(places, np.uint64(0))).astype(np.int32)


def log_count_ratio(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the classes' shares of each feature."""
    p, q = positive + 1.0, negative + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[0] = 1.0  # the constant
    return ratio


def dual_coordinate_descent(
    rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 0.1,
    epochs: int = 30, seed: int = 0,
) -> np.ndarray:
    """Weights of the linear hinge-loss model; labels are -1 and 1.

    Both classes weigh the same in sum.
    """
    weights = np.zeros(len(ratio))
    values = [ratio[r] for r in rows]
    norms = np.array([float(v @ v) for v in values])
    share = np.where(labels > 0, max(1, (labels > 0).sum()), max(1, (labels < 0).sum()))
    bound = cost * len(labels) / (2 * share)
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if not norms[i]:
                continue
            gradient = labels[i] * float(weights[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), bound[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]) * norms[i])
                weights[rows[i]] += (new - alpha[i]) * labels[i] * values[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights * ratio


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) with the largest likelihood (Newton)."""
    positive, negative = (labels > 0).sum(), (labels < 0).sum()
    if not positive or not negative:
        return 0.0, float(np.log((positive + 1) / (negative + 1)))
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * w)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Model:
    """Weights per feature and the sigmoid."""

    def __init__(self, weights: np.ndarray, a: float, b: float):
        self.weights, self.a, self.b = weights.astype(np.float32), a, b

    def score(self, text: bytes) -> float:
        margin = float(self.weights[features(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -700, 700))))


def fit_sample(
    rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray
) -> tuple[np.ndarray, float, float]:
    """Weights and sigmoid from the sample's features and labels (-1 and 1)."""
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False  # too few to spare any
    weights = dual_coordinate_descent(
        [r for r, h in zip(rows, held) if not h], labels[~held], ratio
    )
    use = held if held.any() else ~held
    margins = np.array([weights[r].sum() for r, u in zip(rows, use) if u])
    return weights, *sigmoid_fit(margins, labels[use])


def train(labelled: DataFrame) -> Model:
    """Fits on rows with ``doc_id``, ``text`` and ``label`` (0 or 1; others are left out).

    ``labelled`` is a bounded sample, see ``labelled_sample``; its features meet in
    one task. Without rows every score is a half; with one class, that class's
    smoothed share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 500):
            found = [features(text).astype("<i4").tobytes() for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                ["doc_id", "label", "features"],
            )

    def fit(group: pa.Table) -> pa.Table:
        # In an order that does not depend on the tasks that made the rows.
        rows = sorted(
            zip(*(group[c].to_pylist() for c in ("doc_id", "label", "features"))),
            key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1], r[2]),
        )
        places = [np.frombuffer(x, "<i4") for *_, x in rows]
        labels = np.array([2 * label - 1 for _, label, _ in rows])
        count = np.zeros((2, SIZE))
        for x, label in zip(places, labels):
            count[int(label > 0), x] += 1
        weights, a, b = fit_sample(places, labels, log_count_ratio(count[1], count[0]))
        return pa.table({"weights": [weights.astype("<f4").tobytes()], "a": [a], "b": [b]})

    fitted = (
        labelled.where("label IN (0, 1)")
        .select(F.col("doc_id").cast("bigint"), "text", F.col("label").cast("int"))
        .mapInArrow(run, "doc_id bigint, label int, features binary")
        .groupBy()
        .applyInArrow(fit, "weights binary, a double, b double")
        .collect()
    )
    if not fitted:
        return Model(np.zeros(SIZE), 0.0, 0.0)
    return Model(np.frombuffer(fitted[0]["weights"], "<f4"), fitted[0]["a"], fitted[0]["b"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and ``score``; a null text is scored as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 500):
            scores = [sent.value.score(text) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(scores, pa.float64())],
                [*carried, "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score")
    return docs.select(*carried).mapInArrow(run, f"{schema}, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of about ``bound`` labelled documents that are not held out.

    ``held_out``: a condition on ``doc_id`` of ``labels``. Of several labels of one
    document the more frequent counts, of equally frequent ones none; of several
    rows with one id the smallest text. Labels without a document, and labels other
    than 0 and 1, do not count.
    """
    votes = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out)
        .groupBy("doc_id")
        .agg(F.sum(2 * F.col("quality") - 1).alias("vote"))
        .where("vote <> 0")
        .select("doc_id", (F.col("vote") > 0).cast("int").alias("label"))
    )
    votes = keep(votes, "votes")
    share = min(1.0, bound / max(1, votes.count()))
    drawn = votes.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < share * (1 << 30))
    # Bounded by the parameter, whatever the sizes of the tables.
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
