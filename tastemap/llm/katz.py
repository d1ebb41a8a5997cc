"""Katz backoff language model: bigrams, unigrams, and one unknown word.

    p(w | h) = d(c) c / c(h)             if the bigram was seen c times,
               alpha(h) p(w)             otherwise,
    p(w)     = d(c) c / N                if the word was seen c times,
               what the others leave     for the unknown word.

d is the Good-Turing discount of counts up to ``K``. alpha(h) is the mass that the
seen successors of h leave, divided by the mass that p gives all others, so each
distribution sums to one over the seen words and the unknown one. Where no count
of a history is discounted, its total is raised by one to leave some mass.

How it is spread out:

1. Documents become blocks of about ``BLOCK`` tokens in words of their own
   (a table, so that a block is the same whenever it is read).
2. Blocks' words are counted; words get numbers by falling count. A word's count
   follows from its number and the counts of counts, of which there are at most
   sqrt(2 N); those go to every task. Each block gets its words' numbers.
3. A block asks, once for each of its bigrams, the part that has its history. A part
   adds up the training counts, writes its share of the model, one row of counts,
   and answers each block in the order it asked. Histories of many tokens are split
   over all parts by their successors, and their sums are added up afterwards.
4. Blocks score their documents from the answers, level by level.

A block asks once for a bigram however often it holds it, so neither a frequent
bigram nor copies of a document load one task.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.llm.common import WORDS, blocks, discard, mix, pieces_of, scratch, space_words, unit_logs, utf8, write

#: Counts up to K are discounted.
K = 5
#: Tokens of a block and of a part, about.
BLOCK, PART = 1_000_000, 1_000_000
#: Stands for the end of a text among the words, none of which it can equal.
END = b" end"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte position, compressed."""
    values = np.ascontiguousarray(values, "<i8")
    planes = values.view(np.uint8).reshape(len(values), 8).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1)


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0..K) from counts of counts (index: count, K + 1 at least).

    Good-Turing after Katz. Where the counts of counts do not allow it, the share
    that one constant taken from each count leaves.
    """
    n = np.asarray(counts, float)
    out = np.ones(K + 1)
    excess = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    constant = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    for r in range(1, K + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - excess) / (1 - excess) if n[r] and excess < 1 else 0.0
        out[r] = turing if 0 < turing < 1 else (r - min(constant, 0.9)) / r
    return out


def totals(by_count: np.ndarray, large: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, mass left) of distributions.

    ``by_count``: how many items have the counts 0..K (last axis); ``large``: sum of
    the counts above K.
    """
    r = np.arange(K + 1)
    total = by_count @ r + large
    mass = by_count @ (r * (1 - d))
    none = mass <= 1e-12 * total
    return total + none, np.where(none, 1.0, mass)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count <= K, d[np.minimum(count, K)], 1.0) * count


class Unigrams:
    """Numbers, counts and probabilities of words; words are numbered by falling count."""

    def __init__(self, classes: list[tuple[int, int]]):
        """``classes``: (count, words with it)."""
        classes = sorted(classes, reverse=True)
        self.counts = np.array([c for c, _ in classes] + [0], np.int64)
        sizes = np.array([n for _, n in classes], np.int64)
        self.ends = np.cumsum(sizes)
        self.size = int(sizes.sum())
        self.tokens = int((self.counts[:-1] * sizes).sum())
        n = np.zeros(K + 2)
        for c, k in classes:
            if c <= K + 1:
                n[c] += k
        self.d = discounts(n)
        large = float(sum(c * k for c, k in classes if c > K))
        total, mass = totals(n[: K + 1], np.array(large), self.d)
        self.total, self.unknown = float(total), float(mass / total)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """The unknown word, ``size``, has count 0."""
        return self.counts[np.searchsorted(self.ends, ids, side="right")]

    def probability(self, ids: np.ndarray) -> np.ndarray:
        count = self.count(ids)
        return np.where(count > 0, discounted(count, self.d) / self.total, self.unknown)


BLOCKS = (
    "block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, "
    "tokens binary, words binary"
)


def tokenised(docs: DataFrame, held_out) -> DataFrame:
    """Blocks: documents, their tokens in the block's own words, the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        own: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        rows: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            doc_ids, held, lengths = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([held], pa.list_(pa.bool_())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([pack(np.concatenate(parts))], pa.binary()),
                    pa.array([WORDS.of(list(own)).tobytes()], pa.binary()),
                ],
                ["block", "doc_ids", "held", "lengths", "tokens", "words"],
            )

        for batch in pieces_of(batches, 500):
            for doc, text, held in zip(
                batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("held").to_pylist()
            ):
                words = space_words(text)
                words.append(END)
                parts.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int32, len(words)))
                rows.append((doc, held, len(words)))
                size += len(words)
            if size >= BLOCK:
                yield row()
                number, size, own, parts, rows = number + 1, 0, {}, [], []
        if rows:
            yield row()

    picked = docs.select(F.col("doc_id").cast("bigint"), "text", held_out.alias("held"))
    return picked.mapInArrow(run, BLOCKS)


def training(lengths: list[int], held: list[bool]) -> np.ndarray:
    return np.repeat(~np.array(held, bool), lengths)


def word_counts(table: DataFrame) -> DataFrame:
    """hash, block, n (in the training documents) of each block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            block, held, lengths, tokens, words = (batch.column(c)[0].as_py() for c in batch.schema.names)
            hashes = np.frombuffer(words, np.int64)
            n = np.bincount(unpack(tokens)[training(lengths, held)], minlength=len(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(np.full(len(n), block)), pa.array(n)], ["hash", "block", "n"]
            )

    return table.select("block", "held", "lengths", "tokens", "words").mapInArrow(
        run, "hash bigint, block bigint, n bigint"
    )


def numbered(counts: DataFrame, path: str) -> tuple[DataFrame, Unigrams]:
    """(hash, id of each training word; the unigrams). ids fall with the count."""
    spark = counts.sparkSession
    words = counts.where("n > 0").groupBy("hash").agg(F.sum("n").alias("c"))
    # The written order is fixed, so a row's place in its file is, too.
    place = F.monotonically_increasing_id()
    words = write(
        words.orderBy(F.desc("c"), "hash").select(
            "hash", "c", F.shiftright(place, 33).cast("int").alias("file"), place.bitwiseAND((1 << 33) - 1).alias("place")
        ),
        path,
    )
    classes = words.groupBy("c").count().collect()  # sqrt(2 N) rows at most
    files = sorted(words.groupBy("file").count().collect())  # one row per task
    before, rows = 0, []
    for file, n in files:
        rows.append((file, before))
        before += n
    starts = spark.createDataFrame(rows, "file int, start bigint")
    ids = words.join(F.broadcast(starts), "file").select("hash", (F.col("start") + F.col("place")).alias("id"))
    return ids, Unigrams([tuple(r) for r in classes])


def encoded(table: DataFrame, answers: DataFrame, unknown: int) -> DataFrame:
    """The blocks with ``ids``, the numbers of their words, in place of hashes."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        names = ["block", "doc_ids", "held", "lengths", "tokens"]
        if not block.num_rows:
            return block.select([*names, "words"]).rename_columns([*names, "ids"])
        hashes = np.frombuffer(block["words"][0].as_py(), np.int64)
        order = np.argsort(hashes)
        ids = np.full(len(hashes), unknown, np.int64)
        ids[order[np.searchsorted(hashes, found["hash"].to_numpy(), sorter=order)]] = found["id"].to_numpy()
        return block.select(names).append_column("ids", pa.array([pack(ids)], pa.binary()))

    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, BLOCKS.replace("words", "ids"))


class Bigrams:
    """The distinct bigrams of a block whose history was seen, by history and successor.

    The unknown word is a successor, too; its count is 0, but its history's weight
    is asked for.
    """

    def __init__(self, tokens: bytes, ids: bytes, lengths: list[int], unigrams: Unigrams, parts: int):
        own, numbers = unpack(tokens), unpack(ids)
        unknown = unigrams.size
        numbers = np.append(numbers, unknown + 1)  # the start of a text, as a history
        self.words = numbers[own]
        history = np.empty_like(own)
        history[1:] = own[:-1]
        lengths = np.array(lengths, np.int64)
        history[np.cumsum(lengths) - lengths] = len(numbers) - 1
        self.asked = numbers[history] != unknown
        pair, self.at = np.unique(history[self.asked] * len(numbers) + own[self.asked], return_inverse=True)
        h, w = numbers[pair // len(numbers)], numbers[pair % len(numbers)]
        order = np.lexsort((w, h))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.at, self.h, self.w = rank[self.at], h[order], w[order]
        # Histories of many tokens are dealt out by their successors.
        self.hot = hot(self.h, unigrams)
        key = mix(self.h.astype(np.uint64))
        key = np.where(self.hot, mix(key ^ mix(self.w.astype(np.uint64))), key)
        self.part = (key % np.uint64(parts)).astype(np.int64)

    def by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        """(part, its bigrams in order)."""
        order = np.argsort(self.part, kind="stable")
        ends = np.flatnonzero(np.diff(self.part[order])) + 1
        for at in np.split(order, ends) if len(order) else ():
            yield int(self.part[at[0]]), at


def hot(h: np.ndarray, unigrams: Unigrams) -> np.ndarray:
    """Histories of more than a quarter of ``PART`` tokens; the start of texts is one.

    There are at most 4 N / PART + 1 of them.
    """
    return (unigrams.count(np.minimum(h, unigrams.size)) > PART // 4) | (h > unigrams.size)


def runs(h: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)


def pack_pairs(h: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted pairs: histories, successors of each, successors; as differences."""
    first = runs(h)
    step = np.diff(w, prepend=0)
    step[first] = w[first]
    return pack(np.diff(h[first], prepend=0)), pack(np.diff(np.append(first, len(h)))), pack(step)


def unpack_pairs(h: bytes, sizes: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, sizes, w = np.cumsum(unpack(h)), unpack(sizes), unpack(w)
    total = np.cumsum(w)
    first = np.cumsum(sizes) - sizes
    return np.repeat(h, sizes), total - np.repeat(total[first] - w[first], sizes)


ASKED = "part bigint, block bigint, h binary, sizes binary, w binary, n binary"


def questions(table: DataFrame, unigrams: Unigrams, parts: int) -> DataFrame:
    """What the blocks ask the parts: bigrams with their counts in training documents."""
    sent = table.sparkSession.sparkContext.broadcast(unigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            block, held, lengths, tokens, ids = (batch.column(c)[0].as_py() for c in batch.schema.names)
            found = Bigrams(tokens, ids, lengths, sent.value, parts)
            n = np.bincount(found.at[training(lengths, held)[found.asked]], minlength=len(found.h))
            rows = [(p, block, *pack_pairs(found.h[at], found.w[at]), pack(n[at])) for p, at in found.by_part()]
            if rows:
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["part", "block", "h", "sizes", "w", "n"],
                )

    return table.select("block", "held", "lengths", "tokens", "ids").mapInArrow(run, ASKED)


#: Rows of a part: its share of the model (block null), an answer to each block.
#: ``stats``: for each history n(1..K), the sum of the counts above K, and the mass
#: of p of its successors (as text of a float array).
MODEL = "part bigint, kind string, block bigint, h binary, sizes binary, w binary, n binary, stats binary, lower binary, seen array<bigint>"


def counted(asked: DataFrame, unigrams: Unigrams) -> DataFrame:
    """Each part's share of the model and its answers."""
    sent = asked.sparkSession.sparkContext.broadcast(unigrams)

    def run(group: pa.Table) -> pa.Table:
        columns = [group[c].to_pylist() for c in ("block", "h", "sizes", "w", "n")]
        pairs = [unpack_pairs(*raw) for raw in zip(*columns[1:4])]
        sizes = [len(h) for h, _ in pairs]
        h, w = (np.concatenate(x) for x in zip(*pairs))
        n = np.concatenate([unpack(raw) for raw in columns[4]])
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
        first = np.flatnonzero(new)
        c = np.add.reduceat(n[order], first)
        answer = np.empty(len(n), np.int64)
        answer[order] = c[np.cumsum(new) - 1]
        # Statistics of each history over its seen successors.
        h, w = h[first], w[first]
        seen = c > 0
        lower = np.where(seen, sent.value.probability(w), 0.0)
        start = runs(h)
        stats = np.stack(
            [np.add.reduceat((c == r).astype(np.int64), start) for r in range(1, K + 1)]
            + [np.add.reduceat(np.where(c > K, c, 0), start)]
        )
        mass = np.add.reduceat(lower, start)
        known = h[start]
        split = hot(known, sent.value)
        part = group["part"][0].as_py()
        of_counts = np.bincount(np.minimum(c[seen], K + 2), minlength=K + 3)[: K + 2].tolist()
        rows = [(part, "model", None, *pack_pairs(h[seen], w[seen]), pack(c[seen]), None, None, of_counts)]
        rows.append((
            part, "split", None, pack(known[split]), None, None, None,
            pack(stats[:, split].reshape(-1)), mass[split].tobytes(), None,
        ))
        end = 0
        for block, size, (asked_h, _) in zip(columns[0], sizes, pairs):
            mine = asked_h[runs(asked_h)]
            at = np.searchsorted(known, mine[~hot(mine, sent.value)])
            rows.append((
                part, "answer", block, None, None, None, pack(answer[end : end + size]),
                pack(stats[:, at].reshape(-1)), mass[at].tobytes(), None,
            ))
            end += size
        kinds = (
            pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())
        )
        names = [f.split()[0] for f in MODEL.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return asked.groupBy("part").applyInArrow(run, MODEL)


class Histories:
    """log10 of denominator and backoff weight from the statistics of histories."""

    def __init__(self, stats: np.ndarray, mass: np.ndarray, d: np.ndarray):
        by_count = np.concatenate([np.zeros((1, stats.shape[1])), stats[:K]]).T
        total, left = totals(by_count, stats[K], d)
        known = by_count.sum(axis=1) + stats[K] > 0
        self.total = np.where(known, total, 1.0)
        alpha = (left / self.total) / np.maximum(1 - mass, np.finfo(float).tiny)
        self.alpha = np.where(known, alpha, 1.0)


def split_histories(model: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """Statistics of the histories that were split: at most 4 N / PART + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, stats, lower in zip(*(batch.column(c).to_pylist() for c in ("h", "stats", "lower"))):
                h = unpack(h)
                columns = [*unpack(stats).reshape(K + 1, len(h)), np.frombuffer(lower)]
                yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(c) for c in columns)], names)

    names = ["h", *(f"s{i}" for i in range(K + 1)), "mass"]
    schema = ", ".join(["h bigint", *(f"s{i} bigint" for i in range(K + 1)), "mass double"])
    rows = model.where("kind = 'split'").select("h", "stats", "lower").mapInArrow(run, schema)
    sums = rows.groupBy("h").agg(*(F.sum(c).alias(c) for c in names[1:])).collect()
    return {r.h: (np.array([r[f"s{i}"] for i in range(K + 1)]), r.mass) for r in sums}


SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def scored(
    table: DataFrame, answers: DataFrame, unigrams: Unigrams, d: np.ndarray,
    split: dict[int, tuple[np.ndarray, float]], parts: int,
) -> DataFrame:
    """Scores of the blocks' documents."""
    sent = table.sparkSession.sparkContext.broadcast((unigrams, split))

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SCHEMA_FIELDS]
        if not block.num_rows:
            return pa.table([pa.array([], k) for k in SCORE_KINDS], names)
        doc_ids, held, lengths, tokens, ids = (
            block[c][0].as_py() for c in ("doc_ids", "held", "lengths", "tokens", "ids")
        )
        unigrams, split = sent.value
        own = Bigrams(tokens, ids, lengths, unigrams, parts)
        c = np.zeros(len(own.h), np.int64)
        start = runs(own.h)
        # Statistics per distinct history of the block; hot ones come from all parts.
        stats = np.zeros((K + 1, len(start)), np.int64)
        mass = np.zeros(len(start))
        distinct = own.h[start]
        for i in np.flatnonzero(hot(distinct, unigrams)).tolist():
            stats[:, i], mass[i] = split.get(int(distinct[i]), (0, 0.0))
        replies = {p: i for i, p in enumerate(found["part"].to_pylist())}
        for p, at in own.by_part():
            reply = {k: found[k][replies[p]].as_py() for k in ("n", "stats", "lower")}
            c[at] = unpack(reply["n"])
            mine = own.h[at][runs(own.h[at])]
            mine = np.searchsorted(distinct, mine[~hot(mine, unigrams)])
            stats[:, mine] = unpack(reply["stats"]).reshape(K + 1, len(mine))
            mass[mine] = np.frombuffer(reply["lower"])
        histories = Histories(stats, mass, d)
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(own.h))))
        # Level by level: the unknown word or the unigram, then the bigram above it. A
        # history that was not seen, or not in training, leaves the level below as it is.
        probability = unigrams.probability(own.words)
        asked = np.flatnonzero(own.asked)
        above = discounted(c, d) / histories.total[of]
        probability[asked] = np.where(
            c[own.at] > 0, above[own.at], histories.alpha[of][own.at] * probability[asked]
        )
        lengths = np.array(lengths, np.int64)
        first = np.cumsum(lengths) - lengths
        count = unigrams.count(own.words)
        base = unit_logs((count + 0.1) / (unigrams.tokens + 0.1 * (unigrams.size + 1)))
        columns = [
            doc_ids, held, lengths,
            np.add.reduceat((count > 0).astype(np.int64), first),
            np.full(len(lengths), unigrams.tokens),
            np.add.reduceat(base, first),
            np.add.reduceat(unit_logs(probability), first),
        ]
        return pa.table([pa.array(x, k) for x, k in zip(columns, SCORE_KINDS)], names)

    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)


SCHEMA_FIELDS = SCORES.split(", ")
SCORE_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of tables no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def score(docs: DataFrame, held_out, model_path: str | None = None) -> DataFrame:
    """Learns from the rows of ``docs`` for which ``held_out`` is false, and scores all.

    ``held_out``: a boolean column. A null text is empty; it has the end token alone.
    Repeated rows count, and are scored, each. Without training rows every token is
    unknown, with probability one. Other columns are ignored. ``model_path``: where
    the model is written (a new place in the shared folder if not given), a table
    partitioned by ``kind``; rows of kind ``model`` are the bigrams with counts.
    """
    spark = docs.sparkSession
    first, words = scratch(spark, "tokens"), scratch(spark, "words")
    table = write(tokenised(docs, held_out), first, codec="zstd")
    counts = word_counts(table)
    ids, unigrams = numbered(counts, words)
    answers = counts.select("hash", "block").join(ids, "hash").select("block", "hash", "id")
    second = scratch(spark, "blocks")
    ready = write(encoded(table, answers, unigrams.size), second, codec="zstd")
    del table, counts, ids, answers
    discard(spark, first)
    discard(spark, words)
    release(spark)
    tokens = ready.select(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
    parts = blocks(tokens, PART)
    path = model_path or scratch(spark, "katz")
    model = write(counted(questions(ready, unigrams, parts), unigrams), path, "kind", codec="zstd")
    release(spark)
    # K + 2 numbers.
    sums = model.where("kind = 'model'").select(*(F.sum(F.col("seen")[i]).alias(f"n{i}") for i in range(K + 2))).first()
    d = discounts(np.array([x or 0 for x in sums], float))
    found = model.where("kind = 'answer'").select("block", "part", "n", "stats", "lower")
    return scored(ready, found, unigrams, d, split_histories(model), parts)
