"""Benchmark decontamination by winnowed fingerprints.

Both sides are cut into words; of each run of ``window`` words the ``K``-gram with
the smallest hash is a fingerprint, so any shared run of ``window`` words shares a
fingerprint. A document's fingerprints are looked up among the benchmark's, and
each hit is extended to the windows around it, which are looked up by their hash and
compared word by word. An item of fewer than ``window`` words has no full run; its
whole word sequence is one window, and is looked up by the hash of that length.

Equal windows of several items are one, with a list of those items, so what a document
costs does not depend on how many items share its passages. Lists of items are only
joined for the documents that hold their windows, a bounded number at a time.

The benchmark side is sent to the tasks in slices of bounded size, and documents
never move: a passage that a third of the documents share costs no more than
others. With one slice, the usual case, a single pass over the documents does all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import WORDS, alnum_words, blocks, keep, mix, ngrams, pieces_of, set_aside, utf8

K = 5
#: Bytes of benchmark text in a slice, about; a longer single item makes its own.
SLICE = 8_000_000
#: Item ids that a batch of results holds, unless one document has more.
LISTED = 200_000
#: Columns that a scan adds.
OWN = ("n_words", "hits", "items")


class Index:
    """The items of one slice: words, fingerprints and short windows."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        self.ids: list[object] = []
        parts = []
        for item, text in items:
            words = alnum_words(text)
            if words:
                self.ids.append(item)
                parts.append(WORDS.of(words))
        sizes = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.owner = owner
        long = sizes >= window
        grams = ngrams(self.words, K)
        at = np.flatnonzero(chosen(grams, window))
        at = at[long[owner[at]] & (owner[at] == owner[at + K - 1])] if len(at) else at
        self.marks = np.unique(grams[at]) if len(at) else grams[:0]
        #: By length, the shorter ones first.
        self.windows: list[Windows] = []
        for n in sorted(set(sizes[~long].tolist())):
            self.windows.append(Windows(self.words, self.starts[sizes == n], n, np.flatnonzero(sizes == n)))
        if long.any():
            first = np.flatnonzero(long[owner] & (np.arange(len(owner)) + window <= self.ends[owner]))
            self.windows.append(Windows(self.words, first, window, owner[first]))


class Windows:
    """The distinct windows of ``n`` words that start at these places, and their items."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, n: int, items: np.ndarray):
        self.n = n
        value, first, number = np.unique(hashed(words, starts, n), return_index=True, return_inverse=True)
        self.value, self.start = value, starts[first]
        pairs = np.unique(np.stack([number.reshape(-1), items]), axis=1)
        #: items[bounds[w] : bounds[w + 1]] have window w.
        self.items = pairs[1]
        self.bounds = np.searchsorted(pairs[0], np.arange(len(value) + 1))

    def find(self, own: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows of ``words`` at ``starts`` are among these; and which.

        ``own``: the words that these windows were made of.
        """
        value = hashed(words, starts, self.n)
        at = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        same = self.value[at] == value
        for i in range(self.n):
            same[same] = words[starts[same] + i] == own[self.start[at[same]] + i]
        return starts[same], at[same]


def hashed(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each of ``starts`` on; equal to that of ``ngrams``."""
    value = mix(words[starts] + np.uint64(n))
    for i in range(1, n):
        value = mix(value ^ words[starts + i])
    return value


def chosen(grams: np.ndarray, window: int) -> np.ndarray:
    """Which n-grams are the smallest of some window; all of equal ones count."""
    width = window - K + 1
    n = len(grams)
    if n < width:  # one partial window
        return np.ones(n, bool)
    least, span = grams, 1
    while span < width:
        step = min(span, width - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    found = np.zeros(n, bool)
    for i in range(width):
        found[i : i + len(least)] |= grams[i : i + len(least)] == least
    return found


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def matches(index: Index, words: np.ndarray, owner: np.ndarray) -> list[tuple[Windows, np.ndarray, np.ndarray]]:
    """Of each kind of windows, the document words where one starts, and which it is.

    ``owner``: nondecreasing number of each word's document.
    """
    found = []
    for windows in index.windows:
        n = windows.n
        if len(words) < n:
            continue
        if n < index.window:
            starts = np.flatnonzero(among(ngrams(words, n), windows.value))
        else:
            grams = ngrams(words, K)
            at = np.flatnonzero(chosen(grams, n))
            at = at[among(grams[at], index.marks)]
            around = np.zeros(len(words) + n, bool)
            for i in range(n - K + 1):
                around[np.maximum(at - i, 0)] = True
            starts = np.flatnonzero(around[: len(words) - n + 1])
        starts = starts[owner[starts] == owner[starts + n - 1]]
        if len(starts):
            found.append((windows, *windows.find(index.words, words, starts)))
    return found


def slices(benchmark: DataFrame, id_column: str, text_column: str, limit: int):
    """The items as lists of (id, text) of about ``limit`` bytes, one after another.

    Items are dealt by a hash of id and text. A slice's size is bounded, so it may
    go to the driver and from there to the tasks.
    """
    items = benchmark.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = blocks(total, limit)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        rows = (items.where(part == k) if n > 1 else items).toArrow()
        yield list(zip(rows["id"].to_pylist(), utf8(rows["text"].combine_chunks())))


def names_of(index: Index, parts: list[np.ndarray]) -> list[str]:
    """The sorted ids of these items, without null."""
    if not parts:
        return []
    seen = np.zeros(len(index.ids), bool)
    for part in parts:
        seen[part] = True
    return sorted({name for i in np.flatnonzero(seen).tolist() if (name := index.ids[i]) is not None})


def scan(docs: DataFrame, items: list[tuple[object, bytes]], window: int) -> DataFrame:
    """The columns of ``docs`` and

    ``n_words``   the text's words
    ``hits``      array of (start, end) word ranges that windows of the items cover,
                  merged and in order
    ``items``     array of the ids whose windows occur, as text, in order

    A null text has no words. Repeated rows stay; items with equal text all count. An
    item without an id makes hits and is left out of ``items``.
    Of clashing names the result's own win. ``items``: one slice.
    """
    carried = [c for c in docs.columns if c not in OWN]
    sent = docs.sparkSession.sparkContext.broadcast(
        [(None if i is None else str(i), t) for i, t in items]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, window)
        for batch in pieces_of(batches, 500):
            words = [WORDS.of(alnum_words(text)) for text in utf8(batch.column("text"))]
            sizes = np.array([len(w) for w in words], np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            found = matches(index, np.concatenate(words), owner)
            ends = np.cumsum(sizes)
            hits: list[list] = [[] for _ in words]
            cover = np.zeros(len(owner) + 1, np.int64)
            held: list[list[np.ndarray]] = [[] for _ in words]
            for windows, at, which in found:
                np.add.at(cover, at, 1)
                np.add.at(cover, at + windows.n, -1)
                # Each window of a document once.
                for doc, w in np.unique(np.stack([owner[at], which]), axis=1).T.tolist():
                    held[doc].append(windows.items[windows.bounds[w] : windows.bounds[w + 1]])
            edge = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            if len(edge):
                # Ranges end where the cover or the document does.
                new = np.ones(len(edge), bool)
                new[1:] = (np.diff(edge) > 1) | (owner[edge[1:]] != owner[edge[:-1]])
                first = edge[new]
                last = edge[np.append(np.flatnonzero(new)[1:] - 1, len(edge) - 1)]
                for a, b in zip(first.tolist(), last.tolist()):
                    doc = owner[a]
                    base = int(ends[doc] - sizes[doc])
                    hits[doc].append({"start": a - base, "end": b + 1 - base})
            items: list[list[str]] = []
            for doc, parts in enumerate(held):
                items.append(names_of(index, parts))
                if doc + 1 == len(held) or sum(map(len, items)) >= LISTED:
                    start = doc + 1 - len(items)
                    part = batch.slice(start, len(items))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(c) for c in carried),
                            pa.array(sizes[start : doc + 1]),
                            pa.array(hits[start : doc + 1], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                            pa.array(items, pa.list_(pa.string())),
                        ],
                        [*carried, *OWN],
                    )
                    items = []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in OWN)
    return docs.select(*carried).mapInArrow(
        run,
        f"{schema}, n_words bigint, hits array<struct<start: bigint, end: bigint>>, "
        "items array<string>",
    )


def merge_ranges(hits):
    """SQL for the union of sorted ranges of several slices, as a column."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        return F.when(F.size(done) == 0, F.array(x)).when(
            x["start"] <= F.try_element_at(done, F.lit(-1))["end"], joined
        ).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(F.flatten(hits)), empty, step)


def report(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "item_id",
    limit: int = SLICE,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    With several slices the hits of a document meet by ``doc_id`` and a hash of its
    text, so repeated rows are counted once each and merged rows multiplied back.
    """
    docs = docs.select("doc_id", "text")
    parts = [scan(docs, items, window) for items in slices(benchmark, id_column, "text", limit)]
    if len(parts) == 1:
        found = parts[0].select("doc_id", "n_words", "hits", "items")
    else:
        union = parts[0].withColumn("slice", F.lit(0))
        for k, part in enumerate(parts[1:], 1):
            union = union.unionByName(part.where(F.size("hits") > 0).withColumn("slice", F.lit(k)))
        key = F.struct(F.octet_length("text"), F.xxhash64("text"), F.sha2("text", 256))
        found = (
            union.select("doc_id", key.alias("key"), "n_words", "hits", "items", "slice")
            .groupBy("doc_id", "key")
            .agg(
                F.max("n_words").alias("n_words"),
                merge_ranges(F.collect_set("hits")).alias("hits"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                F.sum((F.col("slice") == 0).cast("int")).alias("copies"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        )
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "item_id",
    limit: int = SLICE,
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; other rows and all
    columns stay as they are."""
    columns = docs.columns
    docs, names = set_aside(docs, *OWN)
    for k, items in enumerate(slices(benchmark, id_column, "text", limit)):
        # Each slice has its own job, so a task holds the index of one.
        docs = keep(docs, "clean") if k else docs
        docs = scan(docs, items, window).where(F.size("hits") == 0).drop(*OWN)
    return docs.withColumnsRenamed(names).select(*columns)
