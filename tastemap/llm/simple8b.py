"""Token files: ids of whole documents in Simple-8b words.

A table of documents is dealt out by ranges of ``doc_id``; each task encodes its
documents in order and writes rows of a Parquet table, so that Spark's commit
protocol covers lost executors and any store Spark can write to will do. A row is
a block:

``shard, block``        its place; rows in this order hold the documents in order
``doc_ids, lengths``    the block's documents and their counts of ids
``words``               Simple-8b words, little-endian, four selector bits on top
``offsets``             first word of each frame of ``FRAME`` ids; says which ids a word holds
``escapes``             ids that no word can hold (60 bits and more), in order

Frames are independent of each other, so all frames of a block are encoded and
decoded side by side with array operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import keep, pieces_of
from tastemap.llm.tokens import encoder

#: Fixed values of the format: (ids in a word, bits of each), by selector.
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
#: All ones in a word of one id: the next value of the escape list.
ESCAPE = (1 << 60) - 1
FRAME = 1024
#: ids of a block, unless one document has more.
BLOCK = 1 << 18

TABLE = (
    "shard int, block int, doc_ids array<bigint>, lengths array<bigint>, "
    "words binary, offsets binary, escapes binary"
)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each frame, escaped values. ``ids``: unsigned."""
    ids = ids.astype(np.uint64)
    large = ids >= np.uint64(ESCAPE)
    escapes = ids[large]
    if len(escapes):
        ids = np.where(large, np.uint64(ESCAPE), ids)
    n = len(ids)
    frames = -(-n // FRAME)
    padded = np.zeros(frames * FRAME, np.uint64)
    padded[:n] = ids
    grid = padded.reshape(frames, FRAME)
    ends = np.full(frames, FRAME, np.int64)
    if frames:
        ends[-1] = n - (frames - 1) * FRAME
    # frexp's exponent is the bit length up to 2**53; larger ids take a whole word.
    width = np.frexp(grid.astype(np.float64))[1].astype(np.int16)
    inside = np.arange(FRAME) < ends[:, None]
    width[~inside] = 99
    best = np.full((frames, FRAME), 15, np.int8)
    widest, span = width, 1
    for selector in range(14, -1, -1):  # rising counts; the last that fits is kept
        count, bits = SELECTORS[selector]
        while span < count:  # widest[i]: of the span ids from i on
            step = min(span, count - span)
            moved = np.full_like(widest, 99)
            moved[:, :-step] = widest[:, step:]
            widest, span = np.maximum(widest, moved), span + step
        best[widest <= bits] = selector
    counts = np.array([c for c, _ in SELECTORS])[best]
    # All frames advance a word at a time.
    at = np.zeros(frames, np.int64)
    steps: list[np.ndarray] = []
    live = np.arange(frames)
    while len(live):
        steps.append(live * FRAME + at[live])
        at[live] += counts[live, at[live]]
        live = live[at[live] < ends[live]]
    starts = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
    selector = best.reshape(-1)[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.flatnonzero(selector == s)):
            for i in range(count):
                words[mine] |= padded[starts[mine] + i] << np.uint64(bits * i)
    offsets = np.searchsorted(starts, np.arange(frames) * FRAME)
    return words, offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block; an error if its frames do not hold as many each.

    All words of all frames at once: the offsets say in which frame a word is, and the
    words before it in the frame where its ids begin.
    """
    offsets = offsets.astype(np.int64)
    frames = -(-n // FRAME)
    if len(offsets) != frames or (frames and (offsets[0] or (np.diff(offsets) <= 0).any() or offsets[-1] >= len(words))):
        raise ValueError("the frames' offsets are damaged")
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selector]
    before = np.cumsum(counts) - counts
    frame = np.repeat(np.arange(frames), np.diff(offsets, append=len(words)))
    starts = frame * FRAME + before - before[offsets][frame]
    if n != counts.sum() or (n and (np.add.reduceat(counts, offsets) != np.minimum(FRAME, n - FRAME * np.arange(frames))).any()):
        raise ValueError("the frames' offsets are damaged")
    ids = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.flatnonzero(selector == s)):
            mask = np.uint64((1 << bits) - 1)
            for i in range(count):
                ids[starts[mine] + i] = (words[mine] >> np.uint64(bits * i)) & mask
    if (large := ids == np.uint64(ESCAPE)).sum() != len(escapes):
        raise ValueError("the escapes are damaged")
    ids[large] = escapes
    return ids


def write_ids(docs: DataFrame, tokenizer: str, end: int, name: str = "simple8b") -> DataFrame:
    """Encodes ``text`` of ``docs`` and writes the token table; returns it, reread.

    Documents stand in ascending ``doc_id``, nulls first, equal ids in the order
    of their texts. ``end`` is appended to each document; a null text is empty.
    Other columns are ignored. ``doc_id`` of another type than whole numbers that fit a
    long is an error.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"doc_id has to be a whole number, not {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        encode_text, stop = encoder(tokenizer).encode, np.array([end], "<u4").tobytes()
        doc_ids: list[int] = []
        parts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            words, offsets, escapes = encode(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                    *(
                        pa.array([x.astype(kind).tobytes()], pa.binary())
                        for x, kind in ((words, "<u8"), (offsets, "<u4"), (escapes, "<u8"))
                    ),
                ],
                ["shard", "block", "doc_ids", "lengths", "words", "offsets", "escapes"],
            )

        for batch in pieces_of(batches, 500):
            for doc, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            ):
                ids = encode_text(text or "") + stop
                if parts and size + len(ids) > 4 * BLOCK:
                    yield row()
                    block, size = block + 1, 0
                    doc_ids, parts = [], []
                doc_ids.append(doc)
                parts.append(ids)
                size += len(ids)
        if parts:
            yield row()

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .select(F.col("doc_id").cast("bigint"), "text")
    )
    return keep(ordered.mapInArrow(run, TABLE), name, codec="zstd")


def read_ids(table: DataFrame) -> DataFrame:
    """Per document of a token table: doc_id, shard, block, start (within the
    block), n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            x = {name: batch.column(name)[0].as_py() for name in batch.schema.names}
            words, offsets, escapes = (
                np.frombuffer(x[c], kind) for c, kind in (("words", "<u8"), ("offsets", "<u4"), ("escapes", "<u8"))
            )
            ids = decode(words, offsets, escapes, sum(x["lengths"]))
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(np.array(x["lengths"], np.int64))
            starts = ends - x["lengths"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x["doc_ids"], pa.int64()),
                    pa.array([x["shard"]] * len(ends), pa.int32()),
                    pa.array([x["block"]] * len(ends), pa.int32()),
                    pa.array(starts),
                    pa.array(x["lengths"], pa.int64()),
                    pa.array(
                        [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()
                    ),
                ],
                ["doc_id", "shard", "block", "start", "n_tokens", "ids_crc32"],
            )

    schema = (
        "doc_id bigint, shard int, block int, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return table.select(
        "shard", "block", "doc_ids", "lengths", "words", "offsets", "escapes"
    ).mapInArrow(run, schema)


def block_starts(table: DataFrame) -> DataFrame:
    """shard, block, before: ids of all earlier blocks.

    Summed within each shard, then over the shards, of which there are as many as
    tasks that wrote.
    """
    from pyspark.sql import Window as W

    sizes = table.select(
        "shard", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")
    )
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.join(shards, "shard")
        .select(
            "shard", "block",
            (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"),
        )
    )


def token_files(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Writes the documents' ids, reads them back, and returns per document
    doc_id, start, n_tokens, ids_crc32.

    An empty table gives no rows; an empty or null text has the end id only.
    """
    table = write_ids(docs, tokenizer, end)
    return (
        read_ids(table)
        .join(block_starts(table), ["shard", "block"])
        .select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
    )
