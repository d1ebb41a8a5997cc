"""Sum-of-squares packing of documents into token sequences of one length.

Only documents longer than a sequence are cut. A piece that fills a sequence has
one of its own. The others are dealt into shards by a hash, and each shard places
its pieces, longest first, where the sum over the gaps of (open bins with that
gap) squared becomes smallest; a new bin is one of the choices. Bins that end
(nearly) full are closed. The pieces of the others are dealt into fewer shards and
packed again, until one shard holds what is left, so a shard's last bins cost
little. The open bins are counted by gap, so a placement costs one array
operation of the sequence's length, whatever the number of bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import blocks, keep, pieces_of
from tastemap.llm.tokens import encoder

SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint"
)
#: Pieces of a shard, about. A shard's memory and time are in proportion.
SHARD = 2_000


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each length, offset in it, fill of each bin). Lengths below ``size``.

    Lengths are placed in the given order. Of equal choices the smallest gap wins,
    and of bins with equal gaps the last one opened or changed.
    """
    count = np.zeros(size + 1, np.int64)  # open bins by gap; a gap of 0 is closed
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fill: list[int] = []
    for i, length in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - length changes the sum of squares by
        # 2 (count[g - length] - count[g]) + 2, by 1 - 2 count[g] if it is full then.
        old = count[length:size]
        change = 2 * (count[: size - length] - old) + 2
        change[0] = 1 - 2 * old[0]
        change[old == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if old[best] and change[best] <= 2 * count[size - length] + 1:
            gap = best + length
            b = by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, b = size, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += length
        gap -= length
        if gap:
            count[gap] += 1
            by_gap[gap].append(b)
    return bins, offsets, np.array(fill, np.int64)


def document_pieces(docs: DataFrame, tokenizer: str, end: int, size: int) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of every document's pieces.

    ``row`` tells repeated rows apart. A null text is empty; ``end`` is appended
    to each document. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(tokenizer).encode, np.array([end], "<u4").tobytes()
        for batch in pieces_of(batches, 500):
            rows = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                ids = memoryview(encode(text or "") + stop)
                for k, start in enumerate(range(0, len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc, row, k, start, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), "text"
    ).mapInArrow(
        run, "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = 2048) -> DataFrame:
    """Packs every document; returns a row per piece, as in ``SCHEMA``.

    A sequence holds pieces of at most ``size`` ids together, gapless from offset
    0. An empty table gives no rows; an empty or null text is the end id alone.
    """
    # Written once: the pieces are counted, and packed more than once.
    table = keep(document_pieces(docs, tokenizer, end, size), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Sequences of one full piece have numbers below 0, the others hold the round,
    # the shard and the bin.
    result = table.where(F.col("length") == size).select(
        *columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    rest = table.where(F.col("length") < size)
    turn, left = 0, rest.count()
    while left:
        shards = blocks(left, SHARD)
        packed = keep(_packed(rest, turn, shards, size), "packed")
        result = result.unionByName(packed.where("closed").drop("closed", "row"))
        rest = packed.where("NOT closed").select("row", *columns)
        turn, left = turn + 1, 0 if shards == 1 else rest.count()
    return result


def _packed(pieces: DataFrame, turn: int, shards: int, size: int) -> DataFrame:
    """One round: each shard packs its pieces and closes all but its emptiest bins.

    Those hold an eighth of its pieces at most, so the rounds shrink fast whatever
    the lengths are; the last round has one shard and closes all.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(
            [("length", "descending"), *((c, "ascending") for c in ("doc_id", "row", "piece"))]
        )
        bins, offsets, fill = place(group["length"].to_numpy(), size)
        emptiest = np.argsort(fill, kind="stable")
        held = np.bincount(bins, minlength=len(fill))
        closed = fill >= size - size // 256
        closed[emptiest[np.cumsum(held[emptiest]) > max(SHARD, len(bins)) // 8]] = True
        if shards == 1:
            closed[:] = True
        sequence = (turn << 57) | (group["shard"][0].as_py() << 24) | bins
        for name, column in (("sequence_id", sequence), ("offset", offsets), ("closed", closed[bins])):
            group = group.append_column(name, pa.array(column))
        return group.drop_columns("shard")

    shard = F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(turn)), F.lit(shards))
    return (
        pieces.withColumn("shard", shard)
        .groupBy("shard")
        .applyInArrow(run, "row bigint, closed boolean, " + SCHEMA)
    )
