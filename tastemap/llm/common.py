"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Only a local session may leave that setting unset; it gets a folder of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if base is None:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="tastemap-")
        base = _local_folders[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *partitions: str, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back, which cuts the lineage."""
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str, *partitions: str, codec: str | None = None) -> DataFrame:
    """``write`` to a new scratch path."""
    return write(df, scratch(df.sparkSession, name), *partitions, codec=codec)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names renamed, and the names to give them back."""
    held = {n: f"{n} set aside" for n in names if n in df.columns}
    return df.withColumnsRenamed(held), {new: old for old, new in held.items()}


def blocks(rows: int, size: int) -> int:
    """Blocks of about ``size`` rows."""
    return max(1, math.ceil(rows / size))


def crc_fold(column: str, folds: int):
    """crc32 of the column as text, modulo ``folds``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and blanks everything of ASCII but letters and digits.
ALNUM_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32
    for c in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.translate(ASCII_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.translate(ALNUM_LOWER).split()


class WordHashes(dict):
    """64-bit hash of each word; holds at most ``limit`` words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache for each Python worker.
WORDS = WordHashes()

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; shorter by ``n - 1``."""
    size = max(0, len(words) - n + 1)
    value = mix(words[:size] + np.uint64(n))
    for i in range(1, n):
        value = mix(value ^ words[i : i + size])
    return value


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [text or b"" for text in column.cast(kind).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def unit_logs(values: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(values, np.finfo(float).tiny))
