"""Phrase collocation mining: SON partitioning, exact counts and scores.

The words of a language's texts lie in shards, the runs of rows that one task reads.
Phrases are mined a length at a time. Each shard is mined completely: it counts all
its phrases of the length whose two parts of one word less are frequent, and those
that reach the shard's local support are locally frequent. The union of all shards'
locally frequent phrases is the candidates; their counts are summed over all shards,
those that were below a shard's support included, and are exact.

The local support of a shard with ``m`` of a language's ``n`` words is
``1 + floor((support - 1) * m / n)``. A phrase that misses it in every shard occurs at
most the sum of ``floor((support - 1) * m / n)`` times, which is below ``support``, so
no frequent phrase is lost. A small support over many shards leaves a local support
of 1; then each shard's counts are complete and the union is all that it saw. What
keeps that small is the rule of the parts: a phrase is counted only where both its
parts of one word less are frequent in the whole corpus.

The parts' frequency is looked up in a bitmap of ``BITS`` bits, a bound that holds for
any corpus. Places may collide, which lets a phrase be counted in vain and never
drops one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastemap.llm.common import keep, pieces_of, utf8

#: What ends a piece.
MARKS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z, writes each mark as a full stop and a tab as a blank.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else 46 if c in MARKS else 32 if c == 9 else c for c in range(256)
)
#: Bits of the map of frequent phrases; 8 MB.
BITS = 1 << 26
#: Words of a shard, unless one text has more.
SHARD = 1 << 20
#: Phrases that are written out at a time.
SOME = 50_000
#: Languages whose words are known to the shards; others have a local support of 1.
LANGUAGES = 1000
_SEED = 42  # of Spark's xxhash64

MINED = "lang string, phrase string, n bigint, frequent boolean"


def words_of(text: bytes) -> list[bytes]:
    """The text's words, with a full stop where a piece ends."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


def local_support(support: int, part: int, total: int) -> int:
    """Of a shard with ``part`` of ``total`` words."""
    return 1 + (support - 1) * part // total


def _shift(i: int) -> int:
    """Bits by which the hash of a phrase's ``i``-th word is shifted in its place."""
    return 13 * i % 38


class Bitmap:
    """Places of frequent phrases of one length.

    A place mixes the hashes of the words, so a shard tests all its phrases without
    writing them out.
    """

    def __init__(self, phrases: DataFrame, length: int, bits: int = BITS):
        """``phrases``: lang, phrase; of ``length`` words each."""
        place = F.lit(0).cast("bigint")
        for i in range(length):
            word = F.element_at(F.split("phrase", " "), i + 1)
            place = place.bitwiseXOR(F.shiftrightunsigned(F.xxhash64(F.concat_ws("\t", "lang", word)), _shift(i)))
        rows = (
            phrases.select(place.bitwiseAND(F.lit(bits - 1)).alias("place"))
            .select(F.expr("place >> 6").alias("at"), F.expr("shiftleft(1L, cast(place & 63 AS int))").alias("bit"))
            .groupBy("at")
            .agg(F.bit_or("bit").alias("bit"))
            .toArrow()
        )
        self.bits = np.zeros(bits // 64, np.uint64)
        self.bits[rows["at"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)

    def has(self, hashes: list[np.ndarray]) -> np.ndarray:
        """For phrases of words with these hashes, a list for each place in the phrase."""
        place = np.zeros(len(hashes[0]), np.uint64)
        for i, h in enumerate(hashes):
            place ^= h >> np.uint64(_shift(i))
        place &= np.uint64(64 * len(self.bits) - 1)
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def word_hashes(lang: bytes, words: Iterable[bytes]) -> np.ndarray:
    lead = lang + b"\t"
    return np.array([xxhash.xxh64_intdigest(lead + w, _SEED) for w in words], np.uint64)


class _Numbers(dict):
    """Number of each word of a shard; the full stop that ends a piece is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Shard:
    """A shard's texts of one language."""

    def __init__(self):
        self.numbers, self.texts = _Numbers(), []

    def add(self, text: bytes) -> int:
        words = words_of(text)
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.texts.append(np.zeros(1, np.int32))
        return len(words)

    def texts_at(self, starts: np.ndarray, size: int) -> Iterator[list[bytes]]:
        """The phrases of ``size`` words at these places, some at a time."""
        names = list(self.numbers)
        for i in range(0, len(starts), SOME):
            places = starts[i : i + SOME, None] + np.arange(size)
            yield [b" ".join([names[w] for w in row]) for row in self.words[places].tolist()]

    def phrases(self, lang: bytes, length: int, maps: list[Bitmap]) -> tuple[np.ndarray, np.ndarray]:
        """A place of each phrase of ``length`` words whose parts ``maps`` has, and its
        count."""
        self.words = np.concatenate(self.texts)
        self.texts = []
        good = self.words > 0
        hashes = word_hashes(lang, self.numbers)[self.words] if length > 1 else None
        for size, known in zip(range(1, length), maps):
            n = len(good)
            good &= known.has([hashes[i : i + n] for i in range(size)])
            good = good[:-1] & good[1:]
        start = np.flatnonzero(good)
        number = self.words[start]
        _, first, number, count = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        for i in range(1, length):
            key = number.reshape(-1).astype(np.int64) << 32 | self.words[start + i]
            _, first, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return start[first], count


def mine(
    docs: DataFrame, length: int, maps: list[Bitmap], support: int, totals: dict[str, int], shard: int = SHARD
) -> DataFrame:
    """lang, phrase, n, frequent: each shard's phrases of ``length`` words.

    ``docs``: lang, text. ``maps``: of the frequent phrases of 1 to ``length - 1``
    words. ``totals``: words of each language, as far as known.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((maps, totals))

    def rows(shards: dict[str, Shard]) -> Iterator[pa.RecordBatch]:
        maps, totals = sent.value
        for lang, own in shards.items():
            start, count = own.phrases(lang.encode(), length, maps)
            words = int((own.words > 0).sum())
            least = local_support(support, words, totals[lang]) if lang in totals else 1
            for i, texts in enumerate(own.texts_at(start, length)):
                part = count[i * SOME : (i + 1) * SOME].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part)),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(part),
                        pa.array(part >= least),
                    ],
                    ["lang", "phrase", "n", "frequent"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        size = 0
        for batch in pieces_of(batches, 500):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                if lang not in shards:
                    shards[lang] = Shard()
                size += shards[lang].add(text)
            if size >= shard:
                yield from rows(shards)
                shards, size = {}, 0
        yield from rows(shards)

    return keep(docs.mapInArrow(run, MINED), f"mined-{length}")


def counted(mined: DataFrame, support: int) -> DataFrame:
    """lang, phrase, n: the frequent ones among all locally frequent phrases."""
    often, rest = mined.where("frequent"), mined.where("NOT frequent")
    if not rest.isEmpty():
        candidates = often.select("lang", "phrase").distinct()
        often = often.unionByName(rest.join(candidates, ["lang", "phrase"], "left_semi"))
    return often.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= support)


def _joined(words, start, n):
    return F.array_join(F.slice(words, start, n), " ")


def scored(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, k, l, r, score of all phrases of two words or more, by their
    lowest cut. ``levels``: the frequent phrases of one word, of two, and so on."""
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    phrases = levels[1].withColumn("size", F.lit(2))
    for size, level in enumerate(levels[2:], 3):
        phrases = phrases.unionByName(level.withColumn("size", F.lit(size)))
    words = F.split("phrase", " ")
    cuts = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        _joined(words, F.lit(1), F.col("k")).alias("left"),
        _joined(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    part = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # Decimals: products of counts pass 64 bits.
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")))
    cuts = cuts.withColumn("down", wide("l") * wide("r")).withColumn("score", F.expr("up div down"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("x")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.k", "x.l", "x.r", "x.score")


def contained(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, longer: the largest count of a longer phrase that holds it."""
    found = None
    for size, level in enumerate(levels, 1):
        for inner in range(2, size):
            starts = F.explode(F.sequence(F.lit(1), F.lit(size - inner + 1)))
            parts = level.select("lang", "phrase", "n", starts.alias("at")).select(
                "lang", _joined(F.split("phrase", " "), F.col("at"), F.lit(inner)).alias("phrase"), "n"
            )
            found = parts if found is None else found.unionByName(parts)
    return found and found.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    docs: DataFrame,
    support: int = 10,
    longest: int = 3,
    top: int = 2000,
    covered: int = 50,
    shard: int = SHARD,
    bits: int = BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to
    ``longest`` words.

    ``docs``: ``lang`` and ``text``; other columns are ignored. A null text is empty, a
    null language is ``und``. Repeated rows count each. ``a``: occurrences of the
    phrase within pieces, ``support`` at least; ``l`` and ``r``: of its parts at the cut
    of the lowest score, ``n``: words of the language; ``score``: floor of
    1000000 a a / (l r). Phrases within a longer frequent one that has ``covered`` per
    cent of their count are left out. Ties of scores go to the larger ``a``, then by
    bytes. An empty table gives no rows.
    """
    if longest < 2 or support < 1:
        raise ValueError("phrases have two words at least, and a support of one")
    docs = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    mined = mine(docs, 1, [], support, {}, shard)
    totals = keep(mined.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    known = {r["lang"]: r["n"] for r in totals.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    levels, maps = [keep(counted(mined, support), "phrases-1")], []
    for length in range(2, longest + 1):
        maps.append(Bitmap(levels[-1], length - 1, bits))
        mined = mine(docs, length, maps, support, known, shard)
        levels.append(keep(counted(mined, support), f"phrases-{length}"))
    found = scored(levels)
    longer = contained(levels)
    if longer is not None:
        found = found.join(longer, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
        )
    # First within slices of a language, so that no task sorts all of a large one's.
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    near = found.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    near = near.where(F.col("rank") <= top).drop("rank", "part")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents
    ), words AS (
        SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
    ), f AS (
        SELECT lang, m, phrase, count(*) AS f FROM (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2),
                   lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
            FROM words, (VALUES (1), (2), (3)) AS sizes(m) WHERE len(w) >= m
        ) GROUP BY ALL
    ), totals AS (
        SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
    ), candidates AS (
        SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 10
    ), cuts AS (
        SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r,
               CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')
    ), lowest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), longer AS (
        SELECT lang, part, max(a) AS longer FROM (
            SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part
            FROM candidates WHERE m = 3
        ) GROUP BY ALL
    ), ranked AS (
        SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND part = phrase
        WHERE longer IS NULL OR 100 * longer < 50 * a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
