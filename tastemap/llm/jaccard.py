"""N-gram Jaccard join: exact, size-aware (light and heavy sets).

A text's set holds its distinct ``SHINGLE``-word shingles. Equal sets are one vertex,
known by a hash of the set, so copies cost nothing after the first pass. All sets
are read in one global order of shingles; any order gives the same result. Shingles
that a sample finds frequent come last, so they rarely take part.

Linked sets a and b share at least ``p (a + b) / (100 + p)`` shingles, which is
``p`` per cent of the larger, so each has one of its first ``n / 4 + 1`` in common
with the other (for p = 75). From that:

heavy sets (more than ``boundary`` shingles) post each of these shingles, and the
  inverted lists are scanned for sets that meet there;
light sets enumerate all subsets of two of one shingle more: a linked light pair
  has two of those in common, so it meets under a whole subset;
light sets that are large enough to link with a heavy one post to the lists, too.

``boundary`` is the size (64 at most) up to which a set has no more subsets than postings and
expected meetings in the lists together, as measured on the sample.

Lists fall apart where sizes and places in the order leave no pair of a smaller and a
larger member, and lists of one set go. In the others, sets are compared in rounds:
some hubs of each list with all that are not in their components; then the hubs leave
the list, components are found anew, and lists of one component go, so that a large
group of near copies costs about a comparison for each member.

Lists that are still open after the hubs of ``ROUNDS`` are keyed anew, by what sets apart
rather than by what they share. For any set h, the symmetric differences D = A ^ h have
A ^ B = D(A) ^ D(B), so sets are linked where their differences share enough. The
lists of one hub are a cluster, and its h holds what most of some of its members have.
Members whose differences are small enough together are linked for certain, without a
comparison; every other pair has to share a shingle of D(A) and D(B), so each member
posts the first shingles of its difference, as many as its best possible partner in
the cluster asks for. The new lists are compared in rounds again, and so on until no
list is open. No list is compared pair by pair, and no pair is left out: h may be any
set, it only steers the work.

A comparison first takes the sets' sketches, of two bits for each shingle: a bit is
the parity of the shingles in its bucket, so each bit that differs stands for one
shingle that is not in common, and the bound on the overlap is exact. Whole sets are
fetched for the pairs that pass.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastemap.llm.common import WORDS, blocks, discard, keep, mix, ngrams, pieces_of, scratch, space_words, utf8, write

SHINGLE = 5
PERCENT = 75
#: One document in so many is looked at for the order of shingles and the boundary.
SAMPLED = 8
#: Shingles that are ordered by their frequency in the sample, at most.
FREQUENT = 200_000
#: Hubs of each list in the rounds before lists are keyed anew.
ROUNDS = (1, 8, 8)
#: Members of a cluster whose common shingles are its h.
CORE = 16
#: Parts that the rows of one component are joined in.
PARTS = 16
#: Rows of a task in the steps that follow a table whose rows are counted. There are no
#: fewer than ``PARTS`` tasks, and no more than shuffle partitions.
TASK_ROWS = 20_000


def _tasks(rows: int) -> int:
    return max(PARTS, blocks(rows, TASK_ROWS))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the text's shingles; of fewer words, the whole sequence's."""
    words = WORDS.of(space_words(text))
    return np.unique(ngrams(words, min(size, len(words)))) if len(words) else words


def vertex(found: np.ndarray) -> int:
    """The set's number, a signed 64-bit hash."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes()))))


def sketch(found: np.ndarray) -> bytes:
    """Parities of the shingles in buckets, twice as many as shingles or more."""
    size = 1 << max(6, int(2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_common(x: bytes, y: bytes, n: int, m: int) -> int:
    """A bound on the shingles in common of sets of ``n`` and ``m`` with these sketches."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


def prefix(n: int, percent: int) -> int:
    """Of sets of ``n``, the first so many hold a common one of any linked set."""
    return n - -(-percent * n // 100) + 1


class Order:
    """The global order: by frequency in the sample, then by hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.counts = frequent[order], counts[order]

    def first(self, found: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of a set."""
        if not len(self.frequent):
            return found[:n]
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        count = np.where(self.frequent[at] == found, self.counts[at], 0)
        return found[np.lexsort((found, count))[:n]]


def keys(found: np.ndarray, order: Order, boundary: int, percent: int) -> tuple[np.ndarray, int]:
    """Keys that the set posts, and how many of them, at first, are shingles in order;
    the others are subsets."""
    n = len(found)
    first = order.first(found, prefix(n, percent) + 1)
    out = []
    if 100 * n > percent * boundary or percent * n <= 100:  # or one in common may do
        out.append(mix(first[: prefix(n, percent)]))
    tokens = sum(map(len, out))
    if n <= boundary:
        a, b = np.triu_indices(len(first), 1)
        out.append(mix(mix(first[a] ^ np.uint64(0x5851F42D4C957F2D)) ^ first[b]))
    return np.concatenate(out), tokens


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def digests(docs: DataFrame, order: Order, boundary: int, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, vertex, text_hash and sketch of each row, with the keys that
    its set posts, of which the first ``tokens`` are in order; null and empty texts have
    no shingle. Of equal sets of one task, the first has the keys."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces_of(batches, 500):
            sets = [shingles(text, size) for text in utf8(batch.column("text"))]
            vertices = [vertex(s) for s in sets]
            posted, tokens = [], []
            for found, v in zip(sets, vertices):
                if not len(found) or v in seen:
                    posted.append(None)
                    tokens.append(0)
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(v)
                key, n = keys(found, sent.value, boundary, percent)
                posted.append(_signed(key))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(vertices, pa.int64()),
                    batch.column("text_hash"),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                    pa.array(posted, pa.list_(pa.int64())),
                    pa.array(tokens, pa.int32()),
                ],
                ["doc_id", "n_shingles", "vertex", "text_hash", "sketch", "keys", "tokens"],
            )

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run,
        "doc_id bigint, n_shingles bigint, vertex bigint, text_hash bigint, sketch binary, "
        "keys array<bigint>, tokens int",
    )


def sample(docs: DataFrame, size: int, percent: int) -> tuple[Order, int]:
    """The order and the boundary, from one in ``SAMPLED`` documents.

    Both only steer the work: every order and boundary gives the same links.
    """
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(SAMPLED)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1000):
            sets = {s.tobytes(): s for s in (shingles(t, size) for t in utf8(batch.column("text")))}
            value, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(value)), pa.array(count)], ["shingle", "n"])

    counted = some.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = keep(counted.where("n > 1"), "frequent")
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    order = Order(top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy())
    # Sets that a posting beyond the frequent ones meets, about.
    rest = counted.agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("n")).first()
    meetings = 0.0 if not rest["lists"] else rest["n"] / rest["lists"] - 1
    boundary = 1
    cost = lambda n: math.comb(prefix(n, percent) + 1, 2) - prefix(n, percent) * (1 + meetings)
    while boundary < 64 and cost(boundary + 1) <= 0:
        boundary += 1
    return order, boundary


def _shared(posted: DataFrame, percent: int) -> DataFrame:
    """Of (key, vertex, n, size, place), each vertex of a key once, and only keys under
    which several meet that may be linked. One shuffle: all steps keep the partitioning
    by key.

    Two members have to reach each other, see ``near``; so in the order of their weights
    a list ends where the next weight is beyond the reach of all before.
    """
    weight = (100 + percent) * F.col("size").cast("bigint") - (100 - percent) * F.col("n")
    reach = 2 * (100 + percent) * (F.col("size") - F.col("place")).cast("bigint") - F.col("weight")
    order = W.partitionBy("key").orderBy("weight", "vertex")
    before = F.max("reach").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        posted.repartition("key")
        .groupBy("key", "vertex", "n", "size")
        .agg(F.min("place").alias("place"))
        .withColumn("weight", weight)
        .withColumn("reach", reach)
        .withColumn("new", (F.coalesce(before, F.col("weight") - 1) < F.col("weight")).cast("int"))
        .withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("members", F.count(F.lit(1)).over(W.partitionBy("key", "part")))
        .where("members > 1")
        .select(F.xxhash64("key", "part").alias("key"), "vertex", "n", "size", "place")
    )


def lists(digest: DataFrame, percent: int) -> DataFrame:
    """key, vertex, n, size, place of all keys under which several vertices meet.

    ``size``: shingles of the set that the keys are taken from, here all ``n`` of the
    vertex; ``place``: the key's place among them, in an order for all.
    """
    posted = digest.where("keys IS NOT NULL").select(
        "vertex", F.col("n_shingles").cast("int").alias("n"), "tokens", F.posexplode("keys").alias("at", "key")
    )
    place = F.when(F.col("at") < F.col("tokens"), F.col("at")).otherwise(0)
    return _shared(posted.select("key", "vertex", "n", F.col("n").alias("size"), place.alias("place")), percent)


def near(a: str, b: str, percent: int):
    """The size and position bounds of two members of a list."""
    of = lambda end, c: F.col(f"{end}.{c}").cast("bigint")
    n, m, s, t = of(a, "n"), of(b, "n"), of(a, "size"), of(b, "size")
    left = F.least(s - of(a, "place"), t - of(b, "place"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        2 * (100 + percent) * left >= (100 + percent) * (s + t) - (100 - percent) * (n + m)
    )


def star(members: DataFrame, hubs: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """In each list, pairs of some hubs with all members of other components; and the
    lists without these hubs.

    Hubs have the smallest hashes, so lists of the same members have the same ones.
    """
    place = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("vertex"), "vertex"))
    own = ["key", "vertex", "n", "size", "place"]
    some = members.withColumn("at", place).where(F.col("at") <= hubs).drop("at")
    a, b = some.alias("a"), members.alias("b")
    pairs = (
        b.join(a, F.col("a.key") == F.col("b.key"))
        .where((F.col("a.component") != F.col("b.component")) & near("a", "b", percent))
        .select(F.least("a.vertex", "b.vertex").alias("a"), F.greatest("a.vertex", "b.vertex").alias("b"))
        .distinct()
    )
    return pairs, members.select(*own).join(some.select("key", "vertex"), ["key", "vertex"], "left_anti")


def cores(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, core: the shingles that most of ``CORE`` members of each cluster have."""

    def run(group: pa.Table) -> pa.Table:
        value, count = np.unique(
            np.concatenate([np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]), return_counts=True
        )
        core = value[2 * count > group.num_rows].tobytes()
        return pa.table({"hub": group["hub"][:1], "core": pa.array([core], pa.binary())})

    place = F.row_number().over(W.partitionBy("hub").orderBy(F.xxhash64("vertex", "hub"), "vertex"))
    some = rows.withColumn("at", place).where(F.col("at") <= CORE).select("hub", "vertex")
    return some.join(sets, "vertex").select("hub", "shingles").groupBy("hub").applyInArrow(run, "hub bigint, core binary")


def differences(rows: DataFrame, sets: DataFrame, core: DataFrame, order: Order) -> DataFrame:
    """hub, vertex, n, apart: the shingles in which each member differs from its core,
    as keys, in an order for all of the cluster."""
    sent = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 500):
            apart = []
            for x, y in zip(batch.column("shingles").to_pylist(), batch.column("core").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                more = np.setdiff1d(x, y, assume_unique=True)
                less = np.setdiff1d(y, x, assume_unique=True)
                more = sent.value.first(more, len(more))
                apart.append(_signed(np.concatenate([mix(more), mix(less ^ np.uint64(0x2545F4914F6CDD1D))])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("hub", "vertex", "n")), pa.array(apart, pa.list_(pa.int64()))],
                ["hub", "vertex", "n", "apart"],
            )

    joined = rows.join(sets, "vertex").join(core, "hub").select("hub", "vertex", "n", "shingles", "core")
    return joined.mapInArrow(run, "hub bigint, vertex bigint, n int, apart array<bigint>")


def rekeyed(members: DataFrame, sets: DataFrame, order: Order, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists of what sets members of a cluster apart, and the links that are certain.

    ``spare`` of a member is what its size allows less its difference. Two members with a
    sum of 0 or more are linked; of a linked pair with a sum below 0 the differences
    share ``-sum / (2 (100 + percent))`` shingles at least. So with the best partner
    that may still need it, the first ``size - share + 1`` shingles are enough to meet.
    """
    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("vertex"), "vertex")).alias("hub"))
    rows = members.join(hubs, "key").select(F.col("hub.vertex").alias("hub"), "vertex", "n").distinct()
    rows = keep(rows, "clusters")
    tasks = _tasks(rows.count())
    apart = differences(rows, sets, keep(cores(rows, sets).coalesce(tasks), "cores"), order).coalesce(tasks)
    spare = (100 - percent) * F.col("n").cast("bigint") - (100 + percent) * F.col("size")
    apart = keep(apart.withColumn("size", F.size("apart")).withColumn("spare", spare), "apart")
    best = apart.groupBy("hub").agg(F.max(F.struct("spare", "vertex")).alias("best"))
    marked = apart.join(best, "hub").withColumn("far", F.col("spare") + F.col("best.spare") < 0)
    certain = marked.where(~F.col("far") & (F.col("vertex") != F.col("best.vertex"))).select(
        F.col("best.vertex").alias("a"), F.col("vertex").alias("b")
    )
    # Clusters without far members are one component each.
    far = marked.where("far").groupBy("hub").agg(F.max("spare").alias("far_spare"))
    marked = marked.join(far, "hub")
    other = F.when(F.col("far"), F.col("best.spare")).otherwise(F.col("far_spare"))
    share = F.ceil(-(F.col("spare") + other) / (2 * (100 + percent)))
    first = (F.col("size") - share + 1).cast("int")
    posted = marked.withColumn("first", first).where("first > 0")
    posted = posted.select("hub", "vertex", "n", "size", F.posexplode(F.slice("apart", 1, F.col("first"))).alias("place", "key"))
    posted = posted.withColumn("key", F.xxhash64("hub", "key"))
    return _shared(posted.select("key", "vertex", "n", "size", "place"), percent), certain


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("vertex")).union(pairs.select(F.col("b").alias("vertex"))).distinct()


def _compared(pairs: DataFrame, facts: DataFrame, passes) -> DataFrame:
    """The pairs (a, b) for which ``passes(fact of a, fact of b)``; facts: vertex, fact.

    What a later round compares is little beside all the sketches and sets, so only those
    of the pairs' ends are dealt out. The ends are written, so that their size is known
    and a few of them are sent to the facts.
    """
    ends = _ends(pairs)
    facts = facts.join(keep(ends.coalesce(_tasks(2 * pairs.count())), "ends"), "vertex", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 500):
            good = [passes(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            both = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield both.filter(pa.array(good, pa.bool_()))

    of = lambda end, name: facts.select(F.col("vertex").alias(end), F.col("fact").alias(name))
    joined = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def likely(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches do not rule out."""

    def passes(x: dict, y: dict) -> bool:
        both = x["n"] + y["n"]
        return (100 + percent) * most_common(x["sketch"], y["sketch"], x["n"], y["n"]) >= percent * both

    facts = vertices.select("vertex", F.struct("n", "sketch").alias("fact"))
    return _compared(pairs, facts, passes)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def passes(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    return _compared(pairs, sets.withColumnRenamed("shingles", "fact"), passes)


def components(links: DataFrame) -> DataFrame:
    """vertex, component: the smallest vertex that links (a, b) reach.

    Each turn takes the smallest label of a vertex and its neighbours, then the
    last turn's label of that label; tables in the shared folder cut the lineage.
    """
    tasks = _tasks(2 * links.count())
    both = keep(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        .coalesce(tasks),
        "links",
    )
    first = both.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    labels = keep(first.select(F.col("a").alias("vertex"), F.least("a", "m").alias("component")), "labels")
    while True:
        near_by = labels.select(F.col("vertex").alias("b"), F.col("component").alias("m"))
        seen = both.join(near_by, "b").groupBy(F.col("a").alias("vertex")).agg(F.min("m").alias("m")).coalesce(tasks)
        lower = seen.join(labels, "vertex").select(
            "vertex", F.col("component").alias("old"), F.least("component", "m").alias("component")
        )
        jump = labels.select(F.col("vertex").alias("component"), F.col("component").alias("next"))
        lower = lower.join(jump, "component").select("vertex", "old", F.col("next").alias("component"))
        labels = keep(lower.coalesce(tasks), "labels")
        if labels.where("old <> component").isEmpty():
            return labels.select("vertex", "component")
        labels = labels.drop("old")


def _in_parts(rows: DataFrame, few: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has one row for each value of ``column``; rows
    of one value are dealt over ``PARTS`` parts."""
    part = F.pmod(F.xxhash64("vertex", F.lit(8)), F.lit(PARTS)).cast("int")
    every = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", part).join(every, [column, "part"], how).drop("part")


def merged(labels: DataFrame | None, links: DataFrame, tasks: int) -> DataFrame | None:
    """``labels`` (vertex, component) with ``links`` (a, b) added, in so many tasks."""
    if labels is None:
        return None if links.isEmpty() else components(links)
    of = lambda end, name: labels.select(F.col("vertex").alias(end), F.col("component").alias(name))
    ends = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")
    ends = keep(ends.coalesce(tasks), "joining")
    if ends.isEmpty():
        return labels
    more = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    more = more.select(F.col("vertex").alias("component"), F.col("component").alias("next"))
    new = ends.select(F.col("a").alias("vertex"), F.col("x").alias("component"))
    new = new.union(ends.select("b", "y")).where("vertex = component").distinct()
    every = labels.unionByName(new.join(labels.select("vertex"), "vertex", "left_anti"))
    moved = _in_parts(every, more, "component", "left")
    moved = moved.select("vertex", F.coalesce("next", "component").alias("component"))
    return keep(moved.coalesce(tasks), "components")


def opened(members: DataFrame, labels: DataFrame | None, tasks: int) -> DataFrame:
    """The lists of several components, with each member's component, in so many tasks."""
    if labels is None:
        now = members.withColumn("component", F.col("vertex"))
    else:
        now = members.join(labels, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    several = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    open_lists = now.join(several.where("x <> y").select("key"), "key", "left_semi")
    return keep(open_lists.coalesce(tasks), "members")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``.

    ``component_id``: the smallest doc_id that links reach, the row's own included;
    rows of equal sets are linked. A text without words has no shingle and no link.
    Rows without a doc_id take part, and have the smallest id of the others, or null.
    Repeated rows stay; other columns are ignored.
    """
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return classes(docs, size, percent).select("doc_id", "n_shingles", component_id.alias("component_id"))


def classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, text_hash, root and component_id of each row; rows without
    shingles share a root, which says nothing about them."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    order, boundary = sample(docs, size, percent)
    digest = keep(digests(docs, order, boundary, size, percent), "digests")
    path = scratch(docs.sparkSession, "lists")
    members = write(lists(digest, percent), path)
    # One document of each member.
    vertices = keep(
        digest.join(members.select("vertex").distinct(), "vertex", "left_semi")
        .groupBy("vertex")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "vertices",
    )
    digest = digest.select("doc_id", "n_shingles", "vertex", "text_hash")
    count, tasks = members.count(), _tasks(vertices.count())
    sets = None

    def fetched(wanted: DataFrame, tasks: int) -> DataFrame:
        """The sets of all vertices so far, and those of ``wanted``."""
        nonlocal sets
        if sets is not None:
            wanted = wanted.join(sets.select("vertex"), "vertex", "left_anti")
        # Written, so that its size is known and decides how the texts are joined.
        wanted = keep(vertices.select("vertex", "doc_id").join(wanted, "vertex").coalesce(tasks), "wanted")
        ids = wanted.select(F.col("doc_id").alias("id"))
        some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        more = _sets(some, size).join(wanted.select("vertex"), "vertex", "left_semi").dropDuplicates(["vertex"])
        more = keep(more.coalesce(tasks), "sets")
        sets = more if sets is None else sets.unionByName(more)
        return sets

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs")
        if not pairs.count():
            return pairs
        passed = keep(likely(pairs, vertices, percent), "likely")
        if not (n := passed.count()):
            return passed
        return keep(linked(passed, fetched(_ends(passed), _tasks(2 * n)), percent), "linked")

    labels = None
    for turn in itertools.count():
        now = opened(members, labels, _tasks(count))
        if not (count := now.count()):
            break
        step = turn % (len(ROUNDS) + 1)
        if step < len(ROUNDS):
            pairs, members = star(now, ROUNDS[step], percent)
            labels = merged(labels, compared(pairs.coalesce(_tasks(count))), tasks)
        else:
            known = fetched(now.select("vertex").distinct(), _tasks(count))
            members, certain = rekeyed(now, known, order, percent)
            labels = merged(labels, certain, tasks)
            members = keep(members, "lists")
            count = members.count()
    smallest = digest.groupBy("vertex").agg(F.min("doc_id").alias("doc_id"))
    if labels is not None:
        smallest = smallest.join(labels, "vertex", "left").withColumn("root", F.coalesce("component", "vertex"))
        groups = smallest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        found = _in_parts(smallest.select("vertex", "root"), groups, "root").select("vertex", "root", "component_id")
    else:
        found = smallest.select("vertex", F.col("vertex").alias("root"), F.col("doc_id").alias("component_id"))
    found = keep(found, "components")
    discard(docs.sparkSession, path)
    return digest.join(found, "vertex").select("doc_id", "n_shingles", "text_hash", "root", "component_id")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 500):
            sets = [s for s in (shingles(t, size) for t in utf8(batch.column("text"))) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([vertex(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["vertex", "shingles"],
            )

    return docs.select("text").mapInArrow(run, "vertex bigint, shingles binary")


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id.

    Of rows with that id the one with the smallest text hash stays; a row without id
    stays if the component has no other. Of those, repeated rows with equal id and text
    are one. Rows without words stay, each.
    """
    found = keep(classes(docs, size, percent), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    chosen = found.where("n_shingles > 0").groupBy("root").agg(first).select("first.doc_id", "first.text_hash")
    chosen = keep(chosen.distinct(), "stay").alias("c")
    # What separates words, see ``space_words``.
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(has_words).withColumn("_text_hash", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d._text_hash") == F.col("c.text_hash"))
    stay = rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)
    return stay.unionByName(docs.where(~has_words))
