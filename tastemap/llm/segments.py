"""Token counts that follow edits: a segment tree of pre-token runs per document.

A text is cut into leaves of about ``LEAF`` pieces, at blanks after a non-blank,
where the tokenizers start a new part whatever follows (see ``tokens``). The tree
holds characters and tokens of each leaf and their sums over subtrees. An edit
finds its leaves by walking down the sums of characters; only these leaves and the
one after are encoded again, for an edit may take away the blank at a leaf's end or
start, and then the sums on their paths are updated. Every other leaf's count
stands, as both its ends are cuts still.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import pieces_of
from tastemap.llm.tokens import Encoder, encoder

LEAF = 32
TREE = "struct<chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<start: int, end: int, text: string>>"
_CUT = re.compile(r"(?<=\S)(?= \S)")


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in runs of ``size`` pieces; an empty text is one empty leaf."""
    cuts = [m.start() for m in _CUT.finditer(text)][size - 1 :: size]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


class SegmentTree:
    """Sums over leaves: node 1 is the root, node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = 1
        while self.n < len(chars):
            self.n *= 2
        self.sums = [(0, 0)] * (2 * self.n)
        for i, pair in enumerate(zip(chars, tokens)):
            self.sums[self.n + i] = pair
        for i in range(self.n - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    @property
    def total(self) -> tuple[int, int]:
        return self.sums[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the last leaf that starts at or before ``char``
        and is not empty, or the first leaf."""
        node, start = 1, 0
        while node < self.n:
            left = self.sums[2 * node][0]
            if char < start + left or not self.sums[2 * node + 1][0]:
                node *= 2
            else:
                node, start = 2 * node + 1, start + left
        return node - self.n, start

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.n + leaf
        self.sums[node] = (chars, tokens)
        while node > 1:
            node //= 2
            (a, b), (c, d) = self.sums[2 * node], self.sums[2 * node + 1]
            self.sums[node] = (a + c, b + d)


def count(encode: Encoder, text: str) -> int:
    return len(encode.encode(text)) // 4


def apply(text: str, tree: SegmentTree, edits, encode: Encoder) -> tuple[str, int]:
    """The edited text and the characters that were encoded again; changes ``tree``.

    ``edits``: (start, end, replacement) one after another, each in characters of
    the text as it then is; places beyond the end mean the end.
    """
    again = 0
    for start, end, new in edits:
        length = tree.total[0]
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        first, first_start = tree.leaf_at(max(0, start - 1))
        last, last_start = tree.leaf_at(end)
        stop = last_start + tree.sums[tree.n + last][0]
        # From the leaf of the character before the edit to that of the one after it.
        text = text[:start] + new + text[end:]
        region_end = stop + len(new) - (end - start)
        region = text[first_start:region_end]
        while True:  # widen until both ends are cuts
            left_ok = first_start == 0 or _CUT.match(text, first_start)
            right_ok = region_end == len(text) or _CUT.match(text, region_end)
            if left_ok and right_ok:
                break
            if not left_ok:
                first, first_start = tree.leaf_at(first_start - 1)
            if not right_ok:
                last, last_start = tree.leaf_at(stop)
                stop = last_start + tree.sums[tree.n + last][0]
                region_end = stop + len(new) - (end - start)
            region = text[first_start:region_end]
        again += len(region)
        parts, slots = leaves(region), last - first + 1
        if len(parts) > slots:
            parts[slots - 1 :] = ["".join(parts[slots - 1 :])]
        for i in range(slots):
            part = parts[i] if i < len(parts) else ""
            tree.update(first + i, len(part), count(encode, part) if part else 0)
    return text, again


KIND_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
KIND_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
#: Columns that ``edit`` adds.
COUNTS = ("n_edits", "tokens_before", "tokens_after", "chars_encoded")
#: Fixed patterns of what ``redactions`` masks: mail addresses, network addresses,
#: long runs of digits (telephone, card), and keys of 20 and more hexadecimal digits.
PRIVATE = re.compile(
    r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{20,}\b|\+?\(?\d[\d() -]{7,}\d"
)

Batches = Iterator[pa.RecordBatch]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added or replaced."""
    names = [c for c in batch.schema.names if c not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns.values()], [*names, *columns])


def _built(batches: Batches, tokenizer: str) -> Batches:
    encode = encoder(tokenizer)
    for batch in pieces_of(batches, 500):
        trees = []
        for text in batch.column("text").to_pylist():
            parts = leaves(text or "")
            trees.append({"chars": [len(p) for p in parts], "tokens": [count(encode, p) for p in parts]})
        yield _with(batch, tree=pa.array(trees, KIND_TREE))


def _redacted(batches: Batches, mask: str) -> Batches:
    for batch in batches:
        edits = [
            [{"start": m.start(), "end": m.end(), "text": mask} for m in PRIVATE.finditer(t or "")][::-1]
            for t in batch.column("text").to_pylist()
        ]
        yield _with(batch, edits=pa.array(edits, KIND_EDITS))


def _edited(batches: Batches, tokenizer: str) -> Batches:
    encode = encoder(tokenizer)
    for batch in pieces_of(batches, 500):
        texts, trees, counts = [], [], []
        for text, tree, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits"))):
            used = SegmentTree(tree["chars"], tree["tokens"])
            before, again = used.total[1], 0
            if edits:
                steps = [(e["start"], e["end"], e["text"] or "") for e in edits]
                text, again = apply(text or "", used, steps, encode)
                live = used.sums[used.n : used.n + len(tree["chars"])]
                live = [x for x in live if x[0]] or [(0, 0)]
                tree = {"chars": [a for a, _ in live], "tokens": [b for _, b in live]}
            texts.append(text)
            trees.append(tree)
            counts.append((len(edits or ()), before, used.total[1], again))
        columns = zip(*counts) if counts else [[]] * 4
        yield _with(
            batch,
            text=pa.array(texts, pa.string()),
            tree=pa.array(trees, KIND_TREE),
            **{name: pa.array(c, pa.int64()) for name, c in zip(COUNTS, columns)},
        )


def _schema(docs: DataFrame, *added: tuple[str, str]) -> str:
    new = dict(added)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in new]
    return ", ".join([*kept, *(f"{name} {kind}" for name, kind in added)])


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` and ``tree``: characters and tokens of each leaf. Null texts are empty."""
    return docs.mapInArrow(lambda batches: _built(batches, tokenizer), _schema(docs, ("tree", TREE)))


def redactions(docs: DataFrame, mask: str = "<PRIVATE>") -> DataFrame:
    """``docs`` and ``edits`` that mask private data, last place first."""
    return docs.mapInArrow(lambda batches: _redacted(batches, mask), _schema(docs, ("edits", EDITS)))


def edit(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (with ``tree`` and ``edits``) after the edits, with ``n_edits``,
    ``tokens_before``, ``tokens_after`` and ``chars_encoded``.

    ``text`` and ``tree`` are the new ones; edits that are null are none, and an edit
    without replacement text is an erasure. Repeated rows stay.
    """
    added = [("text", "string"), ("tree", TREE), *((name, "bigint") for name in COUNTS)]
    return docs.mapInArrow(lambda batches: _edited(batches, tokenizer), _schema(docs, *added))


def counts(docs: DataFrame, tokenizer: str, mask: str = "<PRIVATE>") -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_edits, tokens_before, tokens_after,
    chars_encoded and n_leaves of masking its private data.

    The steps of ``build``, ``redactions`` and ``edit`` in one Python worker, which
    so has one cache of pieces.
    """
    names = ["doc_id", *COUNTS, "n_leaves"]

    def run(batches: Batches) -> Batches:
        for batch in _edited(_redacted(_built(batches, tokenizer), mask), tokenizer):
            leaves = pa.array([len(t["chars"]) for t in batch.column("tree").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:-1]), leaves], names
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, ", ".join(f"{name} bigint" for name in names)
    )
