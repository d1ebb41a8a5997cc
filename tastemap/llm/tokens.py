"""Encoding whole texts with a public tokenizer, a piece at a time.

Written for the two JSON files of the public tokenizers: byte-level BPE, and BPE
with word ends. Both split a text into parts before any merge, and a blank that
follows a non-blank always starts a new part. So a text may be cut there, each
piece encoded once, and the pieces' ids joined. Words repeat, so most pieces come
from a bounded cache. Texts in which another white space stands before a blank
are encoded whole.

A piece of Latin letters, digits and ASCII marks has parts that are known without
the tokenizer's own splitting, which costs more than its merges; its parts go to
the library's model at once. Every other piece takes the library's whole way.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

_UNSAFE = re.compile(r"\s ")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"
#: No apostrophe (contractions), and at most single line feeds between parts.
_PLAIN = re.compile(rf"[{_LETTER}{_MARK}0-9]+(?:\n[{_LETTER}{_MARK}0-9]+)*")


class _Recent(dict):
    """What ``make`` returns for each key; of two generations the older goes.

    At most twice ``limit`` keys are held, and those in use stay.
    """

    def __init__(self, make, limit: int, older: dict | None = None):
        super().__init__()
        self.make, self.limit, self.older = make, limit, older or {}

    def __missing__(self, key: str) -> bytes:
        if (ids := self.older.get(key)) is None:
            ids = self.make(key)
        self[key] = ids
        return ids

    def renewed(self) -> _Recent:
        """This, or a new generation if this one is full."""
        if len(self) < self.limit:
            return self
        self.older = {}
        return _Recent(self.make, self.limit, self)


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    ``path``: a file of the tokenizers library. Strings of special tokens are
    ordinary text. ``limit`` bounds the cache of pieces; that of their parts, which
    cost more and weigh less, holds more. See ``_Recent``.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # it would repeat the caches below
        self.parts = _Recent(self._part, 5 * limit // 2)
        #: Whether a blank belongs to the part after it.
        self.blank = self._ids([" a"])[0] != self._ids(["a"])[0]
        lead = " " if self.blank else ""
        self.pieces = _Recent(lambda piece: self.piece(piece, lead), limit)
        digits = "[0-9]+" if self.blank else "[0-9]"
        lines = r"|\n" if self.blank else ""
        self.split = re.compile(rf"[{_LETTER}]+|{digits}|[{_MARK}]+{lines}").findall
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = str.maketrans({
            chr(c): level.pre_tokenize_str(chr(c))[0][0] for c in [*range(10, 11), *range(32, 256)]
        })

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids([text])[0], "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        text = part if self.blank else part.lower()
        tokens = self.model.tokenize(text.translate(self.bytes))
        return array("I", [t.id for t in tokens]).tobytes()

    def piece(self, piece: str, lead: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._whole(lead + piece)
        first, *rest = self.split(piece)
        return b"".join(map(self.parts.__getitem__, (lead + first, *rest)))

    def encode(self, text: str) -> bytes:
        self.pieces, self.parts = self.pieces.renewed(), self.parts.renewed()
        if not text or _UNSAFE.search(text):
            return self._whole(text)
        head, *rest = text.split(" ")
        if not head:  # a run cut from a text, or a text that starts with a blank
            return b"".join(map(self.pieces.__getitem__, rest))
        return self.piece(head, "") + b"".join(map(self.pieces.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    """The place of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)
