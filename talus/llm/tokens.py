"""Token ids of whole texts by the tokenizers library, with a bounded table of known pieces.

A byte-level BPE never merges across the boundaries that its pattern draws, and a line feed or
a single space between two non-space characters always ends a piece there. Texts are cut at
these places and each distinct piece is encoded once by the library; a text in which a cut
would touch other white space, or that holds an added token of the vocabulary (which the
library takes out of a text before anything else), is encoded by the library as a whole. The
ids are those of one call of a fresh tokenizer for the text with add_special_tokens=False.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Entries of each table of pieces; a full table becomes the older one, which is asked on a miss.
CACHE_PIECES = 300_000


class _Uncut(Exception):
    """The text has white space at a cut."""


class _Pieces(dict):
    def __init__(self, owner: "TextEncoder", lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is not None:
            return self.keep(piece, ids)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uncut
        if piece[-1] in ".," and piece[:-1].isalpha():
            ids = self[piece[:-1]] + self.owner.marks[piece[-1]]
        elif piece.isalpha():
            ids = self.owner.alphabetic(self.lead + piece)
        else:
            ids = self.owner.whole(self.lead + piece)
        return self.keep(piece, ids)

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class TextEncoder:
    """encode(text) -> ids as little-endian unsigned 16-bit (or 32-bit for large vocabularies) bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.byte_level = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.byte_level = self.byte_level and not self.tokenizer.pre_tokenizer.add_prefix_space
        if self.byte_level:
            self.marks = {c: self.whole(c) for c in "., \n"}
            table = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.table: dict[int, str] = {}
            points = [*range(0x800), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)]
            for point in points:  # every byte that UTF-8 has occurs in one of these characters
                if not 0xD800 <= point < 0xE000:
                    self.table.update(zip(chr(point).encode(), table.pre_tokenize_str(chr(point))[0][0]))
            self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")
            self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def alphabetic(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.byte_level or any(token in text for token in self.added):
            return self.whole(text)
        first, later = self.first.__getitem__, self.later.__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                lines.append(first(head) + b"".join(map(later, rest)))
            return self.marks["\n"].join(lines)
        except _Uncut:
            return self.whole(text)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text or ""), self.dtype)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a file; loaded once in a Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
