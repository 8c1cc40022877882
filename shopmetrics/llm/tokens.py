"""Token ids of whole texts by a public tokenizer, with words encoded once.

Byte-pair encoders cut a text into pieces before merging, and never merge
across them. Cutting a text before each space that a non-space follows is a
cut that both supported kinds of tokenizer make as well, so the ids of a text
are the ids of its chunks in order. Chunks repeat, and their ids are kept in a
table of bounded size; texts are never shortened.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

# Chunks and pieces of each of two generations kept in a worker.
KEPT_ENTRIES = 500_000
# A space that isn't followed by a non-space: then the text is cut with care.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
# Chunks of Latin letters, digits, marks and lone line feeds, where the pieces are runs.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf" ?[{_LETTER}0-9{_MARK}]+(?:\n[{_LETTER}0-9{_MARK}]+)*\Z")
_SPACED_PIECES = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n")
_WORD_PIECES = re.compile(rf"[{_LETTER}]+|[0-9]|[{_MARK}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level encoders use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian arrays of the smallest fitting type."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are text
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lower = self.tokenizer.encode("A", add_special_tokens=False).ids == (
            self.tokenizer.encode("a", add_special_tokens=False).ids
        )
        self.code = {"<u2": "H", "<u4": "I"}[self.dtype.str]
        self.letters = _byte_letters()
        self.find_pieces = (_WORD_PIECES if self.lower else _SPACED_PIECES).findall
        # What was met lately, and what was met before that.
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _piece(self, piece: str) -> bytes:
        found = self.old_pieces.get(piece)
        if found is None:
            shown = piece.encode().decode("latin-1").translate(self.letters)
            found = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self.pieces) >= KEPT_ENTRIES:
            self.old_pieces, self.pieces = self.pieces, {}
        self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.old_chunks.get(chunk)
        if found is None:
            if _PLAIN.match(chunk):
                pieces = self.find_pieces(chunk.lower() if self.lower else chunk)
                get, make = self.pieces.get, self._piece
                found = b"".join([get(p) or make(p) for p in pieces])
            else:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
                found = array(self.code, ids).tobytes()
        if len(self.chunks) >= KEPT_ENTRIES:
            self.old_chunks, self.chunks = self.chunks, {}
        self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, as ``tokenizer.encode`` gives them."""
        cut = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        parts = [cut[0]]
        parts += cut[1:] if self.lower else [" " + c for c in cut[1:]]
        chunks, make = self.chunks, self._chunk
        joined = b"".join([chunks.get(c) or make(c) for c in parts if c])
        return np.frombuffer(joined, dtype=self.dtype)


def default_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
