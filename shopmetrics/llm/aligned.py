"""Token groups of two tokenizers over the same texts, by chunks that both cut at.

Tokenizer A is a byte-level encoder of a space and the text, tokenizer B a piece
encoder that adds the space itself. Neither merges across a single space or line
feed between two other characters, so a text is cut there and each distinct chunk
of a block of texts is encoded once. Chunks are put one after the other, so that
the tokenizers and the alignment work on long strings. A group ends wherever a
token of each ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import sentencepiece

from shopmetrics.llm.tokens import Encoder

# Before a lone space or line feed, and after a lone line feed.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
# Chunks that can follow one another, a line feed before those without a space.
_REGULAR = re.compile(r" ?\S(?:.*\S)?", re.DOTALL)
# What a piece encoder shows a space as; a text that holds it doesn't come back.
SPACE_SIGN = "▁"
# Characters encoded in one call, and links of a group that are listed one by one.
RUN_CHARACTERS = 1 << 15
LISTED_LINKS = 1 << 10
_LEAD = " x"


class Vocabularies:
    """Bytes of the tokens of both tokenizers, and A ids to B ids of equal bytes."""

    _kept: dict[tuple[str, str], Vocabularies] = {}

    def __init__(self, path_a: str, path_b: str):
        self.encoder = Encoder.of(path_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {letter: byte for byte, letter in self.encoder.letters.items()}
        size = self.encoder.tokenizer.get_vocab_size()
        shown = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [
            bytes(letters[c] for c in s) if all(c in letters for c in s) else b"" for s in shown
        ]
        self.bytes_b = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        # Of tokens of equal bytes the last one, which is no single-byte fallback.
        by_bytes = {b: i for i, b in enumerate(self.bytes_b) if b}
        same = np.array([by_bytes.get(b, -1) for b in self.bytes_a], dtype=np.int64)
        self.n_b = len(self.bytes_b)
        # Code of a pair: A id times n_b plus B id; here of each A id with its B id of equal bytes.
        self.same = np.where(same >= 0, np.arange(size) * self.n_b + same, -1)
        self.size_a = np.array([len(b) for b in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(b) for b in self.bytes_b], dtype=np.int64)
        self.after_line = len(self.pieces.encode("\n"))
        # Decimal ids followed by each sign that can follow them.
        self.signed = [f"{i}{sign}" for i in range(max(size, self.n_b)) for sign in ",|;"]
        self.signed_size = np.array([len(s) for s in self.signed])

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Vocabularies:
        key = (path_a, path_b)
        if key not in cls._kept:
            cls._kept[key] = cls(path_a, path_b)
        return cls._kept[key]

    def _piece_bytes(self, i: int) -> bytes:
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE_SIGN, " ").encode()

    def both(self, shown: str) -> tuple[list[int], list[int]] | None:
        """Ids of a string that stands within a text; None if their bytes aren't the string's."""
        a = self.encoder.tokenizer.encode(shown, add_special_tokens=False).ids
        if shown[0] == " ":
            b = self.pieces.encode(shown[1:])
        else:
            b = self.pieces.encode("\n" + shown)[self.after_line :]
        want = shown.encode()
        good = (
            b"".join([self.bytes_a[i] for i in a]) == want
            and b"".join([self.bytes_b[i] for i in b]) == want
        )
        return (a, b) if good else None


@dataclass
class Aligned:
    """Figures of chunks; pairs of chunk i have ``pair_chunk`` i, each pair once."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    shown: list[str]  # groups, a semicolon after each
    pair_chunk: np.ndarray
    pair_code: np.ndarray
    pair_links: np.ndarray

    @property
    def n_links(self) -> np.ndarray:
        sums = np.zeros(len(self.good), dtype=np.int64)
        np.add.at(sums, self.pair_chunk, self.pair_links)
        return sums


def cut(text: str) -> list[str]:
    """Chunks of a space and the text."""
    return _CUT.split(" " + text)


def _runs(chunks: list[str]) -> Iterable[tuple[str, list[int], list[int]]]:
    """(string, chunk numbers, byte sizes); number -1 is of what was put between."""
    shown, numbers, sizes, length = [_LEAD], [-1], [len(_LEAD)], 0
    for i, chunk in enumerate(chunks):
        if not _REGULAR.fullmatch(chunk):
            yield chunk, [i], [len(chunk.encode())]
            continue
        if chunk[0] != " ":
            shown.append("\n")
            numbers.append(-1)
            sizes.append(1)
        shown.append(chunk)
        numbers.append(i)
        sizes.append(len(chunk.encode()))
        length += len(chunk)
        if length >= RUN_CHARACTERS:
            yield "".join(shown), numbers, sizes
            shown, numbers, sizes, length = [_LEAD], [-1], [len(_LEAD)], 0
    if len(numbers) > 1:
        yield "".join(shown), numbers, sizes


def _encoded(v: Vocabularies, chunks: list[str]) -> tuple[np.ndarray, ...]:
    """Ids of A and B, and number and byte end of each string in turn."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    numbers: list[int] = []
    sizes: list[int] = []

    def add(shown: str, own: list[int], own_sizes: list[int]) -> bool:
        ids = v.both(shown)
        if ids is None:
            return False
        a.append(np.array(ids[0], dtype=np.int64))
        b.append(np.array(ids[1], dtype=np.int64))
        numbers.extend(own)
        sizes.extend(own_sizes)
        return True

    for shown, own, own_sizes in _runs(chunks):
        if not add(shown, own, own_sizes) and len(own) > 1:
            for i, size in zip(own, own_sizes):
                if i >= 0:
                    add(chunks[i], [i], [size])
    return np.concatenate(a), np.concatenate(b), np.array(numbers, np.int64), np.cumsum(sizes, dtype=np.int64)


def _links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, n: int, n_b: int):
    """(group, code, links) of all token pairs of each group, repeated ids of large ones counted."""
    size_a, size_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    large = size_a * size_b > LISTED_LINKS
    token = np.flatnonzero(~large[ga])
    times = size_b[ga[token]]
    left = np.repeat(token, times)
    within = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    group = ga[left]
    parts = [(group, a[left] * n_b + b[first_b[group] + within], np.ones(len(left), np.int64))]
    for g in np.flatnonzero(large):
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        codes = (ids_a[:, None] * n_b + ids_b[None, :]).ravel()
        parts.append((np.full(len(codes), g), codes, np.outer(times_a, times_b).ravel()))
    return (np.concatenate(x) for x in zip(*parts))


def align(v: Vocabularies, chunks: list[str]) -> Aligned:
    """Groups of every chunk; a chunk whose tokens' bytes aren't its own is not good."""
    a, b, number, ends = _encoded(v, chunks)
    end_a, end_b = np.cumsum(v.size_a[a]), np.cumsum(v.size_b[b])
    last_a, last_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
    ga, gb = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n = int(last_a.sum())
    chunk = number[np.searchsorted(ends, end_a[last_a])] if n else np.zeros(0, np.int64)
    total = len(chunks)
    good = np.zeros(total, dtype=bool)
    good[number[number >= 0]] = True

    def per_chunk(values: np.ndarray) -> np.ndarray:
        return np.bincount(values[values >= 0], minlength=total)

    group, code, links = _links(a, b, ga, gb, n, v.n_b)
    own = chunk[group] >= 0
    key = (chunk[group][own] << 32) | code[own]
    order = np.argsort(key, kind="stable")
    key, links = key[order], links[own][order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    links = np.add.reduceat(links, heads) if len(heads) else links
    key = key[heads]
    # Shown ids: A ids of a group, then its B ids.
    size_a, size_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    signs = np.empty(len(a) + len(b), dtype=np.int64)
    signs[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[ga]] = 3 * a + np.where(last_a, 1, 0)
    signs[np.arange(len(b)) + np.cumsum(size_a)[gb]] = 3 * b + np.where(last_b, 2, 0)
    whole = "".join(map(v.signed.__getitem__, signs.tolist()))
    letters = np.concatenate([[0], np.cumsum(v.signed_size[signs])])
    last = np.cumsum(size_a + size_b)
    of_string = np.searchsorted(ends, end_a[last_a])
    stop = letters[np.concatenate([[0], last])[np.searchsorted(of_string, np.arange(len(number)), side="right")]]
    shown = [""] * total
    start = 0
    for i, to in zip(number.tolist(), stop.tolist()):
        if i >= 0:
            shown[i] = whole[start:to]
        start = to
    return Aligned(
        good, per_chunk(chunk[ga]) if n else np.zeros(total, np.int64),
        per_chunk(chunk[gb]) if n else np.zeros(total, np.int64), per_chunk(chunk),
        shown, key >> 32, key & ((1 << 32) - 1), links,
    )
