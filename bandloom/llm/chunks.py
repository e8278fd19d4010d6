"""A bounded table from pieces of text to what a tokenizer makes of them.

Both tokenizers used here never build a token across the pieces below, so a text's tokens are
those of its pieces in order; each distinct piece is then encoded once per Python worker.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: ASCII marks that word splitting keeps together and apart from letters. Left out: the apostrophe, which opens
#: contractions, and the characters around the names of special tokens.
MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'


def space_pieces(text: str) -> list[str]:
    """Pieces between white space, for a vocabulary that drops white space."""
    return text.replace("\n", " ").split(" ")


def spaced_pieces(text: str) -> list[str]:
    """Cut before each single space that another character follows.

    Byte-level pre-tokenisation joins such a space to what follows it, so the cut is a token
    boundary. A part that is empty or opens with white space stays with the part before it.
    """
    first, *rest = text.split(" ")
    out = [first]
    for part in rest:
        if part and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


def word_and_marks(piece: str) -> tuple[str, str]:
    """The lower-cased word and the closing marks of a Latin-1 piece of that form; otherwise the piece itself.

    For a vocabulary that lower-cases and parts letters from marks, both halves encode on their own.
    """
    if piece and max(piece) < "\u0100":
        word = piece.rstrip(MARKS)
        if word.isalpha():
            return word.lower(), piece[len(word) :]
    return piece, ""


def load_tokenizer(path: str):
    """The library's tokenizer at path, single-threaded, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None] | None = None) -> None:
    """Say that this worker now runs owner's tasks, and how to drop what owner keeps from task to task.

    A worker serves many operators in turn: what the others keep is released here, and freed memory
    goes back to the system.
    """
    others = [name for name in _held if name != owner]
    for name in others:
        _held.pop(name)()
    if release is not None:
        _held[owner] = release
    if others:
        trim()


def trim() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    of_libc = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if of_libc is not None:
        of_libc(0)


class PieceTable(dict):
    """Piece -> value, filled by batch encoding and emptied when it outgrows max_bytes."""

    def __init__(self, encode: Callable[[list[str]], Iterable], max_bytes: int = 48 << 20, batch_bytes: int = 1 << 18):
        super().__init__()
        self.encode, self.max_bytes, self.batch_bytes, self.bytes = encode, max_bytes, batch_bytes, 0

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Afterwards every piece of these texts has its value."""
        wanted = set().union(*texts)
        new = wanted - self.keys()
        if new and self.bytes > self.max_bytes:
            self.forget()
            new = wanted
        batch, size = [], 0
        for piece in new:
            batch.append(piece)
            size += len(piece)
            if size >= self.batch_bytes:
                self._add(batch)
                batch, size = [], 0
        if batch:
            self._add(batch)

    def forget(self) -> None:
        self.clear()
        self.bytes = 0

    def _add(self, batch: list[str]) -> None:
        self.update(zip(batch, self.encode(batch), strict=True))
        self.bytes += sum(map(len, batch)) + 200 * len(batch)


def by_bytes(texts: list[str], limit: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of texts or bytes in a list of about limit characters or bytes each, so that no range outgrows memory by count alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def byte_ranges(column: pa.Array, limit: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of the values of a text or binary column of about limit bytes each, at least one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        done = int(ends[begin - 1]) if begin else 0
        stop = min(len(ends), int(np.searchsorted(ends, done + limit)) + 1)
        yield begin, stop
        begin = stop
