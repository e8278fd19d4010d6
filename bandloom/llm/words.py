"""Token ids of whole texts by way of distinct words, for a vocabulary that lower-cases and drops white space.

Of a batch of texts each distinct word is encoded once, whatever marks and capitals it comes with. Words and
marks stay in Arrow arrays; what turns a word into ids is left to subclasses.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from . import chunks

LATIN_WORD = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes that lie one after another in flat, those asked for, in a row; and their sizes.

    Places take four bytes each where that is enough, and are added up in place: a batch has far more of them than bytes.
    """
    starts, own = np.cumsum(sizes) - sizes, sizes[which]
    total = int(own.sum(dtype=np.int64))
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = np.cumsum(own, dtype=kind)
    shift -= own.astype(kind)
    np.subtract(starts.astype(kind)[which], shift, out=shift)
    places = np.repeat(shift, own)
    del shift
    places += np.arange(total, dtype=kind)
    return flat[places], own


class BatchEncoder:
    """Encodes batches of texts; words and others give ids and sizes of distinct pieces."""

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of lower-case words of Latin-1 letters."""
        raise NotImplementedError

    def others(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of marks, and of pieces of any form."""
        raise NotImplementedError

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct pieces."""
        stem = pc.utf8_rtrim(pieces, chunks.MARKS)
        latin = pc.match_substring_regex(stem, LATIN_WORD)
        marked = pc.and_(latin, pc.less(pc.binary_length(stem), pc.binary_length(pieces)))
        marks = pc.if_else(marked, pc.replace_substring_regex(pieces, LATIN_WORD.rstrip("$"), "", max_replacements=1), "").dictionary_encode()
        words = pc.if_else(latin, pc.utf8_lower(stem), None).dictionary_encode()
        rest = pieces.filter(pc.invert(latin))
        none = np.zeros(0, np.int64)
        flat, sizes = zip(*(f(x) if len(x) else (none, none) for f, x in ((self.words, words.dictionary), (self.others, marks.dictionary), (self.others, rest))), strict=True)
        first = np.empty(len(pieces), np.int64)
        is_latin = latin.to_numpy(zero_copy_only=False)
        first[is_latin] = words.indices.drop_null().to_numpy()
        first[~is_latin] = len(sizes[0]) + len(sizes[1]) + np.arange(len(rest))
        second = len(sizes[0]) + marks.indices.to_numpy()
        ids, own = gather(np.concatenate(flat), np.concatenate(sizes), np.stack([first, second], 1).ravel())
        return ids, own.reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts, coded = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
        del words  # as large as the texts
        flat, sizes = self._pieces(coded.dictionary)
        ids, sizes = gather(flat.astype(np.int32), sizes.astype(np.int32), coded.indices.to_numpy())
        return ids, np.cumsum(sizes, dtype=np.int64)[np.cumsum(counts) - 1]


class WordEncoder(BatchEncoder):
    """With the library's model, which gets the words in strings of JOINED; word-end tokens part them again.

    Lower-case words between spaces need neither its normaliser nor its splitting by kinds of characters.
    """

    JOINED = 500

    def __init__(self, path: str):
        self.library = chunks.load_tokenizer(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.of_words = Tokenizer(self.library.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.breaks = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special]

    def _one_by_one(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(parts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(f) for f in found], np.int64)

    @staticmethod
    def _joined(library, parts: pa.Array, separator: str, size: int) -> np.ndarray:
        """The ids of the parts, joined by the separator in strings of size parts."""
        cuts = pa.array([*range(0, len(parts), size), len(parts)], pa.int32())
        strings = pc.binary_join(pa.ListArray.from_arrays(cuts, parts), separator).to_pylist()
        return np.concatenate([np.array(e.ids, np.int64) for e in library.encode_batch_fast(strings, add_special_tokens=False)])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct words of lower-case Latin-1 letters."""
        ids = self._joined(self.of_words, words, " ", self.JOINED)
        last = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(words) else self._one_by_one(words)

    def others(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct pieces of any form: parted by a special token, unless they may hold one themselves."""
        if not self.breaks or pc.any(pc.match_substring(parts, self.breaks[0][:2])).as_py():
            return self._one_by_one(parts)
        ids = self._joined(self.library, parts, f" {self.breaks[0]} ", len(parts))
        at = np.flatnonzero(ids == self.library.token_to_id(self.breaks[0]))
        if len(at) != len(parts) - 1:
            return self._one_by_one(parts)
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
