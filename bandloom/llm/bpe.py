"""BPE encoding by a depth-first walk over a trie of distinct words.

The encoding of a word's prefix is settled by its last token: that token is the one vocabulary
suffix of the prefix that may stand after the last token of what precedes it. Walking the trie
hands each node's last token down, so a prefix shared by many words is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import chunks
from .common import whole_text
from .words import BatchEncoder

WORD_END = "</w>"


class TrieBPE(BatchEncoder):
    """Encoder for a BPE file with word ends; its normaliser and word splitter are the library's."""

    def __init__(self, path: str, max_pairs: int = 1_000_000, max_words: int = 400_000):
        self.kept: dict[str, list[str]] = {}  # words of earlier batches
        self.max_words = max_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        library = chunks.load_tokenizer(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.byte_form = str.maketrans({c: self.splitter.pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if c.isalpha() and c == c.lower()})
        self.number = self.vocab | self.added
        self.token = np.full(max(self.number.values()) + 1, "", object)  # by id
        self.token[list(self.number.values())] = list(self.number)
        self.decimal = np.array([str(i) for i in range(len(self.token))], object)
        self.heads = {t[:n] for t in self.vocab for n in range(1, len(t.removesuffix(WORD_END)) + 1)}
        self.max_pairs, self.n_pairs = max_pairs, 0
        self.follows: dict[str, dict[str, bool]] = {t: {} for t in self.vocab}

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE on a few symbols: the lowest rank first, leftmost among equals."""
        while len(symbols) > 1:
            best, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]
        return symbols

    @staticmethod
    def _symbols(token: str) -> list[str]:
        body = token.removesuffix(WORD_END)
        out = list(body)
        if len(body) != len(token):
            out[-1] += WORD_END
        return out

    def _may_follow(self, before: str, token: str) -> bool:
        """Whether before and token stay apart; an empty before asks whether token stands alone."""
        if self.n_pairs >= self.max_pairs:
            self.n_pairs = 0
            for known in self.follows.values():
                known.clear()
        pair = [before, token] if before else [token]
        self.n_pairs += 1
        known = self.follows[token][before] = self._merged([s for t in pair for s in self._symbols(t)]) == pair
        return known

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each byte-level word, by one depth-first walk over the trie of them all."""
        root: dict = {}
        for word in words:
            node = root
            for symbol in word[:-1]:
                node = node.setdefault(symbol, {})
            node[word[-1] + WORD_END] = None
        out: dict[str, list[str]] = {}
        # Of the path being walked: tokens[d], the last token of its first d symbols, and starts[d], where that
        # token starts. What a visited node left below its own depth is overwritten before it is read.
        room = max(map(len, words), default=0) + 1
        tokens, starts = [""] * room, [0] * room
        heads, last_token = self.heads, self._last_token
        walk = [("", 0, root)]
        while walk:
            path, low, below = walk.pop()
            depth = len(path)
            if depth:
                while path[low:] not in heads:  # no token that reaches on from here starts at low
                    low += 1
                tokens[depth], starts[depth] = last_token(path, low, depth, tokens)
            for symbol, node in below.items():
                if node is not None:
                    walk.append((path + symbol, low, node))
                    continue
                token, at = last_token(path + symbol, low, depth + 1, tokens)
                found = [token]
                while at:
                    found.append(tokens[at])
                    at = starts[at]
                out[path + symbol[0]] = found[::-1]
        return out

    def _last_token(self, path: str, low: int, depth: int, tokens: list[str]) -> tuple[str, int]:
        """The last token of path, which has depth symbols, and its start, which is not before low."""
        follows = self.follows
        for start in range(low, depth):
            token = path[start:]
            known = follows.get(token)
            if known is not None:
                before = tokens[start]
                fits = known.get(before)
                if fits or fits is None and self._may_follow(before, token):
                    return token, start
        raise ValueError(f"no token of the vocabulary ends {path!r}")

    def split(self, piece: str) -> list[tuple[str, bool]]:
        """The words of a piece as the library splits it; True marks a special token."""
        out: list[tuple[str, bool]] = []
        word, marks = chunks.word_and_marks(piece)  # the common case needs no library call
        if word.isalpha() and max(word) < "\u0100":
            return [(word.translate(self.byte_form), False), *([(marks, False)] if marks else [])]
        if word and not word.strip(chunks.MARKS):
            return [(word, False)]
        for part in self.specials.split(piece) if self.specials else [piece]:
            if part in self.added:
                out.append((part, True))
            elif part:
                out += [(word, False) for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words of lower-case Latin-1 letters."""
        forms = [w if w.isascii() else w.translate(self.byte_form) for w in words.to_pylist()]
        new = {w for w in forms if w not in self.kept}
        if len(self.kept) + len(new) > self.max_words:
            self.kept.clear()
            new = set(forms)
        self.kept.update(self.encode_words(new))
        return self._ids([self.kept[w] for w in forms])

    def others(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces of any form."""
        split = [self.split(piece) for piece in pieces.to_pylist()]
        known = self.encode_words({w for ws in split for w, special in ws if not special})
        return self._ids([[t for w, special in ws for t in ([w] if special else known[w])] for ws in split])

    def _ids(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum())), sizes


_encoders: dict[str, TrieBPE] = {}


def _encoder(path: str) -> TrieBPE:
    chunks.hold("bpe", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = TrieBPE(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, tokenizer: str | None = None, digest: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    digest: doc_id, n_tokens, ids_sha256, decoded_sha256; otherwise doc_id, n_tokens, ids (decimal,
    joined by a space) and decoded themselves. Decoding joins tokens by a space, as a vocabulary
    without a decoder asks. Null or empty text: no token, digests of the empty string. A very
    long text is read whole. Repeated rows each give a row; a null doc_id stays null; other columns
    are ignored; no rows give no rows.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
    sha = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digest else (lambda s: s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for begin, stop in chunks.byte_ranges(texts, 9 << 20):
                ids, ends = encoder.encode(texts[begin:stop])
                starts = np.concatenate([[0], ends[:-1]])
                decimal, token = ([sha(" ".join(shown[ids[b:e]].tolist())) for b, e in zip(starts, ends, strict=True)] for shown in (encoder.decimal, encoder.token))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:stop], pa.array(ends - starts, pa.int64()), pa.array(decimal, pa.string()), pa.array(token, pa.string())], names)
        chunks.trim()

    return whole_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} string, {names[3]} string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
