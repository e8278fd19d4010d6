"""Language of each text by a linear-chain conditional random field over its words.

Words carry hashed affix, n-gram and whole-word (lexicon) features; learned transitions tie
neighbours; forward-backward gives each word's posterior, so code-switched texts are labelled word
by word and a text's language is that of the greatest posterior mass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .common import bound_batches, id_remainder, whole_text

UNKNOWN = "und"
SLOTS = 1 << 16
BLOCK = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_of(piece: str) -> str:
    return "".join(filter(str.isalpha, piece.lower()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place in words and slot of every feature: bigrams, trigrams, affixes up to three letters, the word itself.

    Words are framed by marks, so the grams at a frame are the affixes.
    """
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    place = np.repeat(np.arange(len(words)), sizes)
    edge = np.zeros(len(code), bool)  # where a prefix or suffix of three letters and its frame start
    ends = np.cumsum(sizes)
    edge[ends - sizes] = edge[np.maximum(ends - 4, 0)] = True
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    owner, hashes, gram = [np.arange(len(words))], [_mix(whole * _FACTOR)], code
    for n in (2, 3, 4):
        gram = gram[:-1] * _FACTOR + code[n - 1 :]
        inside = place[: len(gram)] == place[n - 1 :]
        if n == 4:
            inside &= edge[: len(gram)]
        owner.append(place[: len(gram)][inside])
        hashes.append(_mix((gram[inside] + np.uint64(n)) * _FACTOR))
    return np.concatenate(owner), (np.concatenate(hashes) % np.uint64(SLOTS)).astype(np.int64)


def emission_rows(owner: np.ndarray, slots: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """The summed weights of n words' features by label."""
    return np.stack([np.bincount(owner, weights[slots, y], n) for y in range(weights.shape[1])], 1)


def posteriors(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior label shares of every word; emissions holds the words of all sequences one after another.

    Sequences are cut into blocks whose transfer matrices are built side by side; a scan over
    blocks then gives each block its incoming and outgoing message, so long texts cost what short ones do.
    """
    n_labels = transitions.shape[0]
    step = np.exp(transitions - transitions.max())
    blocks = -(-lengths // BLOCK)
    first_block, first_word = np.cumsum(blocks) - blocks, np.cumsum(lengths) - lengths
    n_blocks = int(blocks.sum())
    within = np.arange(len(emissions)) - np.repeat(first_word, lengths)
    row, col = np.repeat(first_block, lengths) + within // BLOCK, within % BLOCK
    here = np.zeros((BLOCK, n_blocks), bool)
    here[col, row] = True
    score = np.ones((BLOCK, n_blocks, n_labels))
    score[col, row] = np.exp(emissions - emissions.max(1, keepdims=True))
    transfer = np.broadcast_to(np.eye(n_labels), (n_blocks, n_labels, n_labels)).copy()
    for t in range(BLOCK):
        at = np.flatnonzero(here[t])
        moved = (transfer[at] @ step) * score[t, at][:, None, :]
        transfer[at] = moved / moved.max((1, 2), keepdims=True)
    enter, leave = np.full((n_blocks, n_labels), 1 / n_labels), np.ones((n_blocks, n_labels))
    for j in range(1, int(blocks.max(initial=0))):
        now = first_block[blocks > j] + j
        enter[now] = (enter[now - 1][:, None, :] @ transfer[now - 1])[:, 0]
        enter[now] /= enter[now].sum(1, keepdims=True)
        last = (first_block + blocks)[blocks > j] - j  # the block j places before the end receives from it
        leave[last - 1] = (transfer[last] @ leave[last][:, :, None])[:, :, 0]
        leave[last - 1] /= leave[last - 1].max(1, keepdims=True)
    forward = np.empty_like(score)
    for t in range(BLOCK):
        moved = (enter @ step) * score[t]
        enter = np.where(here[t][:, None], moved / moved.sum(1, keepdims=True), enter)
        forward[t] = enter
    for t in reversed(range(BLOCK)):
        forward[t] *= leave
        moved = (score[t] * leave) @ step.T
        leave = np.where(here[t][:, None], moved / moved.max(1, keepdims=True), leave)
    out = forward[col, row]
    return out / out.sum(1, keepdims=True)


def expectations(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, lot: int = 4096) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior label shares of every word, expected counts of neighbouring labels, and the log of the summed scores of all labellings.

    Before the first word of a sequence stands one of unknown label, each as likely, as in posteriors. For short
    sequences, a lot of them side by side: forward and backward messages, each scaled to sum to 1.
    """
    n_labels, top = transitions.shape[0], transitions.max()
    step = np.exp(transitions - top)
    marginal, pairs, total = np.empty_like(emissions), np.zeros_like(transitions), 0.0
    first_word = np.cumsum(lengths) - lengths
    for begin in range(0, len(lengths), lot):
        own, first = lengths[begin : begin + lot], first_word[begin : begin + lot]
        longest = int(own.max())
        at = np.minimum(first[:, None] + np.arange(longest), len(emissions) - 1)
        here = np.arange(longest) < own[:, None]
        given = np.where(here[..., None], emissions[at], 0.0)
        peak = given.max(2, keepdims=True)
        score = np.exp(given - peak)
        total += float(peak[..., 0][here].sum()) + top * float(own.sum())
        ahead, back = np.empty_like(score), np.ones((len(own), n_labels))
        message = start = np.full((len(own), n_labels), 1 / n_labels)
        for t in range(longest):
            moved = (message @ step) * score[:, t]
            size = moved.sum(1)
            total += float(np.log(size[here[:, t]]).sum())
            message = np.where(here[:, t, None], moved / size[:, None], message)
            ahead[:, t] = message
        for t in reversed(range(longest)):
            now = here[:, t, None]
            share = ahead[:, t] * back
            marginal[at[here[:, t], t]] = (share / share.sum(1, keepdims=True))[here[:, t]]
            behind, before = np.where(now, score[:, t] * back, 0.0), ahead[:, t - 1] if t else start
            moved = behind @ step.T
            norm = (before * moved).sum(1)
            weight = np.divide(1.0, norm, out=np.zeros_like(norm), where=here[:, t])
            pairs += (before * weight[:, None]).T @ behind * step
            back = np.where(now, moved / moved.max(1, keepdims=True).clip(1e-300), back)
    return marginal, pairs, total


def cut_windows(text: str, window: int = 32, windows: int = 3) -> list[list[str]]:
    """At most so many windows of a text's words, spread from its begin to its end."""
    words = [w for w in map(word_of, text.split()) if w]
    count = min(windows, -(-len(words) // window))
    return [words[begin : begin + window] for k in range(count) for begin in [k * max(0, len(words) - window) // max(1, count - 1)]]


class WordCRF:
    """Emission weights by feature slot and label, and transitions between labels."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions
        self.likelihoods: list[float] = []  # mean log-likelihood a word, before each round

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], **given) -> WordCRF:
        """fit_windows of the texts' windows."""
        return cls.fit_windows([(words, lang) for text, lang in zip(texts, langs, strict=True) for words in cut_windows(text)], **given)

    @classmethod
    def fit_windows(cls, cut: list[tuple[list[str], str]], rounds: int = 40, rate: float = 0.5, seed: int = 7) -> WordCRF:
        """Likelihood ascent on windows of words, each of one language, with per-coordinate rates for emissions and transitions.

        Half of the windows are spliced from two, so that transitions learn to switch; they start from
        the frequencies of neighbours.
        """
        labels, rng = sorted({lang for _, lang in cut}), np.random.default_rng(seed)
        weights, transitions = np.zeros((SLOTS, len(labels))), np.zeros((len(labels), len(labels)))
        if not cut:
            return cls(labels, weights.astype(np.float32), transitions)
        place = {lang: y for y, lang in enumerate(labels)}
        other = rng.permutation(len(cut))
        sequences = []
        for i, (words, lang) in enumerate(cut):
            y = place[lang]
            if i % 2 and len(words) > 1:
                more, z = cut[other[i]][0], place[cut[other[i]][1]]
                k = int(rng.integers(1, len(words)))
                sequences.append((words[:k] + more[k:], [y] * k + [z] * len(more[k:])))
            else:
                sequences.append((words, [y] * len(words)))
        lengths = np.array([len(w) for w, _ in sequences])
        truth = np.concatenate([y for _, y in sequences]).astype(int)
        number: dict[str, int] = {}
        word = np.array([number.setdefault(w, len(number)) for ws, _ in sequences for w in ws])
        owner, slots = word_features(list(number))
        inner = np.ones(len(truth), bool)
        inner[np.cumsum(lengths)[:-1]] = False
        inner[0] = False
        n_labels = len(labels)
        seen = np.zeros((n_labels, n_labels))
        np.add.at(seen, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
        transitions = np.log((seen + 1) / (seen + 1).sum(1, keepdims=True))
        squares, of_steps, onehot = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6), np.eye(n_labels)[truth]
        firsts = np.bincount(truth[np.cumsum(lengths) - lengths], minlength=n_labels)
        likelihoods = []
        for _ in range(rounds):
            emissions = emission_rows(owner, slots, len(number), weights)[word]
            marginal, pairs, total = expectations(emissions, lengths, transitions)
            entered = np.exp(transitions).sum(0)  # into a first word, from any label
            likelihoods.append((float(emissions[np.arange(len(truth)), truth].sum() + (seen * transitions).sum() + (firsts * np.log(entered / n_labels)).sum()) - total) / len(truth))
            slope = (onehot - marginal) / len(truth)
            by_word = np.stack([np.bincount(word, slope[:, y], len(number)) for y in range(n_labels)], 1)
            grad = np.stack([np.bincount(slots, by_word[owner, y], SLOTS) for y in range(n_labels)], 1) - 1e-7 * weights
            squares += grad * grad
            weights += rate * grad / np.sqrt(squares)
            grad = (seen + np.exp(transitions) / entered * firsts - pairs) / len(truth) - 1e-7 * transitions
            of_steps += grad * grad
            transitions = transitions + rate / 5 * grad / np.sqrt(of_steps)
        model = cls(labels, weights.astype(np.float32), transitions)
        model.likelihoods = likelihoods
        return model


class Labeller:
    """A worker's model with the emission rows of words met so far."""

    def __init__(self, model: WordCRF):
        self.model = model
        self.pieces = chunks.PieceTable(self._rows)
        self.words: dict[str, int] = {}
        self.emission = np.zeros((1024, len(model.labels)), np.float32)

    def _rows(self, pieces: list[str]) -> list[int]:
        """The emission row of each piece's word, -1 without letters."""
        if not self.pieces:  # emptied
            self.words.clear()
        words = [word_of(p) for p in pieces]
        new = [w for w in dict.fromkeys(words) if w and w not in self.words]
        if new:
            begin, end = len(self.words), len(self.words) + len(new)
            while end > len(self.emission):
                self.emission = np.concatenate([self.emission, np.zeros_like(self.emission)])
            self.emission[begin:end] = emission_rows(*word_features(new), len(new), self.model.weights)
            self.words.update(zip(new, range(begin, end), strict=True))
        return [self.words[w] if w else -1 for w in words]

    def label(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text; a null text is empty."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.model.labels:
            return langs, scores
        for begin, end in chunks.byte_ranges(texts):
            pieces = [(text or "").split() for text in texts[begin:end].to_pylist()]
            self.pieces.learn(pieces)
            rows = [np.fromiter(map(self.pieces.__getitem__, p), np.int64, len(p)) for p in pieces]
            rows = [r[r >= 0] for r in rows]
            lengths = np.array([len(r) for r in rows])
            full = np.flatnonzero(lengths)
            if not len(full):
                continue
            emissions = self.emission[np.concatenate(rows)].astype(np.float64)
            marginal = posteriors(emissions, lengths[full], self.model.transitions)
            mass = np.add.reduceat(marginal, np.cumsum(lengths[full]) - lengths[full]) / lengths[full][:, None]
            for i, m in zip(full, mass, strict=True):
                best = int(m.argmax())
                langs[begin + i], scores[begin + i] = self.model.labels[best], float(min(1.0, m[best]))
        return langs, scores


def train(docs: DataFrame, per_language: int = 200, longest: int = 20_000, languages: int = 100, folds: int = 5, held_out: int = 0) -> WordCRF:
    """Fit on at most per_language labelled texts of each of at most languages languages (the most frequent ones: no other is ever predicted).

    Texts have at most longest characters, and each teaches by at most three windows of 32 words, which tasks cut. The
    sample takes the least hashes of doc_id among such rows outside the held-out fold, and of several rows of one doc_id and
    lang the one of the least windows; rows with a null lang, doc_id or text teach nothing. So the driver receives
    at most per_language * languages rows of 96 words.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") <= longest))
    usable = usable.filter(id_remainder(F.col("doc_id"), folds) != held_out)
    names = usable.select("doc_id", "lang")
    counts = names.groupBy("lang").agg(F.count("*").alias("n"))
    known = counts.orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = names.distinct().join(F.broadcast(known), "lang").withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_windows(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.list_(pa.list_(pa.string())))], ["doc_id", "lang", "windows"])

    taught = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, lang string, windows array<array<string>>")
    rows = sorted(taught.groupBy("doc_id", "lang").agg(F.min("windows").alias("windows")).collect(), key=lambda r: (r.doc_id, r.lang))
    return WordCRF.fit_windows([(list(words), r.lang) for r in rows for words in r.windows])


_labellers: dict[str, Labeller] = {}


def _labeller(key: str, model) -> Labeller:
    chunks.hold("language", _labellers.clear)
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(WordCRF(*model.value))
    return _labellers[key]


def _shared(docs: DataFrame, model: WordCRF):
    """The model as a broadcast of fixed size, and a key for the workers' copies."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions))
    return f"{docs.sparkSession.sparkContext.applicationId}-{sent._jbroadcast.id()}", sent


def identify(docs: DataFrame, model: WordCRF | None = None, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score (mean posterior of that language) of every whole text.

    Null text or text without a letter: und and 0; so is every text where no row could teach.
    A null doc_id is not held out. Ties go to the first language by name. Repeated rows each give
    a row; other columns take no part in the prediction; no rows give no rows. A very long text is
    read whole, in the memory of about its words times the number of languages.
    """
    key, sent = _shared(docs, model or train(docs, folds=folds, held_out=held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _labeller(key, sent).label(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = whole_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.4, model: WordCRF | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least min_score.

    Null and empty texts and texts without a letter go; where no row could teach, nothing goes. Repeated rows and
    rows without a doc_id are judged each on its own text; very long texts are read whole; other columns, whatever their
    names, are kept as they are; no rows give no rows.
    """
    model = model or train(docs)
    if not model.labels:
        return docs
    key, sent = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _labeller(key, sent).label(batch.column("text"))
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
