"""Token ids in files of directly addressable codes: any token is found without decoding what stands before it.

An id is split into chunks, the lowest first. Level 0 holds the first chunk of every token; a bitmap says which of
them go on, and level l + 1 holds the next chunks of those only. The place of a token's next chunk is the rank of its
bit, which a directory of counts gives with one look at one block of the bitmap. Widths of the chunks are those
that make a file of its ids smallest.

A file, little-endian: MAGIC; documents, tokens and levels (u64 each); width and length of each level (u64 each);
doc_ids (i64 each) and whether each is null (a byte each), where each document ends (u64 each); then for each level its
chunks as a row of bits and, but for the last, its bitmap and the count of ones before each block (u64 each). Each
part begins at a multiple of 8 bytes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import shared_dir, stored, whole_text
from .packing import _encoder, _id_kind

MAGIC = b"DACIDS01"
BLOCK = 512  # bits for each entry of a rank directory
AT_ONCE = 1 << 16  # chunks that are packed or unpacked in one step
MANIFEST = "file string, part int, first long, n_docs long, n_tokens long, n_bytes long"


def chunk_widths(ids: np.ndarray) -> list[int]:
    """The widths, lowest chunk first, that take the fewest bits for these ids, bitmaps and directories included."""
    lengths = np.bincount(np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(int), minlength=2)
    total = len(lengths) - 1
    longer = [int(lengths[s + 1 :].sum()) if s else len(ids) for s in range(total)]  # ids that reach level s
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (total + 1)
    for s in range(total - 1, -1, -1):
        best[s] = min((longer[s] * (e - s + (1 + 64 / BLOCK if e < total else 0)) + best[e][0], [e - s, *best[e][1]]) for e in range(s + 1, total + 1))
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    """width bits of each value, one after another."""
    out = []
    for begin in range(0, len(values), AT_ONCE):  # a multiple of 8 values ends with a whole byte
        bits = np.unpackbits(values[begin : begin + AT_ONCE].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :width], bitorder="little").tobytes())
    return b"".join(out)


def _unpacked(data: bytes, skip: int, n: int, width: int) -> np.ndarray:
    """n values of width bits, after skip bits."""
    raw, out = np.frombuffer(data, np.uint8), np.zeros(n, np.uint32)
    for begin in range(0, n, AT_ONCE):
        size, at = min(AT_ONCE, n - begin), skip + begin * width
        bits = np.unpackbits(raw[at // 8 : (at + size * width + 7) // 8], bitorder="little")[at % 8 :][: size * width].reshape(size, width)
        whole = np.zeros((size, 32), np.uint8)
        whole[:, :width] = bits
        out[begin : begin + size] = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()
    return out


def _whole_words(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def file_bytes(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The parts of a file of these documents, whose ids end at ends."""
    widths = chunk_widths(ids)
    levels, rest = [], ids.astype(np.uint32)
    for level, width in enumerate(widths):
        last = level == len(widths) - 1
        more = rest >> width > 0
        bitmap = b"" if last else np.packbits(more, bitorder="little").tobytes()
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) and not last else np.zeros(0, np.uint64)
        levels.append((width, len(rest), _packed(rest, width), bitmap, (np.cumsum(ones) - ones).astype("<u8")))
        rest = rest[more] >> width
    yield MAGIC + np.array([len(doc_ids), len(ids), len(widths), *(x for width, n, *_ in levels for x in (width, n))], "<u8").tobytes()
    yield np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    yield _whole_words(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    yield ends.astype("<u8").tobytes()
    for *_, packed, bitmap, counts in levels:
        yield _whole_words(packed)
        yield _whole_words(bitmap)
        yield counts.tobytes()


class TokenFile:
    """Reads a file of file_bytes: directories and any run of ids, each with a few short reads of what it needs."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        self.n_docs, self.n_tokens, n_levels = self._numbers(len(MAGIC), 3)
        if self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        sizes = self._numbers(len(MAGIC) + 24, 2 * n_levels)
        at = self.directory = len(MAGIC) + 24 + 16 * n_levels
        at += 8 * self.n_docs + -(-self.n_docs // 8) * 8 + 8 * self.n_docs
        self.levels = []  # width, and where chunks, bitmap and counts begin
        for level in range(n_levels):
            width, n = sizes[2 * level : 2 * level + 2]
            bitmap = at + -(-n * width // 64) * 8
            counts = bitmap + (-(-n // 64) * 8 if level < n_levels - 1 else 0)
            self.levels.append((width, at, bitmap, counts))
            at = counts + (-(-n // BLOCK) * 8 if level < n_levels - 1 else 0)

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _numbers(self, at: int, n: int) -> list[int]:
        return np.frombuffer(self._bytes(at, 8 * n), "<u8").tolist()

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The doc_ids and where their ids end."""
        n, at = self.n_docs, self.directory
        ids = np.frombuffer(self._bytes(at, 8 * n), "<i8").tolist()
        null = self._bytes(at + 8 * n, n)
        ends = np.frombuffer(self._bytes(at + 8 * n + -(-n // 8) * 8, 8 * n), "<u8")
        return [None if gone else d for d, gone in zip(ids, null, strict=True)], ends.astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids at places begin up to end."""
        if not 0 <= begin <= end <= self.n_tokens:
            raise IndexError(f"{begin} to {end} of {self.n_tokens}")
        out, places, shift = np.zeros(end - begin, np.uint32), np.arange(end - begin), 0
        for level, (width, packed, bitmap, counts) in enumerate(self.levels):
            if begin == end:
                break
            data = self._bytes(packed + begin * width // 8, -(-end * width // 8) - begin * width // 8)
            out[places] |= _unpacked(data, begin * width % 8, end - begin, width) << np.uint32(shift)
            shift += width
            if level == len(self.levels) - 1:
                break
            block = begin // BLOCK
            bits = np.unpackbits(np.frombuffer(self._bytes(bitmap + block * BLOCK // 8, -(-end // 8) - block * BLOCK // 8), np.uint8), bitorder="little")
            own = bits[begin - block * BLOCK : end - block * BLOCK] > 0
            begin = self._numbers(counts + 8 * block, 1)[0] + int(bits[: begin - block * BLOCK].sum())  # the rank
            places = places[own]
            end = begin + len(places)
        return out

    def token(self, place: int) -> int:
        """The id at a place."""
        return int(self.ids(place, place + 1)[0])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2, tokenizer: str | None = None, file_tokens: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Write the ids of whole texts, each with end_id after them, in ascending doc_id order; return the manifest of files.

    The manifest has a row for each file: its URI, the task that wrote it, the place of its first id among all ids, and what it
    holds. A file ends with the document that brings it to file_tokens, so only one longer text makes it larger. Each
    attempt of a task writes files of its own, and only those named in the manifest count, so a lost or repeated
    attempt leaves nothing that is read. path is a folder that tasks reach by Arrow's file systems, the shared folder by
    default. A null or empty text is end_id alone; rows of one doc_id, and those without (they come first), go in the order of a
    hash of their texts; ranges of about task_bytes are cut between rows, so one doc_id, and copies of one row, may fill many; other
    columns are ignored; no rows give no file. Texts are shuffled once and encoded where they are written, so docs should be
    read from a table: equal each time it is evaluated.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind, folder = _id_kind(tokenizer, end_id), f"{(path or shared_dir(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    system, inside = file_system(folder)
    system.create_dir(inside, recursive=True)
    rows = whole_text(docs).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    size_of_all = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_of_all // task_bytes + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], kind)
        system, inside = file_system(folder)
        part, first, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(ids) for _, ids in held])
            name = f"{part:06d}-{first:012d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{inside}/{name}") as out:
                for piece in file_bytes([d for d, _ in held], np.concatenate([ids for _, ids in held]), ends):
                    out.write(piece)
                n_bytes = out.tell()
            return pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "part": part, "first": first, "n_docs": len(held), "n_tokens": size, "n_bytes": n_bytes}], _arrow_schema())

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for begin, stop in chunks.byte_ranges(texts, 9 << 20):
                ids, ends = encoder.encode(texts[begin:stop])
                ids = ids.astype(kind)
                for doc_id, own in zip(doc_ids[begin:stop], np.split(ids, ends[:-1]), strict=True):
                    held.append((doc_id, np.concatenate([own, end])))
                    size += len(own) + 1
                    if size >= file_tokens:
                        yield close()
                        first, held, size = first + size, [], 0
        if held:
            yield close()

    order = ["doc_id", "hash", "row"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = stored(ranged.select("doc_id", "text").mapInArrow(write, MANIFEST))
    before, offsets = 0, [0] * parts
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a number a task
        offsets[part], before = before, before + n
    return files.withColumn("first", F.col("first") + F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("part") + 1))


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in MANIFEST.split(", "))])


def read_documents(manifest: DataFrame, piece_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit, little-endian) of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("tokenfile", chunks.trim)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                system, inside = file_system(name)
                with system.open_input_file(inside) as source:
                    found = TokenFile(source)
                    doc_ids, ends = found.documents()
                    starts = np.concatenate([[0], ends[:-1]])
                    at = 0
                    while at < len(ends):
                        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + piece_bytes // 4)))
                        ids = found.ids(int(starts[at]), int(ends[stop - 1])).astype("<u4")
                        bodies = [ids[b:e].tobytes() for b, e in zip(starts[at:stop] - starts[at], ends[at:stop] - starts[at], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:stop], pa.int64()), pa.array(starts[at:stop] + first), pa.array(ends[at:stop] - starts[at:stop]), pa.array(bodies, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        at = stop

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "first").repartition(parts, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_tokens(manifest: DataFrame, places: DataFrame, stride: int = 4 << 20) -> DataFrame:
    """place and token for each wanted place among all ids: only the files that hold one are opened, and no block is decoded.

    places: a column place (repeats answered each; null or outside: null). Files and places meet by stretches of stride
    ids, a file in each stretch that it touches, so neither side is copied whole.
    """
    spans = manifest.select("file", "first", "n_tokens", F.explode(F.sequence(F.expr(f"first div {stride}"), F.expr(f"(first + n_tokens - 1) div {stride}"))).alias("stretch"))
    wanted = places.select(F.col("place").cast("long").alias("place")).withColumn("stretch", F.expr(f"place div {stride}"))
    inside = (wanted.stretch == spans.stretch) & F.col("place").between(F.col("first"), F.col("first") + F.col("n_tokens") - 1)
    met = wanted.join(spans, inside, "left").select("place", "file", (F.col("place") - F.col("first")).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("tokenfile", chunks.trim)
        name = found = None
        with ExitStack() as opened:
            for batch in batches:
                out = []
                for file, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                    if file is not None and file != name:
                        opened.close()
                        system, inside = file_system(file)
                        name, found = file, TokenFile(opened.enter_context(system.open_input_file(inside)))
                    out.append(None if file is None else found.token(at))
                yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.int64())], ["place", "token"])

    return met.sortWithinPartitions("file", "at").mapInArrow(read, "place long, token long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_documents(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
