"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import chunks
from .common import whole_text

_tables: dict[str, chunks.PieceTable] = {}


def _lengths(path: str) -> chunks.PieceTable:
    """This worker's table of piece lengths; kept from task to task."""
    chunks.hold("token_counts", _tables.clear)
    if path not in _tables:
        tokenizer = chunks.load_tokenizer(path)
        _tables[path] = chunks.PieceTable(lambda batch: [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)], max_bytes=128 << 20)
    return _tables[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, as a byte-level tokenizers file counts them.

    Long texts are cut at safe boundaries, pieces are encoded in batches balanced by bytes, and
    only lengths leave the encoder. Null or empty text: 0 bytes and 0 tokens. Repeated rows each
    give a row; a null doc_id stays null; other columns are ignored; no rows give no rows.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _lengths(path)
        for batch in batches:
            texts, n_tokens = batch.column("text"), []
            for begin, end in chunks.byte_ranges(texts):
                pieces = [chunks.spaced_pieces(text) for text in texts[begin:end].to_pylist()]
                table.learn(pieces)
                n_tokens += [sum(map(table.__getitem__, p)) for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return whole_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
