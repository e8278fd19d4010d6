"""JSON manifests, JSON-lines caches and images as DataFrames; sinks beside them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.strict_json import canonical_json
from ..operators import extract
from ..operators.flatten import is_positive
from . import assets

SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg")


def admit_source(name: str, source_url: str | None = None, source_id: str | None = None, path: str | None = None) -> None:
    """Raise ValueError unless suffix, URL and ids are acceptable, FileNotFoundError where a local path is given that is no file."""
    if path is not None and not Path(path).is_file():
        raise FileNotFoundError(path)
    if not name.lower().endswith(SUFFIXES):
        raise ValueError(f"unsupported source: {name}")
    if source_url is not None:
        parts = urlparse(source_url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError("source_url must be http or https")
    if source_id is not None and not source_id.strip():
        raise ValueError("source_id must not be blank")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, one row per element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1), line and whether a line feed closed it, of files of any size.

    Spark splits a file at line feeds, and a split's lines lie in a row in its task: a line's number is its place in the split
    after the lines of the splits before it, so one row a split is all that is ordered. The last line is open if the
    lines and their line feeds make one byte more than the file has.
    """
    meta = {name: F.col(f"_metadata.{name}") for name in ("file_path", "file_block_start", "file_size")}
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    own = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    surplus = F.sum("bytes").over(own) - F.col("size")  # 1 where the last line is open; 3 less after a byte order mark
    spans = splits.select("path", "block", "first", before.alias("before"), F.sum("n").over(own).alias("lines"), surplus.isin(1, -2).alias("open"))
    number = F.col("before") + F.col("at") - F.col("first") + 1
    lines = raw.drop("size").join(spans, ["path", "block"]).withColumn("line_no", number)
    return lines.select("path", "line_no", F.rtrim(F.make_valid_utf8("line")).alias("line"), (~(F.col("open") & (F.col("line_no") == F.col("lines")))).alias("closed"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """line_no, candidate_path, page, paper_id and extraction VARIANT of a run's JSON-lines cache.

    A torn last line is left out. A closed line that is not one JSON object with a text
    candidate_path raises ValueError with its number.
    """
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    parsed = lines.withColumn("v", F.try_parse_json(canonical_json(F.col("line"))))
    sound = F.coalesce(F.schema_of_variant("v").startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get("v", "$.candidate_path", "variant")) == "STRING"), F.lit(False))
    bad = parsed.filter(~sound & F.col("closed")).orderBy("line_no").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].line_no} of {path} is not a cached result")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return parsed.filter(sound).select("line_no", get("candidate_path", "string").alias("candidate_path"), get("page", "int").alias("page"), get("paper_id", "string").alias("paper_id"), get("extraction", "variant").alias("extraction"))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """candidate_path and text_context of JSON lines; the last of equal paths counts, by file and line."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    rows = lines.select("path", "line_no", F.from_json("line", "candidate_path string, text_context string").alias("r")).select("path", "line_no", "r.*")
    return rows.groupBy("candidate_path").agg(F.max_by("text_context", F.struct("path", "line_no")).alias("text_context"))


def is_single_frame(content: Column) -> Column:
    """Whether the bytes are a JPEG, or a PNG that is not animated: without an acTL chunk before its pixel data."""
    png = F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    pixels_at = F.instr(F.hex(content), "49444154")  # twice the place of the first IDAT
    head = F.when(pixels_at > 0, F.substring(content, F.lit(1), F.floor(pixels_at / 2).cast("int"))).otherwise(content)
    return (png & ~F.contains(head, F.lit(b"acTL"))) | (F.substring(content, 1, 3) == F.unhex(F.lit("FFD8FF")))


def read_images(spark: SparkSession, path: str, paper_id: str) -> DataFrame:
    """One candidate per PNG or JPEG: the whole image, page 1, score 1. Other files and images of several frames raise ValueError."""
    odd = spark.read.format("binaryFile").load(path).filter(~is_single_frame(F.col("content"))).select("path").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].path} is not a PNG or JPEG of one frame")
    image = F.col("image")
    box = F.array(F.lit(0), F.lit(0), image["width"], image["height"])
    return spark.read.format("image").option("dropInvalid", True).load(path).select(
        F.lit(paper_id).alias("paper_id"), F.lit(1).alias("page"), box.alias("bbox_page"), box.alias("tight_bbox_page"),
        image["origin"].alias("candidate_path"), F.lit(1.0).alias("cv_score"), image["width"].alias("width_px"), image["height"].alias("height_px"), image["data"].alias("bgr"),
    )


def read_pages(spark: SparkSession, path: str, render: Callable[..., Iterable[tuple[str, int, int, bytes | None]]], dpi: int = 350, count: Callable[[bytes], int] | None = None, at_once: int = 16, image_dir: str | None = None, with_pixels: bool = True) -> DataFrame:
    """path, page (from 1), image_path, text, width_px, height_px and bgr of documents' pages.

    render is a plug-in: from a file's bytes and the scale over 72 dots an inch, each page's text, width,
    height and pixels (rows of blue, green, red bytes, or None). Where count tells a file's pages, render is called with the
    first and last page wanted too, and a document is dealt to tasks by ranges of at_once pages; otherwise a task renders a
    whole document. Pages leave a task one by one, so a document's pixels are never held together. With an image_dir, which
    tasks reach by Arrow's file systems, each page's image is written there and image_path names it; otherwise it is null.
    Without pixels wanted bgr is null.
    """
    scale, names = dpi / 72, ["path", "page", "image_path", "text", "width_px", "height_px", "bgr"]
    kinds = "path string, page int, image_path string, text string, width_px int, height_px int, bgr binary"

    def shown(source: str, pages: Iterable[tuple], first: int) -> Iterator[pd.DataFrame]:
        for k, (text, width, height, bgr) in enumerate(pages, first):
            name = None
            if image_dir and bgr:
                system, inside = assets.file_system(image_dir)
                stem = f"{zlib.crc32(source.encode()):08x}/page_{k:03d}.png"
                at, part = f"{inside}/{stem}", f"{inside}/{stem}.{uuid.uuid4().hex}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(pixels.png(np.frombuffer(bgr, np.uint8).reshape(height, width, -1)[..., :3]))
                system.move(part, at)
                name = f"{image_dir.rstrip('/')}/{stem}"
            yield pd.DataFrame([(source, k, name, text, width, height, bgr if with_pixels else None)], columns=names)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                yield from shown(source, render(content, scale), 1)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "pages": [count(content) for content in pdf["content"]]})

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, first, last in pdf[["path", "first", "last"]].itertuples(index=False):
                system, inside = assets.file_system(source)
                with system.open_input_file(inside) as stream:
                    yield from shown(source, render(stream.read(), scale, first, last), first)

    documents = spark.read.format("binaryFile").load(path).select("path", "content")
    if count is None:
        return documents.mapInPandas(whole, kinds)
    found = documents.mapInPandas(counted, "path string, pages int").filter("pages > 0")
    begins = found.select("path", "pages", F.explode(F.sequence(F.lit(1), "pages", F.lit(at_once))).alias("first"))
    dealt = begins.select("path", "first", F.least("pages", F.col("first") + at_once - 1).alias("last"))
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first").mapInPandas(ranges, kinds)


def latest_positive(spark: SparkSession, path: str) -> DataFrame:
    """file_name and extraction: the last positive result of each file name in a run's cache; none of a cache that cannot be read."""
    try:
        rows = read_cache(spark, path)
    except ValueError:
        rows = spark.createDataFrame([], "line_no int, candidate_path string, page int, paper_id string, extraction variant")
    return extract.latest_positive(rows)


def positive_results(results: DataFrame) -> DataFrame:
    """The results whose extraction is positive."""
    return results.filter(is_positive(F.col("extraction")))


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)
