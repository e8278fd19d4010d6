"""Candidates from pixels: image measures, boxes of ink on pages, crops, sizes for the model."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels
from . import candidates as cand

MEASURES = ("saturation", "dark", "horizontal", "row_ratio", "col_ratio")
ARROW_BYTES, PAGE_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


@contextmanager
def _few_pages(spark: SparkSession) -> Iterator[None]:
    """Within it a batch holds a page or two: large buffers, grown and copied, took longer than the pages' pixels. A bound that the session has set stays."""
    unset = spark.conf.get(ARROW_BYTES, None) is None
    if unset:
        spark.conf.set(ARROW_BYTES, PAGE_BYTES)
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(ARROW_BYTES)


def _array(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, -1)[..., :3]


def image_features(images: DataFrame) -> DataFrame:
    """images with their measures: mean saturation, dark share, horizontal strokes, row and column profile ratios.

    images has width_px, height_px and bgr (rows of blue, green, red bytes). A null or empty image has null measures.
    """
    schema = T.StructType([*images.schema.fields, *(T.StructField(name, T.DoubleType()) for name in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, width, height in zip(*(batch.column(c).to_pylist() for c in ("bgr", "width_px", "height_px")), strict=True):
                found.append(pixels.features(_array(data, width, height)) if data else (None,) * len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))], [*batch.schema.names, *MEASURES])

    return images.mapInArrow(run, schema)


def scored(images: DataFrame) -> DataFrame:
    """images with cv_score from their measures."""
    score = cand.candidate_score(F.col("width_px"), F.col("height_px"), *(F.col(c) for c in MEASURES))
    return image_features(images).withColumn("cv_score", F.coalesce(score, F.lit(0.0))).drop(*MEASURES)


def page_candidates(pages: DataFrame, min_score: float = 0.35, at: str | None = None) -> DataFrame:
    """paper_id, candidate_no, page, bbox_page, tight_bbox_page, candidate_path, cv_score and the crop as an image file.

    pages: paper_id, page, width_px, height_px, bgr. Boxes of ink that are large enough, not nearly the
    whole page and score at least min_score, with margins for labels. candidate_no counts from 0 in
    a paper by page and, on a page, from the bottom up; paths carry it. Pages without pixels give nothing.
    at: a folder where boxes and crops are written once, before numbers are given; without one pixels are worked through twice.
    """
    boxes = "paper_id string, page int, seq int, x int, y int, w int, h int, page_w int, page_h int, saturation double, dark double, horizontal double, row_ratio double, col_ratio double, crop binary"
    names = [f.split()[0] for f in boxes.split(", ")]
    kinds = [pa.string(), *[pa.int32()] * 8, *[pa.float64()] * 5, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper, page, width, height, data in zip(*(batch.column(c).to_pylist() for c in ("paper_id", "page", "width_px", "height_px", "bgr")), strict=True):
                if not data:
                    continue
                rows, image = [], _array(data, width, height)
                luma = pixels.gray(image)
                for seq, (x, y, w, h) in enumerate(pixels.ink_boxes(image, luma=luma)):
                    if w * h >= cand.LEAST_AREA and not (w > cand.WHOLE_PAGE * width and h > cand.WHOLE_PAGE * height):  # spares the measures of others
                        x1, y1, x2, y2 = max(0, x - 240), max(0, y - 60), min(width, x + w + 20), min(height, y + h + 20)
                        rows.append((paper, page, seq, x, y, w, h, width, height, *pixels.features(image[y : y + h, x : x + w], luma[y : y + h, x : x + w]), pixels.png(image[y1:y2, x1:x2])))
                if rows:  # a page at a time: crops are large
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = pages.select("paper_id", F.col("page").cast("int").alias("page"), "width_px", "height_px", "bgr").mapInArrow(run, boxes)
    x, y, w, h, page_w, page_h = (F.col(c) for c in ("x", "y", "w", "h", "page_w", "page_h"))
    score = cand.candidate_score(w, h, *(F.col(c) for c in MEASURES))
    kept = found.filter(cand.passes_geometry(w, h, page_w, page_h)).withColumn("cv_score", score).filter(F.col("cv_score") >= min_score)
    if at:
        with _few_pages(pages.sparkSession):
            kept.write.mode("overwrite").parquet(at)
        kept = pages.sparkSession.read.schema(kept.schema).parquet(at)
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("page", "seq")) - 1
    path = F.format_string("panel_candidates/page_%03d_cand_%04d.png", F.col("page"), F.col("candidate_no"))
    # Numbers are given without the crops, which are joined again by page and box.
    placed = kept.select("paper_id", "page", "seq").withColumn("candidate_no", number)
    return kept.join(placed, ["paper_id", "page", "seq"]).select(
        "paper_id", "candidate_no", "page", cand.expand_bbox(x, y, w, h, page_w, page_h).alias("bbox_page"), F.array(x, y, x + w, y + h).alias("tight_bbox_page"), path.alias("candidate_path"), "cv_score", "crop"
    )


def model_images(images: DataFrame, longest: int = 1800) -> DataFrame:
    """images (width_px, height_px, bgr) with width, height and data_url: shrunk so that no side passes longest, as an inline PNG.

    Sizes are those of scaled_size.
    """
    sized = images.withColumn("_size", cand.scaled_size(F.col("width_px"), F.col("height_px"), longest)).select("*", "_size.width", "_size.height").drop("_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = []
            for data, old_w, old_h, w, h in zip(*(batch.column(c).to_pylist() for c in ("bgr", "width_px", "height_px", "width", "height")), strict=True):
                urls.append("data:image/png;base64," + base64.b64encode(pixels.png(pixels.shrink(_array(data, old_w, old_h), w, h))).decode() if data else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(urls, pa.string())], [*batch.schema.names, "data_url"])

    return sized.mapInArrow(run, T.StructType([*sized.schema.fields, T.StructField("data_url", T.StringType())]))


def crop_parts(images: DataFrame, *carried: str) -> DataFrame:
    """candidate_path, carried columns, part, request_path and the pixels (width_px, height_px, bgr) of the two halves of large images; none of others."""
    box = F.inline(cand.split_boxes(F.col("width_px"), F.col("height_px")))
    rows = images.select("candidate_path", *carried, "width_px", "height_px", "bgr", box)
    begin, length = F.col("y1") * F.col("width_px") * 3, (F.col("y2") - F.col("y1")) * F.col("width_px") * 3  # whole lines, so bytes in a row
    return rows.select("candidate_path", *carried, "part", part_path(F.col("candidate_path"), F.col("part")).alias("request_path"), F.col("x2").alias("width_px"), (F.col("y2") - F.col("y1")).alias("height_px"), F.substring("bgr", begin + 1, length).alias("bgr"))


def part_path(path: Column, part: Column) -> Column:
    """Where a part's crop lies: beside the folder of its candidate."""
    folder, stem = F.regexp_extract(path, r"^(.*?)[^/]*/[^/]*$", 1), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat(folder, F.lit("vlm_panel_splits/"), stem, F.format_string("_part_%02d.png", part))
