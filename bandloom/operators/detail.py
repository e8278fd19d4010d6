"""A record's detail: public fields, image, caption, warnings and the sentences about its figure."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import catalog, context, extract

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg")


def safe_image_path(value: str | None, data_dir: str) -> Path | None:
    """The file that a stored path names, if it is an image beneath data_dir/runs once all links are followed; otherwise None."""
    if not isinstance(value, str) or not value or "\0" in value:
        return None
    base = Path(data_dir)
    try:
        root = (base / "runs").resolve(strict=True)
        given = Path(value)
        whole = given if given.is_absolute() else base / given if given.parts[:1] == ("runs",) else root / given
        path = whole.resolve(strict=True)
    except (OSError, RuntimeError, ValueError):
        return None
    sound = path.is_relative_to(root) and path.suffix.lower() in IMAGE_SUFFIXES and path.is_file()
    return path if sound else None


def is_image_path(path: Column) -> Column:
    """Whether a stored path stays beneath the runs folder and names an image: the part of the guard that needs no file system."""
    climbs = F.exists(F.split(path, "/"), lambda p: p == "..")
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce((path != "") & ~path.startswith("/") & ~climbs & suffix.isin(*IMAGE_SUFFIXES), F.lit(False))


def run_of(path: Column) -> Column:
    """The run folder of a crop: two levels up."""
    return F.regexp_extract(path, r"^(.*)/[^/]+/[^/]+$", 1)


def shown_text(value: Column) -> Column:
    """A value as text: a JSON null as None, lists and objects as JSON."""
    return F.coalesce(V.as_text(value), F.when(F.is_variant_null(value), "None"), F.to_json(value))


def record_detail(records: DataFrame, cache: DataFrame, pages: DataFrame) -> DataFrame:
    """The public columns of records with image_url, figure_caption, paper_context and warnings.

    records: catalog rows; cache: run, candidate_path, extraction VARIANT and line_no; pages: run, page, text
    and page_no. The last positive extraction under the crop's file name in its run counts. Without a
    safe crop path there is no image, caption, context or warning. One row for each record. Answers and pages that are alike
    shrink so far in a file that Spark would take a whole run's for a small table and broadcast it: they are joined by merging.
    """
    path = F.col("candidate_path")
    name = F.regexp_extract("candidate_path", r"([^/]+)$", 1)
    known = records.withColumns({"run": F.when(is_image_path(path), run_of(path)), "file_name": F.when(is_image_path(path), name)})
    ext = F.col("extraction")
    positive = extract.is_positive(ext)
    latest = cache.filter(positive).withColumn("file_name", name).groupBy("run", "file_name").agg(F.max_by(F.to_json("extraction"), "line_no").alias("latest"))
    joined = known.join(latest.hint("merge"), ["run", "file_name"], "left").withColumn("extraction", F.parse_json("latest"))
    given = V.field(ext, "figure_caption")
    caption = F.when(given.isNull(), "").otherwise(shown_text(given))
    shown = joined.select("*", caption.alias("figure_caption"), F.transform(V.list_field(ext, "warnings"), shown_text).alias("warnings"))
    about = context.page_context(known.filter("run IS NOT NULL").select("id", "run", "page", "figure_label"), pages)
    image = F.when(F.col("run").isNotNull(), F.format_string("/api/records/%d/image", F.col("id"))).alias("image_url")
    return catalog.public_records(shown, image, "figure_caption", "warnings").join(about, "id", "left").withColumn("paper_context", F.coalesce("paper_context", F.lit("")))


def published_detail(records: DataFrame, data_dir: str) -> DataFrame:
    """record_detail of catalog rows from the pages and answers that their own runs published beneath data_dir.

    The run folders of the records asked for are looked up (a row each to the driver: ask for a page of records, not for
    the catalog); a run that is gone gives no caption, context or warnings.
    """
    spark = records.sparkSession
    path = F.col("candidate_path")
    runs = [r.run for r in records.filter(is_image_path(path)).select(run_of(path).alias("run")).distinct().collect()]
    found = {}
    for name, columns in (("pages", "page int, page_no int, text string"), ("extractions", "candidate_path string, line_no long, extraction string")):
        there = [f"{data_dir.rstrip('/')}/{run}/{name}" for run in runs if _exists(spark, f"{data_dir.rstrip('/')}/{run}/{name}")]
        base = re.escape(re.sub(r"^[a-z0-9]+:/+", "/", data_dir.rstrip("/")))
        whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        run = F.regexp_extract(whole, rf"{base}/(.*)/{name}/[^/]+$", 1).alias("run")
        found[name] = spark.read.schema(columns).parquet(*there).select(run, "*") if there else spark.createDataFrame([], f"run string, {columns}")
    return record_detail(records, found["extractions"].withColumn("extraction", F.parse_json("extraction")), found["pages"])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def record_image(records: DataFrame, record_id: int, data_dir: str) -> bytes | None:
    """The bytes behind a record's image_url, if its stored path names an image beneath data_dir/runs; otherwise None."""
    found = records.filter(F.col("id") == record_id).select("candidate_path").limit(1).collect()
    path = safe_image_path(found[0].candidate_path, data_dir) if found else None
    return path.read_bytes() if path else None
