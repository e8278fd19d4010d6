"""From pages or an image to published records: preprocessing, the gate before publishing, one call for all of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import assets, files
from . import candidates as cand
from . import catalog, context, extract, flatten, images, ledger
from .settings import Settings

FORMAT = 2  # of what a run folder holds; another number starts every run anew
BAND = ("candidate_key", "panel_label", "row_index", "lane_index", "target")


class Incomplete(RuntimeError):
    """The extraction cannot be published; what the catalog holds is kept."""


def paper_doi(pages: DataFrame, metadata: Column | None = None, most: int = 3) -> DataFrame:
    """paper_id and doi: the first of the metadata column, otherwise of the first pages in order; null without one.

    pages: paper_id, page, text, and what metadata reads.
    """
    own = T.first_doi(metadata) if metadata is not None else F.lit(None).cast("string")
    found = pages.select("paper_id", "page", own.alias("own"), T.first_doi(F.col("text")).alias("doi"))
    return found.groupBy("paper_id").agg(F.coalesce(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("page"))), F.min_by("doi", F.when(F.col("doi").isNotNull() & (F.col("page") <= most), F.col("page")))).alias("doi"))


def candidate_contexts(candidates: DataFrame, pages: DataFrame, user_context: str = "") -> DataFrame:
    """candidate_path, page, text_context and line_no of candidates, from their pages' and the whole paper's text."""
    whole = context.ordered_text(pages, ["paper_id"], "page", context.page_marked(F.col("page"), F.col("text")), "\n\n")
    about = whole.select("paper_id", context.figure_context(F.col("full_text")).alias("figures"), context.snippets(F.col("full_text")).alias("methods"))  # once a paper, not once a candidate
    near = context.neighbour_text(candidates.select("paper_id", "page").distinct(), pages, "paper_id", "page", "text").withColumnRenamed("full_text", "nearby")
    joined = candidates.join(near, ["paper_id", "page"], "left").join(about, "paper_id", "left")
    block = context.candidate_context(F.col("paper_id"), F.col("page"), F.col("bbox_page"), F.coalesce("nearby", F.lit("")), F.col("figures"), F.col("methods"))
    text = context.with_user_context(F.lit(user_context), block) if user_context else block
    return joined.select("candidate_path", "page", text.alias("text_context"), F.col("candidate_no").alias("line_no"))


def preprocess(pages: DataFrame, settings: Settings, user_context: str = "", work_dir: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, those good enough for the model, and the contexts of these.

    pages: paper_id, page, text, width_px, height_px, bgr. Candidates come by score, equal ones in the order of pages.
    With a work_dir boxes and crops are written there as they are found, so pixels are worked through once, whatever reads
    the three results; without one each of them works through the pixels again.
    """
    found = images.page_candidates(pages, settings.min_candidate_score, work_dir and f"{work_dir.rstrip('/')}/boxes")
    good = cand.good_candidates(found, least=settings.min_model_score)
    return found, good, candidate_contexts(good.drop("crop"), pages, user_context)


def preprocess_summary(pages: DataFrame, found: DataFrame, good: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row: pages, candidate_count, llm_candidate_count, contexts_written."""
    counted = pages.agg(F.count("*").alias("pages"))
    for name, rows in (("candidate_count", found), ("llm_candidate_count", good), ("contexts_written", contexts)):
        counted = counted.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    return counted


def single_image(picture: DataFrame, paper_id: str, user_context: str = "") -> tuple[DataFrame, DataFrame]:
    """The one candidate of an image source and its context; picture as of files.read_images."""
    found = picture.select("candidate_path", F.lit(0).alias("candidate_no"), F.lit(paper_id).alias("paper_id"), F.lit(1).alias("page"), "bbox_page", "tight_bbox_page", F.lit(1.0).alias("cv_score"), "width_px", "height_px", "bgr")
    return found, found.select("candidate_path", "page", F.lit(user_context).alias("text_context"), F.lit(1).alias("line_no"))


def validated_records(candidates: DataFrame, results: DataFrame, paper_id: str, source_pdf: str, hashes: DataFrame) -> DataFrame:
    """The band rows of complete results; raises Incomplete or ValueError before anything is written.

    Results must match the candidates one to one, need no retry and name the paper; hashes has
    candidate_path and image_sha256 of every crop that exists. Results that bear needs_retry were judged before.
    """
    judged = results if "needs_retry" in results.columns else flatten.needs_retry(results)
    if not extract.completeness_faults(results, candidates).isEmpty():
        raise Incomplete("results do not match the candidates")
    if not judged.filter("needs_retry").isEmpty():
        raise Incomplete("an extraction failed")
    if not extract.foreign_papers(results, paper_id).isEmpty():
        raise ValueError("a result belongs to another paper")
    if not results.join(hashes, "candidate_path", "left_anti").isEmpty():
        raise ValueError("a crop is missing")
    rows = flatten.flatten_records(results.withColumnRenamed("candidate_no", "figure_no"), source_pdf)
    return rows.join(hashes, "candidate_path", "left").withColumn("input_pos", F.xxhash64("figure_no", "panel_no", "band_no")).drop("figure_no", "panel_no", "band_no")


def with_provenance(rows: DataFrame, source_id: str, model_version: str, source_url: str | None) -> DataFrame:
    """Rows of one source: keys scoped by it, and where they come from."""
    key = T.source_scoped_key(F.lit(source_id), F.col("candidate_key"))
    return rows.withColumns({"candidate_key": key, "source_id": F.lit(source_id), "model_version": F.lit(model_version), "source_url": F.lit(source_url).cast("string")})


def publish_assets(files_: DataFrame, source_name: str, run_dir: str, pages: DataFrame, results: DataFrame) -> str:
    """Publish a source's files, pages and answers in a fresh folder beneath run_dir that nothing writes again; returns its name.

    files_: name and content; what bears the source's name lies at the top, everything else is a crop in panel_candidates.
    Beside them the tables pages and extractions, which record details read.
    """
    placed = files_.select(F.when(F.col("name") == source_name, F.col("name")).otherwise(F.concat(F.lit("panel_candidates/"), F.col("name"))).alias("name"), "content")
    answers = results.select("candidate_path", "paper_id", "page", F.col("candidate_no").cast("long").alias("line_no"), F.to_json("extraction").alias("extraction"))
    return assets.publish_folder(placed, {"pages": pages, "extractions": answers}, run_dir)


def at_published(rows: DataFrame, folder: str, source_name: str) -> DataFrame:
    """Rows whose crop and source paths point into the published folder."""
    crop = F.concat(F.lit(f"{folder}/panel_candidates/"), F.regexp_extract("candidate_path", r"([^/]+)$", 1))
    return rows.withColumns({"candidate_path": crop, "source_pdf": F.lit(f"{folder}/{source_name}")})


def source_fingerprint(candidates: DataFrame, contexts: DataFrame, crops: DataFrame, client: extract.Client, settings: Settings, **given) -> str:
    """The fingerprint of all that shapes an answer: the source's bytes, boxes, contexts, options, model, prompt and schema.

    crops has name, and content or the SHA-256 of it. Prompt and schema are what the client says of itself (its attribute identity); a client that says nothing is told from
    others by config alone.
    """
    boxes = [c for c in ("candidate_no", "candidate_path", "page", "bbox_page", "tight_bbox_page", "cv_score") if c in candidates.columns]
    whole = {
        "format": FORMAT, "crops": assets.rows_digest(crops, ["name", "content"]), "candidates": assets.rows_digest(candidates, boxes), "contexts": assets.rows_digest(contexts, ["candidate_path", "text_context", "line_no"]),
        "dpi": settings.pdf_dpi, "least": [settings.min_candidate_score, settings.min_model_score], "model_version": settings.model_version, "base_url": settings.model_base_url, "max_tokens": settings.max_tokens,
        "timeout": settings.timeout_seconds, "image_max_side": settings.image_max_side, "client": getattr(client, "identity", None), **given,
    }
    return extract.run_fingerprint(whole)


def ingest(
    store: catalog.Catalog, client: extract.Client, candidates: DataFrame, contexts: DataFrame, pixels: DataFrame, crops: DataFrame, source_name: str, paper_id: str,
    settings: Settings, source_id: str | None = None, source_url: str | None = None, use_cache: bool = True, config: dict | None = None, pages: DataFrame | None = None,
) -> dict:
    """Extract, check and publish one source; returns the run's summary.

    candidates, contexts and pixels as of extract.run_extraction; crops has name and content of the
    files to publish (the crops by file name, and the source under source_name); pages has page and text, and lacks a
    single image's. The run folder is that of the paper and of source_fingerprint, so any change of the source or
    of what is asked starts anew. Nothing is published unless every candidate has a good extraction and no band comes
    twice. Files are published before the records that name them. Digests of the crops, judged results and band rows are each
    written once, beside the run, and removed at the end: all checks and what is published read them from there.
    """
    files.admit_source(source_name, source_url, source_id)
    if not paper_id.strip():
        raise ValueError("paper_id must not be blank")
    source_id, spark = source_id.strip() if source_id is not None else source_name, candidates.sparkSession
    if candidates.isEmpty():
        raise Incomplete("no candidate was found")
    slug = spark.range(1).select(T.run_slug(F.lit(paper_id))).first()[0]
    work = f"{settings.data_dir}/runs/{slug}/work-{uuid.uuid4().hex}"
    try:
        digests = extract.stored(crops.select("name", T.content_hash(F.col("content")).alias("content")), f"{work}/digests")
        fingerprint = source_fingerprint(candidates, contexts, digests, client, settings, paper_id=paper_id, source_id=source_id, source_url=source_url, config=config)
        run_dir = f"{settings.data_dir}/runs/{slug}/{fingerprint}"
        results, summary = extract.run_extraction(candidates, contexts, pixels, client, run_dir, use_cache=use_cache, longest=settings.image_max_side)
        judged = flatten.needs_retry(results).withColumn("extraction", F.to_json("extraction"))
        results = extract.stored(judged, f"{work}/results").withColumn("extraction", F.parse_json("extraction"))
        path = F.regexp_extract("candidate_path", r"([^/]+)$", 1)
        hashes = candidates.select("candidate_path", path.alias("name")).join(digests, "name").select("candidate_path", F.col("content").alias("image_sha256"))
        rows = with_provenance(validated_records(candidates, results, paper_id, source_name, hashes), source_id, settings.model_version, source_url)
        rows = extract.stored(rows, f"{work}/rows")
        if not catalog.duplicate_identities(rows, BAND).isEmpty():
            raise ValueError("a band comes twice; the catalog is kept")
        if pages is None:
            first = contexts.groupBy("candidate_path").agg(F.max_by("text_context", "line_no").alias("text"))
            pages = candidates.join(first, "candidate_path", "left").groupBy("page").agg(F.min("text").alias("text"))
        numbered = pages.select(F.col("page").cast("int").alias("page"), F.col("page").cast("int").alias("page_no"), "text")
        store.initialize()
        folder = publish_assets(crops, source_name, run_dir, numbered, results)
        relative = f"runs/{slug}/{fingerprint}/{folder}"
        n = store.replace(at_published(rows, relative, source_name), paper_id, source_id)
    finally:
        ledger.forget(spark, work)
    return {"paper_id": paper_id, "source_id": source_id, "source_url": source_url, "model_version": settings.model_version, "run_dir": run_dir, "published": relative, "database_rows": n, **summary.first().asDict()}
