"""Model extraction as resumable batches: cache, requests, split fallback, completeness, summaries."""

from __future__ import annotations

import hashlib
import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from urllib.error import HTTPError

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strict_json
from ..functions import values as V
from . import catalog, images, ledger
from .flatten import is_positive, merge_parts, needs_retry

Client = Callable[[str, str, str | None], str]  # request_path, text_context, image as data URL -> the model's answer
ATTEMPT = "candidate_path string, request_path string, stage string, part int, raw string, error_type string, error_message string, status_code int, response_url string, response_text string"
DEALT = 125  # requests, with their crops, of about one task where crops are large
MOST_DEALT, DEALT_BYTES, LEAST_TASKS = 4_000, 32 << 20, 64  # small crops: requests and pixels of a task, once there are so many tasks
SHOWN = 1200  # characters of an answer or a refusal that a failure keeps
SPLIT_NOTE = "Asked in two halves, because the request for the whole crop failed."
CACHE = "candidate_path string, paper_id string, page int, attempt_no long, extraction string"


def run_fingerprint(config: dict) -> str:
    """sha256 of the configuration as ASCII JSON with sorted keys; any change starts a new cache."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def with_context(candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """Candidates with their text context, empty where there is none; the last of equal paths counts."""
    last = contexts.groupBy("candidate_path").agg(F.max_by("text_context", "line_no").alias("text_context"))
    return candidates.join(last.hint("merge"), "candidate_path", "left").withColumn("text_context", F.coalesce("text_context", F.lit("")))


def latest_by_key(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, position).alias(value))


def latest_positive(cache: DataFrame) -> DataFrame:
    """The last positive extraction per file name: file_name, extraction."""
    name = F.regexp_extract("candidate_path", r"([^/]+)$", 1)
    return latest_by_key(cache.filter(is_positive(F.col("extraction"))).withColumn("file_name", name), "file_name", "extraction", "line_no")


def usable_cache(cache: DataFrame) -> DataFrame:
    """The last cached result of each candidate, where it needs no retry."""
    last = cache.groupBy("candidate_path").agg(F.max_by(F.struct("paper_id", "page", "extraction"), "line_no").alias("r")).select("candidate_path", "r.*")
    return needs_retry(last).filter(~F.col("needs_retry")).drop("needs_retry")


def resume(candidates: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results to reuse, and candidates that must be asked."""
    usable = usable_cache(cache)
    reused = candidates.select("candidate_path", "candidate_no").join(usable, "candidate_path")
    return reused, candidates.join(usable.select("candidate_path"), "candidate_path", "left_anti")


def error_fields(error: Exception) -> tuple:
    """error_type, error_message, status_code, response_url and the start of response_text of a failed request.

    The last three come from the error's response, or from the error itself where it is the response.
    """
    response = getattr(error, "response", None)
    if response is None and hasattr(error, "code"):
        response = error
    status = getattr(response, "status_code", getattr(response, "code", None))
    text = getattr(response, "text", None)
    return type(error).__name__, str(error), status, getattr(response, "url", None), text[:SHOWN] if text else None


def ask_model(requests: DataFrame, client: Client, kept_at: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """The raw answer or the error of each request; a failed request becomes a row, not a failed job.

    requests: candidate_path, text_context, and where they are there request_path, stage, part, data_url.
    With kept_at every answer is kept in that folder as it comes, and a task that runs again after a lost executor asks only
    what its predecessor had not written; known (request_key, raw) are answers of earlier runs, which are not asked again.
    Errors are not kept. A client must still be safe to call twice for a path; write the result before using it.
    """
    missing = {"request_path": F.col("candidate_path"), "stage": F.lit("full"), "part": F.lit(0), "data_url": F.lit(None).cast("string")}
    asked = requests.select("candidate_path", "text_context", *[F.col(c) if c in requests.columns else v.alias(c) for c, v in missing.items()])
    key = ledger.request_key(*(F.col(c) for c in ("request_path", "stage", "part", "text_context", "data_url")))
    asked = asked.withColumn("request_key", key if kept_at or known is not None else F.lit(None).cast("string"))
    asked = asked.join(known, "request_key", "left") if known is not None else asked.withColumn("raw", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ATTEMPT.split(", ")]
        keeper = ledger.Keeper(kept_at, TaskContext.get().partitionId()) if kept_at else None
        try:
            for pdf in batches:
                rows = []
                for path, context, request, stage, part, url, key, raw in zip(*(pdf[c] for c in ("candidate_path", "text_context", "request_path", "stage", "part", "data_url", "request_key", "raw")), strict=True):
                    if not isinstance(raw, str) and keeper:
                        raw = keeper.known.get(key)
                    try:
                        if not isinstance(raw, str):
                            raw = client(request, context, url)
                            if not isinstance(raw, str):
                                raise ValueError("the model's answer is not a text")
                            if keeper:
                                keeper.keep(key, raw)
                        rows.append((path, request, stage, part, raw, *[None] * 5))
                    except Exception as error:  # the failure log's row
                        rows.append((path, request, stage, part, None, *error_fields(error)))
                yield pd.DataFrame(rows, columns=names).astype({"status_code": "Int32"})
        finally:
            if keeper:
                keeper.flush()

    return asked.mapInPandas(run, ATTEMPT)


def request_body(model: str, prompt: str, schema: dict, text_context: str, data_url: str | None, max_tokens: int) -> dict:
    """A chat request for one crop: image and text, no randomness, no thinking, an answer held to the schema."""
    picture = [{"type": "image_url", "image_url": {"url": data_url}}] if data_url else []
    text = {"type": "text", "text": f"{prompt}\n\nText around the figure:\n{text_context}"}
    form = {"type": "json_schema", "json_schema": {"name": "figure_extraction", "schema": schema}}
    return {"model": model, "messages": [{"role": "user", "content": [*picture, text]}], "temperature": 0, "max_tokens": max_tokens, "chat_template_kwargs": {"enable_thinking": False}, "response_format": form}


def http_client(base_url: str, api_key: str, model: str, prompt: str, schema: dict, timeout: float = 300, max_tokens: int = 4096) -> Client:
    """A client of a chat-completions service; its identity names what shapes the answers. A refusal keeps the start of its body."""

    def ask(path: str, text_context: str, data_url: str | None) -> str:
        body = json.dumps(request_body(model, prompt, schema, text_context, data_url, max_tokens)).encode()
        headers = {"Authorization": f"Bearer {api_key}", "Content-Type": "application/json"}
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{base_url}/chat/completions", body, headers), timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except HTTPError as error:
            error.text = error.read(4 * SHOWN).decode("utf-8", "replace")
            raise

    ask.identity = {"model": model, "prompt": prompt, "schema": schema}
    return ask


def read_answer(raw: Column, shown: int = SHOWN) -> Column:
    """VARIANT of an answer; what is no object with a boolean flag becomes {"error": "invalid_extraction", "raw": its start}."""
    found = strict_json.model_json(raw)
    sound = V.is_object(found) & V.is_kind(V.field(found, "is_western_blot"), "BOOLEAN")
    refused = F.to_json(F.struct(F.lit("invalid_extraction").alias("error"), F.substring(raw, 1, shown).alias("raw")))
    return F.when(sound, found).otherwise(F.parse_json(refused))


def first_candidates(candidates: DataFrame, limit: int | None) -> DataFrame:
    """The first candidates in their order; the limit comes before anything cached is looked at."""
    return candidates if limit is None else candidates.orderBy("candidate_no").limit(limit)


def split_requests(failed: DataFrame, longest: int = 1800) -> DataFrame:
    """Requests for the halves of the large crops among the failed candidates (candidate_path, text_context and pixels)."""
    sized = images.model_images(images.crop_parts(failed, "text_context"), longest)
    return sized.select("candidate_path", "text_context", "part", "request_path", "data_url", F.lit("split").alias("stage"))


def judged_parts(attempts: DataFrame) -> DataFrame:
    """Attempts on parts with their extraction; an answer that would be asked again is a failure too."""
    read = attempts.withColumn("extraction", F.when(F.col("raw").isNotNull(), read_answer(F.col("raw"))))
    checked = needs_retry(read.select(F.col("request_path").alias("candidate_path"), F.lit(1).alias("page"), F.lit("").alias("paper_id"), "extraction"))
    bad = checked.filter("needs_retry").select(F.col("candidate_path").alias("request_path"), F.lit(True).alias("bad"))
    refused = F.col("error_type").isNull() & F.coalesce("bad", F.lit(False))
    joined = read.join(bad, "request_path", "left")
    return joined.withColumns({"error_type": F.when(refused, "ValueError").otherwise(F.col("error_type")), "error_message": F.when(refused, "the answer for this half is no valid extraction").otherwise(F.col("error_message"))}).drop("bad")


def extractions_of(full: DataFrame, parts: DataFrame) -> DataFrame:
    """candidate_path and extraction VARIANT from the attempts on whole crops and the judged ones on their parts.

    Where the whole failed and every part answered well, the parts are merged (no positive part: a
    negative extraction); otherwise an error with the messages of all attempts.
    """
    fine = full.filter("error_type IS NULL").select("candidate_path", read_answer(F.col("raw")).alias("extraction"))
    failed = full.filter("error_type IS NOT NULL").select("candidate_path", F.col("error_message").alias("first_message"))
    message = F.transform(F.array_sort(F.collect_list(F.when(F.col("error_type").isNotNull(), F.struct("part", "error_message")))), lambda e: e["error_message"])
    tried = parts.groupBy("candidate_path").agg(message.alias("messages"), F.transform(F.array_sort(F.collect_list(F.struct("part", "request_path"))), lambda p: p["request_path"]).alias("paths"))
    merged = merge_parts(parts.filter("error_type IS NULL").select(F.col("candidate_path").alias("key"), F.col("part").alias("part_no"), "request_path", "extraction"), SPLIT_NOTE)
    merged = merged.select(F.col("key").alias("candidate_path"), F.to_json("extraction").alias("merged"))
    joined = failed.join(tried, "candidate_path", "left").join(merged, "candidate_path", "left")
    none = F.to_json(F.struct(F.lit(False).alias("is_western_blot"), F.lit("None of the halves shows a blot.").alias("reason"), F.array(F.lit(SPLIT_NOTE)).alias("warnings"), F.col("paths").alias("split_candidate_paths")))
    whole = F.coalesce(F.size("paths") > 0, F.lit(False)) & (F.size("messages") == 0)
    error = F.to_json(F.struct(F.lit("vlm_request_failed").alias("error"), F.array_join(F.concat(F.array("first_message"), F.coalesce("messages", F.array().cast("array<string>"))), "; ").alias("message")))
    text = F.when(whole, F.coalesce("merged", none)).otherwise(error)
    return fine.unionByName(joined.select("candidate_path", F.parse_json(text).alias("extraction")))


def dealt_tasks(n: int, pixel_bytes: int) -> int:
    """Among how many tasks n requests with so many bytes of pixels are dealt: DEALT for each, more where crops are small.

    Rows are dealt twice, so blocks of a shuffle grow with the square of this number.
    """
    return max(1, min(-(-n // DEALT), max(LEAST_TASKS, -(-n // MOST_DEALT), -(-pixel_bytes // DEALT_BYTES))))


def stored(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """The rows written to path and read from there, so that what made them runs once."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_run_cache(spark, run_dir: str) -> DataFrame:
    """What earlier runs appended: candidate_path, paper_id, page, line_no (the attempt) and extraction VARIANT."""
    path = f"{run_dir}/extractions"
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.select("candidate_path", "paper_id", "page", F.col("attempt_no").alias("line_no"), F.parse_json("extraction").alias("extraction"))


def run_extraction(candidates: DataFrame, contexts: DataFrame, pixels: DataFrame, client: Client, run_dir: str, limit: int | None = None, use_cache: bool = True, longest: int = 1800, wave: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Ask the model about every candidate without a usable cached result; results and a one-row summary.

    candidates: candidate_no, candidate_path, paper_id, page; contexts: candidate_path, text_context,
    line_no; pixels: candidate_path, width_px, height_px, bgr. What must be asked is written once with its context and
    crop, a folder for each wave, so a wave reads its own crops only; the first wave has wave requests, each further one twice
    as many, so their number hardly grows. Each wave's results are appended to run_dir/extractions and its failures to
    run_dir/failures before the next begins. Within a wave every task keeps its answers in run_dir/answers as they come, until
    the wave is appended; so a stopped run goes on with the candidate at which it stopped. Without use_cache all three start
    empty. Repeated candidate paths are asked once. Rows with pixels are dealt by number and joined by merging: blank areas
    shrink so far in a shuffle that Spark would take such rows for a small table, gather them in few tasks or broadcast them.
    Their bytes are known from width_px and height_px, which are summed first. A wave without a failed request asks for no halves.
    Answers, which shrink as far, are joined by merging too.
    """
    spark = candidates.sparkSession
    chosen = first_candidates(candidates.dropDuplicates(["candidate_path"]), limit)
    if not use_cache:
        stored(spark.createDataFrame([], CACHE), f"{run_dir}/extractions")
        stored(spark.createDataFrame([], ATTEMPT), f"{run_dir}/failures")
        ledger.forget(spark, f"{run_dir}/answers")
    else:
        stored(spark.createDataFrame([], ATTEMPT), f"{run_dir}/failures", "append")  # there even if nothing fails
    known = ledger.known_answers(spark, f"{run_dir}/answers")
    cache = read_run_cache(spark, run_dir)
    last = cache.agg(F.coalesce(F.max("line_no"), F.lit(0))).first()[0]
    usable = usable_cache(cache).select("candidate_path")
    cached = chosen.join(usable, "candidate_path", "left_semi").count()
    todo = catalog.numbered(chosen.join(usable, "candidate_path", "left_anti"), ["candidate_no", "candidate_path"], "place")
    work = f"{run_dir}/work/{uuid.uuid4().hex}"
    todo = stored(with_context(todo, contexts), f"{work}/asked")
    n = todo.count()
    blocks = -(-n // wave)
    pixel_bytes = pixels.agg(F.coalesce(F.sum(F.col("width_px").cast("long") * F.col("height_px") * 3), F.lit(0))).first()[0]
    dealt = dealt_tasks(n, pixel_bytes)
    shots = pixels.select("candidate_path", "width_px", "height_px", "bgr").repartition(dealt, "candidate_path")
    crops = todo.repartition(dealt, "candidate_path").join(shots.hint("merge"), "candidate_path", "left")
    cut = crops.withColumn("wave", F.expr(f"length(bin((place - 1) div {wave} + 1)) - 1"))
    cut = cut.repartition(dealt, "wave", F.pmod(F.xxhash64("candidate_path"), F.expr(f"least({dealt}, greatest(1, shiftleft({wave}L, wave) div {DEALT}))")))
    cut.write.partitionBy("wave").parquet(f"{work}/todo")
    for k in range(blocks.bit_length()):
        kept_at = f"{run_dir}/answers/{uuid.uuid4().hex}"
        own = spark.read.schema(crops.schema).parquet(f"{work}/todo/wave={k}")
        full = stored(ask_model(images.model_images(own, longest), client, f"{kept_at}/full", known), f"{work}/full-{k}")
        refused = full.filter("error_type IS NOT NULL")
        if refused.isEmpty():
            answers = full.select("candidate_path", read_answer(F.col("raw")).alias("extraction"))
        else:
            failed = own.join(refused.select("candidate_path"), "candidate_path", "left_semi")
            parts = stored(ask_model(split_requests(failed, longest), client, f"{kept_at}/parts", known), f"{work}/parts-{k}")
            judged = judged_parts(parts)
            answers = extractions_of(full, judged)
            refused.unionByName(judged.filter("error_type IS NOT NULL").drop("extraction")).write.mode("append").parquet(f"{run_dir}/failures")
        rows = answers.hint("merge").join(own.select("candidate_path", "paper_id", "page", "place"), "candidate_path")
        rows.select("candidate_path", "paper_id", "page", (F.col("place") + last).alias("attempt_no"), F.to_json("extraction").alias("extraction")).write.mode("append").parquet(f"{run_dir}/extractions")
        ledger.forget(spark, kept_at)
    for folder in [work, *([f"{run_dir}/answers"] if limit is None else [])]:
        ledger.forget(spark, folder)
    latest = read_run_cache(spark, run_dir).groupBy("candidate_path").agg(F.max_by(F.struct("paper_id", "page", F.to_json("extraction").alias("extraction")), "line_no").alias("r"))
    results = chosen.select("candidate_no", "candidate_path").join(latest.hint("merge"), "candidate_path").select("candidate_no", "candidate_path", "r.paper_id", "r.page", F.parse_json("r.extraction").alias("extraction"))
    checked = needs_retry(results)
    counts = checked.agg(F.count("*").alias("results"), F.count_if(is_positive(F.col("extraction"))).alias("positive_results"), F.count_if("needs_retry").alias("failed_candidates"))
    summary = counts.select(F.lit(cached + n).alias("candidates"), "*", F.lit(cached).alias("cached"), F.lit(n).alias("queried"))
    return results, summary


def completeness_faults(results: DataFrame, expected: DataFrame, key: str = "candidate_path") -> DataFrame:
    """key and fault of each breach of a one-to-one match: missing, unexpected or repeated."""
    got = results.groupBy(F.col(key).alias("_got")).agg(F.count("*").alias("_n"))
    wanted = expected.select(F.col(key).alias("_want")).distinct()
    fault = F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return got.join(wanted, F.col("_got") == F.col("_want"), "full_outer").select(F.coalesce("_want", "_got").alias(key), fault.alias("fault")).filter("fault IS NOT NULL")


def foreign_papers(results: DataFrame, paper_id: str) -> DataFrame:
    return results.filter(~F.col("paper_id").eqNullSafe(paper_id))


def run_summary(candidates: DataFrame, results: DataFrame, reused: DataFrame, positive: Column, failed: Column) -> DataFrame:
    """One row: candidates, results, positive_results, failed_candidates, cached, queried."""
    of_results = results.agg(F.count("*").alias("results"), F.count_if(positive).alias("positive_results"), F.count_if(failed).alias("failed_candidates"))
    counted = candidates.agg(F.count("*").alias("candidates")).crossJoin(of_results).crossJoin(reused.agg(F.count("*").alias("cached")))  # one row each
    return counted.withColumn("queried", F.col("results") - F.col("cached"))
