"""Extraction runs, the gate before publishing, ingestion, record detail, streaming publication."""

import hashlib
import json
import threading
import uuid
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import pixels
from bandloom.operators import catalog, detail, extract, flatten, ingest, ledger
from bandloom.operators.settings import Settings
from bandloom.sources import assets, files
from bandloom.streaming import publish

BLOT = {"is_western_blot": True, "figure_label": "Figure 1", "figure_caption": "cap", "bands": [{"target": "AKT", "row_index": 1, "lane_index": 1, "band_state": "present"}], "warnings": ["w"]}


def answers(path, context, data_url):
    """Good for a, negative for b, never for the whole of c but for its parts, never for d; nonsense for e."""
    stem = path.rsplit("/", 1)[1].split(".")[0]
    assert data_url.startswith("data:image/png;base64,") and context == f"about {stem[0]}"
    if stem == "a":
        return json.dumps(BLOT)
    if stem == "b":
        return 'Here: {"is_western_blot": false}'
    if stem.startswith("c_part"):
        return json.dumps({**BLOT, "panel_label": stem[-1]})
    if stem == "e":
        return "[1]"
    raise TimeoutError(f"no answer for {stem}")


def setup(spark, names, large=("c",)):
    rows = [(i, f"runs/r/panel_candidates/{n}.png", "p", i + 1) for i, n in enumerate(names)]
    candidates = spark.createDataFrame(rows, "candidate_no int, candidate_path string, paper_id string, page int")
    contexts = spark.createDataFrame([(r[1], f"{word} {names[i]}", k) for i, r in enumerate(rows) for k, word in enumerate(("old", "about"))], "candidate_path string, text_context string, line_no int")
    shots = []
    for i, n in enumerate(names):
        h, w = (1300, 900) if n in large else (20, 30)
        shots.append((rows[i][1], w, h, np.full((h, w, 3), i, np.uint8).tobytes()))
    return candidates, contexts, spark.createDataFrame(shots, "candidate_path string, width_px int, height_px int, bgr binary")


def test_extraction_run_splits_resumes_and_logs(spark, tmp_path):
    candidates, contexts, shots = setup(spark, "abcde")
    results, summary = extract.run_extraction(candidates, contexts, shots, answers, str(tmp_path), wave=2)
    got = {r.candidate_path[-5]: json.loads(r.e) for r in results.select("candidate_path", F.to_json("extraction").alias("e")).collect()}
    assert got["a"]["is_western_blot"] and got["b"] == {"is_western_blot": False}
    assert [p["panel_label"] for p in got["c"]["panels"]] == ["1", "2"] and got["c"]["warnings"] == ["w", "w", extract.SPLIT_NOTE] and got["c"]["figure_caption"] == "cap"
    assert got["c"]["split_candidate_paths"] == [f"runs/r/vlm_panel_splits/c_part_0{k}.png" for k in (1, 2)]
    assert got["d"] == {"error": "vlm_request_failed", "message": "no answer for d"} and got["e"] == {"error": "invalid_extraction", "raw": "[1]"}
    assert summary.first().asDict() == {"candidates": 5, "results": 5, "positive_results": 2, "failed_candidates": 2, "cached": 0, "queried": 5}
    failures = spark.read.parquet(f"{tmp_path}/failures").collect()
    assert sorted((r.request_path[-5:], r.stage, r.error_type) for r in failures) == [("c.png", "full", "TimeoutError"), ("d.png", "full", "TimeoutError")]

    def patient(path, context, data_url):
        assert path[-5] in "de"
        return '{"is_western_blot": false}'

    results, summary = extract.run_extraction(candidates, contexts, shots, patient, str(tmp_path), wave=10)
    assert summary.first().asDict() == {"candidates": 5, "results": 5, "positive_results": 2, "failed_candidates": 0, "cached": 3, "queried": 2}
    _, summary = extract.run_extraction(candidates, contexts, shots, answers, str(tmp_path), limit=2)
    assert summary.first().asDict() == {"candidates": 2, "results": 2, "positive_results": 1, "failed_candidates": 0, "cached": 2, "queried": 0}
    _, summary = extract.run_extraction(candidates, contexts, shots, answers, str(tmp_path), limit=1, use_cache=False)
    assert summary.first().queried == 1 and spark.read.parquet(f"{tmp_path}/extractions").count() == 1


def test_parts_must_all_answer_well(spark, tmp_path):
    def half(path, context, data_url):
        if "part_01" in path:
            return json.dumps(BLOT)
        return '{"is_western_blot": true}' if "part_02" in path else 1 / 0

    candidates, contexts, shots = setup(spark, "c")
    results, _ = extract.run_extraction(candidates, contexts, shots, half, str(tmp_path))
    assert json.loads(results.select(F.to_json("extraction")).first()[0]) == {"error": "vlm_request_failed", "message": "division by zero; the answer for this half is no valid extraction"}
    negative = extract.run_extraction(candidates, contexts, shots, lambda p, c, u: '{"is_western_blot": false}' if "part" in p else 1 / 0, str(tmp_path / "n"))[0]
    found = json.loads(negative.select(F.to_json("extraction")).first()[0])
    assert found["is_western_blot"] is False and found["warnings"] == [extract.SPLIT_NOTE] and len(found["split_candidate_paths"]) == 2


def test_merged_parts_flatten(spark):
    own = {"is_western_blot": True, "panel_label": "Z", "organism": "", "bands": [{"target": "x"}], "reason": "dropped"}
    listed = {"is_western_blot": True, "organism": "mouse", "panels": [{"panel_label": "B", "bands": [{"target": "y"}]}, 3]}
    rows = [(1, k, json.dumps(e)) for k, e in enumerate((own, {"is_western_blot": False}, listed))] + [(2, 0, '{"is_western_blot": false}')]
    merged = flatten.merge_parts(spark.createDataFrame(rows, "key int, part_no int, j string").withColumn("extraction", F.parse_json("j")))
    flat = flatten.flatten_records(merged.select(F.col("key").alias("figure_no"), F.lit("p").alias("paper_id"), F.lit("a/b.png").alias("candidate_path"), F.lit(1).alias("page"), "extraction"))
    assert [(r.panel_label, r.target, r.organism) for r in flat.orderBy("panel_no").collect()] == [("Z", "x", "mouse"), ("B", "y", "mouse")]
    assert json.loads(merged.select(F.to_json("extraction")).first()[0])["panels"][0] == {"panel_label": "Z", "bands": [{"target": "x"}]}


def test_error_fields_and_request():
    class Response(Exception):
        response = type("R", (), {"status_code": 503, "url": "http://m", "text": "x" * 2000})

    assert extract.error_fields(Response("busy")) == ("Response", "busy", 503, "http://m", "x" * 1200)
    assert extract.error_fields(ValueError("v")) == ("ValueError", "v", None, None, None)
    body = extract.request_body("m", "prompt", {"type": "object"}, "ctx", "data:x", 7)
    assert body["messages"][0]["content"][1]["text"] == "prompt\n\nText around the figure:\nctx" and body["temperature"] == 0 and body["max_tokens"] == 7


def ingested(spark, tmp_path, client, names="ab", **more):
    store = catalog.Catalog(spark, str(tmp_path / "catalog"))
    candidates, contexts, shots = setup(spark, names)
    crops = spark.createDataFrame([(f"{n}.png", bytearray(n.encode())) for n in names], "name string, content binary")
    settings = Settings(data_dir=str(tmp_path / "data"), model="m", model_revision="7")
    return store, ingest.ingest(store, client, candidates, contexts, shots, crops, "paper.pdf", "p", settings, source_id=" s ", source_url="https://x.org/1", **more)


def test_ingestion_publishes_once_complete(spark, tmp_path):
    store, out = ingested(spark, tmp_path, answers)
    assert out["database_rows"] == 1 and out["positive_results"] == 1 and out["model_version"] == "m@7"
    row = store.rows().first()
    assert (row.source_id, row.model_version, row.source_url, row.target) == ("s", "m@7", "https://x.org/1", "AKT")
    assert row.candidate_key.endswith("-a") and len(row.candidate_key) == 18 and row.image_sha256 == hashlib.sha256(b"a").hexdigest()
    assert row.candidate_path.endswith("/panel_candidates/a.png") and row.source_pdf.endswith("/paper.pdf") and row.candidate_path.startswith(out["published"])
    assert {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{tmp_path}/data/{out['published']}/panel_candidates").collect()} == {"a.png": b"a", "b.png": b"b"}
    before = store.version()
    with pytest.raises(ingest.Incomplete):
        ingested(spark, tmp_path, answers, names="abd", config={"another": 1})
    twice = {**BLOT, "bands": BLOT["bands"] * 2}
    with pytest.raises(ValueError, match="twice"):
        ingested(spark, tmp_path, lambda *_: json.dumps(twice), config={"another": 2})
    assert store.version() == before


def test_another_source_or_question_starts_anew(spark, tmp_path):
    """Other crop bytes under the same names, another prompt, or another option never meet old answers; the same meet theirs."""
    blot = lambda target: lambda *_: json.dumps({**BLOT, "bands": [{**BLOT["bands"][0], "target": target}]})
    store, first = ingested(spark, tmp_path, blot("OLD"), names="a")
    _, again = ingested(spark, tmp_path, blot("UNASKED"), names="a")
    assert again["run_dir"] == first["run_dir"] and (again["cached"], again["queried"]) == (1, 0) and store.rows().first().target == "OLD"
    candidates, contexts, shots = setup(spark, "a")
    settings = Settings(data_dir=str(tmp_path / "data"), model="m", model_revision="7")
    crops = lambda body: spark.createDataFrame([("a.png", bytearray(body)), ("paper.pdf", bytearray(b"%PDF"))], "name string, content binary")
    asked = blot("NEW")
    call = lambda body=b"other", client=asked, options=settings, about=contexts: ingest.ingest(store, client, candidates, about, shots, crops(body), "paper.pdf", "p", options, source_id="s")
    changed = call()
    row = store.rows().first()
    assert changed["queried"] == 1 and row.target == "NEW" and row.image_sha256 == hashlib.sha256(b"other").hexdigest()
    prompted = blot("NEW")
    prompted.identity = {"prompt": "p2"}
    keys = {out["run_dir"] for out in (first, changed)}
    for given in ({"client": prompted}, {"options": Settings(data_dir=str(tmp_path / "data"), model="m", model_revision="7", pdf_dpi=100)}, {"about": contexts.withColumn("text_context", F.concat("text_context", F.lit("!")))}):
        keys.add(f"{settings.data_dir}/runs/p/{ingest.source_fingerprint(candidates, given.get('about', contexts), crops(b'other'), given.get('client', asked), given.get('options', settings), paper_id='p', source_id='s', source_url=None, config=None)}")
    assert len(keys) == 5
    # What was published stays as it was, and every stored path leads to its file.
    assert (tmp_path / "data" / first["published"] / "panel_candidates" / "a.png").read_bytes() == b"a"
    assert detail.safe_image_path(row.candidate_path, settings.data_dir).read_bytes() == detail.record_image(store.rows(), row.id, settings.data_dir) == b"other"
    assert (tmp_path / "data" / row.source_pdf).read_bytes() == b"%PDF"
    shown = detail.published_detail(store.rows(), settings.data_dir).first()
    assert (shown.image_url, shown.figure_caption, shown.warnings) == (f"/api/records/{row.id}/image", "cap", ["w"])
    assert detail.record_image(store.rows(), -1, settings.data_dir) is None


def test_files_are_published_whole(spark, tmp_path):
    files_ = spark.createDataFrame([("a/b.png", bytearray(b"1")), ("c", None)], "name string, content binary")
    name = assets.publish_folder(files_, {"t": spark.range(3)}, str(tmp_path))
    assert (tmp_path / name / "a" / "b.png").read_bytes() == b"1" and (tmp_path / name / "c").read_bytes() == b"" and spark.read.parquet(f"{tmp_path}/{name}/t").count() == 3
    for bad in ("../x", "/x", "a//b", "a/./b", ".hidden", "", "a\0"):
        with pytest.raises(ValueError):
            assets.write_files(spark.createDataFrame([(bad, bytearray(b""))], "name string, content binary"), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        assets.write_files(files_.unionByName(files_), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    rows = spark.createDataFrame([(1, bytearray(b"x")), (2, None)], "a int, b binary")
    assert assets.rows_digest(rows, ["a", "b"]) == assets.rows_digest(rows.orderBy(F.desc("a")), ["a", "b"]) != assets.rows_digest(rows.withColumn("b", F.lit(None).cast("binary")), ["a", "b"])
    assert assets.rows_digest(rows.limit(0), ["a"]) == "0:0:0:0:0"


def test_a_refusal_keeps_its_body():
    class Refuse(BaseHTTPRequestHandler):
        def do_POST(self):
            self.send_response(503)
            self.end_headers()
            self.wfile.write(b"busy " * 1000)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Refuse)
    threading.Thread(target=server.handle_request, daemon=True).start()
    client = extract.http_client(f"http://127.0.0.1:{server.server_port}/v1", "k", "m", "prompt", {})
    with pytest.raises(Exception) as error:
        client("a.png", "ctx", None)
    kind, _, status, url, text = extract.error_fields(error.value)
    assert (kind, status, text) == ("HTTPError", 503, ("busy " * 1000)[:1200]) and url.endswith("/chat/completions")
    assert client.identity["prompt"] == "prompt"
    server.server_close()


def test_a_run_reads_each_crop_once_and_goes_on(spark, tmp_path):
    """A client that dies in the second wave costs that wave only: the first one's answers are there."""
    candidates, contexts, shots = setup(spark, "aqrst", large=())
    log = tmp_path / "asked"
    log.mkdir()

    def model(path, context, data_url):
        if path[-5] in "st" and not (log / "ready").exists():
            raise SystemExit("killed")
        (log / f"{path[-5]}{len(list(log.iterdir()))}").touch()
        return '{"is_western_blot": false}'

    with pytest.raises(Exception):  # noqa: B017, PT011
        extract.run_extraction(candidates, contexts, shots, model, str(tmp_path / "run"), wave=3)
    (log / "ready").touch()
    results, summary = extract.run_extraction(candidates, contexts, shots, model, str(tmp_path / "run"), wave=3)
    assert summary.first().asDict() == {"candidates": 5, "results": 5, "positive_results": 0, "failed_candidates": 0, "cached": 3, "queried": 2}
    assert sorted(p.name[0] for p in log.iterdir() if p.name != "ready") == list("aqrst")


def test_answers_outlive_a_killed_wave(spark, tmp_path):
    """All candidates in one wave: what was answered before a client died is not asked again, and nothing is left behind."""
    candidates, contexts, shots = setup(spark, "abcqrstu", large=("c",))
    log = tmp_path / "asked"
    log.mkdir()

    def model(path, context, data_url):
        stem = path.rsplit("/", 1)[1].split(".")[0]
        if stem in ("c_part_02", "u") and not (log / "ready").exists():
            raise SystemExit("killed")
        (log / f"{stem}-{uuid.uuid4().hex}").touch()
        if stem == "c":
            raise TimeoutError("too large")
        return '{"is_western_blot": false}'

    run_dir = str(tmp_path / "run")
    with pytest.raises(Exception):  # noqa: B017, PT011
        extract.run_extraction(candidates, contexts, shots, model, run_dir)
    assert ledger.known_answers(spark, f"{run_dir}/answers").count() > 0
    (log / "ready").touch()
    _, summary = extract.run_extraction(candidates, contexts, shots, model, run_dir)
    assert summary.first().asDict() == {"candidates": 8, "results": 8, "positive_results": 0, "failed_candidates": 0, "cached": 0, "queried": 8}
    asked = Counter(p.name.split("-")[0] for p in log.iterdir() if p.name != "ready")
    assert asked.pop("c") in (1, 2) and asked == dict.fromkeys([*"abqrstu", "c_part_01", "c_part_02"], 1)  # an error is asked again
    assert not (tmp_path / "run" / "answers").exists()


def test_a_keeper_knows_its_predecessor(spark, tmp_path):
    folder = str(tmp_path / "answers")
    first = ledger.Keeper(folder, 3, seconds=0)
    first.keep("k1", "line\n\u2028\"é")
    first.keep("k2", "")
    slow = ledger.Keeper(folder, 13, seconds=1000)
    slow.keep("k3", "lost")  # its task is lost before the file is written
    (tmp_path / "answers" / ".task-3-torn.json").write_text('{"request_key": "k4", "ra')
    assert ledger.Keeper(folder, 3).known == {"k1": "line\n\u2028\"é", "k2": ""} and ledger.Keeper(folder, 13).known == {}
    kept = {r.request_key: r.raw for r in ledger.known_answers(spark, folder).collect()}
    assert kept == {"k1": "line\n\u2028\"é", "k2": ""} and ledger.known_answers(spark, f"{folder}-none") is None
    key = lambda *parts: spark.range(1).select(ledger.request_key(*(F.lit(p).cast("string") for p in parts))).first()[0]
    assert key("a", None) != key("a", "") != key(None, "a") and key("a", "b") == key("a", "b")


def test_gate(spark):
    candidates, _, _ = setup(spark, "ab")
    hashes = candidates.select("candidate_path", F.lit("h").alias("image_sha256"))
    good = candidates.withColumn("extraction", F.parse_json(F.lit(json.dumps(BLOT))))
    assert ingest.validated_records(candidates, good, "p", "s.pdf", hashes).count() == 2
    for bad, error in ((good.limit(1), ingest.Incomplete), (good.unionByName(good), ingest.Incomplete), (good.withColumn("extraction", F.parse_json(F.lit('{"error": "x"}'))), ingest.Incomplete), (good.withColumn("paper_id", F.lit("q")), ValueError)):
        with pytest.raises(error):
            ingest.validated_records(candidates, bad, "p", "s.pdf", hashes)
    with pytest.raises(ValueError, match="missing"):
        ingest.validated_records(candidates, good, "p", "s.pdf", hashes.limit(1))


def test_preprocessing(spark, tmp_path):
    page = np.full((1000, 1200, 3), 255, np.uint8)
    for k in range(4):
        for lane in range(5):
            page[300 + 60 * k : 320 + 60 * k, 400 + 80 * lane : 450 + 80 * lane] = 40
    rows = [("stem", 1, "First page of breast cells. Figure 1 shows it. doi:10.1234/abc.", 1200, 1000, page.tobytes()), ("stem", 2, "Second.", 1200, 1000, None)]
    pages = spark.createDataFrame(rows, "paper_id string, page int, text string, width_px int, height_px int, bgr binary")
    found, good, contexts = ingest.preprocess(pages, Settings(), "given first", str(tmp_path))
    assert sorted(map(repr, ingest.preprocess(pages, Settings())[0].collect())) == sorted(map(repr, found.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the pixels were worked through before
    assert ingest.preprocess_summary(pages, found, good, contexts).first().asDict() == {"pages": 2, "candidate_count": 1, "llm_candidate_count": 1, "contexts_written": 1}
    text = contexts.first().text_context
    assert text.startswith("given first\n\n\nPAPER_ID: stem\nCROP_PAGE: 1\nCROP_BBOX_PAGE: [138, 218, ") and "--- PAGE 2 ---\nSecond." in text and "LIKELY_FIGURE_OR_CAPTION_CONTEXT:\n--- PAGE 1" in text and "\n- " in text
    assert ingest.paper_doi(pages).first().doi == "10.1234/abc"
    picture = spark.createDataFrame([("a.png", [0, 0, 2, 2], [0, 0, 2, 2], 2, 2, bytearray(12))], "candidate_path string, bbox_page array<int>, tight_bbox_page array<int>, width_px int, height_px int, bgr binary")
    one, about = ingest.single_image(picture, "p", "ctx")
    assert (one.first().cv_score, one.first().page, about.first().text_context) == (1.0, 1, "ctx")


def test_record_detail(spark):
    pages = spark.createDataFrame([("runs/r", 4, 0, "It rose. Figure 2 shows it. The end.")], "run string, page int, page_no int, text string")
    answer = lambda caption, positive=True: json.dumps({"is_western_blot": positive, "figure_caption": caption, "warnings": ["w", 1]})
    cache = [("runs/r", "/x/a.png", 1, answer("old")), ("runs/r", "y/a.png", 2, answer("new")), ("runs/r", "a.png", 3, answer("no", False)), ("runs/q", "a.png", 9, answer("other run"))]
    cache = spark.createDataFrame(cache, "run string, candidate_path string, line_no int, j string").withColumn("extraction", F.parse_json("j"))
    rows = [(1, "10.1234/x", "runs/r/panel_candidates/a.png", "Figure 2", "https://x.org"), (2, "p", "runs/../a.png", "Figure 2", "file:///x"), (3, "p", None, None, None)]
    given = spark.createDataFrame(rows, "id long, paper_id string, candidate_path string, figure_label string, source_url string").withColumn("page", F.lit(4))
    out = {r.id: r for r in detail.record_detail(spark.createDataFrame([], catalog.SCHEMA).unionByName(given, allowMissingColumns=True), cache, pages).collect()}
    assert (out[1].image_url, out[1].figure_caption, out[1].warnings, out[1].doi, out[1].source_url) == ("/api/records/1/image", "new", ["w", "1"], "10.1234/x", "https://x.org")
    assert out[1].paper_context == "It rose. Figure 2 shows it. The end."
    for k in (2, 3):
        assert (out[k].image_url, out[k].figure_caption, out[k].warnings, out[k].paper_context, out[k].source_url) == (None, "", [], "", None)
    assert "candidate_path" not in out[1].asDict()


def test_safe_image_path(tmp_path):
    runs = tmp_path / "runs" / "r"
    runs.mkdir(parents=True)
    (runs / "a.png").write_bytes(b"x")
    (runs / "a.txt").write_bytes(b"x")
    (tmp_path / "out.png").write_bytes(b"x")
    (runs / "link.png").symlink_to(tmp_path / "out.png")
    for good in ("runs/r/a.png", "r/a.png", str(runs / "a.png")):
        assert detail.safe_image_path(good, str(tmp_path)) == (runs / "a.png").resolve()
    for bad in (None, "", "r/a.txt", "r/none.png", "../out.png", "r/link.png", str(tmp_path / "out.png"), "r", "\0"):
        assert detail.safe_image_path(bad, str(tmp_path)) is None


def test_settings():
    assert Settings.from_env({"BANDLOOM_PDF_DPI": "72", "BANDLOOM_MODEL": "x"}, pdf_dpi=100).pdf_dpi == 100
    assert Settings(model="a", model_revision="b", model_base_url="https://h/v1/").model_version == "a@b" and Settings(model_base_url="https://h/v1/").model_base_url == "https://h/v1"
    for bad in ({"pdf_dpi": 71}, {"min_model_score": 1.1}, {"timeout_seconds": 0}, {"max_tokens": 0}, {"model_base_url": "ftp://x"}, {"model": ""}, {"timeout_seconds": float("nan")}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert "secret" not in repr(Settings(api_key="secret"))


def test_two_writers_and_a_stream(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    store.initialize()
    with pytest.raises(RuntimeError, match="another writer"):
        store._log({"top": 0, "folders": {}}, 0)
    rows = [("p", f"k{i}", 1, "AKT", False, "total_protein", f"s{i % 2}") for i in range(6)]
    schema = "paper_id string, candidate_key string, page int, target string, is_loading_control boolean, western_blot_type string, source_id string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    version = store.version()
    publish.publish_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    assert store.rows().count() == 6 and store.version() == version + 1
    with pytest.raises(ValueError, match="two sources"):
        both = spark.createDataFrame([(*rows[0][:6], "s8"), (*rows[0][:6], "s9")], schema).withColumn("candidate_key", F.lit("new"))
        store.replace_batch(both, both.select("paper_id", "source_id").distinct())


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"candidate_path": "a"}, {"candidate_path": "b"}]')
    assert files.read_manifest(spark, str(tmp_path / "m.json"), "candidate_path string").count() == 2
    (tmp_path / "c.jsonl").write_text('{"candidate_path": "a", "text_context": "old"}\n\n{"candidate_path": "a", "text_context": "new"}\n')
    assert [tuple(r) for r in files.read_contexts(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", "new")]
    (tmp_path / "i.png").write_bytes(pixels.png(np.full((4, 6, 3), 9, np.uint8)))
    image = files.read_images(spark, str(tmp_path / "i.png"), "p").first()
    assert (image.width_px, image.height_px, image.cv_score, bytes(image.bgr[:3])) == (6, 4, 1.0, b"\x09\x09\x09")
    files.write_json_lines(spark.range(2), str(tmp_path / "out"))
    files.write_json_lines(spark.range(2), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    for bad in (("x.gif",), ("x.pdf", "ftp://h"), ("x.pdf", None, " ")):
        with pytest.raises(ValueError):
            files.admit_source(*bad)
    with pytest.raises(FileNotFoundError):
        files.admit_source("x.pdf", path=str(tmp_path / "none.pdf"))
    pages = files.read_pages(spark, str(tmp_path / "i.png"), lambda content, scale: [("text", 1, int(72 * scale), b"abc"), ("more", 3, 4, None)], dpi=144)
    assert [(r.page, r.text, r.height_px, r.image_path, r.bgr) for r in pages.collect()] == [(1, "text", 144, None, bytearray(b"abc")), (2, "more", 4, None, None)]
    plain = (tmp_path / "i.png").read_bytes()
    (tmp_path / "moving.png").write_bytes(plain[:33] + b"\0\0\0\0acTL" + plain[33:])
    (tmp_path / "text.png").write_bytes(b"no image")
    (tmp_path / "still.png").write_bytes(plain + b"acTL")
    assert files.read_images(spark, str(tmp_path / "still.png"), "p").first().width_px == 6
    for bad in ("moving.png", "text.png"):
        with pytest.raises(ValueError, match="one frame"):
            files.read_images(spark, str(tmp_path / bad), "p")
    (tmp_path / "cut.jsonl").write_bytes(b'{"candidate_path": "a.png", "extraction": {"is_western_blot": true}}\n{"candidate_path": "\xe6')
    assert [r.file_name for r in files.latest_positive(spark, str(tmp_path / "cut.jsonl")).collect()] == ["a.png"]
    assert files.positive_results(files.read_cache(spark, str(tmp_path / "cut.jsonl"))).count() == 1
    (tmp_path / "bad.jsonl").write_text("not json\n")
    assert files.latest_positive(spark, str(tmp_path / "bad.jsonl")).count() == 0


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """The same rows, numbers, torn tail and first bad line as of the file in one piece; blank lines count; several files."""
    lines = [json.dumps({"candidate_path": f"{k}.png", "text_context": "é" * (k % 50), "extraction": {"is_western_blot": k % 2 == 0}}, ensure_ascii=False) if k % 7 else "" for k in range(1, 401)]
    body = "\n".join(lines).encode()
    (tmp_path / "a.jsonl").write_bytes(body + b'\n{"candidate_path": "\xe6')
    (tmp_path / "b.jsonl").write_bytes(body + b"\n")
    (tmp_path / "c.jsonl").write_bytes(body)
    (tmp_path / "d.jsonl").write_bytes(b"")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            for name, tail, closed in (("a", ['{"candidate_path": "\ufffd'], False), ("b", [], True), ("c", [], False)):
                got = files.numbered_lines(spark, str(tmp_path / f"{name}.jsonl")).orderBy("line_no").collect()
                assert [r.line_no for r in got] == list(range(1, len(lines) + len(tail) + 1)) and [r.line for r in got][:400] == lines
                assert [r.closed for r in got] == [True] * (len(got) - 1) + [closed]
            assert files.numbered_lines(spark, str(tmp_path / "[abc].jsonl")).groupBy("path").count().count() == 3
            assert files.numbered_lines(spark, str(tmp_path / "d.jsonl")).count() == 0
            cache = files.read_cache(spark, str(tmp_path / "a.jsonl")).collect()
            assert sorted(r.line_no for r in cache) == [k for k in range(1, 401) if k % 7]
            (tmp_path / "e.jsonl").write_bytes(body[: body.index(b"\n300") if b"\n300" in body else 9000].rsplit(b"\n", 1)[0] + b"\nnot json\n{}\n")
            bad = (tmp_path / "e.jsonl").read_bytes().split(b"\n").index(b"not json") + 1
            with pytest.raises(ValueError, match=f"line {bad} "):
                files.read_cache(spark, str(tmp_path / "e.jsonl"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pages_by_ranges(spark, tmp_path):
    """A long document in many tasks, its images written; the same pages as by one task; no pixels where none are wanted."""
    (tmp_path / "long.bin").write_bytes(bytes([37]))
    (tmp_path / "none.bin").write_bytes(bytes([0]))
    page = lambda k: (f"page {k}", 2, 1, bytes([k] * 6))
    ranged = files.read_pages(spark, str(tmp_path / "*.bin"), lambda content, scale, first, last: map(page, range(first, last + 1)), count=lambda content: content[0], at_once=5, image_dir=str(tmp_path / "images"))
    got = sorted(ranged.collect(), key=lambda r: r.page)
    assert [(r.page, r.text, bytes(r.bgr)) for r in got] == [(k, f"page {k}", bytes([k] * 6)) for k in range(1, 38)]
    assert len({p for p, in ranged.select(F.spark_partition_id()).distinct().collect()}) > 1
    assert all(open(r.image_path, "rb").read() == pixels.png(np.full((1, 2, 3), r.page, np.uint8)) for r in got)
    whole = files.read_pages(spark, str(tmp_path / "long.bin"), lambda content, scale: map(page, range(1, content[0] + 1)), with_pixels=False)
    assert [(r.page, r.bgr, r.image_path) for r in whole.collect()] == [(k, None, None) for k in range(1, 38)]
