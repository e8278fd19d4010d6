"""What must not grow with the input: broadcasts of pixels, waves, tasks that hold everything, reads of one value again and again."""

from pyspark.sql import functions as F

from bandloom.operators import extract


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_halves_are_cut_from_the_failed_rows_without_a_join(spark):
    """Blank crops shrink to almost nothing in a file or a shuffle, so a join with pixels is broadcast and opens them on the driver."""
    failed = spark.range(2).select(F.concat(F.lit("runs/r/panel_candidates/c"), "id", F.lit(".png")).alias("candidate_path"), F.col("id").cast("string").alias("text_context"), F.lit(900).alias("width_px"), F.lit(1200).alias("height_px"), F.unhex(F.repeat(F.lit("808080"), 900 * 1200)).alias("bgr"))
    asked = extract.split_requests(failed)
    assert "Join" not in plan_of(asked)
    rows = asked.orderBy("request_path").collect()
    assert [(r.candidate_path[-6:], r.text_context, r.part, r.request_path[-14:], r.stage) for r in rows] == [(f"c{i}.png", str(i), k, f"c{i}_part_0{k}.png", "split") for i in (0, 1) for k in (1, 2)]
    assert all(r.data_url.startswith("data:image/png;base64,") for r in rows)


def test_figure_windows_stop_at_the_cut():
    """Windows beyond the cut are not gathered, however many mentions a text has."""
    import re

    from bandloom.operators import context

    clean = " ".join(f"w{i} Figure {i}" for i in range(20_000))
    mentions = [re.compile(p, re.IGNORECASE) for p in context.FIGURE_PATTERNS]
    kept = context._first_until(clean, mentions, 5000)
    every = context._first_of_each((clean[max(0, h.start() - 300) : h.start() + 2500] for m in mentions for h in m.finditer(clean)), 250)
    assert len(kept) < 5 < len(every) and "\n\n".join(kept)[:5000] == "\n\n".join(every)[:5000]


def test_bands_are_read_once(spark):
    """No filter inferred from an explode reads the lists again, and no value is lowered or looked at in a lookup."""
    from bandloom.operators import flatten

    figures = spark.range(1).select(F.col("id").alias("figure_no"), F.lit("p").alias("paper_id"), F.lit("c.png").alias("candidate_path"), F.lit(1).alias("page"), F.parse_json(F.concat(F.lit('{"is_western_blot":true,"bands":[{"target":"x","band_state":" Present "}],"n":'), "id", F.lit("}"))).alias("extraction"))
    rows = flatten.flatten_records(figures)
    for shown in (rows, rows.groupBy("candidate_key").count()):
        plan = shown._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "$.bands" in x]
    assert [(r.target, r.band_state) for r in rows.collect()] == [("x", "present")]


def test_small_crops_make_few_tasks():
    """Requests are dealt twice, so the blocks of the shuffle grow with the square of the tasks: 500,000 dots are no 4,000 tasks, large crops still are."""
    assert [extract.dealt_tasks(n, 6 * n) for n in (0, 1, 1000, 10_000, 500_000)] == [1, 1, 8, 64, 125]
    assert extract.dealt_tasks(500_000, 500_000 * 3_000_000) == 4_000 and extract.dealt_tasks(6_000, 600 * 900 * 1200 * 3) == 48


def test_ranks_are_counted_by_ranges(spark, tmp_path):
    """Dense ranks over many ranges, repeated keys included, without a window over all rows."""
    from bandloom.plans import registry

    keys = [k * 7 % 101 for k in range(300)] + [None]
    ranked = registry._ranked(registry._by_ranges(spark.createDataFrame([(k,) for k in keys], "k int"), "k", str(tmp_path / "t"), each=20), "k", "place")
    order = {k: i + 1 for i, k in enumerate(sorted(set(keys), key=lambda k: (k is not None, k)))}
    rows = ranked.collect()
    assert sorted((r.k is not None, r.k, r.place) for r in rows) == sorted((k is not None, k, order[k]) for k in keys)
    assert len(list((tmp_path / "t").glob("*.parquet"))) > 5
    windows = [x for x in plan_of(ranked).splitlines() if "dense_rank" in x and "Window" in x]
    assert windows and all("range" in x.split("windowspecdefinition", 1)[1].split("ASC", 1)[0] for x in windows)


def test_named_files_are_read_by_tasks(spark, tmp_path):
    from bandloom.sources import assets

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a é.png").write_bytes(b"1" * 10)
    (tmp_path / "in" / "b").write_bytes(b"")
    (tmp_path / "out").write_bytes(b"secret")
    names = spark.createDataFrame([("a é.png",), ("b",), ("gone",), ("../out",), (None,)], "name string")
    assert {r.name: bytes(r.content) for r in assets.read_files(names, str(tmp_path / "in")).collect()} == {"a é.png": b"1" * 10, "b": b""}


def test_an_ingestion_reads_its_crops_twice_and_asks_for_no_halves(spark, tmp_path, monkeypatch):
    """Crops are worked out for their digests and for publishing, not again for each check; without a failed request no halves are sought."""
    from bandloom.operators import catalog, ingest
    from bandloom.operators.settings import Settings

    log = tmp_path / "log"
    log.mkdir()

    @F.udf("binary")
    def content(name):
        import uuid

        (log / f"{name}-{uuid.uuid4().hex}").touch()
        return name.encode()

    monkeypatch.setattr(extract, "split_requests", lambda *_: 1 / 0)
    path = F.format_string("runs/r/panel_candidates/%d.png", F.col("id"))
    ids = spark.range(3)
    candidates = ids.select(F.col("id").alias("candidate_no"), path.alias("candidate_path"), F.lit("p").alias("paper_id"), (F.col("id") + 1).cast("int").alias("page"))
    contexts = candidates.select("candidate_path", F.lit("c").alias("text_context"), F.lit(1).alias("line_no"))
    dots = candidates.select("candidate_path", F.lit(1).alias("width_px"), F.lit(1).alias("height_px"), F.unhex(F.lit("000000")).alias("bgr"))
    crops = ids.select(F.format_string("%d.png", F.col("id")).alias("name")).withColumn("content", content("name"))
    settings = Settings(data_dir=str(tmp_path / "data"))
    store = catalog.Catalog(spark, str(tmp_path / "catalog"))
    out = ingest.ingest(store, lambda *_: '{"is_western_blot": true, "bands": [{"target": "x"}]}', candidates, contexts, dots, crops, "s.pdf", "p", settings)
    assert out["database_rows"] == 3 and out["positive_results"] == 3
    assert len(list(log.iterdir())) == 2 * 3
    assert [p.name for p in (tmp_path / "data" / "runs" / "p").iterdir()] == [out["run_dir"].rsplit("/", 1)[1]]
    assert spark.read.schema(extract.ATTEMPT).parquet(f"{out['run_dir']}/failures").count() == 0


def test_details_broadcast_no_answers_and_no_pages(spark):
    """Alike answers shrink to almost nothing in a file; a broadcast would open a whole run's on the driver. Records are read without a join with themselves."""
    from bandloom.operators import catalog, detail

    given = spark.createDataFrame([(1, "p", "runs/r/panel_candidates/a.png", 1, "Figure 1")], "id long, paper_id string, candidate_path string, page int, figure_label string")
    records = spark.createDataFrame([], catalog.SCHEMA).unionByName(given, allowMissingColumns=True)
    cache = spark.createDataFrame([("runs/r", "a.png", 1, '{"is_western_blot": true, "figure_caption": "cap"}')], "run string, candidate_path string, line_no long, j string")
    pages = spark.createDataFrame([("runs/r", 1, 1, "It begins. Figure 1 shows it.")], "run string, page int, page_no int, text string")
    out = detail.record_detail(records, cache.select("run", "candidate_path", "line_no", F.parse_json("j").alias("extraction")), pages)
    plan = plan_of(out)
    assert plan.count("SortMergeJoin [run") == 2 and "BroadcastHashJoin [run" not in plan and plan.count("Join [id") == 1
    row = out.first()
    assert (row.figure_caption, row.paper_context, row.image_url) == ("cap", "It begins. Figure 1 shows it.", "/api/records/1/image")


def page_of_dots(height=300, width=300):
    import numpy as np

    mask = np.random.default_rng(3).random((height, width)) < 0.4
    return np.where(mask[..., None], 120, 255).astype(np.uint8).repeat(3, -1)


def test_boxes_are_sought_without_a_step_for_each_run():
    """A page's runs of ink, tens of thousands where it is grainy, are joined all at once: the calls made do not grow with them."""
    import sys

    from bandloom.functions import pixels

    mask, calls = page_of_dots()[..., 0] < 245, [0]

    def count(*_):
        calls[0] += 1

    sys.setprofile(count)
    try:
        boxes = pixels.outer_boxes(mask)
    finally:
        sys.setprofile(None)
    assert len(pixels.label_runs(mask, True)[0]) > 10_000 and len(boxes) > 100
    assert calls[0] < 2_000


def test_boxes_take_a_few_bytes_a_pixel():
    """A large page's windows are no 64-bit sums over the whole page."""
    import tracemalloc

    import numpy as np

    from bandloom.functions import pixels

    page = np.full((1500, 2000, 3), 255, np.uint8)
    page[300:700, 400:1000] = 120
    tracemalloc.start()
    try:
        assert pixels.ink_boxes(page) == [(378, 278, 644, 444)]
        assert tracemalloc.get_traced_memory()[1] < 8 * 1500 * 2000
    finally:
        tracemalloc.stop()


def test_boxes_are_those_of_a_closed_and_grown_page():
    """The reference closes gaps, then grows; so do plain windows here, blank, grainy and striped pages included."""
    import numpy as np

    from bandloom.functions import pixels

    def window(mask, side, whole):
        part = np.lib.stride_tricks.sliding_window_view(np.pad(mask, side // 2, constant_values=whole), (side, side))
        return part.all((2, 3)) if whole else part.any((2, 3))

    rng = np.random.default_rng(9)
    for share in (0.0, 0.002, 0.01, 0.05, 1.0):
        ink = np.repeat(rng.random((20, 50)) < share, 3, 0)
        page = np.where(ink[..., None], (30, 200, 90), 255).astype(np.uint8)
        for side in (3, 7):
            grown = window(window(window(ink, side, False), side, True), side, False)
            assert pixels.ink_boxes(page, side) == pixels.outer_boxes(grown)
            assert (pixels.dilate(ink, side, side) == window(ink, side, False)).all() and (pixels.erode(ink, side, side) == window(ink, side, True)).all()


def test_many_rows_are_dealt_to_fewer_tasks(spark):
    """A few rows go to as many tasks as before, many to larger tasks, so that tasks do not outgrow their work."""
    from bandloom.plans import registry

    tasks = [registry._dealt(spark.range(n), each=2, most=20).rdd.getNumPartitions() for n in (0, 1, 40, 200, 4_000)]
    assert tasks == [1, 1, 20, extract.LEAST_TASKS, 200] and registry._dealt(spark.range(400), each=2, most=2).rdd.getNumPartitions() == 200


def test_pages_go_to_python_a_few_at_a_time(spark, monkeypatch, tmp_path):
    """While boxes are written a batch holds a page or two, not 64 MB of them; the session's own bound stays and comes back."""
    from bandloom.operators import images

    seen = []

    class Watched(type(spark.range(1).write)):
        def parquet(self, *args, **kwargs):
            seen.append(spark.conf.get(images.ARROW_BYTES, None))
            return super().parquet(*args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "write", property(lambda df: Watched(df)))
    pages = spark.range(2).select(F.lit("p").alias("paper_id"), F.col("id").cast("int").alias("page"), F.lit(1).alias("width_px"), F.lit(1).alias("height_px"), F.unhex(F.lit("ffffff")).alias("bgr"))
    had = spark.conf.get(images.ARROW_BYTES, None)
    try:
        for given in (None, "3m"):
            spark.conf.unset(images.ARROW_BYTES) if given is None else spark.conf.set(images.ARROW_BYTES, given)
            assert images.page_candidates(pages, at=str(tmp_path / f"at-{given}")).count() == 0
            assert spark.conf.get(images.ARROW_BYTES, None) == given
        assert seen == [images.PAGE_BYTES, "3m"]
    finally:
        spark.conf.unset(images.ARROW_BYTES) if had is None else spark.conf.set(images.ARROW_BYTES, had)
