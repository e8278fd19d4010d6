import json

import pytest
from pyspark.sql import functions as F

from bandloom.functions import strict_json
from bandloom.functions import text as T
from bandloom.functions import values as V
from bandloom.operators import catalog, context, flatten, search
from bandloom.operators import extract
from bandloom.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column).first()[0]


def test_white_space_is_unicode(spark):
    assert one(spark, T.normalize_ws(F.col("t")), t="  a  　\n b ") == "a b"


def test_like_pattern_keeps_wildcards_and_drops_stray_escapes():
    assert search.T.like_pattern(r"a\s%b_") == "%as%b_%"
    assert search.T.like_pattern("x\\") == r"%x\%"


def test_search_terms_and_bounds():
    assert search.search_terms("A549 cells", search.SAMPLE_STOPWORDS) == ["A549"]
    assert search.search_terms(" cell line ", search.SAMPLE_STOPWORDS) == ["cell line"]
    assert search.page_bounds(500, -4) == (200, 0)
    with pytest.raises(ValueError):
        search.validate(search.Criteria(), 201, 0)


@pytest.mark.parametrize(("raw", "want"), [("1.4", 1.0), ("true", 1.0), ('"0.5"', None), ('" High "', 0.9), ("null", None), ("-1", 0.0)])
def test_confidence(spark, raw, want):
    assert one(spark, V.confidence(F.parse_json(F.lit(raw)))) == want


@pytest.mark.parametrize(("raw", "want"), [('" 3 "', 3), ("2.9", 2), ("true", 1), ("0", None), ('"x"', None), ("[]", None)])
def test_positive_int(spark, raw, want):
    assert one(spark, V.positive_int(F.parse_json(F.lit(raw)))) == want


def figures(spark, *extractions):
    rows = [(i, "paper", f"crops/c{i}.png", 4, json.dumps(e)) for i, e in enumerate(extractions)]
    return spark.createDataFrame(rows, "figure_no int, paper_id string, candidate_path string, page int, j string").withColumn("extraction", F.parse_json("j")).drop("j")


def test_flatten_inherits_looks_up_and_drops(spark):
    extraction = {
        "is_western_blot": True, "figure_label": "Figure 2", "organism": "mouse", "cell_line_tissue": "  ", "biological_sample": "liver",
        "panels": [{
            "panel_label": "A", "organism": " ",
            "lanes_left_to_right": [{"lane_index": 1, "condition": "old"}, {"lane_index": 1.0, "condition": "new"}, {"lane_index": "2", "condition": "text key"}],
            "targets_top_to_bottom": [{"row_index": 1, "target": "p-AKT", "confidence": "high"}, {"row_index": 2, "target": "GAPDH", "is_loading_control": "false"}, 7],
            "bands": [
                {"row_index": 1, "lane_index": 1, "band_state": " Present "}, {"row_index": "2", "lane_index": 2, "target": "GAPDH", "confidence": 1.4},
                {"row_index": 1, "target": "x", "band_state": "maybe"}, {"lane_index": 1, "target": ""}, 3,
            ],
        }],
    }
    rows = flatten.flatten_records(figures(spark, extraction, {"is_western_blot": "true", "bands": []})).orderBy("band_no").collect()
    assert [(r.target, r.condition, r.confidence, r.western_blot_type, r.band_state) for r in rows] == [
        ("p-AKT", "new", 0.9, "phospho_signaling", "present"), ("GAPDH", None, 1.0, "loading_control", "uncertain"),
    ]
    assert {(r.organism, r["sample"], r.candidate_key, r.page) for r in rows} == {("mouse", None, "c0", 4)}


def test_retry(spark):
    band = {"target": "x"}
    cases = [({"is_western_blot": False}, False), ({"error": "bad_json"}, True), ({"is_western_blot": True, "bands": []}, True), ({"is_western_blot": True, "bands": [band]}, False), ({"is_western_blot": True, "bands": [band], "lanes_left_to_right": None}, True), ([], True)]
    out = flatten.needs_retry(figures(spark, *[c for c, _ in cases]).drop("figure_no")).orderBy("candidate_path").collect()
    assert [r.needs_retry for r in out] == [w for _, w in cases]


def test_retry_row_by_row_agrees_with_the_flattened_rows(spark):
    """Targets from the band or its row, states of any kind, lists that hold other things: 400 figures, nothing shuffled."""
    import random

    draw = random.Random(7)
    names, states, numbers = ["AKT", "", " ", None, 0, 3, True, [], ["x"], {}], ["present", " Absent ", "gone", None, "", 0, 1, [], {"a": 1}], [1, 2, "1", " 2 ", 1.0, None, True, "x", 0, []]
    band = lambda: draw.choice([1, None, "b"]) if draw.random() < 0.1 else {"row_index": draw.choice(numbers), "target": draw.choice(names), "band_state": draw.choice(states)}
    target = lambda: draw.choice([2, None]) if draw.random() < 0.1 else {"row_index": draw.choice(numbers), "target": draw.choice(names)}
    panel = lambda: {"bands": [band() for _ in range(draw.randrange(3))], "targets_top_to_bottom": [target() for _ in range(draw.randrange(4))]}
    given = [{"is_western_blot": True, **(panel() if draw.random() < 0.5 else {"panels": [panel() for _ in range(draw.randrange(3))] + draw.choice([[], [1], [None]])})} for _ in range(400)]
    results = figures(spark, *given).withColumn("candidate_path", F.col("figure_no").cast("string"))
    flat = {r.figure_no for r in flatten.flatten_records(results).select("figure_no").distinct().collect()}
    out = flatten.needs_retry(results)
    assert {r.figure_no for r in out.filter("NOT needs_retry").collect()} == flat and 50 < len(flat) < 350
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("raw", "error"), [("<think>a</think> ```json\n{\"a\": 1}\n```", None), ("not json", "bad_json"), ('{"a":1}{"b":2}', "bad_json"), ("</think><think>{}", None), ("Here:\n```json\n{\"a\": 1}\n```\nDone ```", None), ('{"a":1,"a":2}', None)])
def test_model_json(spark, raw, error):
    v = spark.createDataFrame([(raw,)], "r string").select(strict_json.model_json(F.col("r")).alias("v"))
    assert v.select(F.try_variant_get("v", "$.error", "string")).first()[0] == error


def record(key, source="s", target="AKT", page=1, **more):
    return {"paper_id": "p", "candidate_key": key, "page": page, "target": target, "is_loading_control": False, "western_blot_type": "total_protein", "source_id": source, **more}


def frame(spark, *rows):
    names = {k: v for k, v in (f.split() for f in catalog.SCHEMA.replace("\n", " ").split(", "))}
    used = [n for n in names if any(n in r for r in rows)] or list(record("x"))
    return spark.createDataFrame([tuple(r.get(n) for n in used) for r in rows], ", ".join(f"{n} {names[n]}" for n in used))


def test_catalog_replaces_atomically(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path))
    assert not store.health()
    store.initialize()
    assert store.replace(frame(spark, record("a"), record("b"), record("n", panel_label=None)), "p", "s") == 3
    first = {r.candidate_key: r for r in store.rows().collect()}
    assert sorted(r.id for r in first.values()) == [1, 2, 3]
    store.replace(frame(spark, record("a", page=9, sample="liver"), record("c"), record("c", sample="last")), "p", "s")
    rows = {r.candidate_key: r for r in store.rows().collect()}
    assert set(rows) == {"a", "c"} and rows["c"]["sample"] == "last" and rows["c"].id > 3
    assert (rows["a"].id, rows["a"].page, rows["a"].created_at, rows["a"]["sample"]) == (first["a"].id, 1, first["a"].created_at, "liver")
    before = store.version()
    for bad in (record("d", band_state="maybe"), record("d", page=0), record("d", source="t"), record("d", confidence=1.5)):
        with pytest.raises(ValueError):
            store.replace(frame(spark, bad), "p", "s")
    with pytest.raises(ValueError):
        store.replace(frame(spark, record("a", source=None)), "p", None)
    assert store.version() == before
    page, total = store.search(search.Criteria(q="akt", sample="liver cells"))
    assert [r.candidate_key for r in page.collect()] == ["a"] and total.first().total == 1 and "candidate_path" not in page.columns
    page, total = store.search(search.Criteria(target="' OR TRUE --"), offset=50)
    assert page.count() == 0 and total.first().total == 0
    store.replace(frame(spark, record("a")).limit(0), "p", "s")
    assert store.rows().count() == 0 and store.health()


def test_versions_share_the_buckets_they_do_not_touch(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path))
    store.initialize()
    papers = [f"p{i}" for i in range(6)]
    for paper in papers:
        store.replace(frame(spark, record("a") | {"paper_id": paper}, record("b") | {"paper_id": paper}), paper, "s")
    before = store._entry(store.version())["folders"]
    store.replace(frame(spark, record("c") | {"paper_id": "p0"}), "p0", "s")
    after = store._entry(store.version())["folders"]
    assert [b for b in before if before[b] != after.get(b)] == [str(catalog.bucket_of("p0"))]
    ids = {(r.paper_id, r.candidate_key): r.id for r in store.rows().collect()}
    assert len(ids) == 11 and len(set(ids.values())) == 11 and ids["p0", "c"] == 13
    page, total = store.search(search.Criteria(paper_id=" p3 "))
    assert total.first().total == 2 and {r.paper_id for r in page.collect()} == {"p3"}


def test_cache_reader(spark, tmp_path):
    good = json.dumps({"candidate_path": "a.png", "extraction": {"is_western_blot": False}})
    path = tmp_path / "cache.jsonl"
    path.write_text(good + "\n\n" + '{"candidate_path":')
    assert [r.candidate_path for r in files.read_cache(spark, str(path)).collect()] == ["a.png"]
    for bad in ("not-json", "{}"):
        path.write_text(good + "\n" + bad + "\n" + good + "\n")
        with pytest.raises(ValueError, match="line 2"):
            files.read_cache(spark, str(path))


def test_snippets_against_find(spark):
    terms, most, reach = ("ab", "b", "zz", "c"), 2, 3
    text = "xxab b bb ab c   c ab b abc zz"
    clean, found = " ".join(text.split()), []
    for t in terms:
        at = clean.find(t)
        while at >= 0:
            found.append(clean[max(0, at - reach) : at + len(t) + reach])
            at = clean.find(t, at + len(t))
            if len(found) >= most * 3:
                break
    want = "\n\n".join(f"- {s}" for s in list({s.lower()[:250]: s for s in reversed(found)}.values())[::-1][:0] or [s for i, s in enumerate(found) if s.lower() not in [x.lower() for x in found[:i]]][:most])
    assert one(spark, context.snippets(F.col("t"), terms, most, reach), t=text) == want


def test_page_context_crosses_pages_and_skips_supplement(spark):
    pages = spark.createDataFrame([("r", 3, 0, "Nothing here. See Supplementary Figure 2 now. Filler one."), ("r", 4, 1, "Start of it. As Figures 2A show, it rose.\nFIGURE 2\nCaption text."), ("r", 5, 2, "12\nThen it fell. The end."), ("r", 9, 3, "Figure 2 far away.")], "run string, page int, page_no int, text string")
    records = spark.createDataFrame([(1, "r", 4, "Figure 2"), (2, "r", 4, "none")], "id int, run string, page int, figure_label string")
    out = {r.id: r.paper_context for r in context.page_context(records, pages).collect()}
    assert out == {1: "Filler one. Start of it. As Figures 2A show, it rose. Then it fell."}


def test_fingerprint_depends_on_every_value():
    assert extract.run_fingerprint({"a": 1, "b": "é"}) == extract.run_fingerprint({"b": "é", "a": 1}) != extract.run_fingerprint({"a": 2, "b": "é"})


def test_deep_pages_equal_shallow_ones(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS at", "id % 10 < 9 AS hit").repartition(5)
    order, hits = [F.desc("at"), F.asc("id")], F.col("hit")
    for offset in (0, 130, 899, 900, 1_000_000_000):
        deep = search.search_page(rows, hits, order, 50, offset, deep=0)
        want = sorted((-(i % 7), i) for i in range(1000) if i % 10 < 9)[offset : offset + 50]
        assert deep.columns == rows.columns and [r.id for r in deep.collect()] == [i for _, i in want]


@pytest.mark.parametrize(("descending", "nulls_first"), [(True, True), (False, False)])
def test_deep_pages_by_histograms(spark, descending, nulls_first):
    """Ties, nulls, values at the ends of their range and pages across parts: the same page as by sorting, and no sort of the hits."""
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 11 = 0 THEN NULL WHEN id = 5 THEN 9223372036854775807L WHEN id = 6 THEN -9223372036854775807L - 1 WHEN id % 3 = 0 THEN 77 ELSE id * 1000003 % 5003 END AS at").repartition(5).cache()
    keys = [search.Key("at", descending, nulls_first), search.Key("id", False)]
    want = [r.id for r in rows.orderBy(*[k.order() for k in keys]).collect()]
    for offset in (0, 262, 1500, 2725, 2990, 3000):
        page = search.search_page(rows, F.lit(True), keys, 50, offset, deep=60)
        assert [r.id for r in page.collect()] == want[offset : offset + 50], offset
    assert "Exchange rangepartitioning" not in search.search_page(rows, F.lit(True), keys, 50, 1500, deep=60)._jdf.queryExecution().executedPlan().toString()
    same = spark.range(500).selectExpr("1 AS at", "id")
    assert search.search_page(same, F.lit(True), [search.Key("at")], 50, 480, deep=60).count() == 20
    times = spark.range(400).selectExpr("timestamp_seconds(id) AS at", "id", "date_add(date'2020-01-01', int(id)) AS day")
    for name in ("at", "day"):
        assert [r.id for r in search.search_page(times, F.lit(True), [search.Key(name)], 5, 200, deep=10).collect()] == [199, 198, 197, 196, 195]


def test_figure_windows_against_a_loop(spark):
    import re

    text = "Intro words. " * 40 + "See Figure 1 here. " + "x" * 2600 + " fig. 2 and FIGURE  3, Extended Data Fig. 4 end " + "See Figure 1 here. "
    clean, windows = " ".join(text.split()), []
    for pattern in context.FIGURE_PATTERNS:
        for m in re.finditer(pattern, clean, re.IGNORECASE):
            piece = clean[max(0, m.start() - 300) : m.start() + 2500]
            if piece[:250].lower() not in [w[:250].lower() for w in windows]:
                windows.append(piece)
    assert one(spark, context.figure_context(F.col("t")), t=text) == "\n\n".join(windows)[:5000] and len(windows) > 2
    assert one(spark, context.figure_context(F.col("t")), t="none") == ""
