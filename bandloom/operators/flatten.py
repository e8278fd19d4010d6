"""Nested figure extractions to one row per band."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

ROOT_KEYS = ("figure_label", "figure_caption", "biological_sample", "cell_line_tissue", "organism", "sample_type", "treatment_context")
PANEL_KEYS = ("panel_label", "panel_title", "treatment_context", "targets_top_to_bottom", "lanes_left_to_right", "bands", "warnings")
SAMPLE_KEYS = ("cell_line_tissue", "biological_sample", "sample_type")
BAND_KEYS = ("row_index", "lane_index", "target", "band_state", "confidence")
STATES = ("present", "absent", "uncertain")
LISTS = ("lanes_left_to_right", "targets_top_to_bottom", "bands")


def is_positive(extraction: Column) -> Column:
    """Only the JSON boolean true counts."""
    flag = V.field(extraction, "is_western_blot")
    return F.coalesce(V.is_object(extraction) & V.is_kind(flag, "BOOLEAN") & F.try_variant_get(extraction, "$.is_western_blot", "boolean"), F.lit(False))


def panels_of(extraction: Column) -> Column:
    """The panels that are objects; without any list of panels the extraction itself is the one panel."""
    return V.once(V.list_field(extraction, "panels"), lambda listed: F.when(F.size(listed) > 0, V.objects(listed)).otherwise(F.array(extraction)))


def _same_key(key: Column, wanted: Column) -> Column:
    """A lookup's raw JSON key against a normalised integer; null meets null, text meets nothing."""
    return F.coalesce(F.when(wanted.isNull(), key["absent"]).otherwise(key["number"] == wanted.cast("double")), F.lit(False))


def _key(raw: V.Read) -> Column:
    return F.struct(raw.kind.isNull().alias("absent"), V.as_double(raw).alias("number"))


def _lane(item: Column) -> Column:
    return F.struct(_key(V.read(item["lane_index"])).alias("key"), V.text_or_null(V.read(item["condition"])).alias("condition"))


def _target(item: Column) -> Column:
    name = V.read(item["target"])
    return F.struct(
        _key(V.read(item["row_index"])).alias("key"), F.when(V.truthy(name), V.as_text(name)).alias("name"),
        V.truthy(V.read(item["is_loading_control"])).alias("loading"), V.confidence(V.read(item["confidence"])).alias("confidence"),
    )


def _band(item: Column) -> Column:
    name, trust = V.read(item["target"]), V.read(item["confidence"])
    return F.struct(
        V.positive_int(V.read(item["row_index"])).alias("row_index"), V.positive_int(V.read(item["lane_index"])).alias("lane_index"), F.when(V.truthy(name), V.as_text(name)).alias("named"),
        _band_state(V.read(item["band_state"])).alias("band_state"), V.truthy(trust).alias("trusted"), V.confidence(trust).alias("confidence"),
    )


def flatten_records(figures: DataFrame, source_pdf: str | None = None) -> DataFrame:
    """One row per valid band of positive figures.

    figures: paper_id, candidate_path, page, extraction VARIANT, and figure_no for order. Rows carry
    figure_no, panel_no and band_no. Lookups inside a panel take the last of equal keys; a band
    without target or with another state is dropped. A list that cannot be walked counts as empty
    here; needs_retry() reports it. Kind and text of each value are taken from the VARIANT once, and all that is
    derived comes from these; lists are read before their bands become rows. Nothing is shuffled.
    """
    ext, panel, band = F.col("extraction"), F.col("panel"), F.col("band")
    base = figures.filter(is_positive(ext)).select("figure_no", "paper_id", F.coalesce("candidate_path", F.lit("")).alias("path"), F.col("page").cast("int").alias("page"), "extraction")
    panels = base.select("*", F.posexplode(panels_of(ext)).alias("panel_no", "panel"))
    inherited = ("figure_label", "organism", "treatment_context", *SAMPLE_KEYS)
    panels = panels.select(
        "figure_no", "panel_no", "paper_id", "path", "page", V.once(V.parts(panel, "$.panel_label"), lambda p: V.text_or_null(V.read(p))).alias("panel_label"),
        *[V.once(V.parts(v, f"$.{k}"), _inheritable).alias(f"{w}_{k}") for w, v in (("own", panel), ("root", ext)) for k in inherited],
        V.once(
            F.struct(
                F.transform(V.records_field(panel, "lanes_left_to_right", ("lane_index", "condition")), _lane).alias("lanes"),
                F.transform(V.records_field(panel, "targets_top_to_bottom", ("row_index", "target", "is_loading_control", "confidence")), _target).alias("targets"),
                F.transform(V.records_field(panel, "bands", BAND_KEYS), _band).alias("bands"),
            ), _looked_up,
        ).alias("bands"),
    )
    sample = None
    for k in SAMPLE_KEYS:
        own, root = F.col(f"own_{k}"), F.col(f"root_{k}")
        counts = F.when(own["text"].isNotNull(), own["truthy"]).otherwise(root["truthy"])
        value = F.coalesce(own["text"], root["text"])
        sample = F.when(counts, value) if sample is None else sample.when(counts, value)
    bands = panels.select(
        "figure_no", "panel_no", "paper_id", "path", "page", "panel_label", sample.alias("sample"),
        *[F.coalesce(F.col(f"own_{k}")["text"], F.col(f"root_{k}")["text"]).alias(k) for k in inherited if k not in SAMPLE_KEYS],
        F.posexplode_outer("bands").alias("band_no", "band"),  # from a plain posexplode Spark infers a filter that reads all lists once more
    )
    return bands.filter(band.isNotNull() & (band["target"] != "") & band["band_state"].isin(*STATES)).select(
        "figure_no", "panel_no", "band_no",
        F.coalesce(F.when(F.col("paper_id") != "", F.col("paper_id")), F.lit("unknown")).alias("paper_id"),
        T.candidate_key(F.col("path"), F.col("page")).alias("candidate_key"),
        F.lit(source_pdf).cast("string").alias("source_pdf"),
        F.when(F.col("path") != "", F.col("path")).alias("candidate_path"),
        F.greatest(F.lit(1), F.coalesce("page", F.lit(1))).alias("page"),
        "figure_label", "panel_label", band["row_index"].alias("row_index"), band["lane_index"].alias("lane_index"), band["target"].alias("target"), band["loading"].alias("is_loading_control"),
        T.blot_type(band["target"], band["loading"]).alias("western_blot_type"),
        "sample", "organism", "treatment_context", band["condition"].alias("condition"), band["band_state"].alias("band_state"), band["confidence"].alias("confidence"),
    )


def _looked_up(panel: Column) -> Column:
    """The bands of a panel with what its lanes and targets say of them."""

    def whole(band: Column, info: Column) -> Column:
        lane = V.last_item(F.filter(panel["lanes"], lambda x: _same_key(x["key"], band["lane_index"])))
        return F.struct(
            band["row_index"].alias("row_index"), band["lane_index"].alias("lane_index"), T.strip(F.coalesce(band["named"], info["name"], F.lit(""))).alias("target"), band["band_state"].alias("band_state"),
            F.coalesce(info["loading"], F.lit(False)).alias("loading"), F.when(band["trusted"], band["confidence"]).otherwise(info["confidence"]).alias("confidence"), lane["condition"].alias("condition"),
        )

    def info(band: Column) -> Column:
        by_row = V.last_item(F.filter(panel["targets"], lambda t: _same_key(t["key"], band["row_index"])))
        by_name = V.last_item(F.filter(panel["targets"], lambda t: F.coalesce(t["name"] == band["named"], F.lit(False))))
        return F.coalesce(by_row, by_name)

    return F.transform(panel["bands"], lambda band: V.once(info(band), lambda found: whole(band, found)))


def _inheritable(given: Column) -> Column:
    value = V.read(given)
    return F.struct(V.text_or_null(value).alias("text"), V.truthy(value).alias("truthy"))


def _band_state(raw: V.Read) -> Column:
    """One of the states, otherwise null."""
    stated = T.strip(F.coalesce(F.when(V.truthy(raw), V.as_text(raw)), F.lit("uncertain")))
    return V.once(stated, lambda s: F.coalesce(*[F.when((s == state) | V.is_word(s, state), state) for state in STATES]))


def _gives_rows(panels: Column) -> Column:
    """Whether a band of these panels becomes a row: it has a target, its own or its row's, and one of the states."""

    def target(t: Column) -> Column:
        name = V.read(t["target"])
        return F.struct(_key(V.read(t["row_index"])).alias("key"), V.as_text(name).alias("name"), V.truthy(name).alias("named"))

    def band(b: Column) -> Column:
        name = V.read(b["target"])
        return F.struct(V.positive_int(V.read(b["row_index"])).alias("row"), F.when(V.truthy(name), V.as_text(name)).alias("named"), _band_state(V.read(b["band_state"])).alias("state"))

    read = F.transform(
        panels,
        lambda p: F.struct(
            F.transform(V.records_field(p, "targets_top_to_bottom", ("row_index", "target")), target).alias("targets"),
            F.transform(V.records_field(p, "bands", ("row_index", "target", "band_state")), band).alias("bands"),
        ),
    )  # each value is taken from the VARIANT once

    def sound(targets: Column, band: Column) -> Column:
        of_row = V.last_item(F.filter(targets, lambda t: _same_key(t["key"], band["row"])))
        target = F.coalesce(band["named"], F.when(of_row["named"], of_row["name"]), F.lit(""))
        return band["state"].isin(*STATES) & (T.strip(target) != "")

    return F.coalesce(F.exists(read, lambda p: F.coalesce(F.exists(p["bands"], lambda b: sound(p["targets"], b)), F.lit(False))), F.lit(False))


def needs_retry(results: DataFrame) -> DataFrame:
    """results with needs_retry: not an object, an error, no boolean flag, or a positive figure without a valid row.

    results: an extraction VARIANT and any other columns. Each row is judged on its own, by the rules of
    flatten_records(), without a shuffle; a null extraction is to be asked again.
    """
    ext = F.col("extraction")
    unwalkable = lambda p: V.bad_list(p, LISTS[0]) | V.bad_list(p, LISTS[1]) | V.bad_list(p, LISTS[2])
    flag = V.field(ext, "is_western_blot")
    sound = V.is_object(ext) & ~V.truthy(V.field(ext, "error")) & V.is_kind(flag, "BOOLEAN")
    fruitless = F.when(is_positive(ext), V.once(panels_of(ext), lambda panels: F.exists(panels, unwalkable) | ~_gives_rows(panels)))
    return results.withColumn("needs_retry", ~F.coalesce(sound, F.lit(False)) | F.coalesce(fruitless, F.lit(False)))


def merge_parts(parts: DataFrame, warning: str | None = None) -> DataFrame:
    """One extraction per candidate from the parts of a split crop: key, part_no, extraction VARIANT -> key, extraction VARIANT.

    For each root key the first truthy value in part order, otherwise an empty text; panels and
    warnings in order, then the given warning; a part without panels gives a panel of its own
    panel keys. A column request_path is listed as split_candidate_paths. Candidates without a
    positive part give no row.
    """
    ext = F.col("extraction")
    listed = V.list_field(ext, "panels")
    panels = F.when(F.size(listed) > 0, F.transform(V.objects(listed), lambda p: F.to_json(p))).otherwise(F.array(V.members_json(ext, PANEL_KEYS)))
    values = {k: F.when(V.truthy(V.field(ext, k)), F.to_json(V.field(ext, k))) for k in ROOT_KEYS}
    path = F.to_json(F.array("request_path")) if "request_path" in parts.columns else F.lit(None).cast("string")
    lists = {"panels": panels, "warnings": F.transform(V.list_field(ext, "warnings"), lambda w: F.to_json(w)), "path": path}
    rows = parts.select("key", F.struct("part_no", *[v.alias(k) for k, v in (values | lists).items()], is_positive(ext).alias("counts")).alias("part"))
    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("all")).withColumn("parts", F.filter("all", lambda p: p["counts"]))
    first = {k: F.coalesce(F.try_element_at(F.array_compact(F.transform("parts", lambda p: p[k])), F.lit(1)), F.lit('""')) for k in ROOT_KEYS}  # noqa: B023
    joined = {k: F.flatten(F.transform("parts", lambda p: p[k])) for k in ("panels", "warnings")}  # noqa: B023
    warnings = F.concat(joined["warnings"], F.array(*([F.to_json(F.parse_json(F.lit(json.dumps(warning))))] if warning else [])).cast("array<string>"))
    body = [F.lit('{"is_western_blot":true')]
    for k, v in first.items():
        body += [F.lit(f',"{k}":'), v]
    body += [F.lit(',"panels":['), F.array_join(joined["panels"], ","), F.lit('],"warnings":['), F.array_join(warnings, ","), F.lit("]")]
    if "request_path" in parts.columns:
        paths = F.transform("all", lambda p: F.substring(p["path"], F.lit(2), F.length(p["path"]) - 2))
        body += [F.lit(',"split_candidate_paths":['), F.array_join(paths, ","), F.lit("]")]
    merged = grouped.filter(F.size("parts") > 0).filter(F.size(joined["panels"]) > 0)
    return merged.select("key", F.parse_json(F.concat(*body, F.lit("}"))).alias("extraction"))
