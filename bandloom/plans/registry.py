"""Queries that apply the operators to the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strict_json
from ..functions import text as T
from ..functions import values as V
from ..operators import candidates as cand
from ..operators import catalog, context, detail, extract, flatten, images, ingest, search
from ..operators.settings import Settings
from ..sources import assets, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, each: int = 64, most: int = 64) -> DataFrame:
    """Rows that work or pixels grow out of, dealt evenly so that a task has about `each`: a table of one small file is one task.

    Of many rows a task gets up to `most`, as long as that leaves extract.LEAST_TASKS of them.
    """
    n = rows.count()
    return rows.repartition(max(1, min(-(-n // each), max(extract.LEAST_TASKS, -(-n // most)))))


def _by_ranges(rows: DataFrame, key: str, at: str, each: int = 4_000) -> DataFrame:
    """Rows with the number of their range of key, written once, a file for each range of about `each` rows; equal keys share a range."""
    ranged = rows.repartitionByRange(max(1, -(-rows.count() // each)), key)
    return extract.stored(ranged.withColumn("range", F.spark_partition_id()), at)


def _ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows of _by_ranges with the dense rank of their key: counted within each range, after the ranges before it."""
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = rows.groupBy("range").agg(F.count_distinct(F.struct(key)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.dense_rank().over(Window.partitionBy("range").orderBy(key))
    return rows.join(F.broadcast(offsets), "range").withColumn(name, (own + F.col("before")).cast("int")).drop("range", "before")


# Search over documents and parts: text is the target, source the sample, lang the condition.
DOCS = search.Columns(paper="source", target="text", sample=("source", "lang"), condition=("text", "lang"), everywhere=("text", "source", "lang"))
PARTS = search.Columns(paper="p_brand", target="p_name", sample=("p_name", "p_brand"), condition=("p_type", "p_name"), everywhere=("p_name", "p_brand", "p_type"))
_HIT = "(text ILIKE '%the%' ESCAPE '\\' OR source ILIKE '%the%' ESCAPE '\\' OR lang ILIKE '%the%' ESCAPE '\\') AND (text ILIKE '%src1%' ESCAPE '\\' OR source ILIKE '%src1%' ESCAPE '\\' OR lang ILIKE '%src1%' ESCAPE '\\')"
_WHERE = search.Criteria(q="the  src1")


@query(f"SELECT doc_id, source, lang, n_chars FROM documents WHERE {_HIT} ORDER BY n_chars DESC, doc_id DESC LIMIT 25 OFFSET 5")
def catalog_search(spark, sf_dir):
    page = search.search_page(table(spark, sf_dir, "documents"), search.predicate(_WHERE, DOCS), [F.desc_nulls_first("n_chars"), F.desc_nulls_first("doc_id")], 25, 5)
    return page.select("doc_id", "source", "lang", "n_chars")


@query(f"SELECT count(*) AS total FROM documents WHERE {_HIT}")
def catalog_count(spark, sf_dir):
    return search.search_total(table(spark, sf_dir, "documents"), search.predicate(_WHERE, DOCS))


@query(f"SELECT (SELECT count(*) FROM documents WHERE {_HIT}) AS total, (SELECT count(*) FROM (SELECT 1 FROM documents WHERE {_HIT} LIMIT 200 OFFSET 1000000000)) AS n_rows")
def catalog_page_total(spark, sf_dir):
    docs, where = table(spark, sf_dir, "documents"), search.predicate(_WHERE, DOCS)
    page = search.search_page(docs, where, [F.desc("n_chars"), F.desc("doc_id")], 500, 1_000_000_000)
    return search.search_total(docs, where).crossJoin(page.agg(F.count("*").alias("n_rows")))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%part 1%' ESCAPE '\\' OR p_name ILIKE '%r%n%' ESCAPE '\\'")
def target_phrase(spark, sf_dir):
    where = search.predicate(search.Criteria(target=" part 1 "), PARTS) | search.predicate(search.Criteria(target="r%n"), PARTS)
    return table(spark, sf_dir, "part").filter(where).select("p_partkey", "p_name")


@query("SELECT doc_id, source FROM documents WHERE source = 'src3'")
def paper_exact(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(search.predicate(search.Criteria(paper_id=" src3 "), DOCS)).select("doc_id", "source")


@query("SELECT p_partkey FROM part WHERE (p_name ILIKE '%1%' OR p_brand ILIKE '%1%') AND (p_name ILIKE '%brand%' OR p_brand ILIKE '%brand%')")
def sample_terms_stopwords(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(search.predicate(search.Criteria(sample="Brand cells, 1 TISSUE"), PARTS)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%cell line%' OR p_brand ILIKE '%cell line%'")
def stopwords_only_fallback(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(search.predicate(search.Criteria(sample=" cell line "), PARTS)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%s%' OR p_name ILIKE '%s%'")
def condition_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(search.predicate(search.Criteria(condition="treated with s"), PARTS)).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%t_e%of%' ESCAPE '\\'")
def wildcard_percent(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.contains_phrase(F.col("text"), "t_e%of")).select("doc_id")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def get_by_id(spark, sf_dir):
    return search.get_by_id(table(spark, sf_dir, "customer"), 7, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def recent_page(spark, sf_dir):
    return search.search_page(table(spark, sf_dir, "events"), F.lit(True), [F.desc_nulls_first("ts"), F.desc_nulls_first("event_id")], 50, 100).select("event_id", "event_type")


@query("SELECT o_orderkey, CAST(floor(o_orderkey / 25) AS BIGINT) + 1 AS page, CAST(ceil(o_orderkey / 25) AS BIGINT) AS pages, CAST(floor((greatest(o_orderkey, 1) - 1) / 25) * 25 AS BIGINT) AS last_offset FROM orders")
def paging_math(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", search.page_number(key, 25).alias("page"), search.page_count(key, 25).alias("pages"), search.last_offset(key, 25).alias("last_offset"))


def _orders_catalog(spark, sf_dir):
    """Orders as a catalog of two sources by key; two thirds of them come again in a batch with changed prices."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("candidate_key"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("panel_label"),
        (F.col("o_orderkey") % 2).cast("string").alias("source_id"), F.col("o_custkey").cast("int").alias("page"), F.col("o_totalprice").alias("confidence"),
    )
    batch = orders.filter("id % 3 <> 0 AND source_id = '0'").select("candidate_key", "panel_label", "source_id", (F.col("page") + 1).alias("page"), (F.col("confidence") + 1).alias("confidence"), F.col("id").alias("input_pos"))
    fresh = orders.filter("source_id = '1' AND id % 5 = 0").select((-F.col("candidate_key") - 1).alias("candidate_key"), "panel_label", F.lit("0").alias("source_id"), "page", "confidence", F.col("id").alias("input_pos"))
    return orders, batch.unionByName(fresh)


_ORDERS = """WITH cat AS (SELECT o_orderkey AS id, o_orderkey AS candidate_key, nullif(o_orderpriority, '5-LOW') AS panel_label, CAST(o_orderkey % 2 AS VARCHAR) AS source_id, CAST(o_custkey AS INTEGER) AS page, o_totalprice AS confidence FROM orders),
batch AS (SELECT candidate_key, panel_label, source_id, page + 1 AS page, confidence + 1 AS confidence FROM cat WHERE id % 3 <> 0 AND source_id = '0'
UNION ALL SELECT -candidate_key - 1, panel_label, '0', page, confidence FROM cat WHERE source_id = '1' AND id % 5 = 0) """
_KEYS = ("candidate_key", "panel_label")


@query(_ORDERS + """SELECT coalesce(c.id, -1) AS id, b.candidate_key, b.panel_label, b.source_id, coalesce(c.page, b.page) AS page, round(b.confidence, 2) AS confidence
FROM batch b LEFT JOIN cat c ON c.source_id = b.source_id AND c.candidate_key = b.candidate_key AND c.panel_label IS NOT DISTINCT FROM b.panel_label
UNION ALL SELECT id, candidate_key, panel_label, source_id, page, round(confidence, 2) FROM cat WHERE source_id <> '0'""")
def upsert_replace(spark, sf_dir):
    existing, batch = _orders_catalog(spark, sf_dir)
    sources = spark.range(1).select(F.lit("0").alias("source_id"))
    out = catalog.replace_sources(existing, batch, sources, F.current_timestamp(), _KEYS, ("source_id",), ("id", "page"))
    known = F.when(F.col("candidate_key") >= 0, F.col("id")).otherwise(-1)
    return out.select(known.alias("id"), "candidate_key", "panel_label", "source_id", "page", F.round("confidence", 2).alias("confidence"))


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids FROM orders WHERE o_orderkey % 2 = 1")
def replace_empty(spark, sf_dir):
    existing, batch = _orders_catalog(spark, sf_dir)
    out = catalog.replace_sources(existing, batch.limit(0), spark.range(1).select(F.lit("0").alias("source_id")), F.current_timestamp(), _KEYS, ("source_id",), ("id", "page"))
    return out.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


@query("SELECT o_orderkey AS candidate_key FROM orders WHERE o_orderkey % 4 = 1")
def upsert_conflict_other_source(spark, sf_dir):
    existing, _ = _orders_catalog(spark, sf_dir)
    stolen = existing.filter("id % 4 = 1").withColumn("source_id", F.lit("0"))
    return catalog.other_source_conflicts(existing, stolen, _KEYS).select("candidate_key")


@query(_ORDERS + "SELECT id FROM cat c WHERE source_id = '0' AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.candidate_key = c.candidate_key AND b.panel_label IS NOT DISTINCT FROM c.panel_label)")
def stale_delete(spark, sf_dir):
    existing, batch = _orders_catalog(spark, sf_dir)
    return catalog.stale_rows(existing.filter("source_id = '0'"), batch, _KEYS).select("id")


@query("WITH o AS (SELECT nullif(o_orderpriority, '5-LOW') AS panel_label, nullif(o_orderstatus, 'P') AS state, o_custkey % 10 AS lane FROM orders) SELECT panel_label, state, lane, count(*) AS n FROM o GROUP BY ALL HAVING count(*) > 1")
def nullsafe_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("panel_label"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("state"), (F.col("o_custkey") % 10).alias("lane"))
    return catalog.duplicate_identities(rows, ("panel_label", "state", "lane"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_identity(spark, sf_dir):
    return catalog.duplicate_identities(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity - 3 > 0) OR NOT (lower(l_linestatus) = 'o') OR NOT (l_discount * 12 BETWEEN 0 AND 1)")
def constraint_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 3).alias("page"), F.when(F.lower("l_linestatus") == "o", "present").otherwise("maybe").alias("band_state"), (F.col("l_discount") * 12).alias("confidence"),
        *[F.lit("x").alias(c) for c in catalog.REQUIRED if c != "page"],
    )
    return catalog.violations(rows).select("l_orderkey", "l_linenumber")


def _figures(spark, sf_dir):
    """Orders as figures with their lines as lanes and bands, and suppliers as targets; text JSON read as VARIANT."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_discount").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").distinct()  # one shuffle; a fixed number, since lines shrink so far that Spark would join tasks
    lane = F.struct(F.col("l_linenumber").alias("lane_index"), F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string")).alias("condition"))
    target = F.struct((F.col("l_suppkey") % 5 + 1).alias("row_index"), F.concat(F.lit("p-"), (F.col("l_suppkey") % 5).cast("string")).alias("target"), ((F.col("l_suppkey") % 5) == 0).alias("is_loading_control"), F.lit("medium").alias("confidence"))
    band = F.struct((F.col("l_suppkey") % 5 + 1).cast("string").alias("row_index"), F.col("l_linenumber").alias("lane_index"), F.when(F.col("l_returnflag") == "R", "maybe").when(F.col("l_returnflag") == "A", " Absent ").otherwise("present").alias("band_state"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 20).alias("confidence"))
    grouped = lines.groupBy("l_orderkey").agg(*[F.sort_array(F.collect_list(x)).alias(n) for x, n in ((lane, "lanes_left_to_right"), (target, "targets_top_to_bottom"), (band, "bands"))])
    orders = table(spark, sf_dir, "orders").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"))
    panel = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.lit("own")).otherwise("  ").alias("organism"), F.lit("A").alias("panel_label"), "lanes_left_to_right", "targets_top_to_bottom", "bands")
    ext = F.to_json(F.struct((F.col("o_orderstatus") != "P").alias("is_western_blot"), F.lit("Figure 1").alias("figure_label"), F.col("o_orderpriority").alias("organism"), F.col("o_orderstatus").alias("biological_sample"), F.array(panel).alias("panels")))
    return orders.select(F.col("o_orderkey").alias("figure_no"), F.lit("paper").alias("paper_id"), F.concat(F.lit("crops/fig."), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("candidate_path"), (F.col("o_custkey") % 9).cast("int").alias("page"), F.parse_json(ext).alias("extraction"))


_FLAT = """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity, l_discount FROM lineitem),
lanes AS (SELECT l_orderkey, l_linenumber, max(' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS condition FROM l GROUP BY ALL),
flat AS (SELECT o_orderkey, 'fig.' || o_orderkey AS candidate_key, greatest(1, CAST(o_custkey % 9 AS INTEGER)) AS page, CAST(l_suppkey % 5 + 1 AS INTEGER) AS row_index, l.l_linenumber AS lane_index,
 'p-' || (l_suppkey % 5) AS target, l_suppkey % 5 = 0 AS is_loading_control, o_orderstatus AS sample, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE o_orderpriority END AS organism,
 trim(condition) AS condition, CASE WHEN l_returnflag = 'A' THEN 'absent' ELSE 'present' END AS band_state, round(CASE WHEN l_discount > 0 THEN least(1.0, l_discount * 20) ELSE 0.6 END, 6) AS confidence
 FROM orders JOIN l ON l_orderkey = o_orderkey JOIN lanes ON lanes.l_orderkey = o_orderkey AND lanes.l_linenumber = l.l_linenumber WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R') """


@query(_FLAT + "SELECT candidate_key, page, row_index, lane_index, target, is_loading_control, CASE WHEN is_loading_control THEN 'loading_control' ELSE 'phospho_signaling' END AS western_blot_type, condition, band_state, confidence FROM flat")
def flatten_nested(spark, sf_dir):
    rows = flatten.flatten_records(_figures(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
    return rows.select("candidate_key", "page", "row_index", "lane_index", "target", "is_loading_control", "western_blot_type", "condition", "band_state", "confidence")


@query(_FLAT + "SELECT candidate_key, 'Figure 1' AS figure_label, organism, sample, count(*) AS n FROM flat GROUP BY ALL")
def panel_inherit(spark, sf_dir):
    return flatten.flatten_records(_figures(spark, sf_dir)).groupBy("candidate_key", "figure_label", "organism", "sample").agg(F.count("*").alias("n"))


@query(_FLAT + "SELECT candidate_key, lane_index, max(condition) AS condition FROM flat GROUP BY ALL")
def lane_lookup_last_wins(spark, sf_dir):
    return flatten.flatten_records(_figures(spark, sf_dir)).groupBy("candidate_key", "lane_index").agg(F.max("condition").alias("condition"))


@query("SELECT o_orderkey, o_orderstatus <> 'P' AND n = 0 AS retry FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def retry_needed(spark, sf_dir):
    out = flatten.needs_retry(_figures(spark, sf_dir).withColumnRenamed("figure_no", "o_orderkey"))
    return out.select("o_orderkey", F.col("needs_retry").alias("retry"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.6 WHEN '3-MEDIUM' THEN 0.3 WHEN '5-LOW' THEN CAST(1.0 AS DOUBLE) END AS confidence FROM orders")
def confidence_map(spark, sf_dir):
    words = {"1-URGENT": '" High"', "2-HIGH": '"medium "', "3-MEDIUM": '"LOW"', "5-LOW": "1.4"}
    raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), F.col("o_orderpriority")), F.lit('"0.5"'))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.confidence(F.parse_json(raw)).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'loading_control' WHEN lower(trim(p_name)) LIKE 'p-%' OR lower(trim(p_name)) LIKE 'phospho-%' OR lower(trim(p_name)) LIKE 'phospho %' OR p_size % 2 = 0 THEN 'phospho_signaling' ELSE 'total_protein' END AS kind FROM part")
def blot_type(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" Phospho-"), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.blot_type(name, F.col("p_size") % 7 == 0).alias("kind"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(T.normalize_ws(F.col("text"))).alias("digest"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'paper') AS segment, coalesce(nullif(left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 80), ''), 'source') AS slug FROM pages")
def path_segment(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.path_segment(F.col("url")).alias("segment"), T.run_slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, left(sha256(source), 16) || '-' || doc_id AS scoped FROM documents")
def source_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.source_scoped_key(F.col("source"), F.col("doc_id").cast("string")).alias("scoped"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page-' || page_id ELSE 'crop.' || page_id END AS candidate_key FROM pages")
def candidate_key(spark, sf_dir):
    path = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("runs/a.b/crop."), F.col("page_id").cast("string"), F.lit(".png")))
    return table(spark, sf_dir, "pages").select("page_id", T.candidate_key(path, F.col("page_id")).alias("candidate_key"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("digest"))


@query("SELECT doc_id, '10.1234/abc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '|10.55555/x(' || (doc_id % 7) END AS dois FROM documents")
def doi_extract(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    other = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" (10.55555/x("), (F.col("doc_id") % 7).cast("string"), F.lit(").")))
    text = F.concat(F.lit("see doi:10.1234/abc"), i, F.lit("., also 10.1234/abc"), i, F.lit(";"), other)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.dois(text), "|").alias("dois"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '10.1234/a+' || doc_id WHEN 1 THEN '10.1234/b' || doc_id WHEN 2 THEN '10.1234/c d' END AS doi FROM documents WHERE doc_id % 4 <> 2 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 4 = 2")
def record_doi(spark, sf_dir):
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://DX.doi.org/10.1234%2Fa+"), i)).when(k == 2, F.lit("https://doi.org/10.1234/c%20d")).otherwise(F.lit("https://example.org/x"))
    paper = F.when(k == 1, F.concat(F.lit("doi:10.1234/b"), i)).otherwise(F.lit("paper 10.1/x"))
    return table(spark, sf_dir, "documents").select("doc_id", T.record_doi(paper, url).alias("doi"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS url FROM pages")
def url_filter(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp"), F.col("url"))).otherwise(F.lit("https:///none"))
    return table(spark, sf_dir, "pages").select("page_id", T.public_url(url).alias("url"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN upper(role) ELSE role END || text AS s FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(left(s, 3)) ORDER BY turn) AS n FROM t)
SELECT conv_id, sha256(string_agg(s, '|' ORDER BY turn)) AS digest FROM r WHERE n = 1 GROUP BY conv_id""")
def prefix_dedupe(spark, sf_dir):
    """The turns of a conversation as chunks: the first of each three letters counts."""
    chunk = F.concat(F.when(F.col("turn") % 3 == 0, F.upper("role")).otherwise(F.col("role")), F.col("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", chunk.alias("s")))), lambda x: x["s"]).alias("chunks"))
    return rows.select("conv_id", T.content_hash(F.array_join(context.dedupe_prefix(F.col("chunks"), 3), "|")).alias("digest"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return extract.latest_by_key(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT conv_id, sha256(string_agg('--- PAGE ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def full_text_agg(spark, sf_dir):
    out = context.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", context.page_marked(F.col("turn"), F.col("text")), "\n\n")
    return out.select("conv_id", T.content_hash(F.col("full_text")).alias("digest"))


@query("WITH t AS (SELECT conv_id, turn, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 2500) AS s FROM conversations) SELECT a.conv_id, a.turn, sha256(string_agg('--- PAGE ' || b.turn || ' ---' || chr(10) || b.s, chr(10) || chr(10) ORDER BY b.turn)) AS digest FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY ALL")
def neighbor_text(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return context.neighbour_text(conv, conv, "conv_id", "turn", "text").select("conv_id", "turn", T.content_hash(F.col("full_text")).alias("digest"))


_SENT = "WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS sentence, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), 1) - 1 AS pos FROM documents) "


@query(_SENT + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(sentence) AS digest FROM s")
def sentence_split(spark, sf_dir):
    return context.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("doc_id", "pos", T.content_hash(F.col("sentence")).alias("digest"))


@query(_SENT + """, m AS (SELECT *, max(CAST(sentence LIKE '%that%' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM s),
k AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m WHERE near = 1),
g AS (SELECT doc_id, island, string_agg(sentence, ' ' ORDER BY pos) AS paragraph FROM k GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) AS INTEGER) AS paragraph_no, sha256(paragraph) AS digest FROM g""")
def context_islands(spark, sf_dir):
    rows = context.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return context.context_groups(rows, "doc_id", F.col("sentence").contains("that")).select("doc_id", "paragraph_no", T.content_hash(F.col("paragraph")).alias("digest"))


@query("SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits, CAST(strpos(lower(text), 'the') - 1 AS INTEGER) AS first_at FROM documents WHERE strpos(lower(text), 'the') > 0")
def keyword_hits(spark, sf_dir):
    at = context.match_offsets(F.lower("text"), "the")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(at).cast("long").alias("hits"), F.try_element_at(at, F.lit(1)).alias("first_at")).filter("hits > 0")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE coalesce(l_discount * 10, 0) >= 0.65")
def score_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("cv_score", F.col("l_discount") * 10)
    return cand.good_candidates(rows).select("l_orderkey", "l_linenumber", "l_discount")


_SCORE = """WITH f AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 20 AS INTEGER) AS w, CAST(l_partkey % 900 + 60 AS INTEGER) AS h, l_discount * 1000 AS sat, l_tax * 8 AS dark, l_discount AS horiz, l_quantity / 20 AS rr, l_quantity / 30 AS cr FROM lineitem),
s AS (SELECT *, 0.25 * greatest(0.0, 1 - sat / 80) + 0.20 * least(dark / 0.18, 1.0) + 0.30 * least(horiz / 0.08, 1.0) + 0.15 * least(rr / 1.8, 1.0) + 0.10 * least(cr / 2.5, 1.0) AS raw FROM f) """


@query(_SCORE + "SELECT l_orderkey, l_linenumber, round(CASE WHEN w >= 180 AND h >= 80 AND w * h >= 40000 AND w / greatest(h, 1) BETWEEN 0.6 AND 8.0 AND dark BETWEEN 0.01 AND 0.65 THEN CASE WHEN sat > 70 THEN raw * 0.4 ELSE raw END ELSE 0.0 END, 6) AS score FROM s")
def score_formula(spark, sf_dir):
    w, h = (F.col("l_quantity") * 20).cast("int"), (F.col("l_partkey") % 900 + 60).cast("int")
    score = cand.candidate_score(w, h, F.col("l_discount") * 1000, F.col("l_tax") * 8, F.col("l_discount"), F.col("l_quantity") / 20, F.col("l_quantity") / 30)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, x - 240) AS x1, greatest(0, y - 60) AS y1, least(2000, x + w + 20) AS x2, least(1500, y + h + 20) AS y2 FROM (SELECT *, CAST(l_partkey % 1700 AS INTEGER) AS x, CAST(l_suppkey % 1300 AS INTEGER) AS y, CAST(l_quantity * 10 AS INTEGER) AS w, CAST(l_linenumber * 50 AS INTEGER) AS h FROM lineitem)")
def bbox_expand(spark, sf_dir):
    x, y, w, h = (F.col("l_partkey") % 1700).cast("int"), (F.col("l_suppkey") % 1300).cast("int"), (F.col("l_quantity") * 10).cast("int"), (F.col("l_linenumber") * 50).cast("int")
    box = cand.expand_bbox(x, y, w, h, F.lit(2000), F.lit(1500))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[box[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT o_orderkey, round(round(o_totalprice * 1000) / 16384 / 1000, 3) AS score FROM orders ORDER BY round(o_totalprice * 1000) / 16384 / 1000 DESC, o_orderkey LIMIT 20")
def top_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.round(F.col("o_totalprice") * 1000) / 16384 / 1000).alias("score"))
    return cand.top_candidates(rows, "score", "o_orderkey")


@query("WITH d AS (SELECT p_partkey, CAST(p_size * 60 AS INTEGER) AS w, CAST(p_partkey % 3000 AS INTEGER) AS h FROM part), c AS (SELECT *, CAST(least(h - 200, greatest(200, h // 2 + least(120, greatest(40, h // 14)))) AS INTEGER) AS cut FROM d WHERE h >= 1200 AND w >= 900) SELECT p_partkey, 1 AS part, 0 AS x1, 0 AS y1, w AS x2, cut AS y2 FROM c UNION ALL SELECT p_partkey, 2, 0, cut, w, h FROM c")
def split_boxes(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60).cast("int").alias("w"), (F.col("p_partkey") % 3000).cast("int").alias("h"))
    return dims.select("p_partkey", F.inline(cand.split_boxes(F.col("w"), F.col("h"))))


@query("SELECT p_partkey, CAST(w * least(1.0, 1800.0 / greatest(w, h)) AS INTEGER) AS width, CAST(h * least(1.0, 1800.0 / greatest(w, h)) AS INTEGER) AS height FROM (SELECT p_partkey, 1800 * (1 + p_size % 2) AS w, 900 AS h FROM part)")
def scaled_size(spark, sf_dir):
    size = cand.scaled_size(F.lit(1800) * (1 + F.col("p_size") % 2), F.lit(900))
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def resume_antijoin(spark, sf_dir):
    """Documents are candidates; those of good quality have a usable cached result, the others an error."""
    path = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("candidate_path"), F.col("doc_id").alias("candidate_no"))
    answer = F.when(F.col("quality") == 1, '{"is_western_blot": false}').otherwise('{"error": "bad_json"}')
    cache = table(spark, sf_dir, "labels").select(path.alias("candidate_path"), F.lit("p").alias("paper_id"), F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.parse_json(answer).alias("extraction"))
    return extract.resume(docs, cache)[1].select("doc_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS fault FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def result_completeness(spark, sf_dir):
    return extract.completeness_faults(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("doc_id % 2 = 0"), "doc_id")


@query("SELECT (SELECT count(*) FROM documents) AS candidates, count(*) AS results, count(*) FILTER (toxic = 1) AS positive_results, count(*) FILTER (quality = 0) AS failed_candidates, count(*) FILTER (doc_id % 3 = 0) AS cached, count(*) FILTER (doc_id % 3 <> 0) AS queried FROM labels")
def run_summary(spark, sf_dir):
    results = table(spark, sf_dir, "labels")
    return extract.run_summary(table(spark, sf_dir, "documents"), results, results.filter("doc_id % 3 = 0"), F.col("toxic") == 1, F.col("quality") == 0)


@query("""SELECT conv_id, coalesce(arg_min(role, turn) FILTER (turn >= 1), '') AS figure_label, count(*) AS n_panels,
'[' || string_agg(CASE WHEN turn % 3 = 2 THEN '{"panel_label":"own"}' ELSE '{"panel_label":' || turn || ',"warnings":["' || turn || '"]}' END, ',' ORDER BY turn) || ']' AS panels,
string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || ',split' AS warnings FROM conversations GROUP BY conv_id""")
def merge_parts(spark, sf_dir):
    """Turns are parts: the first turn's label is blank, so the second's counts; a part with panels brings those, any other its own panel keys."""
    label = F.when(F.col("turn") >= 1, F.col("role")).otherwise("")
    own = F.when(F.col("turn") % 3 == 2, F.array(F.struct(F.lit("own").alias("panel_label"))))
    ext = F.to_json(F.struct(F.lit(True).alias("is_western_blot"), label.alias("figure_label"), F.col("turn").alias("panel_label"), own.alias("panels"), F.array(F.col("turn").cast("string")).alias("warnings")))
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("part_no"), F.parse_json(ext).alias("extraction"))
    out, ext = flatten.merge_parts(parts, "split"), F.col("extraction")
    warnings = F.array_join(F.try_variant_get(ext, "$.warnings", "array<string>"), ",")
    panels = V.list_field(ext, "panels")
    shown = F.concat(F.lit("["), F.array_join(F.transform(panels, lambda p: F.to_json(p)), ","), F.lit("]"))
    return out.select(F.col("key").alias("conv_id"), F.try_variant_get(ext, "$.figure_label", "string").alias("figure_label"), F.size(panels).cast("long").alias("n_panels"), shown.alias("panels"), warnings.alias("warnings"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'bad_json' END AS error, CASE event_id % 3 WHEN 0 THEN NULL ELSE event_type END AS kind FROM events")
def model_json(spark, sf_dir):
    body = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('"}'))
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.lit('{"a":1}{"b":2}')).when(k == 1, F.concat(F.lit("<think>{x}</think>\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Answer: "), body, F.lit(" done")))
    parsed = table(spark, sf_dir, "events").select("event_id", strict_json.model_json(raw).alias("v"))
    return parsed.select("event_id", F.try_variant_get("v", "$.error", "string").alias("error"), F.try_variant_get("v", "$.kind", "string").alias("kind"))


@query("SELECT event_id, CAST(json_type(props, '$') AS VARCHAR) = 'OBJECT' AS is_object, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL")
def json_props(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").filter("props IS NOT NULL").select("event_id", V.is_object(v).alias("is_object"), F.coalesce(F.json_object_keys(F.col("props")), F.array()).alias("k")).select("event_id", "is_object", F.size("k").cast("long").alias("n_keys"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, CAST(l_quantity * 25 AS INTEGER) AS w, CAST(l_partkey % 1100 AS INTEGER) AS h FROM lineitem) WHERE w * h >= 40000 AND NOT (w > 0.95 * 1200 AND h > 0.95 * 1000)")
def geometry_filter(spark, sf_dir):
    w, h = (F.col("l_quantity") * 25).cast("int"), (F.col("l_partkey") % 1100).cast("int")
    return table(spark, sf_dir, "lineitem").filter(cand.passes_geometry(w, h, F.lit(1200), F.lit(1000))).select("l_orderkey", "l_linenumber")


@query("WITH c AS (SELECT doc_id, arg_max(quality * 10 + toxic, doc_id + quality) AS v FROM labels GROUP BY doc_id) SELECT d.doc_id, coalesce(CAST(v AS VARCHAR), '') AS text_context FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id")
def candidate_context_join(spark, sf_dir):
    path = F.col("doc_id").cast("string").alias("candidate_path")
    contexts = table(spark, sf_dir, "labels").select(path, (F.col("doc_id") + F.col("quality")).alias("line_no"), (F.col("quality") * 10 + F.col("toxic")).cast("string").alias("text_context"))
    return extract.with_context(table(spark, sf_dir, "documents").select("doc_id", path), contexts).select("doc_id", "text_context")


@query("SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src1'")
def foreign_papers(spark, sf_dir):
    return extract.foreign_papers(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("paper_id")), "src1").select("doc_id")


@query("SELECT doc_id, sha256(left('given' || chr(10) || chr(10) || text, 12000)) AS digest FROM documents")
def user_context_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(context.with_user_context(F.lit("given"), F.col("text"))).alias("digest"))


_CLEAN = "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents), "
_WINDOWS = """p AS (SELECT doc_id, s, string_split({low}, '{term}') AS parts FROM t), o AS (SELECT doc_id, s, unnest(list_slice(range(1, len(parts)), 1, {most})) AS k, parts FROM p WHERE len(parts) > 1),
w AS (SELECT doc_id, s, k, CAST(list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))) AS BIGINT) + (k - 1) * {size} AS pos FROM o),
v AS (SELECT doc_id, k, substring(s, greatest(0, pos - {before}) + 1, least(length(s), pos + {after}) - greatest(0, pos - {before})) AS win FROM w),
f AS (SELECT doc_id, k, win, row_number() OVER (PARTITION BY doc_id, lower(left(win, 250)) ORDER BY k) AS n FROM v), g AS (SELECT doc_id, k, win, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM f WHERE n = 1) """


@query(_CLEAN + _WINDOWS.format(low="lower(s)", term="that", size=4, most=48, before=350, after=354) + "SELECT t.doc_id, sha256(coalesce(string_agg('- ' || win, chr(10) || chr(10) ORDER BY k) FILTER (i <= 16), '')) AS digest FROM t LEFT JOIN g ON g.doc_id = t.doc_id GROUP BY t.doc_id")
def snippet_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(context.snippets(F.col("text"), ("that",))).alias("digest"))


@query(_CLEAN.replace("text,", "regexp_replace(text, ' that ', ' Figure 2 ', 'g'),") + _WINDOWS.format(low="s", term="Figure 2", size=8, most=100000000, before=300, after=2500) + "SELECT t.doc_id, sha256(coalesce(left(string_agg(win, chr(10) || chr(10) ORDER BY k), 5000), '')) AS digest FROM t LEFT JOIN g ON g.doc_id = t.doc_id GROUP BY t.doc_id")
def figure_mentions(spark, sf_dir):
    text = F.regexp_replace("text", " that ", " Figure 2 ")
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(context.figure_context(text)).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '—' ELSE CAST(p_size AS VARCHAR) END AS shown, CASE WHEN p_size % 2 = 0 THEN 'https://x.org/' || p_partkey WHEN p_size % 5 <> 0 THEN 'https://doi.org/10.1234/a%20b/' || p_partkey END AS link, 'm@' || p_size AS version FROM part")
def display_values(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    url = F.when(size % 2 == 0, F.concat(F.lit("https://x.org/"), key)).otherwise("javascript:x")
    doi = F.when(size % 5 != 0, F.concat(F.lit("10.1234/a b/"), key))
    return table(spark, sf_dir, "part").select("p_partkey", T.display(F.when(size % 3 != 0, size)).alias("shown"), T.source_link(doi, url).alias("link"), T.model_version(F.lit("m"), size.cast("string")).alias("version"))


@query("SELECT conv_id AS paper_id, CASE WHEN conv_id % 3 = 0 THEN '10.1234/meta' || conv_id WHEN min(turn) FILTER (turn % 2 = 1 AND turn <= 3) IS NOT NULL THEN '10.1234/p' || min(turn) FILTER (turn % 2 = 1 AND turn <= 3) END AS doi FROM conversations GROUP BY conv_id")
def paper_doi(spark, sf_dir):
    turn = F.col("turn")
    text = F.when(turn % 2 == 1, F.concat(F.lit("see 10.1234/p"), turn.cast("string"), F.lit(", and 10.9999/z"))).otherwise("none")
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), turn.alias("page"), text.alias("text"))
    return ingest.paper_doi(pages, F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit("doi:10.1234/meta"), F.col("paper_id").cast("string"))))


@query("SELECT doc_id AS id, doc_id % 2 = 0 AS has_image, CASE WHEN doc_id % 2 = 0 AND quality IS NOT NULL AND quality = 1 THEN 'caption ' || doc_id ELSE '' END AS figure_caption, CASE WHEN doc_id % 3 = 0 THEN 'https://x.org/' || doc_id END AS source_url FROM (SELECT DISTINCT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")
def record_detail(spark, sf_dir):
    """Documents are records; half have a crop in a run, labels are the run's results, the good ones positive."""
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("runs/r/panel_candidates/c"), i, F.lit(".png"))).otherwise(F.concat(F.lit("../c"), i, F.lit(".png")))
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://x.org/"), i)).otherwise("file:///etc")
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("p").alias("paper_id"), path.alias("candidate_path"), url.alias("source_url"), F.lit(1).alias("page"))
    records = spark.createDataFrame([], catalog.SCHEMA).unionByName(given, allowMissingColumns=True)
    answer = F.to_json(F.struct((F.col("quality") == 1).alias("is_western_blot"), F.concat(F.lit("caption "), i).alias("figure_caption")))
    cache = table(spark, sf_dir, "labels").select(F.lit("runs/r").alias("run"), F.concat(F.lit("/old/c"), i, F.lit(".png")).alias("candidate_path"), F.lit(1).alias("line_no"), F.parse_json(answer).alias("extraction"))
    pages = spark.createDataFrame([], "run string, page int, page_no int, text string")
    out = detail.record_detail(records, cache, pages)
    return out.select("id", F.col("image_url").isNotNull().alias("has_image"), "figure_caption", "source_url")


def _scratch(spark: SparkSession) -> str:
    """A fresh folder where a query that publishes keeps its versions and runs: shared on a cluster, local in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='bandloom-')).rstrip('/')}/query-{uuid.uuid4().hex}"


@query("""SELECT doc_id, quality * 2 + toxic = 1 AS positive, CASE quality * 2 + toxic WHEN 2 THEN 'vlm_request_failed' WHEN 3 THEN 'invalid_extraction' END AS error,
count(*) FILTER (quality = 1) OVER () AS failed_candidates, count(*) OVER () AS queried FROM labels""")
def extraction_run(spark, sf_dir):
    """Labels are candidates; their two marks tell what the model answers: no, yes, nothing, nonsense."""
    path = F.concat(F.lit("runs/r/panel_candidates/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("candidate_path")
    labels = table(spark, sf_dir, "labels")
    candidates = labels.select(F.col("doc_id").alias("candidate_no"), path, F.lit("p").alias("paper_id"), F.lit(1).alias("page"))
    contexts = labels.select(path, (F.col("quality") * 2 + F.col("toxic")).cast("string").alias("text_context"), F.lit(1).alias("line_no"))
    dots = labels.select(path, F.lit(2).alias("width_px"), F.lit(1).alias("height_px"), F.unhex(F.lit("000000ffffff")).alias("bgr"))

    def model(_: str, text_context: str, data_url: str | None) -> str:
        if not data_url or text_context == "2":
            raise TimeoutError("no answer")
        return {"0": '{"is_western_blot": false}', "1": '{"is_western_blot": true, "bands": [{"target": "x"}]}'}.get(text_context, "[]")

    results, summary = extract.run_extraction(candidates, contexts, dots, model, _scratch(spark), wave=100_000)
    ext = F.col("extraction")
    return results.crossJoin(F.broadcast(summary)).select(F.col("candidate_no").alias("doc_id"), flatten.is_positive(ext).alias("positive"), F.try_variant_get(ext, "$.error", "string").alias("error"), "failed_candidates", "queried")


_SUPPLIERS = "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS paper_id, s_name AS target, CASE WHEN s_nationkey < 10 THEN 'again' ELSE 'once' END AS sample FROM supplier WHERE s_nationkey >= 10 OR s_suppkey % 2 = 0"


@query(f"SELECT paper_id, target, sample, count(*) OVER (PARTITION BY paper_id) AS of_paper, s.total FROM ({_SUPPLIERS}), (SELECT count(*) AS total FROM ({_SUPPLIERS}) WHERE target ILIKE '%u%' AND sample ILIKE '%again%' AND paper_id = '4') s")
def catalog_versions(spark, sf_dir):
    """Suppliers are records of their nation's paper; a second batch brings those of ten nations again, without every other one."""
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("paper_id"), F.col("s_suppkey").cast("string").alias("candidate_key"), F.lit(1).alias("page"), F.col("s_name").alias("target"), F.lit(False).alias("is_loading_control"),
        F.lit("total_protein").alias("western_blot_type"), F.lit("s").alias("source_id"), F.lit("once").alias("sample"), "s_suppkey",
    )
    store = catalog.Catalog(spark, _scratch(spark))
    store.initialize()
    store.replace_batch(rows.drop("s_suppkey"), rows.select("paper_id", "source_id").distinct())
    again = rows.filter("CAST(paper_id AS INT) < 10")
    store.replace_batch(again.filter("s_suppkey % 2 = 0").drop("s_suppkey").withColumn("sample", F.lit("again")), again.select("paper_id", "source_id").distinct())
    _, total = store.search(search.Criteria(q="u", sample="again", paper_id="4"), 200)
    of_paper = F.count("*").over(Window.partitionBy("paper_id"))
    return store.rows().crossJoin(F.broadcast(total)).select("paper_id", "target", "sample", of_paper.alias("of_paper"), "total")


@query("""WITH p AS (SELECT doc_id, r, c, CAST('0x' || substring(md5(text), 8 * r + 2 * c + 1, 2) AS INTEGER) AS g FROM documents, range(0, 4) AS a(r), range(0, 4) AS b(c)),
rows_ AS (SELECT doc_id, stddev_pop(m) / (avg(m) + 1e-6) AS row_ratio FROM (SELECT doc_id, r, avg(255 - g) AS m FROM p GROUP BY ALL) GROUP BY doc_id),
cols_ AS (SELECT doc_id, stddev_pop(m) / (avg(m) + 1e-6) AS col_ratio FROM (SELECT doc_id, c, avg(255 - g) AS m FROM p GROUP BY ALL) GROUP BY doc_id)
SELECT p.doc_id, avg(CAST(g < 210 AS INTEGER)) AS dark, round(any_value(row_ratio), 6) AS row_ratio, round(any_value(col_ratio), 6) AS col_ratio, 0.0::DOUBLE AS saturation
FROM p JOIN rows_ ON rows_.doc_id = p.doc_id JOIN cols_ ON cols_.doc_id = p.doc_id GROUP BY p.doc_id""")
def image_measures(spark, sf_dir):
    """The digest of each text as a gray image of four by four."""
    bgr = F.unhex(F.regexp_replace(F.md5(F.col("text").cast("binary")), "(..)", "$1$1$1"))
    out = images.image_features(table(spark, sf_dir, "documents").select("doc_id", F.lit(4).alias("width_px"), F.lit(4).alias("height_px"), bgr.alias("bgr")))
    return out.select("doc_id", "dark", F.round("row_ratio", 6).alias("row_ratio"), F.round("col_ratio", 6).alias("col_ratio"), "saturation")


_TERMS = ("the", "rat", "of")
_HITS = " UNION ALL ".join(f"SELECT doc_id, s, {i} AS term, {len(t)} AS size, string_split(lower(s), '{t}') AS parts FROM t" for i, t in enumerate(_TERMS))


@query(_CLEAN + f"""h AS ({_HITS}), n AS (SELECT doc_id, max(len(parts) - 1) FILTER (term = 0) AS n0, max(len(parts) - 1) FILTER (term = 1) AS n1 FROM h GROUP BY doc_id),
m AS (SELECT doc_id, least(n0, 48) AS c0, least(n0, 48) + least(n1, greatest(1, 48 - least(n0, 48))) AS c1 FROM n),
o AS (SELECT h.doc_id, s, term, size, parts, unnest(range(1, least(len(parts), 1 + CASE term WHEN 0 THEN 48 WHEN 1 THEN greatest(1, 48 - c0) ELSE greatest(1, 48 - c1) END))) AS k FROM h JOIN m ON m.doc_id = h.doc_id),
w AS (SELECT doc_id, s, term, size, k, CAST(list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))) AS BIGINT) + (k - 1) * size AS pos FROM o),
v AS (SELECT doc_id, term, k, substring(s, greatest(0, pos - 350) + 1, least(length(s), pos + size + 350) - greatest(0, pos - 350)) AS win FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(left(win, 250)) ORDER BY term, k) AS first FROM v),
g AS (SELECT doc_id, term, k, win, row_number() OVER (PARTITION BY doc_id ORDER BY term, k) AS i FROM f WHERE first = 1)
SELECT t.doc_id, sha256(coalesce(string_agg('- ' || win, chr(10) || chr(10) ORDER BY term, k) FILTER (i <= 16), '')) AS digest FROM t LEFT JOIN g ON g.doc_id = t.doc_id GROUP BY t.doc_id""")
def keyword_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(context.snippets(F.col("text"), _TERMS)).alias("digest"))


@query(_CLEAN.replace("text,", "regexp_replace(text, '\\bthe\\b', 'Figure 2', 'g'),") + _WINDOWS.format(low="s", term="Figure 2", size=8, most=100000000, before=300, after=2500) + "SELECT t.doc_id, sha256(coalesce(left(string_agg(win, chr(10) || chr(10) ORDER BY k), 5000), '')) AS digest FROM t LEFT JOIN g ON g.doc_id = t.doc_id GROUP BY t.doc_id")
def figure_windows(spark, sf_dir):
    text = F.regexp_replace("text", r"\bthe\b", "Figure 2")
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(context.figure_context(text)).alias("digest"))


@query("""SELECT doc_id, 't' || doc_id AS target, true AS has_image, sha256(text) AS image_sha256, sha256(text) AS file_sha256, 'caption ' || doc_id AS figure_caption,
coalesce('After ' || lag(doc_id) OVER (ORDER BY doc_id) || ' it ended. ', '') || 'Before ' || doc_id || ' it began. Figure ' || doc_id || ' shows the source ' || source || '. After ' || doc_id || ' it ended.' AS paper_context
FROM documents WHERE source IS NOT NULL""")
def ingested_evidence(spark, sf_dir):
    """Documents are the crops of one paper: ingested, then every record, its published file, caption and figure sentences read back."""
    i = F.col("doc_id").cast("string")
    root = _scratch(spark)
    whole = _by_ranges(table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", "source", "text"), "doc_id", f"{root}/documents")
    docs = extract.stored(_ranked(whole.select("doc_id", "source", "range"), "doc_id", "place"), f"{root}/places")
    path = F.concat(F.lit("runs/r/panel_candidates/"), i, F.lit(".png")).alias("candidate_path")
    candidates = docs.select(F.col("doc_id").alias("candidate_no"), path, F.lit("p").alias("paper_id"), F.col("place").alias("page"))
    contexts = docs.select(path, i.alias("text_context"), F.lit(1).alias("line_no"))
    dots = docs.select(path, F.lit(2).alias("width_px"), F.lit(1).alias("height_px"), F.unhex(F.lit("000000ffffff")).alias("bgr"))
    crops = whole.select(F.concat(i, F.lit(".png")).alias("name"), F.col("text").cast("binary").alias("content"))
    about = F.concat(F.lit("Before "), i, F.lit(" it began. Figure "), i, F.lit(" shows the source "), "source", F.lit(". After "), i, F.lit(" it ended."))

    def model(_: str, number: str, __: str | None) -> str:
        return f'{{"is_western_blot": true, "figure_label": "Figure {number}", "figure_caption": "caption {number}", "bands": [{{"target": "t{number}", "band_state": "present"}}]}}'

    store, settings = catalog.Catalog(spark, f"{root}/catalog"), Settings(data_dir=f"{root}/data")
    out = ingest.ingest(store, model, candidates, contexts, dots, crops, "paper.pdf", "p", settings, pages=docs.select(F.col("place").alias("page"), about.alias("text")))
    shown = detail.published_detail(store.rows(), settings.data_dir)
    files = assets.read_files(_dealt(store.rows().select(F.col("candidate_path").alias("name")).distinct(), 4_000), settings.data_dir)
    files = files.select(F.regexp_extract("name", r"([^/]+)\.png$", 1).cast("long").alias("doc_id"), F.sha2("content", 256).alias("file_sha256"))
    rows = shown.select(F.substring("target", 2, 20).cast("long").alias("doc_id"), "target", F.col("image_url").isNotNull().alias("has_image"), "image_sha256", "figure_caption", "paper_context")
    return rows.join(files, "doc_id", "left")


_HEAD = "10.1234/abc.7\nJones et al.\n42\nsee www.Frontiersin.org now\nFrontiers in Cell Biology"
_EVEN, _ODD = "A\n B \nFigure 7\nThe caption.", "Fig 7\nwell-\nknown 123\n7"


@query(f"""WITH l AS (SELECT doc_id, string_split(concat_ws(chr(10), '{_HEAD}', text, CASE WHEN doc_id % 2 = 0 THEN '{_EVEN}' ELSE '{_ODD}' END), chr(10)) AS lines FROM documents),
c AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '^\\s*(FIGURE|Figure)\\s+\\d+\\s*$')), true), 0) AS cut FROM l),
b AS (SELECT doc_id, CASE WHEN cut > 0 THEN regexp_replace(chr(10) || array_to_string(lines[1:cut - 1], chr(10)), '(\\n[ \\t]*[A-Z][ \\t]*)+$', '') ELSE array_to_string(lines, chr(10)) END AS before FROM c),
k AS (SELECT doc_id, list_filter(string_split(before, chr(10)), lambda x: NOT (regexp_matches(x, '^\\s*\\d{{2}}\\s*$') OR regexp_matches(x, '^\\s*10\\.\\d{{4,9}}/\\S+\\s*$')
OR regexp_matches(x, '(?i)^\\s*\\S+\\s+et al\\.\\s*$') OR regexp_matches(x, '^\\s*Frontiers in \\S+(\\s+\\S+)*\\s*$') OR contains(lower(x), 'frontiersin.org'))) AS kept FROM b)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(array_to_string(kept, chr(10)), '(\\w)-\\n(\\w)', '\\1-\\2', 'g'), '\\s+', ' ', 'g'))) AS digest FROM k""")
def page_bodies(spark, sf_dir):
    """Documents as pages with furniture above, and below a figure heading under panel letters, or a broken word and no heading."""
    raw = F.concat_ws("\n", F.lit(_HEAD), "text", F.when(F.col("doc_id") % 2 == 0, _EVEN).otherwise(_ODD))
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(T.page_body(raw)).alias("digest"))


_PAGE = "'Opening words. ' || CASE turn % 3 WHEN 0 THEN 'Figure ' || (turn % 4) || 'A shows it. ' WHEN 1 THEN 'See Supplementary Figure ' || (turn % 4) || '. ' ELSE 'Both figs ' || (turn % 4) || '0 and more. ' END || text"


@query(f"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace({_PAGE}, '\\s+', ' ', 'g')) AS body FROM conversations),
w AS (SELECT r.conv_id, r.turn, CAST(r.turn % 4 AS VARCHAR) AS n, string_agg(body, ' ' ORDER BY p.turn) AS t FROM conversations r JOIN p ON p.conv_id = r.conv_id AND p.turn BETWEEN r.turn - 2 AND r.turn + 1 WHERE r.turn % 5 <> 4 GROUP BY ALL),
l AS (SELECT conv_id, turn, n, string_split(regexp_replace(t, '([.!?])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM w),
s AS (SELECT conv_id, turn, n, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM l),
m AS (SELECT *, max(CAST(regexp_matches(regexp_replace(sentence, '(?i)supplementary fig', '', 'g'), '(?i)\\bfig(ure)?s?\\.?\\s*' || n) AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM s),
k AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM m WHERE near = 1),
g AS (SELECT conv_id, turn, island, string_agg(sentence, ' ' ORDER BY pos) AS paragraph FROM k GROUP BY ALL)
SELECT conv_id, turn, sha256(string_agg(paragraph, chr(10) || chr(10) ORDER BY island)) AS digest FROM g GROUP BY ALL""")
def page_windows(spark, sf_dir):
    """Conversations are papers, their turns pages and records; a record's figure is sought two pages before to one after its own."""
    conv, turn = table(spark, sf_dir, "conversations"), F.col("turn").cast("int")
    number = (turn % 4).cast("string")
    said = F.when(turn % 3 == 0, F.concat(F.lit("Figure "), number, F.lit("A shows it. "))).when(turn % 3 == 1, F.concat(F.lit("See Supplementary Figure "), number, F.lit(". "))).otherwise(F.concat(F.lit("Both figs "), number, F.lit("0 and more. ")))
    label = F.when(turn % 5 == 4, "a blot").otherwise(F.concat(F.lit("Fig. "), number, F.lit(" of 9")))
    records = conv.select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").alias("run"), turn.alias("page"), label.alias("figure_label"))
    pages = conv.select(F.col("conv_id").alias("run"), turn.alias("page"), turn.alias("page_no"), F.concat(F.lit("Opening words. "), said, "text").alias("text"))
    return context.page_context(records, pages).select("id.conv_id", "id.turn", T.content_hash(F.col("paper_context")).alias("digest"))


_SAMPLES = (" the ", " cell lines "), (" la ", " mouse tissue "), (" der ", " Western Blot "), (" of ", " mice "), (" et ", " rat ")
_TERM_ROWS = ", ".join(f"({i}, '{term}')" for i, term in enumerate(context.SAMPLE_KEYWORDS))


def _replaced(text: str) -> str:
    for old, new in _SAMPLES:
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace({_replaced("text")}, '\\s+', ' ', 'g')) AS s FROM documents),
h AS (SELECT doc_id, s, i, term, string_split(lower(s), term) AS parts FROM t, (VALUES {_TERM_ROWS}) AS v(i, term)),
n AS (SELECT doc_id, list([len(parts) - 1] ORDER BY i) AS hits FROM h GROUP BY doc_id),
a AS (SELECT doc_id, list_reduce([[0]] || hits, lambda acc, x: acc || [least(x[1], greatest(1, 48 - list_sum(acc)))]) AS taken FROM n),
o AS (SELECT h.doc_id, s, i, term, parts, unnest(range(1, 1 + CAST(taken[i + 2] AS BIGINT))) AS k FROM h JOIN a ON a.doc_id = h.doc_id),
w AS (SELECT doc_id, s, i, k, length(term) AS size, CAST(list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))) AS BIGINT) + (k - 1) * length(term) AS pos FROM o),
v AS (SELECT doc_id, i, k, substring(s, greatest(0, pos - 350) + 1, least(length(s), pos + size + 350) - greatest(0, pos - 350)) AS win FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(left(win, 250)) ORDER BY i, k) AS first FROM v),
g AS (SELECT doc_id, i, k, win, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS place FROM f WHERE first = 1)
SELECT t.doc_id, sha256(coalesce(string_agg('- ' || win, chr(10) || chr(10) ORDER BY i, k) FILTER (place <= 16), '')) AS digest FROM t LEFT JOIN g ON g.doc_id = t.doc_id GROUP BY t.doc_id""")
def sample_snippets(spark, sf_dir):
    """All sample terms in documents whose commonest words have become some of them."""
    text = F.expr(_replaced("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(context.snippets(text)).alias("digest"))


@query("""SELECT s_suppkey, s_suppkey % 10 = 0 AND s_suppkey % 40 = 0 AS positive,
CASE WHEN s_suppkey % 10 = 0 THEN CASE WHEN s_suppkey % 40 >= 20 THEN 'vlm_request_failed' END WHEN s_suppkey % 3 = 0 THEN 'vlm_request_failed' END AS error,
CASE WHEN s_suppkey % 10 <> 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'no answer' END WHEN s_suppkey % 40 = 20 THEN 'no answer; no answer' WHEN s_suppkey % 40 = 30 THEN 'no answer; the answer for this half is no valid extraction' END AS message,
CASE WHEN s_suppkey % 10 = 0 AND s_suppkey % 40 < 20 THEN 'runs/r/vlm_panel_splits/' || s_suppkey || '_part_01.png, runs/r/vlm_panel_splits/' || s_suppkey || '_part_02.png' END AS halves,
CASE WHEN s_suppkey % 40 = 0 THEN 2 ELSE 0 END AS panels FROM supplier""")
def extraction_halves(spark, sf_dir):
    """Suppliers are candidates, every tenth with a large crop for which the model answers in halves only: yes, no, one missing, one bad."""
    key = F.col("s_suppkey")
    path = F.concat(F.lit("runs/r/panel_candidates/"), key.cast("string"), F.lit(".png")).alias("candidate_path")
    rows, large = _dealt(table(spark, sf_dir, "supplier").select("s_suppkey")), key % 10 == 0
    candidates = rows.select(key.alias("candidate_no"), path, F.lit("p").alias("paper_id"), F.lit(1).alias("page"))
    contexts = rows.select(path, key.cast("string").alias("text_context"), F.lit(1).alias("line_no"))
    shots = rows.select(path, F.when(large, 900).otherwise(2).alias("width_px"), F.when(large, 1200).otherwise(1).alias("height_px"), F.unhex(F.when(large, F.repeat(F.lit("808080"), 900 * 1200)).otherwise("000000ffffff")).alias("bgr"))

    def model(asked: str, number: str, _: str | None) -> str:
        half, kind = asked.rsplit("_part_", 1)[1:], int(number) % 40
        if not half and (int(number) % 10 == 0 or int(number) % 3 == 0) or half == ["02.png"] and kind == 20:
            raise TimeoutError("no answer")
        if half == ["02.png"] and kind == 30:
            return "[]"
        return '{"is_western_blot": true, "panel_label": "A", "bands": [{"target": "x"}]}' if kind == 0 else '{"is_western_blot": false}'

    results, _ = extract.run_extraction(candidates, contexts, shots, model, _scratch(spark))
    get = lambda name, kind: F.try_variant_get("extraction", f"$.{name}", kind)
    return results.select(
        F.col("candidate_no").alias("s_suppkey"), flatten.is_positive(F.col("extraction")).alias("positive"), get("error", "string").alias("error"), get("message", "string").alias("message"),
        F.array_join(get("split_candidate_paths", "array<string>"), ", ").alias("halves"), F.coalesce(F.array_size(get("panels", "array<variant>")), F.lit(0)).alias("panels"),
    )


@query("SELECT doc_id, coalesce((SELECT max(quality * 2 + toxic) % 2 = 0 FROM labels l WHERE l.doc_id = f.doc_id), false) AS reused FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 700) f")
def prefix_before_resume(spark, sf_dir):
    """The last documents are the first candidates: the limit counts before what labels have cached (toxic ones as errors) is taken off."""
    candidates = table(spark, sf_dir, "documents").select("doc_id", (-F.col("doc_id")).alias("candidate_no"), F.col("doc_id").cast("string").alias("candidate_path"))
    answer = F.when(F.col("toxic") == 1, '{"error": "vlm_request_failed"}').otherwise('{"is_western_blot": false}')
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("candidate_path"), F.lit("p").alias("paper_id"), F.lit(1).alias("page"), (F.col("quality") * 2 + F.col("toxic")).alias("line_no"), F.parse_json(answer).alias("extraction"))
    reused, asked = extract.resume(extract.first_candidates(candidates, 700), cache)
    return reused.select((-F.col("candidate_no")).alias("doc_id"), F.lit(True).alias("reused")).unionByName(asked.select("doc_id", F.lit(False).alias("reused")))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS d FROM documents), p AS (SELECT doc_id, CAST('0x' || substring(d, 6 * k + 1, 2) AS INTEGER) AS b, CAST('0x' || substring(d, 6 * k + 3, 2) AS INTEGER) AS g, CAST('0x' || substring(d, 6 * k + 5, 2) AS INTEGER) AS r FROM h, range(0, 10) AS t(k))
SELECT doc_id, avg(CASE WHEN greatest(b, g, r) > 0 THEN (510 * (greatest(b, g, r) - least(b, g, r)) + greatest(b, g, r)) // (2 * greatest(b, g, r)) ELSE 0 END) AS saturation,
avg(CAST((1868 * b + 9617 * g + 4899 * r + 8192) // 16384 < 210 AS INTEGER)) AS dark FROM p GROUP BY doc_id""")
def image_colours(spark, sf_dir):
    """The digest of each text as a coloured image of five by two."""
    bgr = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 60))
    out = images.image_features(table(spark, sf_dir, "documents").select("doc_id", F.lit(5).alias("width_px"), F.lit(2).alias("height_px"), bgr.alias("bgr")))
    return out.select("doc_id", "saturation", "dark")


@query("""WITH b AS (SELECT CAST(s_nationkey AS VARCHAR) AS paper_id, s_suppkey AS page, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS candidate_no, 28 + 10 * (s_suppkey % 7) AS x, 18 + 10 * (s_suppkey % 5) AS y FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT paper_id, page, candidate_no, x AS tight_x, y AS tight_y, x + 284 AS tight_right, y + 184 AS tight_bottom, greatest(0, x - 240) AS x1, greatest(0, y - 60) AS y1, least(700, x + 304) AS x2, least(400, y + 204) AS y2,
(SELECT count(*) FROM supplier) AS pages, (SELECT count(*) FROM b) AS candidate_count, (SELECT count(*) FROM b) AS llm_candidate_count, (SELECT count(*) FROM b) AS contexts_written FROM b""")
def page_boxes(spark, sf_dir):
    """Suppliers are pages of their nation's paper: a third blank, the others with one block of ink, and a speck too small to count."""
    key = F.col("s_suppkey").cast("int")
    left, top = 50 + 10 * (key % 7), 40 + 10 * (key % 5)
    white = lambda n: F.repeat(F.unhex(F.lit("ffffff")).cast("string"), n)  # noqa: E731  bytes of pixels, which only a string repeats
    ink = lambda n: F.repeat(F.unhex(F.lit("787878")).cast("string"), n)
    blank = white(F.lit(700))
    block = F.concat(F.repeat(blank, top), F.repeat(F.concat(white(left), ink(F.lit(240)), white(460 - left)), F.lit(140)))
    speck = F.concat(F.repeat(blank, 320 - top - 140), F.repeat(F.concat(white(F.lit(600)), ink(F.lit(30)), white(F.lit(70))), F.lit(5)), F.repeat(blank, F.lit(75)))
    drawn = F.when(key % 3 != 0, F.concat(block, speck)).otherwise(F.repeat(blank, F.lit(400))).cast("binary")
    pages = _dealt(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), most=512).select(F.col("s_nationkey").cast("string").alias("paper_id"), key.alias("page"), F.lit("see Figure 1").alias("text"), F.lit(700).alias("width_px"), F.lit(400).alias("height_px"), drawn.alias("bgr"))
    found, good, contexts = ingest.preprocess(pages, Settings(min_candidate_score=0.01, min_model_score=0.01), work_dir=_scratch(spark))
    counts = ingest.preprocess_summary(pages, found, good, contexts)
    corners = [F.col(box)[k].alias(name) for box, names in (("tight_bbox_page", ("tight_x", "tight_y", "tight_right", "tight_bottom")), ("bbox_page", ("x1", "y1", "x2", "y2"))) for k, name in enumerate(names)]
    return found.crossJoin(F.broadcast(counts)).select("paper_id", "page", "candidate_no", *corners, "pages", "candidate_count", "llm_candidate_count", "contexts_written")  # one row


@query("SELECT doc_id || '.png' AS file_name, 'caption \"' || doc_id || '\" é' AS caption FROM labels WHERE quality = 1")
def cached_answers(spark, sf_dir):
    """Labels written as lines of a run's cache and read back: the positive answer of each file name."""
    i = F.col("doc_id").cast("string")
    answer = F.struct((F.col("quality") == 1).alias("is_western_blot"), F.concat(F.lit('caption "'), i, F.lit('" é')).alias("figure_caption"), F.array(F.struct(F.lit("x").alias("target"))).alias("bands"))
    lines = table(spark, sf_dir, "labels").select(F.concat(F.lit("runs/r/panel_candidates/"), i, F.lit(".png")).alias("candidate_path"), F.lit(1).alias("page"), F.lit("p").alias("paper_id"), answer.alias("extraction"))
    at = _scratch(spark)
    files.write_json_lines(lines, at)
    return files.latest_positive(spark, at).select("file_name", F.try_variant_get("extraction", "$.figure_caption", "string").alias("caption"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN '—' ELSE CAST(CAST(floor(l_discount * 10 / 8 * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS confidence, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || ' ' || l_linestatus || ' ' ELSE '—' END AS kind FROM lineitem")
def shown_confidence(spark, sf_dir):
    share = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount") * 10 / 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.shown_percent(share).alias("confidence"), T.spaced(F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", F.lit("_"), "l_linestatus", F.lit("_")))).alias("kind"))
