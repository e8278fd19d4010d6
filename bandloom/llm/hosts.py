"""URL verdicts from host and path rules, and for the rest from trust over the host graph.

Trust spreads from hosts with allowed pages along links, distrust from hosts with blocked pages
against them, both as personalised PageRank; a host is blocked where distrust outweighs trust.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule's (verdict, rule) as a struct, null where none fits."""
    fits: Column | None = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        name, slash, rest = rule.partition("/")
        match = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits = F.when(match, value) if fits is None else fits.when(match, value)
    return fits if fits is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links a -> b between hosts: absolute and scheme-relative links of the pages, and each host and its parent domains, step by step to two labels, both ways.

    Pages are read once for their links, whose distinct pairs are written; very long html is searched whole.
    """
    host = host_of(F.col("url"))
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?(//[^"'\s>]+)"""), 1)
    found = pages.filter(F.instr("html", "//") > 0).select(host.alias("a"), F.explode(links).alias("link"))
    linked = stored(found.select("a", host_of(F.concat(F.lit("http:"), "link")).alias("b")).distinct())
    hosts = pages.select(host.alias("host")).unionByName(linked.select(F.col("b").alias("host"))).distinct()
    label, n = F.split("host", r"\."), F.size(F.split("host", r"\."))
    steps = F.explode(F.sequence(F.lit(1), n - 2)).alias("step")
    step = hosts.filter(n > 2).select(label.alias("label"), n.alias("n"), steps)
    up = step.select(*[F.array_join(F.slice("label", F.col("step") + k, F.col("n")), ".").alias(name) for k, name in enumerate("ab")])
    up = up.filter(F.col("a").rlike(r"^[^.]+\.") & F.col("b").rlike(r"^[^.]+\..")).distinct()
    both = linked.unionByName(up).unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.filter("a <> '' AND b <> '' AND a <> b").distinct()


def _blocks(ways: DataFrame, block_edges: int) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function that gives hosts the number of their block: a domain with others, or part of a domain with very many links.

    Any parting is right; one that keeps a domain's hosts together leaves few links between blocks.
    """
    inside = ways.filter(_domain("host") == _domain("to"))
    number = max(1, -(-ways.count() // block_edges))
    heavy = stored(inside.groupBy(_domain("host").alias("domain")).agg(F.ceil(F.count("*") / block_edges).alias("parts")).filter("parts > 1"))

    def numbered(df: DataFrame, host: str, name: str) -> DataFrame:
        joined = df.join(heavy, _domain(host) == F.col("domain"), "left")
        light = F.pmod(F.xxhash64(_domain(host)), F.lit(number))
        return joined.withColumn(name, F.when(F.col("parts").isNull(), light).otherwise(F.xxhash64("domain", F.pmod(F.xxhash64(host), F.col("parts"))))).drop("domain", "parts")

    return numbered


def _domain(host: str) -> Column:
    return F.substring_index(F.col(host), ".", -2)


def _settle(arriving: pa.Table, edges: pa.Table) -> pa.Table:
    """What passes through each host of a block until all that arrives has died out inside or left it."""
    n_arriving, n_edges = arriving.num_rows, edges.num_rows
    out = pa.schema([("side", pa.string()), ("host", pa.string()), ("passed", pa.float64())])
    if not n_arriving:
        return out.empty_table()
    names = pa.chunked_array([*arriving.column("host").chunks, *edges.column("host").chunks, *edges.column("to").chunks], pa.string()).combine_chunks().dictionary_encode()
    place, n = names.indices.to_numpy(), len(names.dictionary)
    source, target = place[n_arriving : n_arriving + n_edges], place[n_arriving + n_edges :]
    share = edges.column("share").to_numpy()
    moving = np.bincount(place[:n_arriving], arriving.column("moving").to_numpy(), n)
    passed = moving.copy()
    while (moving > passed * 1e-9).any():
        moving = np.bincount(target, moving[source] * share, n)
        passed += moving
    return pa.table([pa.repeat(arriving.column("side")[0], n), names.dictionary, pa.array(passed)], out)


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, bound: float = 1e-6, block_edges: int = 250_000) -> DataFrame:
    """side, host, mass: personalised PageRank of both sides.

    seeds has side (trust or distrust), host and a positive weight. Trust goes along the edges,
    distrust against them; a host shares its mass equally among its neighbours. Hosts are parted into
    blocks of about block_edges links. A round settles what arrives inside each block, in one task a
    block, and sends on what leaves it by joins. Ends when no host is sent more than bound of its own
    mass, so not before every host that a seed reaches has some.
    """
    ways = edges.select(F.lit("trust").alias("side"), F.col("a").alias("host"), F.col("b").alias("to")).unionByName(
        edges.select(F.lit("distrust").alias("side"), F.col("b").alias("host"), F.col("a").alias("to"))
    )
    degree = ways.groupBy("side", "host").agg((F.lit(damping) / F.count("*")).alias("share"), F.count("*").alias("degree"))
    numbered = _blocks(ways, block_edges)
    ways = stored(numbered(numbered(ways.join(degree, ["side", "host"]), "host", "block"), "to", "to_block"))
    is_inside = (F.col("block") == F.col("to_block")) & (F.col("degree") <= block_edges)  # a hub's links are too many for one task
    inside, leaving = ways.filter(is_inside).select("side", "block", "host", "to", "share"), ways.filter(~is_inside).select("side", "host", "to", "to_block", "share")
    total = seeds.groupBy("side").agg(F.sum("weight").alias("total"))
    first = seeds.join(total, "side").select("side", "host", (F.col("weight") / F.col("total") * (1 - damping)).alias("moving"))
    arriving = stored(numbered(first, "host", "block").groupBy("side", "host", "block").agg(F.sum("moving").alias("moving")))
    ranks = arriving.select("side", "host", F.lit(0.0).alias("mass"))
    while True:
        active = inside.join(arriving.select("side", "block").distinct(), ["side", "block"], "left_semi")
        passed = stored(arriving.groupBy("side", "block").cogroup(active.groupBy("side", "block")).applyInArrow(_settle, "side string, host string, passed double"))
        held = ranks
        ranks = stored(ranks.unionByName(passed.withColumnRenamed("passed", "mass")).groupBy("side", "host").agg(F.sum("mass").alias("mass")))
        if hasattr(held, "stored_at"):
            discard(held)
        sent = passed.join(leaving, ["side", "host"]).groupBy("side", F.col("to").alias("host"), F.col("to_block").alias("block"))
        last, arriving = arriving, stored(sent.agg(F.sum(F.col("passed") * F.col("share")).alias("moving")))
        discard(passed)
        discard(last)
        news = arriving.join(ranks, ["side", "host"], "left").filter(F.col("moving") > F.coalesce("mass", F.lit(0.0)) * bound)
        if news.isEmpty():
            return ranks


def judge(pages: DataFrame, rules=RULES, tolerance: float = 1e-5) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Null url or url without "://": empty host and path. A page that no rule fits takes its host's
    verdict: block where distrust exceeds trust by more than tolerance of the trust, otherwise (hosts
    that nothing reaches, ties, the empty host) allow. Null html gives no links. Repeated rows each
    give a row; html and urls of any length are read whole; other columns are ignored; no rows give no rows.
    """
    read = pages.select("page_id", "url", "html")
    parsed = read.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("by_rule"))
    side = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust")
    seeds = ruled.filter("by_rule IS NOT NULL").groupBy(side.alias("side"), "host").agg(F.count("*").cast("double").alias("weight"))
    ranks = propagate(stored(host_edges(read)), seeds)
    trust, distrust = (F.sum(F.when(F.col("side") == side, F.col("mass")).otherwise(0.0)) for side in ("trust", "distrust"))
    sides = ranks.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust"))
    blocked = sides.filter(F.col("distrust") > F.col("trust") * (1 + tolerance)).select("host", F.lit(True).alias("distrusted"))
    verdict = F.coalesce("by_rule", F.when(F.col("distrusted"), "block").otherwise("allow"))
    return ruled.join(blocked, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
