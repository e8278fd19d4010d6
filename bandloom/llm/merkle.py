"""A Merkle manifest of a table by superblocks: fanout^k neighbouring leaves are one group of one task.

A leaf's bucket is its index in its tree, divided by fanout^k. Collapsing each bucket by k levels leaves a tree
of bucket roots that is fanout^k times smaller, which is collapsed alike until each tree is one node; the roots of
all trees are the leaves of one more tree. On the way down a bucket's upper proof goes once to its bucket, where
it is joined to the lower proof of each leaf. Digests are lower-case hex, and a node is the SHA-256 of its run of
at most fanout children, one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, id_remainder, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place: int, others: array<string>>>"
PROOF_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, or - for null."""
    framed = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*framed), 256)


def height(n: int, fanout: int = FANOUT) -> int:
    """How many levels stand above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapsed(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and the levels above them: every fanout neighbours become one, a last run of fewer too."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with idx, each row's place in its tree by the order, and n, the rows of its tree.

    Rows are dealt by ranges of tree and order, so a tree of any size lies in many tasks; the driver gets one count a
    task, and what is kept for each tree is a table of its own.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 1_000_000 + 1)
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # rows that agree in all else, dealt apart
    ranged = salted.repartitionByRange(parts, "tree", *order, "salt").sortWithinPartitions("tree", *order, "salt")
    placed = stored(ranged.drop("salt").withColumn("at", F.monotonically_increasing_id()))
    before, offsets = 0, [0] * parts
    for part, n in sorted(placed.groupBy(F.shiftright("at", 33).cast("int").alias("part")).count().collect()):
        offsets[part], before = before, before + n
    place = F.element_at(F.lit(offsets).cast("array<bigint>"), F.shiftright("at", 33).cast("int") + 1) + F.col("at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("at", place)
    trees = stored(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    return placed.join(trees, "tree").withColumn("idx", F.col("at") - F.col("first")).drop("at", "first")


def reduced(leaves: DataFrame, k: int, fanout: int = FANOUT) -> list[DataFrame]:
    """leaves (tree, idx, n, digest and what else they carry), then bucket roots, until each tree is one node."""
    size = fanout**k

    def collapse(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        n = int(nodes.n.iloc[0])
        top = collapsed(nodes.sort_values("idx").digest.tolist(), min(k, height(n, fanout)), fanout)[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // size)], "digest": top})

    levels, most = [leaves], leaves.agg(F.max("n")).first()[0]
    while most is not None and (most > 1 or len(levels) == 1):
        nodes = levels[-1].select("tree", "idx", "n", "digest", F.expr(f"idx div {size}").alias("bucket"))
        levels.append(stored(nodes.groupBy("tree", "bucket").applyInPandas(collapse, "tree string, idx long, n long, digest string")))
        most = -(-most // size)
    return levels


def _with_proofs(k: int, fanout: int, names: Sequence[str], carried: Sequence[str], given: Sequence[str]):
    """For one bucket: its nodes' columns with what stands above the bucket, lower proof before upper proof."""

    def join(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        higher = upper.column("proof")[0].as_py()
        stages = collapsed(nodes.column("digest").to_pylist(), min(k, height(nodes.column("n")[0].as_py(), fanout)), fanout)[:-1]
        steps = []
        for stage in stages:
            steps.append([])
            for j in range(len(stage)):
                begin = j - j % fanout
                steps[-1].append({"place": j - begin, "others": stage[begin:j] + stage[j + 1 : begin + fanout]})
        whole = [[step[i // fanout**level] for level, step in enumerate(steps)] + higher for i in range(len(nodes))]
        columns = [nodes.column(c) for c in carried] + [pa.repeat(upper.column(c)[0], len(nodes)) for c in given]
        return pa.Table.from_arrays([*columns, pa.array(whole, PROOF_ARROW)], names=[*names, "proof"])

    return join


def proofs(levels: list[DataFrame], above: DataFrame, k: int, keep: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """Each leaf's kept columns with its whole proof and its tree's columns of above.

    above: tree, bucket 0, the proof that stands above the tree's root, and further columns.
    """
    size, down = fanout**k, above
    given = [f for f in above.schema.fields if f.name not in ("tree", "bucket", "proof")]
    for r in range(len(levels) - 2, -1, -1):
        carried = list(keep) if r == 0 else ["tree", "idx"]
        kinds = [levels[r].schema[c] for c in carried] + given
        names = ["bucket" if f.name == "idx" and r else f.name for f in kinds]
        schema = ", ".join([*(f"`{name}` {f.dataType.simpleString()}" for name, f in zip(names, kinds, strict=True)), f"proof {PROOF}"])
        nodes = levels[r].select("tree", "idx", "n", "digest", F.expr(f"idx div {size}").alias("bucket"), *(c for c in carried if c not in ("tree", "idx", "digest")))
        join = _with_proofs(k, fanout, names, carried, [f.name for f in given])
        down = nodes.groupBy("tree", "bucket").cogroup(down.groupBy("tree", "bucket")).applyInArrow(join, schema)
        down = stored(down) if r else down
    return down


def manifest(rows: DataFrame, tree: Column, order: Sequence[str], keep: Sequence[str] = (), k: int = 4, fanout: int = FANOUT) -> DataFrame:
    """The order and kept columns of rows with their digest, and subroot, root and proof.

    rows: a column digest and what is named. tree: a text; each distinct one (null: before all others) has a tree of its
    rows, ordered (nulls first) by the order and then the digest; the roots of all trees, ordered by tree, make the tree
    above. proof: for each level the place in the run and the others of the run, from the leaf to the root. A task
    works on fanout^k nodes at a time, whatever a tree's size. Rows that agree in order and digest stand next
    to each other, each a leaf of its own; no rows give no rows.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    kept = list(dict.fromkeys([*order, "digest", *keep]))
    named = F.when(tree.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), tree))  # null sorts first
    leaves = stored(rows.select(named.alias("tree"), *kept))
    lower = reduced(numbered(leaves, [*order, "digest"]), k, fanout)
    subroots = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = reduced(numbered(subroots, ["name", "digest"]), k, fanout)
    top = upper[-1].first()
    if top is None or len(lower) == 1:
        return leaves.limit(0).select(*kept, F.lit("").alias("subroot"), F.lit("").alias("root"), F.lit(None).cast(PROOF).alias("proof"))
    crown = spark.createDataFrame([("", 0, [])], f"tree string, bucket long, proof {PROOF}")
    above = proofs(upper, crown, k, ["name", "digest"], fanout)
    above = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("bucket"), "proof", F.col("digest").alias("subroot"))
    return proofs(lower, above, k, kept, fanout).withColumn("root", F.lit(top.digest))


def folded(leaf: Column, proof: Column, fanout: int = FANOUT) -> Column:
    """The root that follows from a leaf's digest and its proof."""

    def up(node: Column, level: Column) -> Column:
        left, right = F.slice(level.others, F.lit(1), level.place), F.slice(level.others, level.place + 1, F.lit(fanout))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, from leaf to root, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: level.others)), ""), 256)


def audited(docs: DataFrame, tampered: Column, k: int = 4) -> DataFrame:
    """Every document's leaf, its proof's digest, and whether the leaf of what is found now folds to the root.

    tampered: whether a row's text is found in lower case (A to Z). Null fields are leaves of their own form; very long
    texts are hashed whole; repeated rows are a leaf each; a null doc_id stands first in its lang; other columns
    are ignored; no rows give no rows.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in FIELDS]
    found = F.when(tampered, leaf_digest([*fields[:-1], lower]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_digest(fields).alias("digest"), found.alias("found"))
    proved = manifest(rows, F.col("lang"), ["doc_id"], ["found"], k)
    checked = proved.withColumn("folded_root", folded(F.coalesce("found", "digest"), F.col("proof")))
    return checked.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"), id_remainder(F.col("doc_id"), 3) == 0)




def _framed(text: str) -> str:
    return " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))


def _fold(leaves: str, tree: str) -> str:
    """From leaves (rid, tree, i, h) up a tree's runs: the siblings passed and the node reached, level by level."""
    return f"""SELECT rid, tree, 0 AS lvl, i, h, '' AS p FROM {leaves} UNION ALL
  SELECT f.rid, f.tree, f.lvl + 1, f.i // 8, sha256(s.l || f.h || s.r), f.p || s.l || s.r FROM {tree}_fold f JOIN {tree}_sides s ON s.tree = f.tree AND s.lvl = f.lvl AND s.i = f.i AND s.n > 1"""


def _sides(tree: str) -> str:
    side = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, i // 8 ORDER BY i ROWS BETWEEN {}), '')"
    return f"SELECT tree, lvl, i, n, h, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {tree}_tree"


def _tree(leaves: str, tree: str) -> str:
    return f"SELECT tree, 0 AS lvl, i, n, h FROM {leaves} UNION ALL SELECT tree, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {tree}_tree WHERE n > 1 GROUP BY tree, lvl, i // 8, n"


_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda d, x: xor(d >> 1, (d & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295)"

OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, sha256({_framed("text")}) AS leaf,
    sha256({_framed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lower, {_CRC} % 3 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT rid, doc_id, tree, leaf AS h, CASE WHEN hit THEN lower ELSE leaf END AS found, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM docs
), low_tree AS ({_tree("leaves", "low")}),
tops AS (SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM low_tree WHERE n = 1),
top_tree AS ({_tree("tops", "top")}),
low_sides AS ({_sides("low")}),
top_sides AS ({_sides("top")}),
found AS (SELECT rid, tree, i, found AS h FROM leaves),
low_fold AS ({_fold("found", "low")}),
mid AS (SELECT f.rid, '' AS tree, t.i, f.h, f.p AS below, t.h AS subroot FROM (SELECT * FROM low_fold QUALIFY lvl = max(lvl) OVER (PARTITION BY rid)) f JOIN tops t ON t.name = f.tree),
top_fold AS ({_fold("mid", "top")}),
ends AS (SELECT * FROM top_fold QUALIFY lvl = max(lvl) OVER (PARTITION BY rid)),
root AS (SELECT h AS root FROM top_tree WHERE n = 1)
SELECT doc_id, l.h AS leaf, subroot, root, sha256(below || p) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM leaves l JOIN mid USING (rid) JOIN ends e USING (rid), root
"""
