"""Near-duplicate groups by a chosen-path set similarity join over word shingles.

Each text's shingle set gets minwise tokens. A tree deals the texts into nodes by one minwise token
and deals each text of a node that stays large into several children by further ones; small nodes are
compared exhaustively. Independent trees and children bring the share of pairs that never meet to the
target at every depth. Inside a node a bitmap of each set bounds its distance to the others from below,
and what the bound leaves is compared on full sets, so no filter loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks
from .common import discard, stored
from .components import components

SKETCH = 128  # minwise tokens of which a byte each is kept, for the children of large nodes
CHOICES, SPAN, LEVELS = 6, 4, 4  # children of each text of a large node, tokens that a child's texts share, levels of children
FIRST_TREES, PIVOTS, SALTS = 2, 32, 16
SIEVE = 18  # 2 ** SIEVE words of 64 bits tell most rows that a join does not need
WIDEST = 18  # a bitmap has at most 2 ** WIDEST bits; a larger set only makes its bound weaker
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _M) | np.uint64(1)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width words; fewer words are one run; no words, none."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    run = own[: len(own) - width + 1] * _M
    for j in range(1, width):
        run = (run + own[j : len(own) - width + 1 + j]) * _M
    return np.unique(_mix(run + np.uint64(width)))


def minwise(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of the set under each of n orders."""
    factors, out = _factors(n), np.full(n, ~np.uint64(0))
    for i in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[i : i + 1024, None] * factors).min(0), out=out)
    return out


def bitmap(shingles: np.ndarray, bits_each: int) -> np.ndarray:
    """The set's hashes as bits, at least bits_each for each and at most twice as many, as 64-bit words."""
    bits = 1 << min(WIDEST, max(6, (bits_each * max(1, len(shingles)) - 1).bit_length()))
    mask = np.zeros(bits, bool)
    mask[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(mask).view(np.uint64)


def most_apart(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """How many elements sets of these sizes may have apart from one of this size to reach percent of similarity."""
    total = sizes + size
    return total - 2 * -(-percent * total // (100 + percent))


class Members:
    """A node's sets in the order of size, with bitmaps that bound their distances from below."""

    def __init__(self, bitmaps: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.sizes, self.percent, self.own = sizes, percent, bitmaps
        self.width = np.array([len(b) for b in bitmaps])
        self.place = np.zeros(len(bitmaps), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.stack([bitmaps[i] for i in at])
        self.folded = {w: m[:, : w // 2] | m[:, w // 2 :] for w, m in self.rows.items() if w > 1}

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others, in the order of size, whose bound allows the similarity with i."""
        size, w = int(self.sizes[i]), len(self.own[i])
        low, high = np.searchsorted(self.sizes[others], [-(-self.percent * size // 100), 100 * size // self.percent + 1])
        others = others[low:high]
        if not len(others):
            return others
        apart = np.full(len(others), 1 << 62)
        for u, rows, mine in ((w, self.rows.get(w), self.own[i]), (2 * w, self.folded.get(2 * w), self.own[i]), (w // 2, self.rows.get(w // 2), self.own[i][: w // 2] | self.own[i][w // 2 :] if w > 1 else None)):
            at = np.flatnonzero(self.width[others] == u)
            if len(at) and rows is not None and mine is not None:
                apart[at] = np.bitwise_count(rows[self.place[others[at]]] ^ mine).sum(1)
        return others[apart <= most_apart(self.sizes[others], size, self.percent)]


def promising(members: Members, label: np.ndarray) -> np.ndarray:
    """Whether each member's bounds allow a link to some other one of another label."""
    n = len(label)
    alive, every = np.zeros(n, bool), np.arange(n)
    for i in range(n):
        others = every[i + 1 :]
        if alive[i]:
            others = others[~alive[i + 1 :]]
        found = members.near(i, others[label[others] != label[i]])
        if len(found):
            alive[found] = alive[i] = True
    return alive


def links_within(sets: list[np.ndarray], label: np.ndarray, percent: int, bits_each: int = 16) -> list[tuple[int, int]]:
    """Pairs that join the members, in the order of size, into the groups that their links and equal labels make.

    A walk over links: each member is compared with those that no walk has reached yet.
    """
    sizes = np.array([len(s) for s in sets])
    members = Members([bitmap(s, bits_each) for s in sets], sizes, percent)
    unmet, out = np.arange(len(sets)), []
    while len(unmet):
        first, queue, unmet = int(unmet[0]), [int(unmet[0])], unmet[1:]
        for i in queue:
            same = label[unmet] == label[i]
            if same.any():
                queue += unmet[same].tolist()
                unmet = unmet[~same]
            near = members.near(i, unmet)
            for at in range(0, len(near), 256):
                part = near[at : at + 256]
                ends = np.cumsum(sizes[part])
                values = np.concatenate([sets[j] for j in part])
                spot = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
                both = np.add.reduceat(sets[i][spot] == values, ends - sizes[part], dtype=np.int64)
                linked = part[100 * both >= percent * (sizes[part] + sizes[i] - both)]
                out += [(first, int(j)) for j in linked]
                queue += linked.tolist()
                unmet = np.setdiff1d(unmet, linked, assume_unique=True)
    return out


def _profiles(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """Per row: its own number, the row itself, set size, digest of the set, first node in each tree, sketch and bitmap (null without shingles)."""
    salt = _mix(np.arange(trees, dtype=np.uint64) + np.uint64(77))
    own = [T.StructField("row", T.LongType()), T.StructField("doc", docs.schema), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]
    more = [T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("bits", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("neardup")
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc = batch.column("doc")
            n, first, second, nodes, sketch, bits = [], [], [], [], [], []
            for text in doc.field("text"):
                shingles = shingle_set(text.as_py() or "", width)
                n.append(len(shingles))
                if len(shingles):
                    token = _mix(minwise(shingles, SKETCH + trees))
                    digest = xxhash.xxh3_128_digest(shingles.tobytes())
                    first.append(int.from_bytes(digest[:8], "big", signed=True)), second.append(int.from_bytes(digest[8:], "big", signed=True))
                    nodes.append(_mix(token[SKETCH:] ^ salt).view(np.int64))
                    sketch.append((token[:SKETCH] >> np.uint64(56)).astype(np.uint8).tobytes())
                    bits.append(bitmap(shingles, 4).tobytes())
                else:
                    for column in (first, second, nodes, sketch, bits):
                        column.append(None)
            columns = [pa.array(np.arange(at, at + len(n)), pa.int64()), doc, *(pa.array(c, pa.int64()) for c in (n, first, second)), pa.array(nodes, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(bits, pa.binary())]
            at += len(n)
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in own + more])

    return docs.select(F.struct("*").alias("doc")).mapInArrow(run, T.StructType(own + more))


def _sieve(ids: DataFrame) -> DataFrame:
    """word and mask: a bitmap of hashes of the ids' only column, of at most 2 ** SIEVE words whatever their number."""
    id_ = ids.columns[0]
    return ids.select(*_spot(id_)).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, spot)")).alias("mask"))


def _spot(id_: str) -> tuple[Column, Column]:
    hashed = F.xxhash64(id_)
    return F.pmod(hashed, F.lit(1 << SIEVE)).alias("word"), F.pmod(F.shiftright(hashed, 32), F.lit(64)).cast("int").alias("spot")


def _through(df: DataFrame, id_: str, sieve: DataFrame) -> DataFrame:
    """df with passes: false only where the id is surely none of the sieve's. A broadcast of bounded size, so df is not shuffled."""
    met = df.withColumns(dict(zip(("word", "spot"), _spot(id_), strict=True))).join(F.broadcast(sieve), "word", "left")
    return met.withColumn("passes", F.coalesce(F.expr("bit_get(mask, spot) = 1"), F.lit(False))).drop("word", "spot", "mask")


def _by_node(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The named columns as lists, node by node, of rows that come sorted by node."""
    kept: list[list] = [[] for _ in range(len(names) + 1)]
    for batch in batches:
        columns = [k + batch.column(c).to_pylist() for k, c in zip(kept, ("node", *names), strict=True)]
        node = np.array(columns[0], np.int64)
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for b, e in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield [c[b:e] for c in columns[1:]]
        kept = [c[cuts[-2] :] for c in columns]
    if kept[0]:
        yield kept[1:]


def _links(members: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a, b that join the members (node, v, n_shingles, label) of each node into groups; no node is large."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("neardup")
        for node, v, n, label, bits in _by_node(batches, "node", "v", "n_shingles", "label", "bits"):
            alive = np.flatnonzero(promising(Members([np.frombuffer(b, np.uint64) for b in bits], np.array(n), percent), np.array(label)))
            if len(alive):
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in alive], pa.int64()) for c in (node, v, n, label)], ["node", "v", "n_shingles", "label"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("neardup")
        for v, label, text in _by_node(batches, "v", "label", "text"):
            pairs = links_within([shingle_set(t, width) for t in text], np.array(label), percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([v[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    of_bits = members.join(rows.select(F.col("row").alias("v"), "bits"), "v").select("node", "v", "n_shingles", "label", "bits")
    sifted = stored(of_bits.repartition("node").sortWithinPartitions("node", "n_shingles", "v").mapInArrow(sift, "node long, v long, n_shingles long, label long"))
    texts = _through(rows.select(F.col("row").alias("v"), "doc.text"), "v", _sieve(sifted.select("v"))).filter("passes")
    of_text = sifted.join(texts, "v").select("node", "v", "n_shingles", "label", "text")
    links = stored(of_text.repartition("node").sortWithinPartitions("node", "n_shingles", "v").mapInArrow(compare, "a long, b long").distinct())
    discard(sifted)
    return links


def _parts(size: Column, weight: Column, small: int, heavy: int) -> Column:
    return F.greatest(F.ceil(size / small), F.ceil(weight / heavy)).cast("int")


def _pieces(large: DataFrame, small: int, heavy: int) -> DataFrame:
    """Large nodes cut at random into small ones that share about PIVOTS members."""
    parts = _parts(F.col("size"), F.col("weight"), small, heavy)
    every = F.pmod(F.xxhash64("v", "node", F.lit(1)), F.col("size")) < PIVOTS
    into = F.when(every, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("v", "node"), parts).cast("int")))
    return large.withColumn("part", F.explode(into)).withColumn("node", F.xxhash64("node", "part"))


def _split(large: DataFrame, small: int, heavy: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Members (with label) of large nodes: those to compare in small nodes, and those to deal on.

    A node inside one group needs no more links and is dropped. Where at most small members lie outside
    the largest group, they join each part of that group. A node of up to CHOICES parts (any, at the
    last level) becomes all pairs of its parts.
    """
    groups = large.groupBy("node", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    main = groups.groupBy("node").agg(F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max_by("w", F.struct("n", "label")).alias("main_weight"))
    sized = stored(large.join(main, "node").withColumns({"others": F.col("size") - F.col("most"), "other_weight": F.col("weight") - F.col("main_weight")}))
    light = F.col("others").between(1, small) & (F.col("other_weight") <= heavy)
    parts = _parts(F.col("most"), F.col("main_weight"), small, heavy)
    number = F.pmod(F.xxhash64("v", "node"), parts).cast("int")
    into = F.when(F.col("label") == F.col("main"), F.array(number)).otherwise(F.sequence(F.lit(0), parts - 1))
    few = sized.filter(light).withColumn("part", F.explode(into)).withColumn("node", F.xxhash64("node", "part"))
    many = sized.filter((F.col("others") > 0) & ~light).withColumn("parts", _parts(F.col("size"), F.col("weight"), small, heavy))
    fits = F.lit(last) | (F.col("parts") <= CHOICES)
    pairs = many.filter(fits).withColumn("part", F.pmod(F.xxhash64("v", "node"), F.col("parts")).cast("int"))
    pairs = pairs.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter(F.col("with") != F.col("part"))
    pairs = pairs.withColumn("node", F.xxhash64("node", F.least("part", "with"), F.greatest("part", "with")))
    own = ["node", "v", "n_shingles", "label"]
    return few.select(own).unionByName(pairs.select(own)), many.filter(~fits).select("tree", *own)


def _groups(rows: DataFrame, width: int, percent: int, trees: int, small: int, heavy: int) -> DataFrame:
    """d1, d2, component_id and kept_row of the digests that several rows have or links join."""
    first = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row")
    vertices = stored(
        rows.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min(first).alias("first"), F.count("*").alias("copies")).select("d1", "d2", "copies", F.col("first.row").alias("v"), F.col("first.doc_id").alias("least"))
    )
    tokens = rows.join(vertices.select("v"), F.col("row") == F.col("v"), "left_semi").select(F.col("row").alias("v"), "n_shingles", F.posexplode("nodes").alias("tree", "node"))
    links: list[DataFrame] = []
    found: DataFrame | None = None

    def labelled(live: DataFrame) -> DataFrame:
        if found is None:
            return live.withColumn("label", F.col("v"))
        return live.join(found, live["v"] == found["vertex"], "left").select(live["*"], F.coalesce("component", "v").alias("label"))

    def compared(members: DataFrame) -> None:
        nonlocal found
        links.append(_links(members, rows, width, percent))
        found = components(reduce(DataFrame.unionByName, links))

    def sized(live: DataFrame) -> DataFrame:
        """Members of the nodes that hold several groups still, with the node's size and weight."""
        live = labelled(live)
        sizes = live.groupBy("node").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high"))
        return stored(live.join(sizes.filter("low < high").drop("low", "high"), "node"))

    large: list[DataFrame] = []
    own = ["node", "v", "n_shingles", "label"]

    def wave(live: DataFrame) -> None:
        members = sized(live)
        is_large = (F.col("size") > small) | ((F.col("weight") > heavy) & (F.col("size") > 16))
        compared(members.filter(~is_large).select(own).unionByName(_pieces(members.filter(is_large), small, heavy).select(own)))
        if not members.filter(is_large).isEmpty():
            large.append(members.filter(is_large).drop("label"))

    # The first trees join most of what is alike; the others then compare only what is not yet in one group.
    wave(tokens.filter(F.col("tree") < FIRST_TREES))
    wave(tokens.filter(F.col("tree") >= FIRST_TREES))
    for level in range(LEVELS):
        if not large:
            break
        beside, deep = _split(labelled(reduce(DataFrame.unionByName, large)), max(1, small // 2), heavy, level == LEVELS - 1)
        large = []
        compared(beside)
        deep = stored(deep)
        if deep.isEmpty():
            break
        # Each choice is SPAN bytes of the sketch, at a place of the tree's and the choice's own.
        choice = deep.drop("label").join(rows.select(F.col("row").alias("v"), "sketch"), "v").withColumn("choice", F.explode(F.sequence(F.lit(0), F.lit(CHOICES - 1))))
        place = F.pmod(F.xxhash64("tree", "choice", F.lit(level)), F.lit(SKETCH - SPAN + 1)).cast("int") + 1
        wave(choice.select("v", "n_shingles", "tree", F.xxhash64("node", "choice", F.substring("sketch", place, F.lit(SPAN))).alias("node")))
    joined = vertices.join(found, vertices["v"] == found["vertex"], "left").select(vertices["*"], "component").filter("copies > 1 OR component IS NOT NULL")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "v"))
    named = joined.filter("component IS NOT NULL").groupBy("component").agg(first.alias("first"))
    return joined.join(named, "component", "left").select("d1", "d2", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("first.least")).alias("component_id"), F.coalesce("first.v", "v").alias("kept_row"))


def _judged(docs: DataFrame, width: int, similarity: float, trees: int, small: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """The profiles; and of each row row, doc_id, n_shingles, component_id, and chosen: the one row of each group that stands for it."""
    rows = stored(_profiles(docs, width, trees))
    groups = _groups(rows, width, round(similarity * 100), trees, small, heavy).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Copies of one text can be a third of all rows, so a digest meets its rows in several places.
    spread = rows.select("row", "doc.doc_id", "n_shingles", F.coalesce("d1", "row").alias("d1"), "d2", F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = spread.join(groups, ["d1", "d2", "salt"], "left")
    alone = F.col("kept_row").isNull()
    return rows, joined.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("kept_row"))).alias("chosen"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, trees: int = 8, small: int = 4096, heavy: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept of every document.

    Links join texts whose sets of width-word shingles have Jaccard similarity of at least
    similarity (compared as a whole per cent), on full sets. Rows of equal sets are one vertex; a text
    without words, or a null text, has an empty set and no link; a very long text is read whole. Rows
    that repeat a doc_id are linked by their texts alone. A null doc_id takes part in links but names
    no component: a group without ids has a null component, and one row of it is kept. Other columns
    are ignored; no rows give no rows.

    A pair at the similarity meets in the first node of a tree with probability similarity; a node of
    at most small texts and heavy shingles is compared exhaustively, so eight trees miss the pair with
    probability 3e-6. A larger node is cut into pieces that share pivots. Then what lies outside the
    node's largest linked group is compared with all of the node where it is at most half of small; a
    node of up to CHOICES parts is compared exhaustively by pairs of parts; a larger one is dealt on,
    each text into CHOICES children of SPAN tokens. A pair at 0.8 then has 2.5 common children in the
    mean at each level, which eight trees all miss with probability 1e-5 whatever the depth. Nodes still
    larger after LEVELS are compared exhaustively by parts: slow (the square of the node), but nothing is
    left out. Bitmaps rule out only pairs that their bound proves to be below the similarity.
    """
    _, judged = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, similarity, trees, small, heavy)
    kept = F.when(F.col("component_id").isNull(), F.col("chosen")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return judged.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, trees: int = 8, small: int = 4096, heavy: int = 1 << 21) -> DataFrame:
    """One row, all columns, of each near-duplicate group: that of the least doc_id.

    Rows without words, null and empty texts all stay. Repeated rows, of one doc_id or of none, are
    copies like any others, so one stays. No rows give no rows.
    """
    rows, judged = _judged(docs, width, similarity, trees, small, heavy)
    dropped = stored(judged.filter("NOT chosen").select(F.col("row").alias("dropped")))
    met = _through(rows.select("row", "doc"), "row", _sieve(dropped))
    sure, doubtful = met.filter("NOT passes"), met.filter("passes")
    return sure.select("doc.*").unionByName(doubtful.join(dropped, F.col("row") == F.col("dropped"), "left_anti").select("doc.*"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, similarity=0.8)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.shingles) + len(y.shingles) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, least) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, reached.least FROM reached JOIN ways ON ways.a = reached.doc_id WHERE ways.b > reached.least)
SELECT s.doc_id, CAST(len(any_value(shingles)) AS BIGINT) AS n_shingles, min(least) AS component_id, s.doc_id = min(least) AS kept
FROM s JOIN reached ON reached.doc_id = s.doc_id GROUP BY s.doc_id
"""
