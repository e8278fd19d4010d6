"""The manifest against a plain tree: proofs, roots, tampering; trees of many sizes and superblocks of many heights."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bandloom.llm import merkle
from bandloom.llm.common import id_remainder

RND = random.Random(2)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(leaves, fanout=8):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout=8):
    out = []
    for level in levels[:-1]:
        begin = i - i % fanout
        out.append((level[begin:i], level[i + 1 : begin + fanout]))
        i //= fanout
    return out


def expected(rows):
    """One tuple per row, in any order: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for x in langs}
    trees = {x: tree([leaf(r, r[4]) for r in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            proof = siblings(trees[x], i) + siblings(top, j)
            node = trees[x][0][i]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, r[4].translate(LOWER))
            for left, right in proof:
                node = sha("".join(left) + node + "".join(right))
            out.append((r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], sha("".join(s for left, right in proof for s in left + right)), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("k", [1, 2, 4])
def test_against_a_plain_tree(spark, tmp_path, k):
    """A null lang, an empty one, langs of one to 150 rows, null fields, repeated ids and rows, clashing columns."""
    rows = [(i, RND.choice(["web", None, "ünï"]), RND.choice([None, "", "en", "é"]), RND.choice([None, i]), RND.choice([None, "", "Some Text É", "X" * 5000])) for i in range(300)]
    rows += [(1000, "s", "one", 3, "Abc"), (7, "web", "en", 7, "Again"), (None, "s", "en", 1, "No Id"), rows[5], (None, "s", "en", 1, "No Id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx long, root string").repartition(3)
    got = [tuple(r) for r in merkle.audited(df, id_remainder(F.col("doc_id"), 3) == 0, k).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(rows)))
    assert {r[6] for r in got} == {True, False}


def test_one_tree_and_one_leaf(spark):
    """One lang: its root is the whole root; a lone leaf is both, with an empty proof."""
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(9)]
    tampered = id_remainder(F.col("doc_id"), 3) == 0
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    got = [tuple(r) for r in merkle.audited(spark.createDataFrame(rows, kinds), tampered).collect()]
    assert sorted(got) == sorted(expected(rows)) and all(r[2] == r[3] for r in got)
    lone = merkle.audited(spark.createDataFrame(rows[:1], kinds), tampered).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == sha("")
    assert merkle.audited(spark.createDataFrame([], kinds), tampered).count() == 0


def test_proofs_of_other_fanouts(spark):
    """The operator's own rows: siblings by level, with fanout 3, fold to the root; a changed leaf does not."""
    rows = spark.range(40).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"), (F.col("id") % 4).cast("string").alias("t"))
    got = merkle.manifest(rows, F.col("t"), ["id"], ["t"], k=2, fanout=3)
    back = got.select("*", merkle.folded(F.col("digest"), F.col("proof"), 3).alias("same"), merkle.folded(F.sha2("digest", 256), F.col("proof"), 3).alias("other")).collect()
    trees = {t: tree([sha(str(i)) for i in range(40) if i % 4 == t], 3) for t in range(4)}
    top = tree([trees[t][-1][0] for t in range(4)], 3)
    for r in back:
        assert r.root == top[-1][0] == r.same != r.other and r.subroot == trees[int(r.t)][-1][0]
        assert [(p.others[: p.place], p.others[p.place :]) for p in r.proof] == siblings(trees[int(r.t)], r.id // 4, 3) + siblings(top, int(r.t), 3)
    assert len(back) == 40
