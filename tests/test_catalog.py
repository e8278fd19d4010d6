"""Writers that meet, buckets that grow and split, point lookups that open one bucket."""

import threading
import zlib

import pytest
from pyspark.sql import functions as F

from bandloom.operators import catalog, grams, search

KINDS = "paper_id string, candidate_key string, page int, target string, is_loading_control boolean, western_blot_type string, sample string, source_id string"


def batch(spark, *rows):
    """Rows of (paper, key, source, sample)."""
    return spark.createDataFrame([(p, k, 1, "AKT", False, "total_protein", sample, s) for p, k, s, sample in rows], KINDS)


def held(store):
    return sorted((r.paper_id, r.candidate_key, r.source_id, r["sample"]) for r in store.rows().collect())


class Interrupted(catalog.Catalog):
    """Lets others write between the work on a replacement and its commit."""

    others = ()

    def _commit(self, *given):
        if self.others:
            first, *self.others = self.others
            first()
        return super()._commit(*given)


@pytest.mark.parametrize("paper", ["p2", "p1"])
def test_interleaved_writers_both_land(spark, tmp_path, paper):
    """Of two papers the second commit goes on top of the first; of one paper it is worked out again."""
    store, other = Interrupted(spark, str(tmp_path)), catalog.Catalog(spark, str(tmp_path))
    store.initialize()
    store.replace(batch(spark, ("p1", "old", "s", "a")), "p1", "s")
    store.others = [lambda: other.replace(batch(spark, (paper, "x", "t", "b"), (paper, "y", "t", "b")), paper, "t")]
    assert store.replace(batch(spark, ("p1", "old", "s", "c"), ("p1", "new", "s", "c")), "p1", "s") == 2
    assert held(store) == sorted([("p1", "new", "s", "c"), ("p1", "old", "s", "c"), (paper, "x", "t", "b"), (paper, "y", "t", "b")])
    ids = [r.id for r in store.rows().collect()]
    assert len(set(ids)) == 4 and min(ids) == 1


def test_a_writer_that_lost_the_race_is_checked_again(spark, tmp_path):
    """The identity that both bring belongs to the writer that landed; the other changes nothing."""
    store, other = Interrupted(spark, str(tmp_path)), catalog.Catalog(spark, str(tmp_path))
    store.initialize()
    store.others = [lambda: other.replace(batch(spark, ("p", "k", "t", "b")), "p", "t")]
    with pytest.raises(ValueError, match="another source"):
        store.replace(batch(spark, ("p", "k", "s", "a")), "p", "s")
    assert held(store) == [("p", "k", "t", "b")]
    store.others = [(lambda k: lambda: other.replace(batch(spark, ("p", "k", "t", f"v{k}")), "p", "t"))(k) for k in range(2)]
    with pytest.raises(RuntimeError, match="other writers"):
        store.replace_batch(batch(spark, ("p", "z", "s", "a")), batch(spark, ("p", "z", "s", "a")).select("paper_id", "source_id"), tries=2)
    assert held(store) == [("p", "k", "t", "v1")]


def test_writers_in_threads(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path))
    store.initialize()
    failed = []

    def write(k):
        try:
            catalog.Catalog(spark, str(tmp_path)).replace(batch(spark, *[(f"p{k % 2}", f"{k}-{i}", f"s{k}", "x") for i in range(3)]), f"p{k % 2}", f"s{k}")
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(held(store)) == 9 and len({r.id for r in store.rows().collect()}) == 9


def test_a_replacement_writes_its_own_rows_only(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path))
    store.initialize()
    store.replace_batch(batch(spark, *[("p", f"k{i}", f"s{i % 5}", "old") for i in range(50)]), batch(spark, *[("p", "", f"s{i}", "") for i in range(5)]).select("paper_id", "source_id"))
    store.replace(batch(spark, ("p", "k3", "s3", "new"), ("p", "more", "s3", "new")), "p", "s3")
    (bucket,) = store._entry(store.version())["folders"].values()
    assert [p["rows"] for p in bucket["parts"]] == [50, 2] and bucket["parts"][1]["sources"] == [["p", "s3"]]
    rows = held(store)
    assert len(rows) == 42 and [r for r in rows if r[2] == "s3"] == [("p", "k3", "s3", "new"), ("p", "more", "s3", "new")]
    store.replace(batch(spark, ("p", "", "s1", "")).limit(0), "p", "s1")
    assert len(held(store)) == 32 and not [r for r in held(store) if r[2] == "s1"]
    before, rows = store.version(), sorted(map(tuple, store.rows().collect()), key=repr)
    assert store.compact() == 1 and store.compact() == 0
    (bucket,) = store._entry(store.version())["folders"].values()
    assert [p["rows"] for p in bucket["parts"]] == [32] and sorted(map(tuple, store.rows().collect()), key=repr) == rows
    assert sorted(map(tuple, store.rows(before).collect()), key=repr) == rows


def test_buckets_split_and_lookups_open_one(spark, tmp_path):
    """Of papers that share a bucket, each split parts some; a paper larger than a bucket stays whole; null sources too."""
    papers = [p for p in map("paper{}".format, range(20_000)) if zlib.crc32(p.encode()) % 64 == 5][:40]
    store = catalog.Catalog(spark, str(tmp_path), bucket_rows=20, most_parts=3)
    store.initialize()
    rows = [(p, f"k{i}", None, "x") for p in papers for i in range(3)] + [(papers[0], f"big{i}", "s", "x") for i in range(50)]
    store.replace_batch(batch(spark, *rows), batch(spark, *rows).select("paper_id", "source_id"))
    folders = store._entry(store.version())["folders"]
    assert len(folders) >= 8 and all(int(k) % 64 == 5 for k in folders)
    for k in range(4):
        store.replace(batch(spark, (papers[k], "k0", None, f"v{k}")), papers[k], None)
        rows = [r for r in rows if (r[0], r[2]) != (papers[k], None)] + [(papers[k], "k0", None, f"v{k}")]
    assert sorted(map(repr, [(r.paper_id, r.candidate_key, r.source_id, r["sample"]) for r in store.rows().collect()])) == sorted(map(repr, rows))
    known = store.rows().collect()
    assert len({r.id for r in known}) == len(known)
    for r in known[::25]:
        found = store.get(r.id)
        assert [tuple(x) for x in found.collect()] == [tuple(r)]
        key = catalog.directory_key(store._entry(store.version())["folders"], zlib.crc32(r.paper_id.encode()))
        assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in found.inputFiles()} == {key}
    assert store.get(10**9).count() == store.get(0).count() == 0
    page, total = store.search(search.Criteria(paper_id=papers[0]), 200)
    assert total.first().total == 51 and page.count() == 51
    assert store.rows().groupBy("paper_id").agg(F.count("*")).count() == 40


PHRASES = ["zeta", "ZETA-1", "ze%a", "z_ta", "et", "\\\\zeta", "a\\%b", "a%b", "élan", "ÉLAN v", "lan vital", "zeta vital", "\u212aelvin", "kelvin", "nowhere", "100%", "pap", "\\"]


@pytest.mark.parametrize("field", ["q", "sample"])
def test_trigrams_rule_files_out_and_lose_no_hit(spark, tmp_path_factory, field):
    """Every phrase finds what a scan finds, wildcards, escapes and case included; fewer files are opened where it has three letters."""
    store = getattr(test_trigrams_rule_files_out_and_lose_no_hit, "store", None)
    if store is None:
        store = catalog.Catalog(spark, str(tmp_path_factory.mktemp("grams")))
        store.initialize()
        samples = ["Zeta-1 cells", "z\\zeta", "a%b", "aXb", "Élan vital", "\u212aelvin", "", None, "100% pure", "new\nzeta line", "ab", "İzeta"]
        rows = [(f"paper{i}", "k", 1, t, False, "total_protein", s, "s") for i, (s, t) in enumerate(zip(samples, ["AKT", "zeta", *samples[2:6], *"bcdefg"], strict=True))]
        frame = spark.createDataFrame(rows, KINDS)
        store.replace_batch(frame, frame.select("paper_id", "source_id"))
        store.replace(batch(spark, ("paper0", "k", "s", "kappa")), "paper0", "s")  # what it held is still in the older file
        test_trigrams_rule_files_out_and_lose_no_hit.store = store
    whole = store.rows().cache()
    files = set(store.rows().inputFiles())
    for phrase in PHRASES:
        criteria = search.Criteria(**{field: phrase})
        page, total = store.search(criteria, 200)
        wanted = sorted(r.id for r in whole.filter(search.predicate(criteria)).collect())
        assert sorted(r.id for r in page.collect()) == wanted and total.first().total == len(wanted), phrase
        opened = set(page.inputFiles())
        assert opened <= files
        if any(grams.required(asked) for asked, _ in search.phrases(criteria)):
            assert len(opened) <= len(wanted) + 2, phrase
        else:
            assert opened == files, phrase


def test_required_trigrams():
    assert grams.required("ab%cdef_gh") == {"cde", "def"}
    assert grams.required("a\\%bC") == {"a%b", "%bc"} and grams.required("été") == grams.required("") == set()
    assert grams.required("abc\\") == {"abc", "bc%"}


def test_parts_without_trigrams_are_read_whole(spark, tmp_path):
    """Versions written before there was an index, and one that was compacted since."""
    store = catalog.Catalog(spark, str(tmp_path))
    store.initialize()
    store.replace(batch(spark, ("p1", "k", "s", "alpha")), "p1", "s")
    entry = store._entry(store.version())
    for bucket in entry["folders"].values():
        bucket["parts"] = [{k: v for k, v in part.items() if k != "grams"} for part in bucket["parts"]]
    store._log(entry, store.version())
    store.replace(batch(spark, ("p2", "k", "s", "beta")), "p2", "s")
    store.replace(batch(spark, ("p2", "j", "t", "gamma")), "p2", "t")
    for _ in range(2):
        found = {word: sorted(r.paper_id for r in store.search(search.Criteria(sample=word), 10)[0].collect()) for word in ("alpha", "beta", "gamma", "delta")}
        assert found == {"alpha": ["p1"], "beta": ["p2"], "gamma": ["p2"], "delta": []}
        store.compact()
