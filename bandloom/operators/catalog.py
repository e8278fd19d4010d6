"""The record catalog: immutable snapshots, atomic replacement by source, null-safe identities."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Collection, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import grams, search

IDENTITY = ("paper_id", "candidate_key", "panel_label", "row_index", "lane_index", "target")
BUCKETS = 64  # of a new catalog
STRETCH = 1 << 20  # ids whose papers are noted in one folder
FILE_ROWS = 1 << 15  # of a part that one task writes, and whose trigrams one task finds
KEPT_ON_UPDATE = ("id", "created_at", "page")
SCHEMA = """id BIGINT, paper_id STRING, candidate_key STRING, source_pdf STRING, candidate_path STRING, page INT,
figure_label STRING, panel_label STRING, row_index INT, lane_index INT, target STRING, is_loading_control BOOLEAN,
western_blot_type STRING, sample STRING, organism STRING, treatment_context STRING, condition STRING, band_state STRING,
confidence DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP, image_sha256 STRING, model_version STRING, source_url STRING, source_id STRING"""
REQUIRED = ("paper_id", "candidate_key", "page", "target", "is_loading_control", "western_blot_type")
PUBLIC = tuple(f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ") if f.split()[0] not in ("source_pdf", "candidate_path"))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def public_records(rows: DataFrame, *more: str | Column) -> DataFrame:
    """The public columns, with a source_url only where it is a web address, the DOI, and more columns of the rows."""
    url = T.public_url(F.col("source_url"))
    return rows.select(*[url.alias(c) if c == "source_url" else c for c in PUBLIC], T.record_doi(F.col("paper_id"), url).alias("doi"), *more)


def stale_rows(own: DataFrame, batch: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Rows of a source that its new batch does not hold again: an empty batch leaves them all."""
    return own.join(batch, same(own, batch, identity), "left_anti")


def violations(rows: DataFrame) -> DataFrame:
    """Rows that break a constraint: a required value missing, page, state or confidence out of range."""
    sound = (F.col("page") > 0) & (F.col("band_state").isNull() | F.col("band_state").isin("present", "absent", "uncertain")) & (F.col("confidence").isNull() | F.col("confidence").between(0, 1))
    return rows.filter(reduce(Column.__or__, [F.col(c).isNull() for c in REQUIRED]) | ~F.coalesce(sound, F.lit(False)))


def duplicate_identities(rows: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Identities held by more than one row, nulls equal, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def last_of_each(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Of rows with equal keys the one that came last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def numbered(rows: DataFrame, keys: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Consecutive numbers from 1, counted per hashed part (the session's shuffle partitions) so that no task holds all rows."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # parts rows
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before")


def other_source_conflicts(existing: DataFrame, incoming: DataFrame, identity: Sequence[str] = IDENTITY, source: str = "source_id") -> DataFrame:
    """Incoming rows whose identity another source holds."""
    return incoming.join(existing, same(existing, incoming, identity) & ~existing[source].eqNullSafe(incoming[source]), "left_semi")


def replacing_rows(existing: DataFrame, incoming: DataFrame, sources: DataFrame, now: Column, identity: Sequence[str] = IDENTITY, scope: Sequence[str] = ("paper_id", "source_id"), kept: Sequence[str] = KEPT_ON_UPDATE, id_column: str = "id", top: int | None = None) -> DataFrame:
    """What these sources hold once the incoming rows replace theirs.

    A row of known identity keeps its id, creation time and page; a new one gets the next id. Of equal incoming
    identities the last by input_pos counts. Missing provenance columns become null. top is the highest
    id so far, where existing is only a part of the catalog.
    """
    batch = last_of_each(incoming, identity, "input_pos").drop("input_pos")
    own = existing.join(F.broadcast(sources) if sources.isLocal() else sources, same(existing, sources, scope), "left_semi")
    old = own.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(identity)], *[F.col(c).alias(f"_old_{c}") for c in kept])
    match = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(identity)])
    joined = batch.join(old, match, "left").drop(*[f"_k{i}" for i in range(len(identity))])
    known, new = joined.filter(F.col(f"_old_{id_column}").isNotNull()), joined.filter(F.col(f"_old_{id_column}").isNull())
    last = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top")) if top is None else existing.sparkSession.range(1).select(F.lit(top).cast("long").alias("_top"))
    new = numbered(new, identity, "_n").crossJoin(F.broadcast(last)).withColumn(f"_old_{id_column}", F.col("_top") + F.col("_n")).drop("_n", "_top")
    rows = known.unionByName(new)
    values = {f.name: F.lit(None).cast(f.dataType) for f in existing.schema} | {c: F.col(c) for c in batch.columns}
    values |= {c: F.coalesce(F.col(f"_old_{c}"), values[c]) for c in kept if c != "created_at"}
    if "created_at" in existing.columns:
        values |= {"created_at": F.coalesce("_old_created_at", now), "updated_at": now}
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in existing.schema])


def replace_sources(existing: DataFrame, incoming: DataFrame, sources: DataFrame, now: Column, identity: Sequence[str] = IDENTITY, scope: Sequence[str] = ("paper_id", "source_id"), kept: Sequence[str] = KEPT_ON_UPDATE, id_column: str = "id", top: int | None = None) -> DataFrame:
    """The catalog after the rows of these sources are replaced by the incoming ones, as replacing_rows says.

    Rows of the sources that did not come again go; an empty batch removes them all.
    """
    others = existing.join(sources, same(existing, sources, scope), "left_anti")
    return others.unionByName(replacing_rows(existing, incoming, sources, now, identity, scope, kept, id_column, top))


def bucket_of(paper_id: str) -> int:
    """A paper's bucket in a directory that was never split."""
    return zlib.crc32(paper_id.encode()) % BUCKETS


def directory_key(folders: dict, crc: int) -> str:
    """The bucket of a paper's CRC: buckets that were split hold one more bit of it for each split."""
    depth = BUCKETS.bit_length() - 1
    while True:
        key = str(crc % (1 << depth))
        if folders.get(key, {"depth": depth})["depth"] <= depth:
            return key
        depth += 1


class Moved(RuntimeError):
    """Another writer changed one of the buckets that were read."""


class Catalog:
    """Versions of the table under a folder: a numbered entry of the log names, for each bucket of papers, its parts.

    A replacement writes only the rows of its sources, as one more part of their buckets; the part's record names the
    sources, whose rows in earlier parts no longer count. A bucket with many parts, or whose parts outgrow the first, is
    written anew as one, and split by further bits of the paper's CRC so that each holds about bucket_rows. The entry is
    created last and only if its number is free: a writer that finds it taken appends to what has come since
    where its buckets are unchanged, and otherwise works its replacement out again. An entry that a writer left
    empty as it died counts for nothing but keeps its number: remove it by hand.
    """

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = 1_000_000, most_parts: int = 32, most_sources: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.bucket_rows, self.most_parts, self.most_sources = bucket_rows, most_parts, most_sources

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _latest(self, log: str) -> int:
        fs, path = self._fs(f"{self.root}/{log}")
        return max((int(x.getPath().getName()) for x in fs.listStatus(path) if x.getLen()), default=0) if fs.exists(path) else 0

    def version(self) -> int:
        """The number of the latest entry; 0 before the first."""
        return self._latest("log")

    def initialize(self) -> None:
        """Create the empty table unless it is there; older versions gain missing columns when read."""
        if not self.version():
            self._log({"folders": {}}, 0)

    def _read(self, log: str, number: int) -> dict:
        fs, path = self._fs(f"{self.root}/{log}/{number:020d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _entry(self, version: int) -> dict:
        return self._read("log", version)

    def _log(self, entry: dict, expected: int, log: str = "log") -> None:
        fs, path = self._fs(f"{self.root}/{log}/{expected + 1:020d}")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as error:
            raise RuntimeError("another writer published meanwhile; nothing was changed") from error
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()

    def _reserve(self, n: int) -> int:
        """The id after which n ids are this writer's alone."""
        while True:
            number = self._latest("reserved")
            top = self._read("reserved", number)["top"] if number else 0
            try:
                self._log({"top": top + n}, number, "reserved")
                return top
            except RuntimeError:
                continue

    def _bucket(self, folders: dict) -> Column:
        """The bucket of a row's paper."""
        depth = max([BUCKETS.bit_length() - 1, *(b["depth"] for b in folders.values())])
        slot = F.crc32(F.col("paper_id").cast("binary")) % (1 << depth)
        keys = [int(directory_key(folders, s)) for s in range(1 << depth)]
        return slot if keys == list(range(1 << depth)) else F.element_at(F.lit(keys).cast("array<bigint>"), slot.cast("int") + 1)

    def rows(self, version: int | None = None, buckets: Collection[str | int] | None = None) -> DataFrame:
        """One snapshot, or these buckets of it; columns it lacks are null."""
        return self._rows(self._entry(version or self.version()), buckets)

    def _chains(self, entry: dict, buckets: Collection[str | int] | None = None) -> list[list[dict]]:
        wanted = None if buckets is None else {str(b) for b in buckets}
        return [b["parts"] for key, b in sorted(entry["folders"].items()) if wanted is None or key in wanted]

    def _rows(self, entry: dict, buckets: Collection[str | int] | None = None, phrases: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
        """The rows of an entry, without files that by their trigrams cannot hold every phrase."""
        chains = self._chains(entry, buckets)
        paths = [f"{self.root}/{path}" for path in self._possible([part for parts in chains for part in parts if part["path"]], phrases)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        whole = self.spark.read.schema(f"{SCHEMA}, seq BIGINT").parquet(*paths)
        gone = [(paper, source, part["seq"]) for parts in chains for part in parts[1:] for paper, source in part["sources"]]
        if gone:
            later = self.spark.createDataFrame(gone, "paper_id string, source_id string, seq long")
            whole = whole.join(later, same(whole, later, ("paper_id", "source_id")) & (whole["seq"] < later["seq"]), "left_anti")
        return whole.drop("seq")

    def _possible(self, parts: list[dict], phrases: Sequence[tuple[str, Sequence[str]]]) -> list[str]:
        """The folders of parts, or their files alone that can hold every phrase; a part written without trigrams is read whole."""
        asked = [(wanted, fields) for phrase, fields in phrases if (wanted := grams.required(phrase))]
        indexed = {part["path"] for part in parts if part.get("grams")} if asked else set()
        if not indexed:
            return [part["path"] for part in parts]
        tables = sorted({path.split("/")[0] for path in indexed})
        index = self.spark.read.schema(grams.SCHEMA).parquet(*[f"{self.root}/{name}-grams" for name in tables])
        files = [r.file for r in grams.files_holding(index, asked).collect()]  # a name a file, as Spark's own listing of what it reads
        return [part["path"] for part in parts if part["path"] not in indexed] + sorted(f for f in files if f.rsplit("/", 1)[0] in indexed)

    def _write(self, seen: dict, seq: int, fresh: DataFrame | None, sources: dict[str, list], anew: dict[str, int], replaced: DataFrame | None, top: int | None = None) -> tuple[dict, str]:
        """Write fresh rows, and whole the buckets of anew (key -> rows to expect); the changed buckets and the folder."""
        folders, name = seen["folders"], f"v-{uuid.uuid4().hex}"
        first = BUCKETS.bit_length() - 1
        changes: dict[str, dict] = {key: {"depth": folders[key]["depth"], "parts": list(folders[key]["parts"])} for key in sources if key not in anew}
        for key, expected in anew.items():
            depth = folders.get(key, {"depth": first})["depth"]
            levels = max(0, -(-expected // self.bucket_rows) - 1).bit_length()
            changes |= {str(int(key) + (j << depth)): {"depth": depth + levels, "parts": []} for j in range(1 << levels)}
        out = fresh
        if anew:
            old = self._rows(seen, anew)
            old = old if replaced is None else old.join(replaced, same(old, replaced, ("paper_id", "source_id")), "left_anti")
            out = old if fresh is None else fresh.unionByName(old)
        salts = max(1, -(-max(anew.values(), default=0) // min(self.bucket_rows, FILE_ROWS)))
        dealt = out.withColumns({"seq": F.lit(seq).cast("long"), "bucket": self._bucket(folders | changes)})
        dealt = dealt.repartition("bucket", F.pmod(F.xxhash64(*IDENTITY), F.lit(salts)))  # a paper may be larger than a bucket
        dealt.write.partitionBy("bucket").option("maxRecordsPerFile", self.bucket_rows).parquet(f"{self.root}/{name}")
        written = self.spark.read.schema("id BIGINT, paper_id STRING, bucket BIGINT").parquet(f"{self.root}/{name}")
        counts = {str(r.bucket): r["count"] for r in written.groupBy("bucket").count().collect()}  # a row a bucket
        for key, bucket in changes.items():
            n = counts.get(key, 0)
            if n or key in sources and bucket["parts"]:
                bucket["parts"].append({"path": f"{name}/bucket={key}" if n else None, "seq": seq, "rows": n, "grams": True, "sources": sources.get(key, []) if bucket["parts"] else []})
        whole = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{name}")
        file = F.concat(F.lit(f"{name}/"), F.regexp_extract("_metadata.file_path", r"(bucket=\d+/[^/]+)$", 1))
        grams.index(whole, file, search.Columns().everywhere).write.parquet(f"{self.root}/{name}-grams")
        if top is not None:
            self._index(written.filter(F.col("id") > top), name)
        return changes, name

    def _index(self, new: DataFrame, name: str) -> None:
        """Note the paper's CRC of each new id in the folder of its stretch of STRETCH ids."""
        at = f"{self.root}/{name}-ids"
        crc = F.crc32(F.col("paper_id").cast("binary")).alias("crc")
        new.select("id", crc, F.expr(f"id div {STRETCH}").alias("stretch")).repartition("stretch").sortWithinPartitions("id").write.partitionBy("stretch").parquet(at)
        fs, folder = self._fs(at)
        for stretch in fs.listStatus(folder):
            if stretch.isDirectory():
                target = f"{self.root}/ids/{stretch.getPath().getName()}"
                fs.mkdirs(self._fs(target)[1])
                for file in fs.listStatus(stretch.getPath()):
                    if file.getPath().getName().endswith(".parquet"):
                        fs.rename(file.getPath(), self._fs(f"{target}/{uuid.uuid4().hex}.parquet")[1])
        fs.delete(folder, True)

    def _commit(self, seen: dict, read: Collection[str], changes: dict) -> None:
        """Log the changes upon the latest version; raises Moved where one of the buckets read is no longer the same."""
        while True:
            latest = self.version()
            entry = self._entry(latest)
            if any(entry["folders"].get(key) != seen["folders"].get(key) for key in read):
                raise Moved("another writer changed these papers")
            try:
                return self._log({**entry, "folders": entry["folders"] | changes}, latest)
            except RuntimeError:  # the number is taken: look again
                continue

    def _drop(self, name: str) -> None:
        """Remove what a writer that lost has written."""
        self._delete(f"{self.root}/{name}")
        self._delete(f"{self.root}/{name}-grams")

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def replace(self, records: DataFrame, paper_id: str, source_id: str | None = None) -> int:
        """Replace one source's rows; every check comes before the first write. Returns the number of rows given."""
        source = self.spark.createDataFrame([(paper_id, source_id)], "paper_id string, source_id string")
        foreign = ~F.col("paper_id").eqNullSafe(paper_id) | ~F.col("source_id").eqNullSafe(source_id)
        return self.replace_batch(records, source, foreign)

    def replace_batch(self, records: DataFrame, sources: DataFrame, foreign: Column | None = None, tries: int = 20) -> int:
        """Replace the rows of all these sources (paper_id, source_id) by the records in one version.

        Of writers of different buckets all land; one that finds its buckets changed works out its replacement on
        what they hold now, up to tries times, so nothing is lost.
        """
        at = f"{self.root}/incoming-{uuid.uuid4().hex}"
        records = records if "input_pos" in records.columns else records.withColumn("input_pos", F.monotonically_increasing_id())
        whole = self.spark.createDataFrame([], SCHEMA).drop("id", "created_at", "updated_at").withColumn("input_pos", F.lit(0).cast("long")).unionByName(records, allowMissingColumns=True)
        whole.write.parquet(at)  # evaluated once: its numbering and its source may differ the next time
        try:
            records = self.spark.read.schema(whole.schema).parquet(at)
            if foreign is not None and not records.filter(foreign).isEmpty():
                raise ValueError("a record belongs to another paper or source")
            if not violations(records).isEmpty():
                raise ValueError("a record breaks a constraint")
            shared = records.groupBy(*IDENTITY).agg(F.min(F.struct("source_id")).alias("low"), F.max(F.struct("source_id")).alias("high"))
            if not shared.filter(~F.col("low").eqNullSafe(F.col("high"))).isEmpty():
                raise ValueError("two sources of the batch hold one identity")
            for _ in range(tries):
                try:
                    self._replace(records, sources.select("paper_id", "source_id").distinct() if not sources.isLocal() else sources)
                    return records.count()
                except Moved:
                    continue
            raise RuntimeError("other writers kept changing these papers; nothing was changed")
        finally:
            self._delete(at)

    def _replace(self, records: DataFrame, sources: DataFrame) -> None:
        version = self.version()
        seen = self._entry(version)
        bucket = self._bucket(seen["folders"]).cast("string").alias("bucket")
        coming = {r.bucket: r["count"] for r in records.select(bucket).groupBy("bucket").count().collect()}  # a row a bucket
        named = sources.withColumn("bucket", bucket)
        replaced = {r.bucket: r["count"] for r in named.groupBy("bucket").count().collect()}
        read = coming.keys() | replaced.keys()
        existing = self._rows(seen, read)
        if not other_source_conflicts(existing, records).isEmpty():
            raise ValueError("another source holds one of these identities")
        own = existing.join(sources, same(existing, sources, ("paper_id", "source_id")), "left_semi")
        batch = records.select(*IDENTITY).distinct()
        top = self._reserve(batch.join(own, same(batch, own, IDENTITY), "left_anti").count())
        anew = {key: n + coming.get(key, 0) for key in read for parts in [seen["folders"].get(key, {"parts": []})["parts"]] for n in [sum(p["rows"] for p in parts)] if self._too_long(parts, coming.get(key, 0), replaced.get(key, 0))}
        kept = {key: [] for key in read if key not in anew}
        for r in named.filter(F.col("bucket").isin(*kept)).collect() if kept else []:  # at most most_sources a bucket
            kept[r.bucket].append([r.paper_id, r.source_id])
        fresh = replacing_rows(existing, records, sources, F.current_timestamp(), top=top)
        changes, name = self._write(seen, version + 1, fresh, kept, anew, sources, top)
        try:
            self._commit(seen, read, changes)
        except Moved:
            self._drop(name)
            raise

    def _too_long(self, parts: list[dict], coming: int, sources: int) -> bool:
        """Whether a bucket is better written anew than given one more part."""
        later = coming + sum(p["rows"] for p in parts[1:])
        return not parts or sources > self.most_sources or len(parts) >= self.most_parts or later > max(self.bucket_rows // 8, parts[0]["rows"])

    def compact(self) -> int:
        """Write every bucket of several parts anew as one; returns how many. Snapshots before stay readable."""
        while True:
            version = self.version()
            seen = self._entry(version)
            anew = {key: sum(p["rows"] for p in b["parts"]) for key, b in seen["folders"].items() if len(b["parts"]) > 1}
            if not anew:
                return 0
            changes, name = self._write(seen, version + 1, None, {}, anew, None)
            try:
                self._commit(seen, anew, changes)
                return len(anew)
            except Moved:
                self._drop(name)

    def search(self, criteria: search.Criteria, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """Page and total from the same snapshot; files whose trigrams rule the phrases out are not opened."""
        search.validate(criteria, limit, offset)
        paper = (criteria.paper_id or "").strip()
        entry = self._entry(self.version())
        buckets = {directory_key(entry["folders"], zlib.crc32(paper.encode()))} if paper else None
        rows, where = self._rows(entry, buckets, search.phrases(criteria)), search.predicate(criteria)
        page = search.search_page(rows, where, [search.Key("updated_at"), search.Key("id")], limit, offset)
        return public_records(page), search.search_total(rows, where)

    def get(self, record_id: int) -> DataFrame:
        """The record of an id, read from the one bucket of its paper; no row where there is none."""
        at = f"{self.root}/ids/stretch={record_id // STRETCH}"
        fs, path = self._fs(at)
        found = self.spark.read.schema("id BIGINT, crc BIGINT").parquet(at).filter(F.col("id") == record_id).limit(1).collect() if fs.exists(path) else []
        entry = self._entry(self.version())
        return search.get_by_id(self._rows(entry, {directory_key(entry["folders"], r.crc) for r in found}), record_id)

    def health(self) -> bool:
        try:
            return self.spark.sql("SELECT 1").first()[0] == 1 and self.version() > 0
        except Exception:
            return False
