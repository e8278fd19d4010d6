"""Published evidence: each file of a source written by the task that holds it, all of them there at once by one rename."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


READ_BYTES = 8 << 20  # of files that a task holds at a time


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def is_plain_name(name: Column) -> Column:
    """Whether a name stays beneath its folder: relative, without empty, hidden or climbing parts."""
    return F.coalesce(F.forall(F.split(name, "/"), lambda part: (part != "") & ~part.startswith(".")) & ~F.contains(name, F.lit("\0")), F.lit(False))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write content under name beneath folder, each by its task; name, n_bytes and sha256 of what was written.

    A file gets its name by a rename once it is whole, so a task that runs again replaces it by the same bytes and
    a reader never sees half of one. Names that leave the folder, or come twice, raise ValueError before the first write.
    The result is lazy: the files are there once it has been evaluated. A null content is an empty file.
    """
    odd = files.filter(~is_plain_name(F.col("name"))).select("name").limit(1).collect() or files.groupBy("name").count().filter("count > 1").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].name!r} is no name of one file")
    names = ["name", "n_bytes"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = file_system(folder)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                at, body = f"{inside}/{name}", content.as_py() or b""
                inner = at.rsplit("/", 1)[0]
                if inner not in made:
                    system.create_dir(inner, recursive=True)
                    made.add(inner)
                part = f"{inner}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(body)
                system.move(part, at)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names)

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "name string, n_bytes long")


def read_files(names: DataFrame, folder: str) -> DataFrame:
    """name and content of the files named (by name, beneath folder), read by the tasks that hold the names; none where there is no file.

    Spark's binaryFile source lists a folder on the driver and opens a few files a task: for many small files that is a task
    for every few of them. Here a task opens as many as it has names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = file_system(folder)
        for batch in batches:
            found, size = [], 0
            for name in batch.column("name").to_pylist():
                try:
                    with system.open_input_stream(f"{inside}/{name}") as stream:
                        found.append((name, stream.read()))
                except FileNotFoundError:
                    continue
                size += len(found[-1][1])
                if size >= READ_BYTES:
                    yield _named(found)
                    found, size = [], 0
            if found:
                yield _named(found)

    return names.filter(is_plain_name(F.col("name"))).select("name").mapInArrow(read, "name string, content binary")


def _named(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
    names, contents = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])


def publish_folder(files: DataFrame, tables: dict[str, DataFrame], parent: str) -> str:
    """Files and tables (Parquet) in a fresh folder beneath parent that nothing writes again; returns its name.

    All is written to a hidden folder, which one rename publishes: a run that dies leaves nothing under a published name.
    """
    spark, name = files.sparkSession, f"published-{uuid.uuid4().hex}"
    hidden = f"{parent.rstrip('/')}/.{name}"
    wanted = files.count()
    write_files(files, hidden).write.parquet(f"{hidden}/files")
    for table, rows in tables.items():
        rows.write.parquet(f"{hidden}/{table}")
    written = spark.read.schema("name string, n_bytes long").parquet(f"{hidden}/files").count()
    if written != wanted:
        raise RuntimeError(f"{written} of {wanted} files were written")
    _move(spark, hidden, f"{parent.rstrip('/')}/{name}")
    return name


def _move(spark: SparkSession, path: str, target: str) -> None:
    from_path, to_path = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    if not from_path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(from_path, to_path):
        raise RuntimeError(f"{path} could not be published")


def rows_digest(rows: DataFrame, columns: list[str]) -> str:
    """A digest of a table's rows whatever their order: how many there are, and sums over the SHA-256 of each.

    Constant in size: no task and no driver gathers the rows. Binary columns count by their own SHA-256.
    """
    kinds = dict(rows.dtypes)
    shown = [F.sha2(c, 256).alias(c) if kinds[c] == "binary" else F.col(c) for c in columns]
    digest = F.sha2(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    found = rows.select(digest.alias("digest")).agg(F.count("*").cast("string"), *parts).first()
    return ":".join(x or "0" for x in found)
