"""Answers kept as they come, so that a request is asked once: small files beside a run, read before anything is asked again."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import assets

KEPT = "request_key string, raw string"


def request_key(*parts: Column) -> Column:
    """sha256 of all that is sent; equal requests have equal keys, and null parts differ from empty ones."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def known_answers(spark: SparkSession, folder: str) -> DataFrame | None:
    """request_key and raw of what stopped runs kept in folder, one row a key; None where nothing is kept."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(KEPT).option("recursiveFileLookup", True).json(folder).groupBy("request_key").agg(F.min("raw").alias("raw"))


def forget(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Keeper:
    """What one task has been answered, written every few seconds to a file of its own that appears whole.

    A task that takes the place of a lost one reads what that one had written (its files bear the task's partition). What
    is asked twice after a loss is therefore what was answered within those seconds, and the number of files follows the
    time spent, not the number of answers.
    """

    def __init__(self, folder: str, partition: int, seconds: float = 5.0):
        self.system, self.folder = assets.file_system(folder)
        self.mine, self.seconds = f"task-{partition}-", seconds
        self.fresh: list[tuple[str, str]] = []
        self.written_at = time.monotonic()
        self.known = dict(self._earlier())

    def _earlier(self) -> Iterable[tuple[str, str]]:
        for info in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.base_name.startswith(self.mine):
                with self.system.open_input_file(info.path) as stream:
                    for line in stream.read().decode().splitlines():
                        row = json.loads(line)
                        yield row["request_key"], row["raw"]

    def keep(self, key: str, raw: str) -> None:
        self.fresh.append((key, raw))
        if time.monotonic() - self.written_at >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.fresh:
            name = f"{self.mine}{uuid.uuid4().hex}.json"
            hidden = f"{self.folder}/.{name}"
            self.system.create_dir(self.folder, recursive=True)
            with self.system.open_output_stream(hidden) as out:
                out.write("".join(json.dumps({"request_key": k, "raw": r}) + "\n" for k, r in self.fresh).encode())
            self.system.move(hidden, f"{self.folder}/{name}")
        self.fresh, self.written_at = [], time.monotonic()
