"""What several operators share: the shared folder, written tables, text normal forms."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset a local folder stands in, but only for a local master: on a cluster nobody
    else would see it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="bandloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the bytes of the batches that Arrow functions get, where the session leaves Spark's own bound of 64 MB."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, most)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/bandloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(df: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever else the table holds."""
    bound_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
