"""What the operators share: table access, scratch tables in the shared folder, small hashes."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if spark.conf.get("tessellar.scratch.dir", None) is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.conf.set("tessellar.scratch.dir", "file://" + tempfile.mkdtemp(prefix="tessellar-"))
        atexit.register(__import__("shutil").rmtree, spark.conf.get("tessellar.scratch.dir")[7:], True)
    return spark.conf.get("tessellar.scratch.dir")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessellar/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, n: int) -> F.Column:
    """crc32 of the id's decimal text, modulo n: the fold of a row."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)



def still(batches: Iterator) -> Iterator:
    """The batches, with the collector of cycles off until they end: what is made of them is many small objects in no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if on:
            gc.enable()
