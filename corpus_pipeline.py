"""A corpus pipeline: quality classifier, language ID, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Rows with null texts: quality scores them as it does empty texts; language ID
rejects those that quality leaves. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import langid, near, packing, pii, quality
from tessellar.llm.common import crc_mod, table, text_or_empty, written


def filtered(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows whose texts keep() marks, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the threshold of the classifier, which learns from the labels."""
    settings = quality.Settings()
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2), settings)
    return filtered(docs, lambda texts: [s >= settings.threshold for s in model.scores(texts)])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language that was learned: without a letter, or whose best score is below a half."""
    net = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))

    def keep(texts: list[str | None]) -> list[bool]:
        return [name != "und" and score >= 0.5 for name, score in zip(*net.predict(texts), strict=True)]

    return filtered(docs, keep)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (smallest id, nulls last) of each group of near-duplicates (five words, similarity 0.8); of rows with one id and text, one.

    Documents are told apart by id and text: rows that share an id but not a text go or stay by their own texts.
    """
    groups = written(near.near_duplicates(docs, near.Settings()), "pipeline-groups").select(F.col("doc_id").alias("near_id"), F.col("version").alias("near_version"), "first")
    gone = groups.where("not first").select("near_id", "near_version").distinct()
    repeated = written(groups.groupBy("near_id", "near_version").count().where("count > 1").select("near_id", "near_version"), "pipeline-repeated")
    own = F.xxhash64(text_or_empty("text"))

    def same(others: DataFrame) -> F.Column:
        return docs["doc_id"].eqNullSafe(others["near_id"]) & (own == others["near_version"])

    left = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same(repeated), "left_anti").unionByName(once)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [EMAIL], [IP], [CARD] and [PHONE] in the place of personal data."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_stage), ("personal_data", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
