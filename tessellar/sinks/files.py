"""Rows to files: a Python data source that stages each file and renames all of them when every task has succeeded.

The path must be a folder that the driver and all executors share; a rename there is what makes a file appear.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    names: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Rows of name and data; a null datum writes nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, rows) -> Staged:
        out = []
        os.makedirs(self.path, exist_ok=True)
        for r in rows:
            if r.data is None:
                continue
            if not r.name or r.name in (".", "..") or not re.fullmatch(r"[^/\0]+", r.name):
                raise ValueError(f"{r.name!r} is no file name")
            held = os.path.join(self.path, f".{self.run}-{uuid.uuid4().hex}")
            with open(held, "wb") as f:
                f.write(r.data)
            out.append((held, r.name))
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        staged = [x for m in messages if m for x in m.names]
        names = [n for _, n in staged]
        twice = len(set(names)) < len(names)
        there = [] if self.overwrite else [n for n in names if os.path.exists(os.path.join(self.path, n))]
        if twice or there:
            self.abort(messages)
            raise ValueError("two rows have one name" if twice else f"{there[0]} is there already")
        for held, name in staged:
            os.replace(held, os.path.join(self.path, name))

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for held, _ in m.names if m else []:
                if os.path.exists(held):
                    os.remove(held)


class Files(DataSource):
    """df.write.format("files").mode("append" or "overwrite").option("path", folder).save(), with columns name and data."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """df: name and data."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(Files)
    df.select("name", "data").write.format("files").mode("overwrite" if overwrite else "append").option("path", path).save()


def metadata_files(metadata: DataFrame, id_col: str = "path") -> DataFrame:
    """name and data of each payload that is there: the file's own name with .icc, .exif or .xmp."""
    stem = F.regexp_extract(F.col(id_col).cast("string"), r"([^/]+)$", 1)
    kinds = F.array(*(F.struct(F.concat(stem, F.lit(f".{k}")).alias("name"), F.col(k).alias("data")) for k in ("icc", "exif", "xmp")))
    return metadata.select(F.inline(kinds)).where("data is not null")


def discard(df: DataFrame) -> None:
    """Works everything out and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
