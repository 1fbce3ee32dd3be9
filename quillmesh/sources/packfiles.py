"""Packs as files, as users open them: a data source that writes documents (slug, name, body) to folders.

``documents.write.format("pack").mode("append").save(folder)``. Every attempt of a task writes to a folder of its own
aside; only what Spark says has been committed is moved to the packs, and a pack's manifest comes last, so a pack
without a manifest is none, and readers never see half a pack. An aborted or repeated attempt leaves nothing behind.
``mode("overwrite")`` replaces packs of the same slug; with ``append`` they are an error before anything is moved.
The folder must be one that the driver and all executors see under the same path.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    aside: str
    files: list[tuple[str, str]]  # slug, name


def inside(slug: str, name: str) -> bool:
    """Whether a document stays in the folder of its pack."""
    return bool(slug) and "/" not in slug and slug not in (".", "..") and not slug.startswith(".") and bool(name) and not os.path.isabs(name) and ".." not in name.split("/")


class PackWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.job = os.path.join(root, f".job-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Written:
        aside, files = os.path.join(self.job, uuid.uuid4().hex), []
        for row in iterator:
            if not inside(row.slug, row.name):
                raise ValueError(f"no place for {row.name!r} in pack {row.slug!r}")
            full = os.path.join(aside, row.slug, row.name)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(row.body or "")
            files.append((row.slug, row.name))
        return Written(aside, files)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            moves = [(m.aside, slug, name) for m in messages if m for slug, name in m.files]
            slugs = {slug for _, slug, _ in moves}
            taken = sorted(s for s in slugs if os.path.exists(os.path.join(self.root, s)))
            if taken and not self.overwrite:
                raise FileExistsError(f"packs are there already: {', '.join(taken[:5])}")
            for slug in taken:  # first the manifest, so that no half pack is seen
                manifest = os.path.join(self.root, slug, MANIFEST)
                if os.path.exists(manifest):
                    os.remove(manifest)
                shutil.rmtree(os.path.join(self.root, slug))
            for aside, slug, name in sorted(moves, key=lambda m: (m[2] == MANIFEST, m[1], m[2])):
                to = os.path.join(self.root, slug, name)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.replace(os.path.join(aside, slug, name), to)
        finally:
            shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pack"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PackWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """slug, manifest of all whole packs in a folder."""
    rows = spark.read.option("recursiveFileLookup", "false").text(f"{folder}/*/{MANIFEST}", wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("slug"), F.col("value").alias("manifest"))
