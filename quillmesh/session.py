"""Session settings and table loading."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def local_session(cores: int | None = None, name: str = "quillmesh") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers of this session, unless their path has it."""
    root = Path(__file__).resolve().parent.parent
    if any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return spark
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        base = Path(tempfile.mkdtemp(prefix="spark-")) / "quillmesh_package"
        sc.addPyFile(shutil.make_archive(str(base), "zip", root_dir=root, base_dir="quillmesh"))
        _shipped.add(sc.applicationId)
    return spark


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset
    (tests in local mode) a fresh folder under the machine's temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillmesh/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def fingerprint(df: DataFrame, *more: str) -> str:
    """A digest of the files that ``df`` reads, with their sizes and times, of its columns and of ``more``."""
    spark = df.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    digest = hashlib.md5(repr((df.dtypes, more)).encode())
    for name in sorted(df.inputFiles()):
        status = path(name).getFileSystem(conf).getFileStatus(path(name))
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()


def publish(spark: SparkSession, own: str, path: str) -> None:
    """Make the folder ``own`` known as ``path``, unless another run was first."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(own), to):
        delete(spark, own)


def staged(df: DataFrame, label: str, spent: Iterable[DataFrame] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and what
    several branches read is computed once. ``spent`` are such tables that nothing reads any more once
    ``df`` is written; their files are deleted then. ``compression``: a codec of Parquet, else the session's."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, compression=compression)
    for table in spent:
        delete(spark, table.scratch_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out
