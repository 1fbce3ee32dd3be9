"""What git prints, as tables: history, changed files and their lines. Git runs on the driver, once per
table; its output is text that Spark parses."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import extract


def git(root: str, *args: str) -> str | None:
    """The command's output, None if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=False)
    return done.stdout if done.returncode == 0 else None


def is_repository(root: str) -> bool:
    return git(root, "rev-parse", "--git-dir") is not None


def ref_exists(root: str, ref: str) -> bool:
    return git(root, "rev-parse", "--verify", "--end-of-options", ref) is not None


def current_branch(root: str) -> str:
    return (git(root, "rev-parse", "--abbrev-ref", "HEAD") or "HEAD").strip()


def current_commit(root: str) -> str | None:
    out = git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def history(spark: SparkSession, root: str) -> DataFrame:
    """path, at: a row per file of each commit."""
    commits = (git(root, "log", "--name-only", "--pretty=format:%x01%ct") or "").split("\x01")
    return parse_history(spark.createDataFrame([(c,) for c in commits if c], "record string"))


def parse_history(commits: DataFrame) -> DataFrame:
    """``commits``: record, a commit's time in seconds and its files, a line each. Parsed in the commit's row; a log
    in a file that all executors see is read with the same records as ``spark.read.option("lineSep", "\\x01").text``."""
    lines = commits.select(F.split("record", r"\r?\n").alias("ls")).select(F.get("ls", F.lit(0)).try_cast("long").alias("s"), F.explode(F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0)))).alias("path"))
    return lines.filter("path <> '' and s is not null").select("path", F.timestamp_seconds("s").alias("at"))


def diff(spark: SparkSession, root: str, base: str) -> DataFrame:
    """file, status, additions, deletions of what changed since ``base``."""
    frame = lambda text: spark.createDataFrame([(0, text or "")], "id long, content string")
    return extract.diff_entries(frame(git(root, "diff", "--name-status", base)), frame(git(root, "diff", "--numstat", base))).drop("id")


def changes(spark: SparkSession, root: str, base: str, head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The entries and the changed lines between two commits or branches (from their common ancestor), or of the
    working tree against ``base``."""
    span = base if head is None else f"{base}...{head}"
    return diff(spark, root, span), changed_lines(spark, root, span)


def modified(entries: DataFrame) -> DataFrame:
    return entries.filter("status <> 'deleted'").select("file")


def deleted(entries: DataFrame) -> DataFrame:
    return entries.filter("status = 'deleted'").select("file")


def diff_text(root: str, base: str, *files: str) -> str:
    return git(root, "diff", base, "--", *files) or ""


def changed_lines(spark: SparkSession, root: str, base: str) -> DataFrame:
    """path, line of all changed lines, from one diff without surrounding lines."""
    text = git(root, "diff", "-U0", base) or ""
    rows = spark.createDataFrame([(text,)], "content string").select(F.explode(F.expr(r"split(content, '(?m)^diff --git ')")).alias("content"))
    parts = rows.select(F.regexp_extract("content", r"(?m)^\+\+\+ b/(.+)$", 1).alias("id"), "content").filter("id <> ''")
    return extract.changed_lines(parts).withColumnRenamed("id", "path")
