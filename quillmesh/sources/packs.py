"""Packs: what is written for a task, and the catalogue of what was written.

Reports are assembled as columns, one row per task, and written by Spark; the archive is made on the
driver from the few files of one pack.
"""

from __future__ import annotations

import tarfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T

VERSION = "0.1.0"
# Test commands by file ending.
COMMANDS = {r"\.php$": ["php artisan test", "./vendor/bin/phpunit"], r"\.[jt]sx?$": ["npm test", "npm run test:watch"], r"\.py$": ["pytest", "python -m pytest"], r"\.go$": ["go test ./..."], r"\.rs$": ["cargo test"]}
NO_COMMAND = "# Run your test suite"
ENTRY_LIKE = r"(?i:Controller\.|Handler\.|routes?/)|index\.|main\.|app\."


def _percent(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))


def _in_order(value: Column) -> Column:
    """The values of a group as an array in the order of ``ord``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), value.alias("v")))), lambda x: x["v"])


def manifests(tasks: DataFrame, selected: DataFrame, excerpts: DataFrame, at: Column) -> DataFrame:
    """``selected``: query, path, ord, score, reasons; ``excerpts``: query, path, content. query, slug, manifest (JSON)."""
    files = selected.groupBy("query").agg(_in_order(F.struct("path", "score", "reasons")).alias("files"))
    budget = excerpts.groupBy("query").agg(F.ceil(F.sum(F.length("content")) / 4).cast("long").alias("budgetTokens"))
    t = tasks.join(files, "query", "left").join(budget, "query", "left")
    none = F.array().cast("array<struct<path:string,score:double,reasons:array<string>>>")
    slug = T.slug(F.col("text"), at)
    body = F.struct(F.lit(VERSION).alias("version"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), slug.alias("slug"),
                    F.struct("text", "keywords", "files_hint", "symbols", "change_type", "confidence").alias("task"), F.coalesce("files", none).alias("files"), F.coalesce("budgetTokens", F.lit(0)).alias("budgetTokens"),
                    F.transform("domains", lambda d: d["domain"]).alias("tags"))
    return t.select("query", slug.alias("slug"), F.to_json(body).alias("manifest"))


def catalogue(written: DataFrame) -> DataFrame:
    """``written``: slug, manifest. slug, date, time, task, n_files, the newest first."""
    n = F.size(F.from_json("manifest", "files array<struct<path:string>>")["files"])
    return written.select("slug", T.slug_parts(F.col("slug")).alias("p"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias("n_files")).filter("p is not null").select("slug", "p.date", "p.time", "p.task", "n_files").orderBy(F.desc("slug"))


def latest(packs: DataFrame) -> DataFrame:
    """The newest pack of a catalogue."""
    return packs.orderBy(F.desc("slug")).limit(1)


def by_prefix(packs: DataFrame, prefix: str) -> DataFrame:
    """Packs whose slug, or the task in it, begins with ``prefix``, the newest first."""
    return packs.filter(F.col("slug").startswith(prefix) | F.col("task").startswith(prefix)).orderBy(F.desc("slug"))


def commands(selected: DataFrame) -> DataFrame:
    """query, commands: how to test the selected files."""
    each = [F.when(F.bool_or(F.col("path").rlike(p)), F.array(*[F.lit(c) for c in cs])).otherwise(F.array().cast("array<string>")) for p, cs in COMMANDS.items()]
    rows = selected.groupBy("query").agg(F.concat(*each).alias("commands"))
    return rows.select("query", F.when(F.size("commands") > 0, F.col("commands")).otherwise(F.array(F.lit(NO_COMMAND))).alias("commands"))


def edges_within(selected: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """query, path, direction, other: imports among the selected files, of the first ``most``."""
    first = selected.filter(F.col("ord") <= most).select("query", "path")
    inside = selected.select("query", F.col("path").alias("other"))
    out = edges.select(F.col("src").alias("path"), F.col("dst").alias("other"), F.lit("imports").alias("direction"))
    back = edges.select(F.col("dst").alias("path"), F.col("src").alias("other"), F.lit("imported by").alias("direction"))
    return out.unionByName(back).join(first, "path").join(inside, ["query", "other"]).select("query", "path", "direction", "other")


def files_report(selected: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """query, report: the selected files with score, reasons, size and symbols by kind."""
    kinds = symbols.groupBy("path", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("names"))
    kinds = kinds.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "kind", F.lit(": "), F.array_join("names", ", ")))), "\n").alias("symbols"))
    rows = selected.join(files.select("path", "language", "size"), "path", "left").join(kinds, "path", "left")
    text = F.concat_ws("\n", F.concat(F.lit("## "), "path"), F.concat(F.lit("**Score:** "), _percent(F.col("score"))), F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n"),
                       F.concat(F.lit("**Language:** "), "language"), F.concat(F.lit("**Size:** "), T.pretty_bytes(F.col("size"))), "symbols")
    return rows.groupBy("query").agg(F.concat(F.lit("# Files\n\n"), F.array_join(_in_order(text), "\n\n")).alias("report"))


def pack_report(tasks: DataFrame, selected: DataFrame) -> DataFrame:
    """query, report: goal, files in order of priority, commands and notes."""
    listed = selected.groupBy("query").agg(F.array_join(_in_order(F.concat(F.col("ord").cast("string"), F.lit(". excerpts/"), T.safe_filename(F.col("path")), F.lit(".md ("), _percent(F.col("score")), F.lit(")"))), "\n").alias("listed"))
    has = lambda d: F.exists("domains", lambda x: x["domain"] == d)
    notes = F.array_compact(F.array(F.when(has("payments"), "- Payments: keep webhook handlers idempotent"), F.when(has("auth"), "- Auth: check permissions"), F.when(has("database"), "- Database: add migrations if the schema changes"),
                                    F.when(F.col("confidence") < 0.5, "- The task says little; review the files")))
    t = tasks.join(listed, "query", "left").join(commands(selected), "query", "left")
    return t.select("query", F.concat_ws("\n", F.lit("# Goal\n"), "text", F.lit("\n# Files\n"), "listed", F.lit("\n# Commands\n"), F.array_join(F.transform("commands", lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit("\n# Notes\n"), F.array_join(notes, "\n")).alias("report"))


def task_report(tasks: DataFrame) -> DataFrame:
    """query, report: what was understood of the task."""
    several = lambda title, values: F.when(F.size(values) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")))
    weighed = F.transform("domains", lambda d: F.concat(d["domain"], F.lit(" ("), d["weight"].cast("string"), F.lit(")")))
    text = F.concat_ws("\n\n", F.lit("# Task"), "text", F.concat(F.lit("**Kind of change:** "), "change_type"), F.concat(F.lit("**Confidence:** "), _percent(F.col("confidence"))), several("Keywords", F.col("keywords")),
                       several("Symbols", F.col("symbols")), several("Files", F.col("files_hint")), several("Domains", weighed))
    return tasks.select("query", text.alias("report"))


def graph_report(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """query, report: imports among the selected files, and those that look like entry points."""
    line = F.concat(F.lit("- "), "path", F.lit(" "), "direction", F.lit(" "), "other")
    links = edges_within(selected, edges).groupBy("query").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("links"))
    entries = selected.filter(F.col("path").rlike(ENTRY_LIKE)).groupBy("query").agg(F.array_join(_in_order(F.concat(F.lit("- "), "path")), "\n").alias("entries"))
    rows = selected.select("query").distinct().join(links, "query", "left").join(entries, "query", "left")
    return rows.select("query", F.concat_ws("\n\n", F.lit("# Graph"), F.lit("## Imports"), F.coalesce("links", F.lit("none")), F.lit("## Entry points"), F.coalesce("entries", F.lit("none"))).alias("report"))


def tests_report(selected: DataFrame) -> DataFrame:
    """query, report: the selected tests, and the commands that run them."""
    tests = selected.filter(F.col("path").rlike(r"(?i)test|spec")).groupBy("query").agg(F.array_join(_in_order(F.concat(F.lit("- "), "path")), "\n").alias("tests"))
    rows = commands(selected).join(tests, "query", "left")
    run = F.array_join(F.transform("commands", lambda c: F.concat(F.lit("- `"), c, F.lit("`"))), "\n")
    return rows.select("query", F.concat_ws("\n\n", F.lit("# Tests"), F.coalesce("tests", F.lit("none")), F.lit("## Commands"), run).alias("report"))


def documents(tasks: DataFrame, selected: DataFrame, excerpts: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, at: Column, diffs: DataFrame | None = None) -> DataFrame:
    """query, slug, name, body: the manifest, the reports (the diff's where there is one) and the excerpts of each task."""
    reports = {"PACK.md": pack_report(tasks, selected), "TASK.md": task_report(tasks), "FILES.md": files_report(selected, files, symbols), "GRAPH.md": graph_report(selected, edges), "TESTS.md": tests_report(selected)}
    if diffs is not None:
        reports["DIFF.md"] = diff_report(diffs)
    m = manifests(tasks, selected, excerpts, at)
    out = m.select("query", F.lit("manifest.json").alias("name"), F.col("manifest").alias("body"))
    for name, report in reports.items():
        out = out.unionByName(report.select("query", F.lit(name).alias("name"), F.col("report").alias("body")))
    out = out.unionByName(excerpt_documents(excerpts).select("query", F.concat(F.lit("excerpts/"), "name").alias("name"), F.col("document").alias("body")))
    return out.join(m.select("query", "slug"), "query").select("query", "slug", "name", "body")


def diff_report(entries: DataFrame) -> DataFrame:
    """``entries``: query, file, status, additions, deletions. query, n, additions, deletions, report."""
    icon = F.when(F.col("status") == "added", "+").when(F.col("status") == "deleted", "-").when(F.col("status") == "renamed", "→").otherwise("M")
    line = F.concat(F.lit("- ["), icon, F.lit("] "), "file", F.format_string(" (+%d -%d)", "additions", "deletions"))
    return entries.groupBy("query").agg(F.count("*").alias("n"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("report"))


def excerpt_documents(excerpts: DataFrame) -> DataFrame:
    """query, name, document: an excerpt's own file."""
    state = F.when(F.col("truncated"), "(truncated)").otherwise("(complete)")
    text = F.concat_ws("\n", F.concat(F.lit("# "), "path"), F.lit(""), F.format_string("Lines %d-%d of %d", "start_line", "end_line", "total_lines"), state, F.lit(""), F.concat(F.lit("```"), T.fence_language(F.col("path"))), "content", F.lit("```"))
    return excerpts.select("query", F.concat(T.safe_filename(F.col("path")), F.lit(".md")).alias("name"), text.alias("document"))


def archive(folder: str, name: str = "pack.tgz") -> str:
    """Pack a folder on the driver's disk."""
    out = Path(folder) / name
    with tarfile.open(out, "w:gz") as tar:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file() and p != out:
                tar.add(p, arcname=str(p.relative_to(folder)))
    return str(out)
