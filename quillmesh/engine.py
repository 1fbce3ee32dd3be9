"""The engine as a whole: build an index of a corpus, and answer tasks from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import discover, domains, excerpts, extract, graph, ignore, index, projects, resolve, score, synonyms
from quillmesh.plans.words import CHANGE_TYPES, DOMAINS, STOPWORDS, SYMBOL_STOPWORDS
from quillmesh.session import staged
from quillmesh.sources import packfiles, packs


@dataclass
class Index:
    """The tables of an indexed corpus."""

    content: DataFrame  # path, content
    files: DataFrame  # path, language, size, mtime, hash
    symbols: DataFrame  # path, name, kind, start_line, end_line, signature
    edges: DataFrame  # src, dst, how
    postings: DataFrame  # path, term, tf of path and content
    lengths: DataFrame  # path, len

    @classmethod
    def build(cls, tree: DataFrame, ignored: str = "") -> Index:
        """``tree``: path, content. One projection of the content feeds all extractors."""
        kept = ignore.keep(tree, ignored)
        files = staged(index.catalogue(kept), "files")
        # Staged, for all steps read it: the rules of what is ignored are applied once.
        content = staged(kept.select("path", "content").join(files.select("path", "language"), "path"), "content")
        searched = content.select("path", F.concat_ws(" ", "path", "content").alias("content"))
        return cls(content.select("path", "content"), files, staged(extract.symbols(content), "symbols"), staged(graph.resolve(extract.imports(content), files), "edges"),
                   staged(index.postings(searched), "postings"), staged(index.lengths(searched), "lengths"))


@dataclass
class Pack:
    """The answer to a set of tasks."""

    tasks: DataFrame
    selected: DataFrame
    excerpts: DataFrame

    def reports(self, idx: Index, at: Column, diffs: DataFrame | None = None) -> DataFrame:
        """query, slug, name, body: all that is written for each task."""
        return packs.documents(self.tasks, self.selected, self.excerpts, idx.files, idx.symbols, idx.edges, at, diffs)

    def write(self, idx: Index, at: Column, folder: str, diffs: DataFrame | None = None) -> None:
        """A Parquet table of documents, partitioned by the pack's slug."""
        self.reports(idx, at, diffs).write.mode("append").partitionBy("slug").parquet(folder)

    def write_files(self, idx: Index, at: Column, folder: str, diffs: DataFrame | None = None) -> None:
        """The same as files, a folder for each pack."""
        packfiles.register(idx.content.sparkSession)
        self.reports(idx, at, diffs).select("slug", "name", "body").write.format("pack").mode("append").save(folder)


def highlighted(content: DataFrame, frames: DataFrame | None, changed: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
    """query, path, line: the lines of frames (query, file, line), of changes (query, path, line) and those given."""
    parts = [p.select("query", "path", "line") for p in (changed, more) if p is not None]
    if frames is not None and "line" in frames.columns:
        hits = discover.match_paths(frames.select("query", F.col("file").alias("pattern")), content.select("path"))
        named = frames.select("query", discover.T.normalize_path(F.col("file")).alias("pattern"), "line")
        parts.append(hits.join(named, ["query", "pattern"]).select("query", "path", "line"))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def pack(idx: Index, tasks: DataFrame, git: DataFrame, frames: DataFrame | None = None, diffs: DataFrame | None = None, changed: DataFrame | None = None, highlights: DataFrame | None = None, most: int = score.MAX_FILES, config: domains.Config = domains.Config()) -> Pack:
    """``tasks``: query, text; ``git``: path, churn; ``frames``: query, file, function and, if known, line; ``diffs``:
    query, file, status; ``changed`` (by a diff) and further ``highlights``: query, path, line. Domains are the
    core's, those of the frameworks that the tree uses, and those of ``config``."""
    spark = tasks.sparkSession
    used = [r.name for r in projects.frameworks(idx.content).collect()]  # at most the known frameworks
    words = projects.words_of(used, DOMAINS, config)
    resolved = resolve.resolve(tasks, STOPWORDS, SYMBOL_STOPWORDS, words, CHANGE_TYPES, frames, diffs)
    resolved = staged(resolved, "resolved")
    resolved = staged(synonyms.widen(resolved), "tasks", spent=[resolved])
    found = discover.discover(resolved, idx.content, idx.symbols, idx.edges, idx.postings, idx.lengths, frames, diffs)
    chosen = score.select(score.score(found, resolved, git, words), resolved, most)
    chosen = staged(chosen, "selected")
    # Excerpts of one (query, path) each: the pair stands for the path.
    key = F.concat_ws("\n", F.col("query").cast("string"), "path")
    rows = chosen.join(idx.content, "path").select(key.alias("path"), "content", (F.col("stacktrace_hit") | F.col("diff_hit")).alias("in_trace"), F.col("symbol_match").alias("has_symbol"))
    own = chosen.select("query", "path").join(idx.symbols, "path").withColumn("path", key)
    lit = highlighted(idx.content, frames, changed, highlights)
    lines = spark.createDataFrame([], "path string, line int") if lit is None else lit.join(chosen.select("query", "path"), ["query", "path"], "left_semi").select(key.alias("path"), "line")
    cut = excerpts.excerpts(rows, own, lines)
    parts = F.split("path", "\n", 2)
    kind = dict(tasks.dtypes)["query"]
    return Pack(resolved, chosen, cut.select(parts[0].cast(kind).alias("query"), parts[1].alias("path"), "content", "start_line", "end_line", "total_lines", "truncated"))
