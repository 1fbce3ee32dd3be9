"""A log-structured index of a stream of changed files.

Each micro-batch holds (path, content, deleted, seq) rows; the last of a path in a batch counts. A batch writes one
segment: the rows of its added and changed files in every table, postings sorted by term, probes by key. Files have
numbers, and a file that is changed or deleted stays where it is: its number is marked in a bitmap, of which the batch
writes the words that it changes. Readers take all segments and leave out what the bitmaps mark. A manifest, written
last and as a whole, names the segments and bitmaps of a batch, so a batch that fails leaves nothing that is seen. One
that is tried again starts from the manifest before it and writes the same names anew, or does nothing if its own
manifest is there.

Segments of a like size are merged, FANOUT at a time, without what is marked: a row is written again about
log(files) / log(FANOUT) times in its life, whatever the size of the corpus.

Import edges are maintained by their changes. The table of probes says for every specifier which paths and stems it
would take, in order; read by key it says which specifiers an added or removed path concerns. Those, and the new
files' own, are resolved again, all others stay. The latest row of a (file, specifier) counts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.functions import text as T
from quillmesh.operators import extract, graph, index
from quillmesh.session import delete, exists, staged

#: Tables of a segment, and by what they are sorted.
TABLES = {
    "files": ("doc long, path string, language string, size long, mtime long, hash string, len long", ["path"]),
    "postings": ("term string, doc long, tf long", ["term", "doc"]),
    "symbols": ("doc long, path string, name string, kind string, start_line int, end_line int, signature string", ["name"]),
    "probes": ("key string, ord int, doc long, path string, language string, specifier string, base string", ["key"]),
    "edges": ("doc long, path string, specifier string, dst string, how string, version long", ["doc"]),
}
DEAD = "word long, bits long"
FANOUT = 4
#: A file's number: batch, task and place in the task, in so many bits.
BATCH_BITS, TASK_BITS, PLACE_BITS = 20, 15, 28
WORD = 64
#: Rows of small tables (marked words, a batch's files, concerned specifiers) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
#: Files of a segment that one task sorts and writes.
FILES_PER_TASK = 5_000


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df``, marked for broadcast if it is a written table of few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def together(*writes: Callable[[], object]) -> None:
    """Run independent writes at the same time: small jobs by themselves leave most of a cluster idle."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for job in [pool.submit(w) for w in writes]:
            job.result()


def latest_rows(batch: DataFrame) -> DataFrame:
    """One row per path: the one with the largest ``seq``; of equal ones the same in each run."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq"), F.xxhash64("content", "deleted")))
    return batch.withColumn("rn", last).filter("rn = 1").drop("rn")


@dataclass(frozen=True)
class Segment:
    id: str
    files: int
    at: int  # the batch that wrote it: marks up to then are applied


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: tuple[Segment, ...] = ()
    dead: tuple[int, ...] = ()  # batches whose marks concern a segment

    @classmethod
    def read(cls, spark: SparkSession, root: str, version: int) -> Manifest:
        """That after batch ``version``; empty before the first."""
        if version < 0:
            return cls(-1)
        (row,) = spark.read.text(f"{root}/manifests/v{version}", wholetext=True).collect()
        d = json.loads(row.value)
        return cls(d["version"], tuple(Segment(**s) for s in d["segments"]), tuple(d["dead"]))

    def write(self, spark: SparkSession, root: str) -> None:
        body = json.dumps({"version": self.version, "segments": [vars(s) for s in self.segments], "dead": self.dead})
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifests/v{self.version}")

    def folders(self, root: str) -> set[str]:
        return {f"{root}/segments/{s.id}" for s in self.segments} | {f"{root}/dead/b{n}" for n in self.dead}


def word_of(doc: Column) -> Column:
    return F.floor(doc / WORD)


@dataclass
class Snapshot:
    """The index after a batch."""

    spark: SparkSession
    root: str
    manifest: Manifest

    def marks(self) -> DataFrame | None:
        """The words of the bitmap with a mark."""
        if not self.manifest.dead:
            return None
        return self.spark.read.schema(DEAD).parquet(*[f"{self.root}/dead/b{n}" for n in self.manifest.dead]).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def raw(self, table: str, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        """A table's rows, also of files that are marked."""
        kept = self.manifest.segments if segments is None else segments
        schema = TABLES[table][0]
        if not kept:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/segments/{s.id}/{table}" for s in kept])

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column doc, without those of marked files."""
        marks = self.marks()
        if marks is None:
            return rows
        marks = marks.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
        both = rows.withColumn("__of", word_of(F.col("doc"))).join(small(marks), F.col("__of") == F.col("__word"), "left")
        return both.filter(F.col("__bits").isNull() | (F.getbit("__bits", F.pmod("doc", F.lit(WORD))) == 0)).drop("__of", "__word", "__bits")

    def table(self, name: str) -> DataFrame:
        return self.live(self.raw(name))

    def edges(self) -> DataFrame:
        """src, dst, how."""
        newest = latest_edges(self.table("edges")).filter("dst is not null")
        return newest.groupBy(F.col("path").alias("src"), "dst").agg(F.min("how").alias("how"))


def latest_edges(edges: DataFrame) -> DataFrame:
    whole = F.struct("path", "dst", "how", "version")
    return edges.groupBy("doc", "specifier").agg(F.max_by(whole, "version").alias("e")).select("doc", "e.path", "specifier", "e.dst", "e.how", "e.version")


def load(spark: SparkSession, root: str, version: int) -> dict[str, DataFrame]:
    """The tables after a batch by path: files, postings, lengths, symbols, edges."""
    s = Snapshot(spark, root, Manifest.read(spark, root, version))
    files = s.table("files")
    postings = s.raw("postings").join(files.select("doc", "path"), "doc").select("path", "term", "tf")
    return {"files": files.select("path", "language", "size", "mtime", "hash"), "postings": postings, "lengths": files.select("path", "len"), "symbols": s.table("symbols").drop("doc"), "edges": s.edges()}


def _deal(df: DataFrame, name: str, files: int) -> DataFrame:
    by = TABLES[name][1]
    parts = max(1, math.ceil(files / FILES_PER_TASK))
    dealt = df.repartition(1) if parts == 1 else df.repartitionByRange(parts, *by)
    return dealt.select(*[f.split(" ")[0] for f in TABLES[name][0].split(", ")]).sortWithinPartitions(*by)


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, written, with their numbers as files of batch ``n``."""
    i = F.monotonically_increasing_id()
    task, place = F.shiftright(i, 33), i.bitwiseAND((1 << 33) - 1)
    return staged(rows.withColumn("doc", F.lit(n << (TASK_BITS + PLACE_BITS)) + task * (1 << PLACE_BITS) + place), "batch")


def writer(root: str, compact: bool = True) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batch n adds a segment and the marks of what it replaces."""
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n >= 1 << BATCH_BITS:
            raise ValueError(f"batch {n} is beyond the numbers of files; build the index anew")
        if exists(spark, f"{root}/manifests/v{n}/_SUCCESS"):
            return  # this batch is in the index, and only the stream does not know yet
        before = Snapshot(spark, root, Manifest.read(spark, root, n - 1))
        rows = _numbered(latest_rows(batch).select("path", "content", "deleted"), n)
        new = index.catalogue(rows.filter("not deleted").select("path", "content"))
        known = staged(before.live(before.raw("files").select("doc", "path", "hash").join(small(rows.select("path")), "path", "left_semi")), "known")
        same = new.join(known.select("path", "hash"), ["path", "hash"], "left_semi").select("path")
        fresh = staged(rows.select("doc", "path", "content").join(new.join(same, "path", "left_anti"), "path"), "fresh")
        gone = known.join(same, "path", "left_anti")
        n_fresh = fresh.count()

        segment, folder = Segment(f"b{n}", n_fresh, n), f"{root}/segments/b{n}"
        marks = gone.groupBy(word_of(F.col("doc")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("doc", F.lit(WORD)).cast("int"))).alias("bits"))
        numbers, code = fresh.select("path", "doc"), fresh.select("path", "language", "content")
        few = F.broadcast(numbers) if n_fresh <= MAX_BROADCAST else numbers
        write_table = lambda df, name: _deal(df, name, n_fresh).write.mode("overwrite").parquet(f"{folder}/{name}")
        together(
            lambda: marks.repartition(1).write.mode("overwrite").parquet(f"{root}/dead/b{n}"),
            lambda: write_table(fresh.withColumn("len", F.size(T.search_tokens(F.col("content"))).cast("long")), "files"),
            lambda: write_table(index.postings(fresh, "doc"), "postings"),
            lambda: write_table(extract.symbols(code).join(few, "path"), "symbols"),
            lambda: write_table(graph.probes(graph.specifiers(extract.imports(code).join(few, "path"))), "probes"))

        after = Snapshot(spark, root, Manifest(n, (*before.manifest.segments, segment), (*before.manifest.dead, n)))
        appeared = fresh.select("path").join(known, "path", "left_anti").select("path")
        vanished = gone.select("path").join(fresh, "path", "left_anti").select("path")
        changed = staged(appeared.union(vanished), "changed-paths")
        edges, scratch = resolved(after, changed, segment)
        write_table(edges.withColumn("version", F.lit(n).cast("long")), "edges")

        manifest = merged(after, n) if compact else after.manifest
        manifest.write(spark, root)
        prune(spark, root, n, manifest)
        for t in (rows, known, fresh, changed, *scratch):
            delete(spark, t.scratch_path)

    return write


def concerned(index_: Snapshot, changed: DataFrame, fresh: Segment) -> DataFrame:
    """doc, path, language, specifier, base of the specifiers that may take a ``changed`` path, and of the segment's own."""
    keys = graph.keys_of(changed).select("key").distinct()
    columns = ["doc", "path", "language", "specifier", "base"]
    older = tuple(s for s in index_.manifest.segments if s != fresh)
    hit = index_.live(index_.raw("probes", older).join(small(keys), "key", "left_semi").select(*columns).distinct())
    return hit.unionByName(index_.raw("probes", (fresh,)).select(*columns).distinct())


def resolved(index_: Snapshot, changed: DataFrame, fresh: Segment) -> tuple[DataFrame, list[DataFrame]]:
    """doc, path, specifier, dst (null for none), how of the concerned specifiers, as the files are now; and the written
    tables that this reads."""
    specs = staged(concerned(index_, changed, fresh), "concerned")
    probed = staged(graph.probes(specs), "probed")
    keys = graph.keys_of(index_.table("files").select("path")).join(small(probed.select("key").distinct()), "key", "left_semi")
    found = graph.choose(probed, keys, ["doc", "specifier"])
    return specs.select("doc", "path", "specifier").join(found, ["doc", "specifier"], "left"), [specs, probed]


def to_merge(segments: tuple[Segment, ...], fanout: int = FANOUT) -> list[Segment]:
    """The segments of the smallest size of which there are ``fanout``, and all smaller ones."""
    size = lambda s: int(math.log(max(s.files, 1), fanout))
    sizes = sorted({size(s) for s in segments})
    for k in sizes:
        if sum(size(s) == k for s in segments) >= fanout:
            return [s for s in segments if size(s) <= k]
    return []


def merged(index_: Snapshot, n: int) -> Manifest:
    """The manifest with what is due merged into one segment, whose tables are written without marked files."""
    old = to_merge(index_.manifest.segments)
    if not old:
        return index_.manifest
    folder, chosen = f"{index_.root}/segments/m{n}", tuple(old)
    guess = sum(s.files for s in old)
    def write(name: str) -> None:
        rows = index_.live(index_.raw(name, chosen))
        _deal(latest_edges(rows) if name == "edges" else rows, name, guess).write.mode("overwrite").parquet(f"{folder}/{name}")

    together(*[lambda name=name: write(name) for name in TABLES])
    files = index_.spark.read.parquet(f"{folder}/files").count()
    segments = tuple(s for s in index_.manifest.segments if s not in old) + (Segment(f"m{n}", files, n),)
    oldest = min(s.at for s in segments)
    return Manifest(n, segments, tuple(d for d in index_.manifest.dead if d > oldest))


def prune(spark: SparkSession, root: str, n: int, now: Manifest) -> None:
    """Delete what the manifests of batches n - 1 and n do not name."""
    if n < 2:
        return
    old, last = Manifest.read(spark, root, n - 2), Manifest.read(spark, root, n - 1)
    for folder in old.folders(root) - last.folders(root) - now.folders(root):
        delete(spark, folder)
    delete(spark, f"{root}/manifests/v{n - 2}")


def start(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """``changes``: a stream of path, content, deleted, seq. Runs over what is there and stops."""
    return changes.writeStream.foreachBatch(writer(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
