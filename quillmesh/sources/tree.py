"""A source tree as a table: a Python data source that reads directories, dotfiles included, once or as a stream.

``spark.read.format("tree").load("/some/root")`` gives path (relative), content, size, mtime (ms). Spark's
own file sources leave out names that begin with a dot or an underscore, which source trees have. A
partition is one directory below the root (and the root's own files), so a large tree is read in
parallel; directories that are never indexed are not entered. Files that are not UTF-8 are left out. Filters on path
(equal, prefix, suffix), size and mtime are looked at before a file is opened, prefixes before a directory is entered.

``spark.readStream.format("tree").option("state", folder)`` gives path, content, deleted, seq: what has changed since the
last batch, as the streaming index takes it. Offsets are numbers of listings (path, size, mtime of all files), which are
kept in the state folder; a batch opens the files whose size or time differs between two of them.
"""

from __future__ import annotations

import json
import operator
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NEVER = {".git", ".quillmesh"}
COMPARE = {D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le, D.EqualTo: operator.eq}
#: Changed files that one task of a batch reads.
FILES_PER_PARTITION = 1000


class Directory(InputPartition):
    def __init__(self, rel: str, deep: bool):
        self.rel, self.deep = rel, deep


class Wanted:
    """What the filters say of a file before it is opened."""

    def __init__(self):
        self.prefixes: list[str] = []
        self.tests: list[tuple[str, object, object]] = []  # column, comparison, value

    def add(self, f: D.Filter) -> None:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, D.StringStartsWith) and column == "path":
            self.prefixes.append(f.value)
        elif isinstance(f, D.StringEndsWith) and column == "path":
            self.tests.append((column, str.endswith, f.value))
        elif type(f) in COMPARE and column in ("path", "size", "mtime"):
            self.tests.append((column, COMPARE[type(f)], f.value))
            if isinstance(f, D.EqualTo) and column == "path":
                self.prefixes.append(f.value)

    def enters(self, directory: str) -> bool:
        """``directory``: relative, with a slash at its end, empty for the root."""
        return all(p.startswith(directory) or directory.startswith(p) for p in self.prefixes)

    def takes(self, path: str, size: int, mtime: int) -> bool:
        values = {"path": path, "size": size, "mtime": mtime}
        return all(path.startswith(p) for p in self.prefixes) and all(test(values[c], v) for c, test, v in self.tests)


def relative(full: str, root: str) -> str:
    rel = os.path.relpath(full, root).replace(os.sep, "/")
    return "" if rel == "." else rel


def listed(root: str, rel: str, deep: bool, wanted: Wanted, most: int) -> Iterator[tuple[str, int, int]]:
    """path, size, mtime of the files of a directory, with ``deep`` also of those below."""
    for d, dirs, names in os.walk(os.path.join(root, rel)):
        here = relative(d, root)
        here = here + "/" if here else ""
        dirs[:] = sorted(x for x in dirs if x not in NEVER and wanted.enters(f"{here}{x}/")) if deep else []
        for name in sorted(names):
            full = os.path.join(d, name)
            try:
                at = os.stat(full)
            except OSError:
                continue
            mtime = at.st_mtime_ns // 1_000_000
            if os.path.isfile(full) and at.st_size <= most and wanted.takes(here + name, at.st_size, mtime):
                yield here + name, at.st_size, mtime


def read_text(full: str) -> str | None:
    try:
        with open(full, "rb") as f:
            return f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


class TreeReader(DataSourceReader):
    def __init__(self, root: str, most: int, split_depth: int):
        self.root, self.most, self.split_depth, self.wanted = root, most, split_depth, Wanted()

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """All filters are returned: what is read less by them, Spark looks at again."""
        for f in filters:
            self.wanted.add(f)
            yield f

    def partitions(self) -> list[InputPartition]:
        """Directories down to ``splitDepth`` levels are partitions of their own."""
        out: list[InputPartition] = []

        def visit(rel: str, level: int) -> None:
            deep = level >= self.split_depth
            out.append(Directory(rel, deep))
            if not deep:
                for e in os.scandir(os.path.join(self.root, rel)):
                    below = os.path.join(rel, e.name)
                    if e.is_dir(follow_symlinks=False) and e.name not in NEVER and self.wanted.enters(below.replace(os.sep, "/") + "/"):
                        visit(below, level + 1)

        visit("", 0)
        return out

    def read(self, partition: Directory) -> Iterator[tuple]:
        for path, size, mtime in listed(self.root, partition.rel, partition.deep, self.wanted, self.most):
            content = read_text(os.path.join(self.root, path))
            if content is not None:
                yield path, content, size, mtime


class Changed(InputPartition):
    def __init__(self, seq: int, paths: list[str], gone: list[str]):
        self.seq, self.paths, self.gone = seq, paths, gone


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, most: int):
        self.root, self.state, self.most = root, state, most

    def _listing(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        with open(os.path.join(self.state, f"{n}.json")) as f:
            return json.load(f)

    def _last(self) -> int:
        numbers = [int(x[:-5]) for x in os.listdir(self.state) if x.endswith(".json")] if os.path.isdir(self.state) else []
        return max(numbers, default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        n = self._last()
        now = {path: [size, mtime] for path, size, mtime in listed(self.root, "", True, Wanted(), self.most)}
        if now != self._listing(n):
            os.makedirs(self.state, exist_ok=True)
            n += 1
            own = os.path.join(self.state, f".{n}-{os.getpid()}")
            with open(own, "w") as f:
                json.dump(now, f)
            os.replace(own, os.path.join(self.state, f"{n}.json"))
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        changed = sorted(p for p, x in new.items() if old.get(p) != x)
        gone = sorted(set(old) - set(new))
        step = FILES_PER_PARTITION
        return [Changed(end["listing"], changed[i:i + step], []) for i in range(0, len(changed), step)] + [Changed(end["listing"], [], gone[i:i + step]) for i in range(0, len(gone), step)]

    def read(self, partition: Changed) -> Iterator[tuple]:
        for path in partition.paths:
            content = read_text(os.path.join(self.root, path))
            yield path, content, content is None, partition.seq
        for path in partition.gone:
            yield path, None, True, partition.seq

    def commit(self, end: dict) -> None:
        """Listings before the last one that is read are not needed any more."""
        for name in os.listdir(self.state) if os.path.isdir(self.state) else ():
            if name.endswith(".json") and int(name[:-5]) < end["listing"]:
                os.remove(os.path.join(self.state, name))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, content string, deleted boolean, seq long" if "state" in self.options else "path string, content string, size long, mtime long"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("maxFileSize", 1 << 20)), int(self.options.get("splitDepth", 2)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStreamReader(self.options["path"], self.options["state"], int(self.options.get("maxFileSize", 1 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
