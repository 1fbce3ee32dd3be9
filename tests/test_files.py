"""Sources and sinks of files: the tree source with filters and as a stream, packs, digests of directories."""

import builtins
import json
import os
import random

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quillmesh.operators import index
from quillmesh.sources import packfiles, packs, tree
from quillmesh.streaming import incremental


def put(root, **files):
    for name, body in files.items():
        full = root / name.replace("__", "/").replace("_dot_", ".")
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(body)


def test_filters_are_looked_at_before_files_are_opened(spark, tmp_path, monkeypatch):
    put(tmp_path, src__a_dot_py="one", src__big_dot_py="x" * 100, src__deep__b_dot_ts="two", doc__c_dot_py="three", e_dot_py="four")
    reader = tree.TreeReader(str(tmp_path), 1 << 20, 1)
    filters = [D.StringStartsWith(("path",), "src/"), D.LessThan(("size",), 50), D.StringEndsWith(("path",), ".py"), D.IsNotNull(("path",))]
    assert list(reader.pushFilters(filters)) == filters  # Spark looks at them again
    opened = []
    with monkeypatch.context() as m:
        m.setattr(builtins, "open", lambda f, *a, own=open, **k: (opened.append(os.path.relpath(f, tmp_path)), own(f, *a, **k))[1])
        parts = reader.partitions()
        rows = [r for p in parts for r in reader.read(p)]
    assert opened == ["src/a.py"] and [r[:2] for r in rows] == [("src/a.py", "one")] and "doc" not in {p.rel for p in parts}
    tree.register(spark)
    df = spark.read.format("tree").load(str(tmp_path)).filter("path like 'src/%' and size < 50")
    assert {r.path for r in df.collect()} == {"src/a.py", "src/deep/b.ts"}
    assert spark.read.format("tree").load(str(tmp_path)).count() == 5


def test_a_stream_of_a_tree_feeds_the_index(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, a_dot_py="one two", b_dot_py="three", d__c_dot_py="four")
    tree.register(spark)

    def go():
        changes = spark.readStream.format("tree").option("state", str(tmp_path / "state")).load(str(root))
        incremental.start(changes, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)

    go()
    assert {r.path for r in incremental.load(spark, str(tmp_path / "index"), 0)["files"].collect()} == {"a.py", "b.py", "d/c.py"}
    put(root, a_dot_py="one five six")
    (root / "b.py").unlink()
    go()
    t = incremental.load(spark, str(tmp_path / "index"), 1)
    assert {(r.path, r.term) for r in t["postings"].collect()} == {("a.py", "one"), ("a.py", "five"), ("a.py", "six"), ("d/c.py", "four")}
    batch = spark.read.parquet(str(tmp_path / "index" / "segments" / "b1" / "files")).collect()
    assert {r.path for r in batch} == {"a.py"}


DOCS = [("20240101-000000-one", n, b) for n, b in (("manifest.json", json.dumps({"files": [{"path": "a"}]})), ("TASK.md", "é"), ("excerpts/a.md", "x"), ("EMPTY.md", None))] + [
    ("20240102-000000-two", "manifest.json", json.dumps({"files": []})), ("20240102-000000-two", "TASK.md", "t")]
SCHEMA = "slug string, name string, body string"


def test_packs_are_whole_or_not_there(spark, tmp_path):
    packfiles.register(spark)
    folder = str(tmp_path / "packs")
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(4)
    df.write.format("pack").mode("append").save(folder)
    assert (tmp_path / "packs" / DOCS[0][0] / "excerpts" / "a.md").read_text() == "x" and (tmp_path / "packs" / DOCS[0][0] / "EMPTY.md").read_text() == ""
    assert sorted(os.listdir(folder)) == [DOCS[0][0], DOCS[4][0]]
    found = packs.catalogue(packfiles.read(spark, folder)).collect()
    assert [(r.slug, r.n_files) for r in found] == [(DOCS[4][0], 0), (DOCS[0][0], 1)]
    with pytest.raises(Exception, match="there already"):
        df.write.format("pack").mode("append").save(folder)
    changed = spark.createDataFrame([(DOCS[0][0], "manifest.json", "{}"), (DOCS[0][0], "NEW.md", "n")], SCHEMA)
    changed.write.format("pack").mode("overwrite").save(folder)
    assert sorted(os.listdir(f"{folder}/{DOCS[0][0]}")) == ["NEW.md", "manifest.json"] and os.path.exists(f"{folder}/{DOCS[4][0]}/TASK.md")

    # A task that fails, after others have written: nothing is seen, and nothing is left aside.
    bad = spark.createDataFrame([("20240103-000000-three", "manifest.json", "{}"), ("20240103-000000-three", "../out.md", "x")], SCHEMA).repartition(2)
    with pytest.raises(Exception, match="no place"):
        bad.write.format("pack").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == [DOCS[0][0], DOCS[4][0]]


def test_a_repeated_attempt_counts_once(tmp_path):
    """Two attempts of a task write; Spark commits one of them."""
    from pyspark.sql import Row

    w = packfiles.PackWriter(str(tmp_path), False)
    rows = [Row(slug="s", name="manifest.json", body="{}"), Row(slug="s", name="a.md", body="late")]
    w.write(iter([Row(slug="s", name="a.md", body="early")]))  # lost before it could report
    second = w.write(iter(rows))
    assert not os.path.exists(tmp_path / "s")
    w.commit([second, None])
    assert (tmp_path / "s" / "a.md").read_text() == "late" and os.listdir(tmp_path) == ["s"]


def test_changes_by_directories(spark):
    rng = random.Random(4)
    old = {"/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) + f"/f{i}".lstrip("/" if i % 9 == 0 else ""): str(i) for i in range(300)}
    old = {p.strip("/"): h for p, h in old.items()}
    new = {p: ("changed" if rng.random() < 0.02 else h) for p, h in old.items() if rng.random() > 0.02} | {"new/x/y": "1", "a/f9999": "2"}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "path string, hash string")
    want = {(p, "added" if p not in old else "deleted" if p not in new else "changed") for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
    assert {(r.path, r.change) for r in index.tree_changes(frame(old), frame(new)).collect()} == want
    assert index.tree_changes(frame(old), frame(old), index.directories(frame(old))).count() == 0
    one = dict(old) | {"c/c/c/only": "1"}
    dirs = {r.dir for r in index.changed_directories(index.directories(frame(old)), index.directories(frame(one))).collect()}
    assert dirs == {"", "c", "c/c", "c/c/c"}  # its own line of directories, whatever else there is
    assert index.tree_changes(frame(old).limit(0), frame(one)).filter(F.col("change") == "added").count() == len(one)
