"""The log-structured index: against full builds after random changes, with retries, failures and merges."""

import random

from quillmesh.operators import extract, graph, index
from quillmesh.streaming import incremental

SCHEMA = "path string, content string, deleted boolean, seq long"
SF = "/root/testdata/sf0.01"


def size(spark, *folders):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sum(path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path(f)).getLength() for f in folders)


def test_streaming_index(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "index")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    put([("a.py", "one two", False, 1), ("b.py", "three", False, 1), ("a.py", "one one", False, 2)])
    go = lambda: incremental.start(spark.readStream.schema(SCHEMA).parquet(str(src)), root, str(tmp_path / "cp")).awaitTermination(120)
    go()
    put([("b.py", None, True, 3), ("c.py", "four", False, 3), ("a.py", "one one", False, 4)])
    go()
    t = incremental.load(spark, root, 1)
    assert {(r.path, r.term, r.tf) for r in t["postings"].collect()} == {("a.py", "one", 2), ("c.py", "four", 1)}
    assert {r.path for r in t["files"].collect()} == {"a.py", "c.py"} and t["lengths"].count() == 2
    (unchanged,) = spark.read.schema(incremental.TABLES["files"][0]).parquet(f"{root}/segments/b1/files").select("path").collect()
    assert unchanged.path == "c.py"  # a.py came again as it was, and is not written again


NAMES = [f"src/{d}/{b}{e}" for d in ("a", "b", "a/c") for b in ("index", "util", "core", "view") for e in (".ts", ".tsx", ".js", ".py")] + ["src/a/pkg/__init__.py", "src/b/lib/index.ts"]
SPECS = ["./util", "./core.js", "../a/util", "../b/lib", "./index", "@/src/a/view", "../c/core", "./pkg", "missing/util", "lib/core"]


def content(rng):
    body = [f"import x{k} from '{rng.choice(SPECS)}'" for k in range(rng.randrange(4))] + [f"from .{rng.choice(['util', 'pkg', 'core'])} import y"]
    return "\n".join([*body, f"class K{rng.randrange(9)} {{", "}", "word " * rng.randrange(5)])


def whole(spark, files):
    """The tables of a full build."""
    rows = spark.createDataFrame(sorted(files.items()), "path string, content string")
    cat = index.catalogue(rows)
    code = rows.join(cat.select("path", "language"), "path")
    return {"files": cat, "postings": index.postings(rows), "lengths": index.lengths(rows), "symbols": extract.symbols(code), "edges": graph.resolve(extract.imports(code), rows)}


def same(got, want):
    for name, table in want.items():
        a, b = (sorted(map(tuple, t.select(*sorted(table.columns)).collect()), key=str) for t in (got[name], table))
        assert a == b, (name, [x for x in a if x not in b][:5], [x for x in b if x not in a][:5])


def test_random_changes_equal_full_builds(spark, tmp_path):
    rng, files, root = random.Random(3), {}, str(tmp_path / "index")
    write, was_merged = incremental.writer(root), False
    for n in range(6):
        rows = []
        for path in rng.sample(NAMES, 30 if n == 0 else 5):
            if path in files and rng.random() < 0.5:
                del files[path]
                rows.append((path, None, True, n))
            else:
                files[path] = content(rng)
                rows += [(path, "old", False, n), (path, files[path], False, n + 100)]
        batch = spark.createDataFrame(rows, SCHEMA)
        write(batch, n)
        if n in (2, 4):  # tried again, as after a lost driver
            write(batch, n)
        manifest = incremental.Manifest.read(spark, root, n)
        was_merged |= any(s.id.startswith("m") for s in manifest.segments)
        if n in (0, 2, 5):
            same(incremental.load(spark, root, n), whole(spark, files))
    assert was_merged and len(manifest.segments) < 6


def test_a_failed_batch_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    write = incremental.writer(root)
    write(spark.createDataFrame([("a.py", "one", False, 1)], SCHEMA), 0)

    def fail(*_):
        raise RuntimeError("lost")

    second = spark.createDataFrame([("a.py", "two", False, 2), ("b.py", "three", False, 2)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(incremental, "merged", fail)
        try:
            write(second, 1)
        except RuntimeError:
            pass
    assert {r.term for r in incremental.load(spark, root, 0)["postings"].collect()} == {"one"}
    write(second, 1)
    same(incremental.load(spark, root, 1), whole(spark, {"a.py": "two", "b.py": "three"}))


def test_only_concerned_specifiers_are_resolved_again(spark, tmp_path):
    root = str(tmp_path / "index")
    write = incremental.writer(root, compact=False)
    write(spark.createDataFrame([(f"src/m{i}.ts", f"import x from './m{i + 1}'\nimport y from './far{i}'", False, 1) for i in range(40)], SCHEMA), 0)
    write(spark.createDataFrame([("src/far7.ts", "let z = 1", False, 2), ("src/m20.ts", None, True, 2)], SCHEMA), 1)
    rows = spark.read.parquet(f"{root}/segments/b1/edges").collect()
    assert {(r.path, r.specifier, r.dst) for r in rows} == {("src/m7.ts", "./far7", "src/far7.ts"), ("src/m19.ts", "./m20", None)}


def test_a_small_batch_writes_little(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    write = incremental.writer(root)
    rows = docs.selectExpr("concat('d/', doc_id, '.txt') AS path", "text AS content", "false AS deleted", "1L AS seq")
    write(rows, 0)
    write(docs.filter("doc_id % 100 = 0").selectExpr("concat('d/', doc_id, '.txt') AS path", "concat(text, ' changed') AS content", "false AS deleted", "2L AS seq"), 1)
    all_bytes, own = size(spark, f"{root}/segments/b0"), size(spark, f"{root}/segments/b1", f"{root}/dead/b1")
    assert own < 0.03 * all_bytes, (own, all_bytes)
    now = docs.selectExpr("concat('d/', doc_id, '.txt') AS path", "if(doc_id % 100 = 0, concat(text, ' changed'), text) AS content")
    got = incremental.load(spark, root, 1)
    assert got["postings"].exceptAll(index.postings(now)).count() == 0 and index.postings(now).exceptAll(got["postings"]).count() == 0


def test_sizes_that_are_merged():
    s = lambda i, n: incremental.Segment(f"b{i}", n, i)
    assert incremental.to_merge((s(0, 1000), s(1, 10), s(2, 10), s(3, 10))) == []
    assert [x.id for x in incremental.to_merge((s(0, 1000), s(1, 10), s(2, 2), s(3, 10), s(4, 12), s(5, 9)))] == ["b1", "b2", "b3", "b4", "b5"]
    assert incremental.to_merge(()) == []
