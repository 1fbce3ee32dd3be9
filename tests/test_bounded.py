"""What keeps a task's memory and the exchanges in proportion, whatever the tables hold."""

from collections import Counter

from quillmesh.operators import blocks, index, projects


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_where_the_documents_are(spark):
    texts = {1: "b a b Café cafe b a", 2: "", 3: None, 4: "one", 5: "x " * 3000 + "y", 6: "- . -"}
    got = index.postings(spark.createDataFrame(list(texts.items()), "path long, content string"))
    want = {1: ["b"] * 3 + ["a"] * 2 + ["cafe"] * 2, 4: ["one"], 5: ["x"] * 3000 + ["y"]}
    assert sorted(map(tuple, got.collect())) == sorted((k, t, n) for k, ts in want.items() for t, n in Counter(ts).items())
    assert got.schema.simpleString() == "struct<path:bigint,term:string,tf:bigint>"
    assert "Exchange" not in plan(got) and "Aggregate" not in plan(got)


def test_many_deleted_keys_are_hashed_and_tables_are_not_sorted(spark, monkeypatch):
    rows = spark.range(50).selectExpr("concat('f', id % 10) AS path", "id AS n")
    keys = spark.createDataFrame([("f1",), ("f1",), ("f2",), (None,)], "path string")
    few, = index.delete(keys, rows)
    monkeypatch.setattr(index, "MOST_KEYS", 1)
    many, = index.delete(keys, rows)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(f"f{i}", n) for i in (0, *range(3, 10)) for n in range(i, 50, 10)]
    assert "ShuffledHashJoin" in plan(many) and "Sort" not in plan(many)


def test_parts_of_the_index_follow_its_postings(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blocks, "PART", 100)
    docs = spark.range(300).selectExpr("id", "concat('common w', id % 7, ' r', id) AS body")
    folder = f"file://{tmp_path}/index"
    blocks.BlockIndex.write(docs, "id", "body", folder)
    sizes = [n for _, n in spark.read.parquet(f"{folder}/posts").groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 900 and len(sizes) > 4 and max(sizes) <= 300
    assert spark.read.parquet(f"{folder}/docs").count() == 300


def test_domains_of_trees_are_spread_at_the_end(spark):
    files = spark.createDataFrame([("a", "package.json", "{}"), ("a", "x", ""), ("b", "README", ""), ("c", "composer.json", '{"require": {"laravel/framework": "1"}}'), ("d", "x", "")], "tree string, path string, content string")
    body = '{"customDomains": [{"name": "one", "keywords": ["first"]}, {"name": "own"}, {"name": "one", "keywords": ["last"]}], "disabledDomains": ["two", "own"]}'
    configs = spark.createDataFrame([("a", body), ("b", "no"), ("d", '{"disabledDomains": ["one"]}'), ("e", '{"customDomains": [{"name": "far", "keywords": ["f"]}]}')], "tree string, body string")
    got = projects.in_force(files, {"one": ["1"], "two": ["2"]}, configs, "tree")
    rows = {(r.tree, r.domain): (r.words, r.source) for r in got.collect()}
    of = lambda tree, name: {(tree, d): (ws, name) for d, ws in projects.FRAMEWORKS[name][2].items()}
    core = lambda tree, *ds: {(tree, d): ([{"one": "1", "two": "2"}[d]], "core") for d in ds}
    assert rows == of("a", "nodejs") | {("a", "one"): (["last"], "custom")} | core("b", "one", "two") | core("c", "one", "two") | of("c", "laravel") | core("d", "two") | {("e", "far"): (["f"], "custom")}
    # What is spread is neither ranked nor exchanged: the windows rank what configurations define.
    lines = plan(got).split("\n")
    spread = next(i for i, line in enumerate(lines) if "Generate inline" in line)
    assert not any("Window" in line or "Exchange" in line for line in lines[:spread])


def test_rows_meet_needles_by_longer_grams_and_are_not_exchanged(spark, monkeypatch):
    from quillmesh.operators import contain

    rows = spark.createDataFrame([(i, f"unit{i}") for i in range(60)] + [(90, "xunit11y"), (91, ""), (92, "it"), (93, None)], "id long, hay string")
    asked = [(1, "unit1"), (2, "unit11"), (2, "it"), (3, ""), (3, "unit1"), (4, "nit59"), (5, "gone")]
    needles = spark.createDataFrame(asked, "q long, word string")
    want = sorted((r.id, q, w) for r in rows.collect() for q, w in asked if w and w in (r.hay or ""))
    got = contain.containing(rows, "hay", needles, "word")
    assert sorted((r.id, r.q, r.word) for r in got.collect()) == want
    assert not any(x in plan(got) for x in ("Exchange hashpartitioning", "SortMergeJoin"))
    monkeypatch.setattr(contain, "PER_GRAM", 1)
    monkeypatch.setattr(contain, "MAX_BROADCAST", 1)
    many = contain.containing(rows, "hay", needles, "word")
    assert sorted((r.id, r.q, r.word) for r in many.collect()) == want
    assert "SortMergeJoin" not in plan(many)


def test_contents_are_read_once_for_symbols_and_references(spark):
    from quillmesh.operators import discover, extract

    content = "<?php\nclass Cart\n{\n    public function total() {\n        return new Price();\n    }\n}\n"
    rows = [("a/Cart.php", content, "php"), ("a/price.TS", "export class Other {\n}\n", "typescript"), ("b/Price.md", "Price", "markdown"), ("b/pricelist.php", "<?php\nclass PriceList {}\n", "php")]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    symbols = extract.symbols(files)
    assert "regexp_extract_all" not in plan(symbols)
    assert sorted((r.path, r.name, r.start_line, r.end_line) for r in symbols.collect()) == [("a/Cart.php", "Cart", 2, 7), ("a/Cart.php", "total", 4, 6), ("a/price.TS", "Other", 1, 2), ("b/pricelist.php", "PriceList", 2, 2)]
    merged = spark.createDataFrame([(1, "a/Cart.php"), (2, "b/Price.md")], "query long, path string")
    found = discover.from_references(merged, files, symbols)
    assert "regexp_extract_all" not in plan(found)
    assert sorted((r.query, r.path) for r in found.collect()) == [(1, "a/Cart.php"), (1, "a/price.TS"), (1, "b/pricelist.php")]


def test_grams_of_many_needles_are_of_different_texts_only(spark, monkeypatch):
    from quillmesh.operators import contain

    monkeypatch.setattr(contain, "MAX_BROADCAST", 0)
    rows = spark.createDataFrame([(i, ["unit1", "run12", None, ""][i % 4]) for i in range(40)], "id long, hay string")
    needles = spark.createDataFrame([(1, "unit1"), (1, "n1"), (2, "n1"), (3, "unit12")], "q long, word string")
    got = contain.containing(rows, "hay", needles, "word")
    want = sorted((r.id, q, w) for r in rows.collect() for q, w in [(1, "unit1"), (1, "n1"), (2, "n1"), (3, "unit12")] if w in (r.hay or ""))
    assert sorted((r.id, r.q, r.word) for r in got.collect()) == want
    assert not any("id#" in line for line in plan(got).split("\n") if "Generate explode" in line)
