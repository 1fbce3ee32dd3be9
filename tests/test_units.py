import re
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import stem
from quillmesh.functions import text as T
from quillmesh.operators import excerpts, graph, ignore, index, resolve, rules, score
from quillmesh.plans import project
from quillmesh.plans.words import DOMAINS, STOPWORDS
from quillmesh.sources import git, packs, tree


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("word, want", [("users", "user"), ("payments", "payment"), ("running", "run"), ("consignment", "consign"), ("generously", "generous"), ("knightly", "knight"), ("skies", "sky"), ("hopping", "hop"), ("hoped", "hope"),
                                        ("relational", "relat"), ("kindness", "kind"), ("communism", "communism"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("vileness", "vile"), ("early", "earli"), ("by", "by"), ("say", "say"), ("controlling", "control")])
def test_english_stems(word, want):
    assert stem.english(word) == want


@pytest.mark.parametrize("word, want", [("utente", "utent"), ("utenti", "utent"), ("abbandonata", "abbandon"), ("abbandonare", "abbandon"), ("pronto", "pront"), ("propaga", "propag"), ("pagamenti", "pag"), ("amiche", "amic")])
def test_italian_stems(word, want):
    assert stem.italian(word) == want


@given(st.text(alphabet="abcdefghilmnoqrstuvzyàèìòù'", max_size=14))
@settings(max_examples=400, deadline=None)
def test_stems_never_fail_and_never_grow(word):
    for f in (stem.english, stem.italian):
        assert len(f(word)) <= len(word) + 1


def test_paths(spark):
    cases = {"a/b.test.ts": ("a", "b.test.ts", "ts", "b.test", "typescript"), ".env": (".", ".env", "", ".env", "unknown"), "Makefile": (".", "Makefile", "", "Makefile", "unknown"), "x/y/__init__.py": ("x/y", "__init__.py", "py", "__init__", "python")}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    p = F.col("p")
    got = {r.p: tuple(r[1:]) for r in df.select("p", T.dirname(p), T.basename(p), T.extension(p), T.stem_name(p), T.language(p)).collect()}
    assert got == cases
    assert one(spark, T.display_path(F.lit("a/b/c/d.py"))) == "b/c/d.py" and one(spark, T.safe_filename(F.lit("a/b.c"))) == "a_b_c" and one(spark, T.fence_language(F.lit("a.tsx"))) == "tsx"
    assert one(spark, T.normalize_path(F.lit(".\\a\\b"))) == "a/b" and one(spark, T.signature(F.lit("  x" + "y" * 300))) == "x" + "y" * 199 + "..."
    assert one(spark, graph.joined(F.lit("a/b"), F.lit("../../c/./d"))) == "c/d"


def prefix_match(query, segments):
    """By trying all ways to cut the query."""
    if not query:
        return True
    return bool(segments) and any(prefix_match(query[k:], segments[1:]) for k in range(1, len(query) + 1) if segments[0].startswith(query[:k]))


@given(st.text(alphabet="ab1", min_size=1, max_size=5), st.lists(st.text(alphabet="ab1", min_size=1, max_size=4), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_acronym_pattern(query, segments):
    assert bool(re.search(T.acronym_pattern(query), " ".join(segments))) == prefix_match(query, segments)


@pytest.mark.parametrize("rule, hits, misses", [("build/", ["build/x", "a/build/x"], ["build", "rebuild/x"]), ("/build", ["build", "build/x"], ["a/build"]), ("*.ts", ["a.ts", "b/c.ts"], ["a.tsx"]), ("a/**/b", ["a/b", "a/x/y/b"], ["x/a/b"]),
                                                 ("**/foo", ["foo", "a/foo", "a/foo/x"], ["foox"]), ("a?c", ["abc", "x/abc"], ["a/c"]), ("[ab].md", ["a.md"], ["c.md"]), ("doc/*.md", ["doc/a.md"], ["doc/x/a.md", "y/doc/a.md"])])
def test_ignore_patterns(rule, hits, misses):
    p = re.compile(ignore.to_regex(rule))
    assert all(p.search(x) for x in hits) and not any(p.search(x) for x in misses)


def test_ignore_built_in_rules_cannot_be_lifted(spark):
    assert one(spark, ignore.is_ignored(F.lit(".idea/x"), "!.idea/")) and not one(spark, ignore.is_ignored(F.lit("a.log"), "*.log\n!a.log"))


def test_index_round_trip(spark):
    files = spark.createDataFrame([("a.py", "one two two"), ("b.md", "three"), ("c.bin", "x"), ("d.py", ""), (".git/e.py", "x")], "path string, content string")
    first = index.incremental({"files": index.catalogue(files.limit(0)), "postings": index.postings(files.limit(0)), "lengths": index.lengths(files.limit(0))}, files.filter("path in ('a.py', 'b.md')"))
    assert {r.path for r in first["files"].collect()} == {"a.py", "b.md"}
    second = index.incremental(first, spark.createDataFrame([("a.py", "one four"), ("f.py", "five")], "path string, content string"))
    assert {(r.path, r.term, r.tf) for r in second["postings"].collect()} == {("a.py", "one", 1), ("a.py", "four", 1), ("f.py", "five", 1)}
    assert {(r.path, r.len) for r in second["lengths"].collect()} == {("a.py", 2), ("f.py", 1)} and {r.path for r in second["files"].collect()} == {"a.py", "f.py"}
    once = index.upsert(first["files"], first["files"])
    assert sorted(map(str, once.collect())) == sorted(map(str, first["files"].collect()))


def naive_bfs(seeds, edges, depth, most):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, queue, out = set(seeds), [(s, 0) for s in sorted(seeds)], {}
    level = {}
    while queue and len(seen) < most:
        node, d = queue.pop(0)
        if d < depth:
            for x in sorted(near.get(node, ()), key=lambda x: x):
                if x not in seen:
                    seen.add(x)
                    out[x] = level[x] = d + 1
                    queue.append((x, d + 1))
    return out


def test_bfs_matches_a_queue(spark):
    import random

    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(90)]
    edges = [(a, b) for a, b in edges if a != b] + [("n00", "n01"), ("n01", "n00")]
    e = spark.createDataFrame(edges, "src string, dst string")
    for most in (4, 12, 100):
        s = spark.createDataFrame([(1, "n00", 1), (1, "n07", 2)], "query long, node string, ord int")
        got = {r.node: r.depth for r in graph.bfs(s, e, 2, most).collect()}
        assert got == naive_bfs(["n00", "n07"], edges, 2, most)


def test_entities(spark):
    text = "UserController.show and manage_credit fail at POST /api/checkout in app/Services/StripeService.php, @Cart.php: E404 PAYMENT_FAILED 502 loadUser"
    e = one(spark, resolve.entities(F.lit(text), STOPWORDS))
    assert {"UserController", "user_controller", "manage_credit", "manageCredit", "ManageCredit", "StripeService"} <= set(e.class_names)
    assert {"show", "loadUser", "load_user"} <= set(e.method_names) and e.file_names == ["app/Services/StripeService.php", "Cart.php"]
    assert "/api/checkout" in e.routes and set(e.error_codes) == {"E404", "PAYMENT_FAILED", "502"}
    nothing = one(spark, resolve.entities(F.lit(""), STOPWORDS))
    assert all(len(v) == 0 for v in nothing.asDict().values())


def candidates(spark, rows):
    df = spark.createDataFrame([(1, p, *f) for p, *f in rows], "query long, path string, exact boolean, word boolean, symbol boolean")
    return score.merge(score.signals(df, file_hint_hit=F.col("exact"), file_hint_exact=F.col("exact"), keyword_match=F.col("word"), exact_symbol=F.col("symbol")))


def test_selection_bounds(spark):
    rows = [("src/named.ts", True, False, False), ("src/sym.ts", False, False, True), ("tests/named.test.ts", False, True, False)] + [(f"src/f{i}.ts", False, True, False) for i in range(50)] + [("tests/other.test.ts", False, True, False), ("config/auth.php", False, True, False), ("config/zzz.php", False, True, False)]
    tasks = spark.createDataFrame([(1, [("auth", 2)])], "query long, domains array<struct<domain:string,weight:int>>")
    git_ = spark.createDataFrame([], "path string, churn double")
    s = score.score(candidates(spark, rows), tasks, git_, DOMAINS)
    got = score.select(s, tasks, most=12).orderBy("ord").collect()
    paths = [r.path for r in got]
    assert paths[:2] == ["src/named.ts", "src/sym.ts"] and len(got) <= 12 and all(0 <= r.score <= 1 for r in got) and max(r.score for r in got) == 1
    assert sum(r["class"] == 1 for r in got) == 7 and "tests/named.test.ts" in paths and "tests/other.test.ts" not in paths and "config/auth.php" in paths and "config/zzz.php" not in paths
    assert len(score.select(s, tasks, most=1).collect()) == 1


def test_merge_is_free_of_order(spark):
    df = spark.createDataFrame([(1, "a", True, None, 2), (1, "a", False, 3, 1), (1, "a", False, 1, None)], "query long, path string, hit boolean, n int, depth int")
    part = score.signals(df, stacktrace_hit=F.col("hit"), path_matches=F.col("n"), graph_depth=F.col("depth"))
    for order in (F.asc("path_matches"), F.desc("path_matches")):
        r = score.merge(part.orderBy(order)).first()
        assert (r.stacktrace_hit, r.path_matches, r.graph_depth, r.graph_decay) == (True, 3, 1, 1.0)


def test_header_end(spark):
    cases = [(["import a", "", "class X {"] + ["x"] * 30, 10), (["/*", "text", "*/"] + ["// c"] * 12 + ["export const y = 1", "// late"], 15), ([], 10), (["use a;"] * 60, 50)]
    for ls, want in cases:
        assert one(spark, excerpts.header_end(F.array(*[F.lit(x) for x in ls]).cast("array<string>"))) == want


def test_rules_registry(spark):
    files = project.FILES.frame(spark)
    c = files.filter("path = 'src/userController.js'").select(F.lit(1).cast("long").alias("query"), "path", "content")
    t = spark.createDataFrame([(1, [], [], [])], "query long, domains array<struct<domain:string,weight:int>>, keywords array<string>, symbols array<string>")
    got = {(r.path, r.signal) for r in rules.apply(c, files, t).collect()}
    assert ("src/userService.js", "related_file") in got and ("src/index.ts", "related_file") in got and not any(p == "src/userController.js" for p, _ in got)
    bare = files.filter("path not in ('package.json', 'composer.json')")
    assert not any(p == "src/index.ts" for p in {r.path for r in rules.apply(c, bare, t).collect()})


def test_projects(spark):
    from quillmesh.operators import domains, projects

    files = spark.createDataFrame([("a", "package.json", "{}"), ("a", "composer.json", '{"require": {"laravel/framework": "11"}}'), ("b", "x.py", ""), ("c", "sub/package.json", "{}"), (None, "package.json", None)], "tree string, path string, content string")
    of = lambda df: {t: {r.name for r in df.collect() if r.tree == t} for t in ("a", "b", "c", None)}
    got = of(projects.detect(files, "tree"))
    assert {"configs", "roles"} == got["b"] == got["c"] and "node-index" in got["a"] and "laravel-views" in got["a"] and "node-tests" in got[None]
    assert {r.name for r in projects.detect(files.filter("tree = 'a'").drop("tree")).collect()} == got["a"]
    kept = projects.cache(projects.detect(files, "tree"), F.lit("2024-01-01 00:00:00").cast("timestamp"), "tree")
    stale = files.filter("tree <> 'a'").unionByName(spark.createDataFrame([("a", "other", "")], files.schema))
    assert of(projects.applied(stale, kept, "tree"))["a"] == got["a"]  # as cached
    again = projects.dropped(kept, files.filter("tree = 'a'"), "tree")
    assert of(projects.applied(stale, again, "tree"))["a"] == {"configs", "roles"}
    two = kept.unionByName(spark.createDataFrame([("a", '{"rules": ["roles"], "detectedAt": "2025"}'), ("b", "broken"), ("b", None)], kept.schema))
    assert of(projects.applied(files, two, "tree"))["a"] == {"roles"} and of(projects.applied(files, two, "tree"))["b"] == {"configs", "roles"}
    config = domains.Config().put("nova", ["mine"]).disable("core1")
    table = projects.in_force(files, {"core1": ["c"], "express": ["core"]}, spark.createDataFrame([("a", config.dump()), ("b", "?")], "tree string, body string"), "tree")
    force = {(r.tree, r.domain): (r.words, r.source) for r in table.collect()}
    assert force["a", "nova"] == (["mine"], "custom") and ("a", "core1") not in force and force["b", "core1"] == (["c"], "core") and force["a", "express"][1] == "nodejs" and ("b", "nova") not in force
    assert {d: ws for (t, d), (ws, _) in force.items() if t == "a"} == projects.words_of(["nodejs", "laravel"], {"core1": ["c"], "express": ["core"]}, config)
    assert projects.detect(files.limit(0), "tree").count() == projects.in_force(files.limit(0), {"a": ["b"]}, kept.limit(0), "tree").count() == 0


def test_statamic_rules(spark):
    files = spark.createDataFrame([("composer.json", '{"require": {"statamic/cms": "5"}}'), ("content/collections/blog/a.md", "x"), ("resources/blueprints/collections/blog/post.yaml", "import: seo_fields"), ("resources/fieldsets/seo_fields.yaml", "f"), ("resources/views/blog/show.antlers.html", "{{ partial:nav/menu }} taxonomy=\"tags\""),
                                   ("resources/views/partials/nav/menu.antlers.html", "nav"), ("content/taxonomies/tags/x.yaml", "t")], "path string, content string")
    t = spark.createDataFrame([(1, [], ["nav", "seo"], [])], "query long, domains array<struct<domain:string,weight:int>>, keywords array<string>, symbols array<string>")
    names = [n for n in rules.REGISTRY if n.startswith("statamic")]
    run = lambda *paths: {(r.path, r.signal) for r in rules.apply(files.filter(F.col("path").isin(*paths)).select(F.lit(1).cast("long").alias("query"), "path", "content"), files, t, names).collect()}
    assert {"resources/blueprints/collections/blog/post.yaml", "resources/views/blog/show.antlers.html"} <= {p for p, _ in run("content/collections/blog/a.md")}
    assert ("resources/fieldsets/seo_fields.yaml", "related_file") in run("resources/blueprints/collections/blog/post.yaml")
    assert ("resources/views/partials/nav/menu.antlers.html", "related_file") in run("resources/views/blog/show.antlers.html")
    assert ("resources/views/blog/show.antlers.html", "example_usage") in run("content/taxonomies/tags/x.yaml")


def test_tree_source(spark, tmp_path):
    for p, c in {"a.py": b"x = 1", ".hidden": b"h", "_priv/__init__.py": b"i", "d/e/f/g.txt": b"deep", ".git/config": b"no", "bin.dat": b"\xff\xfe\x00", "d/big.txt": b"z" * 3000}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    tree.register(spark)
    got = {r.path: (r.content, r.size) for r in spark.read.format("tree").option("maxFileSize", "2000").load(str(tmp_path)).collect()}
    assert got == {"a.py": ("x = 1", 5), ".hidden": ("h", 1), "_priv/__init__.py": ("i", 1), "d/e/f/g.txt": ("deep", 4)}


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    assert not git.is_repository(str(tmp_path))
    run("init", "-q")
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    (tmp_path / "b.txt").write_text("b\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.txt").write_text("1\nx\n3\n4\n")
    run("commit", "-qam", "two")
    root = str(tmp_path)
    assert git.is_repository(root) and git.ref_exists(root, "HEAD~1") and not git.ref_exists(root, "nope") and len(git.current_commit(root)) == 40
    assert sorted((r.path for r in git.history(spark, root).collect())) == ["a.txt", "a.txt", "b.txt"]
    (entry,) = git.diff(spark, root, "HEAD~1").collect()
    assert tuple(entry) == ("a.txt", "modified", 2, 1)
    assert {(r.path, r.line) for r in git.changed_lines(spark, root, "HEAD~1").collect()} == {("a.txt", 2), ("a.txt", 4)}
    assert git.modified(git.diff(spark, root, "HEAD~1")).count() == 1 and "+x" in git.diff_text(root, "HEAD~1", "a.txt")


def test_pack_outputs(spark, tmp_path):
    sel = spark.createDataFrame([(1, "src/a.ts", 1, 1.0, ["why"]), (1, "src/b.py", 2, 0.5, [])], "query long, path string, ord int, score double, reasons array<string>")
    assert packs.commands(sel).first().commands == ["npm test", "npm run test:watch", "pytest", "python -m pytest"]
    edges = spark.createDataFrame([("src/a.ts", "src/b.py"), ("src/a.ts", "x.ts")], "src string, dst string")
    assert {tuple(r) for r in packs.edges_within(sel, edges).collect()} == {(1, "src/a.ts", "imports", "src/b.py"), (1, "src/b.py", "imported by", "src/a.ts")}
    files = spark.createDataFrame([("src/a.ts", "typescript", 2048)], "path string, language string, size long")
    syms = spark.createDataFrame([("src/a.ts", "class", "A", 1)], "path string, kind string, name string, start_line int")
    report = packs.files_report(sel, files, syms).first().report
    assert "## src/a.ts" in report and "2.0 KB" in report and "- class: A" in report
    tasks = spark.createDataFrame([(1, "do it", [("auth", 1)], 0.2)], "query long, text string, domains array<struct<domain:string,weight:int>>, confidence double")
    assert "1. excerpts/src_a_ts.md (100%)" in packs.pack_report(tasks, sel).first().report
    cut = spark.createDataFrame([(1, "src/a.ts", "code", 1, 1, 1, False)], "query long, path string, content string, start_line int, end_line int, total_lines int, truncated boolean")
    assert "Lines 1-1 of 1\n(complete)" in packs.excerpt_documents(cut).first().document
    (tmp_path / "x.md").write_text("x")
    import tarfile

    assert tarfile.open(packs.archive(str(tmp_path))).getnames() == ["x.md"]


def test_grammars(spark):
    from quillmesh.operators import extract

    code = {
        "a.ts": ("typescript", "export default class Shop<T> {\nexport async function* pull() {}\nexport type Id = string\nconst f = async (x: number): Promise<void> => {}\n  private async load<T>(id: string): Promise<T> {\n  if (x) {\nlet n = 3\n"),
        "b.php": ("php", "abstract class Cart\ntrait Sums\n  public static function &total()\n  return new Cart();\n"),
        "c.py": ("python", "class A(B):\n    async def go(self):\ndef end():\nprint(x)\n"),
        "d.go": ("go", "type Box[T any] struct {\ntype Shape interface {\nfunc (b *Box) Open() {\nfunc Map[K any](k K) {\n"),
        "e.rs": ("rust", "pub(crate) struct P;\nenum E {\ntrait T {\nimpl<T> P {\npub async fn run() {\n"),
        "f.rb": ("ruby", "module M\nclass C < D\n  def self.make\n  def each\n"),
        "g.java": ("java", "public final class Main {\ninterface Greets {\n  private static List<String> names(int n) {\n  return size(x);\n"),
        "h.kt": ("kotlin", "class K\n"), "i.cs": ("csharp", "public enum Colour {\n"),
    }
    df = spark.createDataFrame([(p, lang, c) for p, (lang, c) in code.items()], "path string, language string, content string")
    got = {}
    for r in extract.symbols(df).collect():
        got.setdefault(r.path, {})[r.name] = (r.kind, r.start_line)
    assert got == {
        "a.ts": {"Shop": ("class", 1), "pull": ("function", 2), "Id": ("interface", 3), "f": ("function", 4), "load": ("method", 5)}, "b.php": {"Cart": ("class", 1), "Sums": ("interface", 2), "total": ("function", 3)},
        "c.py": {"A": ("class", 1), "go": ("function", 2), "end": ("function", 3)}, "d.go": {"Box": ("class", 1), "Shape": ("interface", 2), "Open": ("function", 3), "Map": ("function", 4)},
        "e.rs": {"P": ("class", 1), "E": ("class", 2), "T": ("interface", 3), "run": ("function", 5)}, "f.rb": {"M": ("class", 1), "C": ("class", 2), "make": ("function", 3), "each": ("function", 4)},
        "g.java": {"Main": ("class", 1), "Greets": ("interface", 2), "names": ("method", 3)}, "h.kt": {"K": ("class", 1)}, "i.cs": {"Colour": ("class", 1)},
    }
    code = {"a.js": ("javascript", "import a, { b } from './x';\nimport './y';\nconst z = require('../z');\nimport('./lazy');\nimport r from 'react';\nconst s = 'from nowhere';\n"), "b.rb": ("ruby", "require_relative 'lib/x'\nrequire 'json'\n"),
            "c.rs": ("rust", "use crate::a::b;\nuse std::fs;\n"), "d.java": ("java", "import static com.acme.X.y;\nimport java.util.List;\n"), "e.php": ("php", "use App\\A as B;\nrequire_once('inc/x.php');\nuse Symfony\\X;\n")}
    df = spark.createDataFrame([(p, lang, c) for p, (lang, c) in code.items()], "path string, language string, content string")
    assert sorted(tuple(r) for r in extract.imports(df).collect()) == [("a.js", "javascript", "../z"), ("a.js", "javascript", "./lazy"), ("a.js", "javascript", "./x"), ("a.js", "javascript", "./y"), ("b.rb", "ruby", "lib/x"),
                                                                       ("c.rs", "rust", "crate::a::b"), ("d.java", "java", "com.acme.X.y"), ("e.php", "php", "App\\A"), ("e.php", "php", "inc/x.php")]


def test_synonyms_and_logs(spark, tmp_path):
    from quillmesh.operators import synonyms
    from quillmesh.sources import logs

    t = spark.createDataFrame([(1, ["signin", "checkout page"]), (2, ["carrello"]), (3, [])], "query long, keywords array<string>")
    got = {r.query: r.keywords for r in synonyms.widen(t).collect()}
    assert got[1][:2] == ["signin", "checkout page"] and {"login", "order", "screen"} <= set(got[1]) and "cart" in got[2] and "basket" in got[2] and got[3] == []
    assert {r.lang: r.n_words for r in synonyms.statistics(synonyms.tables(spark)[0]).collect()}["en"] > 100
    assert [len(synonyms.lines(p)) for p in (synonyms.GROUPS["en"], synonyms.GROUPS["it"], synonyms.TRANSLATIONS)] >= [89, 60, 190]
    every = [tuple(x) for p in (*synonyms.GROUPS.values(), synonyms.TRANSLATIONS) for x in synonyms.lines(p)]
    assert len(every) == len(set(every)) and all(len(x) > 1 and len(x) == len(set(x)) or len(x) == 2 for x in every)
    (tmp_path / "own.txt").write_text("# of this project\nsku gizmo\n\n")
    own = synonyms.tables(spark, {"en": tmp_path / "own.txt"}, tmp_path / "own.txt")
    assert {r.query: r.keywords for r in synonyms.widen(spark.createDataFrame([(1, ["sku"])], "query long, keywords array<string>"), *own).collect()} == {1: ["sku", "gizmo"]}
    (tmp_path / "own.txt").unlink()
    (tmp_path / "a.log").write_text("2024-01-10 09:00:00 old\n at old\n2024-01-12 09:00:00 new\n at new\n")
    assert [r.body for r in logs.lines(spark, str(tmp_path), F.lit("2024-01-11").cast("timestamp")).orderBy("line").collect()] == ["2024-01-12 09:00:00 new", " at new", ""]
    assert logs.contents(spark, str(tmp_path)).count() == 1


def test_written_packs_and_their_catalogue(spark):
    from quillmesh import engine

    at = F.lit("2024-01-31 12:00:00").cast("timestamp")
    tasks = spark.createDataFrame([(1, "Fix the cart", ["cart"], ["src/a.ts"], ["Cart"], "bugfix", 0.4, [("ui", 2)])],
                                  "query long, text string, keywords array<string>, files_hint array<string>, symbols array<string>, change_type string, confidence double, domains array<struct<domain:string,weight:int>>")
    sel = spark.createDataFrame([(1, "src/a.ts", 1, 1.0, ["why"]), (1, "src/a.test.ts", 2, 0.5, [])], "query long, path string, ord int, score double, reasons array<string>")
    cut = spark.createDataFrame([(1, "src/a.ts", "code", 1, 1, 1, False)], "query long, path string, content string, start_line int, end_line int, total_lines int, truncated boolean")
    files = spark.createDataFrame([("src/a.ts", "typescript", 4)], "path string, language string, size long")
    syms = spark.createDataFrame([("src/a.ts", "class", "Cart", 1)], "path string, kind string, name string, start_line int")
    edges = spark.createDataFrame([("src/a.test.ts", "src/a.ts")], "src string, dst string")
    docs = {r.name: r for r in packs.documents(tasks, sel, cut, files, syms, edges, at).collect()}
    assert set(docs) == {"manifest.json", "PACK.md", "TASK.md", "FILES.md", "GRAPH.md", "TESTS.md", "excerpts/src_a_ts.md"}
    assert "bugfix" in docs["TASK.md"].body and "- ui (2)" in docs["TASK.md"].body and "- src/a.test.ts imports src/a.ts" in docs["GRAPH.md"].body and "- src/a.test.ts" in docs["TESTS.md"].body and "`npm test`" in docs["TESTS.md"].body
    written = spark.createDataFrame([(docs["PACK.md"].slug, docs["manifest.json"].body), ("20230101-000000-old-task", "{}")], "slug string, manifest string")
    c = packs.catalogue(written)
    assert packs.latest(c).first().n_files == 2 and [r.slug for r in packs.by_prefix(c, "old").collect()] == ["20230101-000000-old-task"] and packs.by_prefix(c, "2024").count() == 1
    frames = spark.createDataFrame([(1, "x/src/a.ts", 7), (1, "a.ts", 9)], "query long, file string, line int")
    changed = spark.createDataFrame([(1, "src/b.ts", 3)], "query long, path string, line int")
    tree_ = spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "path string")
    assert sorted(tuple(r) for r in engine.highlighted(tree_, frames, changed, None).collect()) == [(1, "src/a.ts", 7), (1, "src/a.ts", 9), (1, "src/b.ts", 3)] and engine.highlighted(tree_, None, None, None) is None
    assert {n: t.count() for n, t in index.truncate({"files": files, "edges": edges}).items()} == {"files": 0, "edges": 0}
    assert [spark.createDataFrame([(x,)], "content string").filter(rules.needs("a/b")).count() for x in ('{"require": {"a/b": "1"}}', '{"require-dev": {"a/b": "1"}}', '{"name": "a/b"}', "no json")] == [1, 1, 0, 0]


def test_domain_configuration(spark):
    from quillmesh.operators import domains

    c = domains.Config().put("a", ["x"]).put("b", ["y"]).drop("a").disable("auth").disable("auth").disable("ui").enable("ui")
    assert domains.Config.parse(c.dump()) == c and domains.Config.parse("not json") == domains.Config() and domains.Config.parse(None) == domains.Config()
    got = {r.domain: r.source for r in domains.active(spark, {"auth": ["l"], "b": ["z"]}, {"fw": {"ui": ["v"]}}, c).collect()}
    assert got == {"b": "custom", "ui": "fw"}


def test_search_tokens_have_no_accents(spark):
    rows = ["Café café CAFÉ", "Ünïcödé Straße ≠ x", "plain text 12", "", "́ lone", "が ガ İstanbul naïve-œuvre ǖ", "áb c̈"]
    want = [["cafe"] * 3, ["unicode", "straße", "x"], ["plain", "text", "12"], [], ["lone"], ["か", "カ", "istanbul", "naive", "œuvre", "u"], ["ab", "c"]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.search_tokens(F.col("t"))).collect()] == want
