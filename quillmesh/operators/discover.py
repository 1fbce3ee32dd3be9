"""Candidates of tasks: files found by trace, diff, symbols, keywords, hints, names, imports, references,
tests and conventions, for many tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import stem as S
from quillmesh.functions import text as T
from quillmesh.operators import extract, graph, retrieve, rules
from quillmesh.operators.contain import containing
from quillmesh.operators.score import merge, signals
from quillmesh.session import staged

MOST_KEYWORDS, PER_KEYWORD = 30, 20
#: Endings under which a class may be a file of its name.
CLASS_FILES = ("php", "ts", "js", "tsx", "jsx", "py", "rb", "java", "go")
TEST_LIKE = r"(?i)test|spec"


def match_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted``: query, pattern. query, pattern, path, exact: the file of that path, or else those of its
    basename (exact) and those whose path contains it."""
    w = wanted.select("query", T.normalize_path(F.col("pattern")).alias("pattern")).filter("pattern <> ''").distinct()
    f = files.select("path")
    whole = w.join(f, F.col("pattern") == F.col("path")).select("query", "pattern", "path", F.lit(True).alias("exact"))
    left = w.join(whole.select("query", "pattern"), ["query", "pattern"], "left_anti").select("query", "pattern", F.lower("pattern").alias("low"))
    low = f.select("path", F.lower("path").alias("low_path"))
    same = left.withColumn("base", T.basename(F.col("low"))).join(low.withColumn("base", T.basename(F.col("low_path"))), "base").select("query", "pattern", "path", F.lit(True).alias("exact"))
    inside = containing(low, "low_path", left, "low").select("query", "pattern", "path", F.lit(False).alias("exact"))
    return whole.unionByName(same).unionByName(inside).groupBy("query", "pattern", "path").agg(F.bool_or("exact").alias("exact"))


def from_trace(frames: DataFrame, files: DataFrame) -> DataFrame:
    """``frames``: query, file."""
    return signals(match_paths(frames.select("query", F.col("file").alias("pattern")), files), stacktrace_hit=F.lit(True))


def from_diff(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """``diffs``: query, file, status."""
    return signals(diffs.filter("status <> 'deleted'").select("query", F.col("file").alias("path")).join(files.select("path"), "path"), diff_hit=F.lit(True))


def match_symbols(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """``names``: query, name, and perhaps more. query, path, kind, symbol, and what more there is, of symbols that contain
    a name, case aside."""
    n = names.withColumn("needle", F.lower("name")).drop("name").distinct()
    rows = symbols.select("path", "kind", F.col("name").alias("symbol"), F.lower("name").alias("low"))
    return containing(rows, "low", n, "needle").drop("low")


def from_symbols(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    names = tasks.select("query", F.explode("symbols").alias("name"))
    return signals(match_symbols(names, symbols), symbol_match=F.lit(True), exact_symbol=F.lit(True))


def from_keywords(tasks: DataFrame, postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """The best files of each of a task's first keywords; a keyword of several words needs all of them."""
    k = tasks.select("query", F.explode(F.slice("keywords", 1, MOST_KEYWORDS)).alias("keyword"))
    terms = k.select(F.col("keyword").alias("query"), F.explode(F.array_distinct(T.search_tokens(T.sanitize_query(F.col("keyword"))))).alias("term")).distinct()
    best = retrieve.top(retrieve.bm25(postings, lengths, terms, "path", every=True), PER_KEYWORD, "query", "score", "path")
    return signals(best.select(F.col("query").alias("keyword"), "path").join(k, "keyword"), keyword_match=F.lit(True))


def from_hints(tasks: DataFrame, files: DataFrame) -> DataFrame:
    m = match_paths(tasks.select("query", F.explode("files_hint").alias("pattern")), files)
    return signals(m, file_hint_hit=F.lit(True), file_hint_exact=F.col("exact"))


def grouped(words: DataFrame) -> DataFrame:
    """``words``: query, word, ord, form. query, group, form: in order, a word joins the first group that has one of its
    forms and brings its own along, or begins a group; groups are never joined later. A fold over a task's words, in
    the row of the task."""
    forms = words.groupBy("query", "word").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("form")).alias("forms"))
    rows = forms.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "forms"))).alias("words"))

    def step(groups, w):
        def placed(at):  # from 1, 0 for none
            joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.array_union(g, w["forms"])).otherwise(g))
            return F.when(at == 0, F.concat(groups, F.array(w["forms"]))).otherwise(joined)

        return F.get(F.transform(F.array(F.array_position(F.transform(groups, lambda g: F.arrays_overlap(g, w["forms"])), True)), placed), F.lit(0))

    groups = F.aggregate("words", F.array().cast("array<array<string>>"), step)
    return rows.select("query", F.posexplode(groups).alias("group", "forms")).select("query", "group", F.explode("forms").alias("form"))


def from_names(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of a task's words in the path: as typed among its segments, and groups of words with a common
    stem among the segments and their stems, in the path and in the basename."""
    files = staged(files.select("path"), "paths")  # read six times, and perhaps made from contents
    words = tasks.select("query", F.posexplode(F.array_distinct(F.filter(F.transform(F.concat("symbols", "keywords", F.transform("domains", lambda d: d["domain"])), F.lower), lambda w: F.length(w) >= 3))).alias("ord", "word"))
    seg = files.select("path", F.explode(F.array_distinct(T.path_segments(F.col("path")))).alias("term"))
    base = files.select("path", F.explode(F.array_distinct(T.identifier_segments(T.stem_name(F.col("path")), "[-_]"))).alias("term"))
    stems = staged(S.stems(words.select(F.col("word").alias("term")).union(seg.select("term"))), "stems")
    forms = lambda df, c: df.join(stems.select(F.col("term").alias(c), "stem"), c).withColumnRenamed("stem", "form").select(*[x for x in df.columns if x != c], F.col(c), "form").union(df.select(*[x for x in df.columns if x != c], F.col(c), F.col(c))).distinct()
    own = staged(grouped(forms(words, "word")), "groups")
    exact = forms(seg, "term").select("path", "form").distinct().join(own, "form").select("query", "path", "group")
    inside = containing(files.select("path", F.lower("path").alias("low")), "low", own, "form").select("query", "path", "group")
    expanded = exact.union(inside).groupBy("query", "path").agg(F.countDistinct("group").alias("path_matches"))
    in_base = forms(base, "term").select("path", "form").distinct().join(own, "form").groupBy("query", "path").agg(F.countDistinct("group").alias("basename_matches"))
    raw = seg.join(tasks.select("query", F.explode("raw_words").alias("term")), "term").groupBy("query", "path").agg(F.countDistinct("term").alias("raw_path_matches"))
    every = expanded.join(in_base, ["query", "path"], "full").join(raw, ["query", "path"], "full").filter("path_matches > 0 or raw_path_matches > 0")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return signals(every, raw_path_matches=n("raw_path_matches"), path_matches=n("path_matches"), basename_matches=n("basename_matches"), symbol_match=n("path_matches") > 0)


def from_graph(merged: DataFrame, edges: DataFrame, depth: int = 2, most: int = 100) -> DataFrame:
    """Files near the strong candidates in the import graph (near any, where a task has no strong one)."""
    strong = F.col("stacktrace_hit") | F.col("diff_hit") | F.col("symbol_match") | F.col("exact_symbol")
    any_strong = F.max(strong.cast("int")).over(Window.partitionBy("query"))
    seeds = merged.withColumn("any", any_strong).filter((F.col("any") == 0) | strong).select("query", F.col("path").alias("node"))
    seeds = seeds.withColumn("ord", F.row_number().over(Window.partitionBy("query").orderBy("node")))
    found = graph.bfs(seeds, edges, depth, most)
    return signals(found.withColumnRenamed("node", "path"), graph_related=F.lit(True), graph_depth=F.col("depth"))


def from_references(merged: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """What the candidates' contents refer to: classes by file name or definition, methods, paths."""
    refs = extract.references(files.join(merged.select("path").distinct(), "path", "left_semi")).join(merged.select("query", "path"), "path")
    refs = staged(refs.select("query", F.col("kind").alias("of"), F.col("ref").alias("name")).distinct(), "references")  # read four times
    # A name with an ending that has no dot: the ending goes from the file's name, and the names need not be made with each.
    of_class = F.lower(T.extension(F.col("path"))).isin(*CLASS_FILES)
    bases = files.select("path").filter(of_class).select("path", F.regexp_replace(F.lower(T.basename(F.col("path"))), r"\.[^.]+$", "").alias("base"))
    by_name = bases.join(refs.filter("of = 'class'").select("query", F.lower("name").alias("base")).distinct(), "base")
    defined = match_symbols(refs.filter("of in ('class', 'method')"), symbols).filter((F.col("of") == "method") | F.col("kind").isin("class", "interface"))
    paths = match_paths(refs.filter("of = 'path'").select("query", F.col("name").alias("pattern")), files)
    every = by_name.select("query", "path").union(defined.select("query", "path")).union(paths.select("query", "path")).distinct()
    return signals(every, related_file=F.lit(True))


# Folders that hold tests, what marks a test's name before its ending, and the endings it is used with.
TEST_FOLDERS = ("test", "tests", "spec", "specs", "__tests__")
TEST_MARKS = {"Test": ("php", "ts", "js"), "_test": ("go", "py")}


def tested_path(path: Column) -> Column:
    """The path of the file that a test is named after: without the first folder of each kind of tests and the mark."""
    parts, name = F.split(T.dirname(path), "/"), T.basename(path)
    first = lambda p, i: F.array_position(F.transform(parts, F.lower), F.lower(p)) == i + 1
    kept = F.filter(parts, lambda p, i: ~(F.lower(p).isin(*TEST_FOLDERS) & first(p, i)) & (p != "."))
    # A mark is a part of the name by itself, or stands before its last part.
    pieces = F.split(name, r"\.")
    middle = F.filter(pieces, lambda x, i: (i == 0) | (i == F.size(pieces) - 1) | ~x.isin("test", "spec"))
    name = F.array_join(middle, ".")
    for mark, endings in TEST_MARKS.items():
        name = F.when(T.extension(name).isin(*endings), F.regexp_replace(name, rf"{mark}(\.[a-z]+)$", "$1")).otherwise(name)
    return F.array_join(F.concat(kept, F.array(name)), "/")


def from_tests(merged: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tests of candidates, by path and by the symbols that they name."""
    tests = files.filter(F.col("path").rlike(TEST_LIKE)).select("path")
    by_path = tests.select(F.col("path").alias("test"), tested_path(F.col("path")).alias("path")).join(merged.select("query", "path"), "path").select("query", F.col("test").alias("path"))
    mine = merged.select("query", "path").join(symbols.select("path", "name"), "path").select("query", "name").distinct()
    named = symbols.join(tests, "path", "left_semi").select("path", F.regexp_replace(F.regexp_replace("name", "^(.*?)Test", "$1"), "test_", "").alias("name"))
    return signals(by_path.union(named.join(mine, "name").select("query", "path")).distinct(), test_file=F.lit(True))


def from_rules(merged: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    c = merged.select("query", "path").join(files, "path")
    hits = rules.apply(c, files, tasks)
    return signals(hits, related_file=F.col("signal") == "related_file", test_file=F.col("signal") == "test_file", example_usage=F.col("signal") == "example_usage")


def discover(tasks: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, postings: DataFrame, lengths: DataFrame, frames: DataFrame | None = None, diffs: DataFrame | None = None) -> DataFrame:
    """``tasks`` of ``resolve``; ``files``: path, content; ``edges``: src, dst; ``postings``, ``lengths`` of paths and contents. The merged candidates. Steps that
    look at candidates see those of the steps before."""
    parts = [from_symbols(tasks, symbols), from_keywords(tasks, postings, lengths), from_hints(tasks, files), from_names(tasks, files)]
    if frames is not None:
        parts.append(from_trace(frames, files))
    if diffs is not None:
        parts.append(from_diff(diffs, files))
    merged = staged(merge(*parts), "candidates")
    more = lambda m, new: staged(merge(m.drop("graph_decay"), new), "candidates")
    merged = more(merged, from_graph(merged, edges))
    merged = more(merged, from_references(merged, files, symbols))
    merged = more(merged, from_tests(merged, files, symbols))
    merged = more(merged, from_rules(merged, files, tasks))
    return rules.mute_generic_migrations(merged.join(files.select("path"), "path", "left_semi"), tasks)
