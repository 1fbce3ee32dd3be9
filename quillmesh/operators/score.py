"""Signals of candidates, their merge, score, explanation and the quota-bound selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.session import staged

FLAGS = ("stacktrace_hit", "diff_hit", "file_hint_hit", "file_hint_exact", "symbol_match", "exact_symbol", "keyword_match", "graph_related", "test_file", "git_hotspot", "related_file", "example_usage")
COUNTS = ("raw_path_matches", "path_matches", "basename_matches")
# Weights of signals and factors of bonuses.
WEIGHTS = {"stacktrace_hit": 0.30, "diff_hit": 0.22, "symbol_match": 0.20, "keyword_match": 0.08, "test_file": 0.05, "git_hotspot": 0.04, "related_file": 0.12, "example_usage": 0.04}
EXACT_HINT, PARTIAL_HINT, RAW_PATH, GRAPH = 2.0, 0.40, 0.25, 0.05
ENTRY, WEAK_ENTRY, MODEL, SYMBOL, DOMAIN, RAW_BASE, PATH_BASE, PATH_MANY, BASENAME_BASE, MANY_SIGNALS, SAME_DIR, ACTIVE = 1.3, 1.1, 1.2, 1.25, 0.25, 1.4, 1.2, 1.3, 1.5, 1.15, 1.1, 1.1
MAIN_SHARE, TEST_SHARE, CONFIG_SHARE, MAX_FILES = 0.7, 0.2, 0.1, 25
# Kinds of files by path.
TEST = r"(?i:tests?/|specs?/|__tests__/)|\.test\.|\.spec\.|Test\.[a-z]+$|_test\.[a-z]+$"
CONFIG = r"^config/|\.config\.|^\.env|^\..*rc$|package\.json$|composer\.json$|tsconfig\.json$"
ENTRY_POINT = r"(?i:Controller\.[a-z]+$|Handler\.[a-z]+$|Middleware\.[a-z]+$|routes?/|api\.[a-z]+$)|index\.[a-z]+$|main\.[a-z]+$|app\.[a-z]+$"
MODEL_FILE = r"(?i:Models?/|Entities/|Entity/|\.model\.|Model\.[a-z]+$|Entity\.[a-z]+$)"


def signals(rows: DataFrame, **set_: Column) -> DataFrame:
    """``rows``: query, path and what ``set_`` names: all signals, false or null where not set."""
    cols = [set_.get(f, F.lit(False)).alias(f) for f in FLAGS] + [set_.get(c, F.lit(None)).cast("int").alias(c) for c in COUNTS]
    return rows.select("query", "path", *cols, set_.get("graph_depth", F.lit(None)).cast("int").alias("graph_depth"))


def merge(*parts: DataFrame) -> DataFrame:
    """One row per query and path: any of the flags, the most of the counts, the least depth and its decay."""
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("query", "path").agg(*[F.bool_or(f).alias(f) for f in FLAGS], *[F.max(c).alias(c) for c in COUNTS], F.min("graph_depth").alias("graph_depth"))
    return out.withColumn("graph_decay", F.lit(1.0) / F.col("graph_depth"))


def domain_share(path: Column, domains: Column, words: dict[str, list[str]]) -> Column:
    """The share of a task's domain weight whose domains have a word in the path; null without domains."""
    low = F.lower(path)
    hit = lambda d: F.coalesce(*[F.when(d == name, reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in ws])) for name, ws in words.items()], F.lit(False))
    total = F.aggregate(domains, F.lit(0), lambda a, x: a + x["weight"])
    return F.when(total > 0, F.aggregate(domains, F.lit(0), lambda a, x: a + F.when(hit(x["domain"]), x["weight"]).otherwise(0)) / total)


def base_score(share: Column) -> Column:
    """``share`` as of ``domain_share``."""
    s = F.when(F.col("file_hint_exact"), EXACT_HINT).when(F.col("file_hint_hit"), PARTIAL_HINT).otherwise(0.0)
    for name, w in WEIGHTS.items():
        s = s + F.when(F.col(name), w).otherwise(0.0)
    s = s + RAW_PATH * F.least(F.coalesce("raw_path_matches", F.lit(0)), F.lit(3))
    return s + F.when(F.col("graph_related"), GRAPH * F.coalesce(F.greatest(share, F.lit(0.2)), F.lit(1.0)) * F.coalesce("graph_decay", F.lit(1.0))).otherwise(0.0)


def bonus(share: Column, churn: Column, near_hit: Column) -> Column:
    """The product of all bonuses. ``near_hit``: another candidate in the directory is in the trace or diff."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    factor = lambda cond, x: F.when(cond, x).otherwise(F.lit(1.0))
    strong = F.col("file_hint_hit") | F.col("stacktrace_hit") | F.col("diff_hit") | (n("raw_path_matches") >= 1) | F.col("exact_symbol")
    entry = F.col("path").rlike(ENTRY_POINT)
    count = sum((F.col(f).cast("int") for f in FLAGS[1:]), F.col(FLAGS[0]).cast("int"))
    return (F.when(entry & strong, ENTRY).when(entry, WEAK_ENTRY).otherwise(1.0) * factor(F.col("path").rlike(MODEL_FILE), F.lit(MODEL)) * factor(F.col("symbol_match"), F.lit(SYMBOL))
            * (1 + DOMAIN * F.coalesce(share, F.lit(0.0))) * factor(n("raw_path_matches") >= 2, F.pow(F.lit(RAW_BASE), n("raw_path_matches") - 1)) * factor(n("path_matches") >= 2, F.pow(F.lit(PATH_BASE), n("path_matches") - 1))
            * factor(n("path_matches") >= 4, F.lit(PATH_MANY)) * factor((n("basename_matches") >= 2) & (n("raw_path_matches") >= 1), F.pow(F.lit(BASENAME_BASE), n("basename_matches") - 1))
            * factor(count >= 3, F.lit(MANY_SIGNALS)) * factor(near_hit, F.lit(SAME_DIR)) * factor(F.coalesce(churn, F.lit(0.0)) > 0.5, F.lit(ACTIVE)))


def reasons(share: Column, domains: Column) -> Column:
    """Why a candidate is there, in order."""
    say = lambda cond, text: F.when(cond, text)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    names = F.array_join(F.transform(domains, lambda d: d["domain"]), ", ")
    return F.array_compact(F.array(
        F.when(F.col("file_hint_exact"), "named exactly in the task").when(F.col("file_hint_hit"), "named in part in the task"), say(F.col("stacktrace_hit"), F.lit("in the stack trace")), say(F.col("diff_hit"), F.lit("changed in the diff")),
        F.when(F.col("exact_symbol"), "defines a named symbol").when(F.col("symbol_match"), "has a matching symbol"), say(F.col("keyword_match"), F.lit("has matching keywords")),
        say(n("raw_path_matches") >= 1, F.format_string("path has %d words of the task", n("raw_path_matches"))), say(n("path_matches") >= 2, F.format_string("path matches %d keywords", n("path_matches"))),
        say(n("basename_matches") >= 2, F.format_string("file name matches %d keywords", n("basename_matches"))),
        F.when(F.col("graph_related") & (F.coalesce("graph_depth", F.lit(1)) == 1), "imports or imported").when(F.col("graph_related"), F.format_string("related by imports over %d steps", F.coalesce("graph_depth", F.lit(1)))),
        say(F.col("test_file"), F.lit("tests a candidate")), say(F.col("git_hotspot"), F.lit("changes often")), say(F.col("related_file"), F.lit("related by convention or reference")), say(F.col("example_usage"), F.lit("example of use")),
        say(F.col("path").rlike(ENTRY_POINT), F.lit("entry point")), say(F.col("path").rlike(MODEL_FILE), F.lit("model")), say(F.coalesce(share, F.lit(0.0)) > 0, F.concat(F.lit("fits the domains "), names))))


def score(candidates: DataFrame, tasks: DataFrame, git: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """``candidates`` of ``merge``; ``tasks``: query, domains; ``git``: path, churn. Adds score (rounded) and
    reasons. Directories with a hit are an aggregate, joined back: no window holds the candidates."""
    hit = (F.col("stacktrace_hit") | F.col("diff_hit")).cast("int")
    c = candidates.withColumn("dir", T.dirname(F.col("path")))
    dirs = c.filter(hit == 1).groupBy("query", "dir").agg(F.count("*").alias("hits"))
    c = c.join(tasks.select("query", "domains"), "query").join(git.select("path", "churn"), "path", "left").join(dirs, ["query", "dir"], "left")
    c = c.withColumn("near", F.coalesce("hits", F.lit(0)) - hit > 0).drop("dir", "hits")
    c = c.withColumn("share", domain_share(F.col("path"), F.col("domains"), words))
    out = c.withColumn("score", F.round(base_score(F.col("share")) * bonus(F.col("share"), F.col("churn"), F.col("near")), 6)).withColumn("reasons", reasons(F.col("share"), F.col("domains")))
    return out.drop("near", "share", "churn", "domains")


def test_stem(path: Column) -> Column:
    """A test file's basename without what marks it as a test, in lower case."""
    b = T.basename(path)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"\.(test|spec)\.[a-z]+$", ""), r"Test\.[a-z]+$", ""), r"_test\.[a-z]+$", ""))


def select(scored: DataFrame, tasks: DataFrame, most: int = MAX_FILES, tests: bool = True, configs: bool = True) -> DataFrame:
    """The files of a pack: named ones always, then shares of what is left for main files, tests of those
    and configuration of the task's domains. query, path, class, ord, score (1 for the best), reasons. Candidates are
    counted by aggregates, and only the ``most`` best of each class, which each task picks from its own rows first, are
    ranked together."""
    test = F.col("path").rlike(TEST)
    kind = F.when((F.col("file_hint_exact") | F.col("exact_symbol")) & ~test, 0).when(test, 2).when(F.col("path").rlike(CONFIG), 3).otherwise(1)
    c = scored.withColumn("class", kind)
    left = F.greatest(F.lit(most) - F.count_if(F.col("class") == 0), F.lit(0))
    c_left = c.groupBy("query").agg(left.alias("left"))
    # A filter on the rank that the planner knows as a limit of each group, applied before rows are shuffled.
    best_of = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "class").orderBy(F.desc("score"), "path"))).filter(F.col("rank") <= most)
    within = lambda rows, share: best_of(rows).join(c_left, "query").filter((F.col("class") == 0) | (F.col("rank") <= F.floor(F.col("left") * share))).drop("left")
    first = staged(within(c.filter("class < 2"), MAIN_SHARE), "main-files")
    parts = [first]
    if tests:
        stem = F.lower(F.regexp_replace(T.basename(F.col("path")), r"\.[a-z]+$", ""))
        stems = first.groupBy("query").agg(F.collect_set(stem).alias("stems"))  # at most `most` of a query
        own = test_stem(F.col("path"))
        good = c.filter("class = 2").join(stems, "query").filter(F.exists("stems", lambda s: F.contains(own, s) | F.contains(s, own))).drop("stems")
        parts.append(within(good, TEST_SHARE))
    if configs:
        good = c.filter("class = 3").join(tasks.select("query", "domains"), "query").filter(F.exists("domains", lambda d: F.contains(F.lower("path"), d["domain"]))).drop("domains")
        parts.append(within(good, CONFIG_SHARE))
    chosen = reduce(DataFrame.unionByName, parts).withColumn("ord", F.row_number().over(Window.partitionBy("query").orderBy("class", "rank"))).filter(F.col("ord") <= most)
    best = F.max("score").over(Window.partitionBy("query"))
    return chosen.select("query", "path", "class", "ord", F.when(best > 0, F.round(F.col("score") / best, 6)).otherwise(0.0).alias("score"), "reasons", *FLAGS)
