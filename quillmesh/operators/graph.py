"""Dependency graph: from specifiers to files, and bounded search from seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.session import staged

# What may follow a specifier's path, in this order.
PROBES = {
    "typescript": ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"], "javascript": ["", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", "/index.js", "/index.jsx"],
    "php": ["", ".php"], "python": ["", ".py", "/__init__.py"], "go": ["", ".go"], "rust": ["", ".rs", "/mod.rs"], "ruby": ["", ".rb"], "java": ["", ".java"],
}


def joined(base: Column, rel: Column) -> Column:
    """A relative path from a directory, with `.` and `..` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", base, rel), "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, none, lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/")


def base_path(source: Column, spec: Column, lang: Column) -> Column:
    """Where a specifier points, before extensions are tried."""
    python = lang == "python"
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    up = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/")))
    rust = F.replace(F.regexp_replace(spec, r"^(crate|self)::", ""), F.lit("::"), F.lit("/"))
    return (F.when(python & (dots > 0), joined(T.dirname(source), up)).when(spec.startswith("."), joined(T.dirname(source), spec)).when(spec.rlike("^[@~]/"), spec.substr(F.lit(3), F.length(spec)))
            .when(spec.startswith("/"), spec.substr(F.lit(2), F.length(spec))).when(lang == "rust", F.when(spec.startswith("crate"), F.concat(F.lit("src/"), rust)).otherwise(joined(T.dirname(source), rust)))
            .otherwise(T.namespace_path(spec, lang)))


#: Where the probes of compiled extensions and of similar paths come in the order of preference.
COMPILED, SIMILAR = 100, 1000


def specifiers(edges: DataFrame) -> DataFrame:
    """``edges``: path, language, specifier, and perhaps doc. Each once, with its base path."""
    return edges.select(*edges.columns, base_path(F.col("path"), F.col("specifier"), F.col("language")).alias("base")).distinct()


def probes(specs: DataFrame) -> DataFrame:
    """``specs`` of ``specifiers``. A row for each thing that could be what a specifier means: ord, its place in the
    order of preference, and key: a path, or `~` and a stem for files of a similar path."""
    base = F.col("base")
    suffixes = F.coalesce(*[F.when(F.col("language") == lang, F.array(*[F.lit(x) for x in xs])) for lang, xs in PROBES.items()], F.array(F.lit("")))
    own = F.transform(suffixes, lambda x, i: F.struct(i.alias("ord"), F.concat(base, x).alias("key")))
    source = F.regexp_replace(base, r"\.m?jsx?$", "")
    compiled = F.when(F.col("language").isin("typescript", "javascript") & base.rlike(r"\.m?jsx?$"),
                      F.transform(F.array(F.lit(".ts"), F.lit(".tsx")), lambda x, i: F.struct((i + COMPILED).alias("ord"), F.concat(source, x).alias("key"))))
    stem = T.stem_name(F.concat(F.lit("x/"), base))
    similar = F.when(stem != "", F.array(F.struct(F.lit(SIMILAR).alias("ord"), F.concat(F.lit("~"), stem).alias("key"))))
    none = F.array().cast("array<struct<ord: int, key: string>>")
    every = F.concat(own, F.coalesce(compiled, none), F.coalesce(similar, none))
    return specs.select("*", F.explode(every).alias("p")).select(*specs.columns, "p.ord", "p.key")


def keys_of(files: DataFrame) -> DataFrame:
    """``files``: path. key, target: what a file can be probed by."""
    return files.select(F.explode(F.array(F.col("path"), F.concat(F.lit("~"), T.stem_name(F.col("path"))))).alias("key"), F.col("path").alias("target"))


def choose(probed: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``probed`` of ``probes``, ``keys`` of ``keys_of``. ``by``, dst, how (exact, probe, similar) of the specifiers that
    mean a file: the first in the order of preference, of similar paths the shortest. One join, one aggregate."""
    hits = probed.join(keys, "key")
    near = F.col("ord") >= SIMILAR
    hits = hits.filter(~near | (T.similar_path(F.col("target"), F.col("specifier")) & (F.col("target") != F.col("path"))))
    best = hits.groupBy(*by).agg(F.min(F.struct("ord", F.when(near, F.length("target")).otherwise(0).alias("n"), "target")).alias("b"))
    return best.select(*by, F.col("b.target").alias("dst"), F.when(F.col("b.ord") == 0, "exact").when(F.col("b.ord") < SIMILAR, "probe").otherwise("similar").alias("how"))


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``edges``: path, language, specifier; ``files``: path. src, dst, how (exact, probe, similar): each
    specifier's file. Paths are probed in order of preference; a compiled extension finds its source; what is left
    goes by basename, to a file whose path is similar."""
    found = choose(probes(specifiers(edges)), keys_of(files), ["path", "specifier"])
    return found.groupBy(F.col("path").alias("src"), "dst").agg(F.min("how").alias("how"))


def bfs(seeds: DataFrame, edges: DataFrame, depth: int = 2, most: int = 100) -> DataFrame:
    """``seeds``: query, node, ord; ``edges``: src, dst, followed both ways. query, node, depth, decay of the
    nodes found beyond the seeds. Nodes are expanded in queue order while fewer than ``most`` have been
    visited: node i of a level if seeds and first discoveries before it are below that. Queries that have
    reached the bound are not joined to edges at all. Each level is two joins and one window per query over
    what it reached; it is written, so later ones read and do not recompute it."""
    both = staged(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "both-ways")
    visited = level = staged(seeds.select("query", "node", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("depth")), "level")
    for d in range(1, depth + 1):
        counts = visited.groupBy("query").agg(F.count("*").alias("before")).filter(F.col("before") < most)
        out = level.join(counts.select("query"), "query", "left_semi").join(both, F.col("node") == F.col("src")).select("query", F.col("ord").alias("by"), F.col("dst").alias("node"))
        fresh = staged(out.join(visited.select("query", "node"), ["query", "node"], "left_anti").groupBy("query", "node").agg(F.min("by").alias("by")), "fresh")
        found_by = fresh.groupBy("query", "by").agg(F.count("*").alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        open_ = found_by.withColumn("earlier", earlier).join(counts, "query").filter(F.col("before") + F.col("earlier") < most).select("query", "by")
        order = F.row_number().over(Window.partitionBy("query").orderBy("by", "node")).cast("long")
        level = staged(fresh.join(open_, ["query", "by"]).select("query", "node", order.alias("ord"), F.lit(d).alias("depth")), "level", spent=[fresh])
        visited = visited.unionByName(level)
    return visited.filter("depth > 0").select("query", "node", "depth", F.try_divide(F.lit(1.0), F.col("depth")).alias("decay"))
