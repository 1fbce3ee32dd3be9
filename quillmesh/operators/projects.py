"""Projects: which rules apply to a source tree, what was cached of that, and the domains in force in it.

All functions take many trees at once: ``keys`` are the columns that tell them apart (none for a single
tree). Rules apply by marker files; a cache is a JSON document for each tree, and a tree whose document is
missing or broken is looked at again. Domains come from the core, from the frameworks of the tree and from its
own configuration; a later source replaces a domain of the same name, and disabled ones are left out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import domains, rules

#: Frameworks: the marker file, the package that it requires, and the domains that the framework's rules bring.
FRAMEWORKS: dict[str, tuple[str, str | None, dict[str, list[str]]]] = {
    "nodejs": ("package.json", None, domains.NODE),
    "laravel": ("composer.json", "laravel/framework", domains.LARAVEL),
    "statamic": ("composer.json", "statamic/cms", {}),
}
CACHE = "rules array<string>, detectedAt string"
CONFIG = "customDomains array<struct<name: string, keywords: array<string>>>, disabledDomains array<string>"


def _marked(files: DataFrame, wanted: dict[str, tuple[str | None, str | None]], keys: tuple[str, ...]) -> DataFrame:
    """keys, name: one pass over the marker files of all trees."""
    markers = sorted({m for m, _ in wanted.values() if m})
    hits = [F.when((F.col("path") == m) & (rules.needs(p) if p else F.lit(True)), F.lit(n)) for n, (m, p) in wanted.items() if m]
    found = files.filter(F.col("path").isin(*markers)).select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("name")).distinct()
    always = [n for n, (m, _) in wanted.items() if m is None]
    if not always:
        return found
    trees = files.select(*keys).distinct() if keys else files.sparkSession.range(1).select()
    return found.unionByName(trees.select(*keys, F.explode(F.array(*map(F.lit, always))).alias("name")))


def detect(files: DataFrame, *keys: str) -> DataFrame:
    """``files``: keys, path, content. keys, name of the rules that apply."""
    return _marked(files, {n: (m, p) for n, (m, p, _) in rules.REGISTRY.items()}, keys)


def frameworks(files: DataFrame, *keys: str) -> DataFrame:
    """keys, name of the frameworks that a tree uses."""
    return _marked(files, {n: (m, p) for n, (m, p, _) in FRAMEWORKS.items()}, keys)


def cache(detected: DataFrame, at: Column, *keys: str) -> DataFrame:
    """keys, body: the document to keep for each tree."""
    body = F.to_json(F.struct(F.array_sort(F.collect_set("name")).alias("rules"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("detectedAt")))
    return detected.groupBy(*keys).agg(body.alias("body"))


def applied(files: DataFrame, cached: DataFrame, *keys: str) -> DataFrame:
    """``detect`` for trees without a readable document in ``cached`` (keys, body); for the others the rules in it
    that there still are. Of several documents of a tree the latest counts."""
    doc = cached.select(*keys, F.from_json("body", CACHE).alias("doc")).filter("doc.rules is not null")
    latest = doc.groupBy(*keys).agg(F.max_by("doc", F.struct(F.coalesce("doc.detectedAt", F.lit("")), F.to_json("doc"))).alias("doc"))
    kept = latest.select(*keys, F.explode(F.array_distinct("doc.rules")).alias("name")).filter(F.col("name").isin(*rules.REGISTRY))
    return kept.unionByName(detect(files.join(latest.select(*keys), list(keys), "left_anti"), *keys))


def dropped(cached: DataFrame, trees: DataFrame, *keys: str) -> DataFrame:
    """``cached`` without the documents of ``trees``, which are looked at again."""
    return cached.join(trees.select(*keys).distinct(), list(keys), "left_anti")


def _fixed(names: tuple[str, ...], core: dict[str, list[str]]) -> list[tuple[str, list[str], str]]:
    """domain, words, source of a tree with the frameworks ``names``: theirs replace the core's, of two frameworks the one
    that has the domain further up."""
    every = {d: (ws, "core", -1) for d, ws in core.items()}
    for name in names:
        for i, (d, ws) in enumerate(FRAMEWORKS[name][2].items()):
            if d not in every or every[d][1] == "core" or i < every[d][2]:
                every[d] = (ws, name, i)
    return [(d, ws, source) for d, (ws, source, _) in every.items()]


def in_force(files: DataFrame, core: dict[str, list[str]], configs: DataFrame, *keys: str) -> DataFrame:
    """``configs``: keys, body (a JSON configuration). keys, domain, words, source: the domains of each tree. A
    configuration that cannot be read is none; of a name that it defines twice the last counts. A tree is one narrow row up
    to the end: the fixed domains are the same for all trees of the same frameworks, and only names are told apart."""
    spark = files.sparkSession
    doc = configs.select(*keys, F.from_json("body", CONFIG).alias("doc"))
    custom = doc.select(*keys, F.posexplode("doc.customDomains").alias("ord", "d")).filter("d.name is not null")
    custom = custom.select(*keys, F.col("d.name").alias("domain"), F.coalesce("d.keywords", F.array().cast("array<string>")).alias("words"), F.lit("custom").alias("source"), "ord")
    latest = F.row_number().over(Window.partitionBy(*keys, "domain").orderBy(F.desc("ord")))
    off = doc.select(*keys, F.explode("doc.disabledDomains").alias("domain")).distinct()
    custom = custom.withColumn("__n", latest).filter("__n = 1").join(off, [*keys, "domain"], "left_anti")
    # A tree's frameworks, and the fixed domains that its configuration replaces or disables.
    names = F.array_compact(F.concat(F.coalesce(F.transform("doc.customDomains", lambda d: d["name"]), F.array().cast("array<string>")), F.coalesce("doc.disabledDomains", F.array().cast("array<string>"))))
    none, text = F.lit(None).cast("array<string>").alias("__hidden"), F.lit(None).cast("string").alias("__name")
    about = files.select(*keys, F.lit(True).alias("__tree"), text, none).unionByName(frameworks(files, *keys).select(*keys, F.lit(True).alias("__tree"), F.col("name").alias("__name"), none))
    about = about.unionByName(doc.select(*keys, F.lit(None).cast("boolean").alias("__tree"), text, names.alias("__hidden")))
    used = F.concat_ws(",", *[F.max(F.when(F.col("__name") == n, n)) for n in FRAMEWORKS])
    trees = about.groupBy(*keys).agg(F.max("__tree").alias("__tree"), used.alias("__used"), F.flatten(F.collect_list("__hidden")).alias("__hidden")).filter("__tree")
    sets = [c for n in range(len(FRAMEWORKS) + 1) for c in combinations(FRAMEWORKS, n)]
    fixed = spark.createDataFrame([(",".join(c), _fixed(c, core)) for c in sets], "__used string, __fixed array<struct<domain: string, words: array<string>, source: string>>")
    rows = trees.join(F.broadcast(fixed), "__used").select(*keys, "__hidden", F.inline("__fixed")).filter(~F.array_contains("__hidden", F.col("domain")))
    return rows.select(*keys, "domain", "words", "source").unionByName(custom.select(*keys, "domain", "words", "source"))


def words_of(names: list[str], core: dict[str, list[str]], config: domains.Config) -> dict[str, list[str]]:
    """The domains in force in one tree with the frameworks ``names``, for expressions over tasks."""
    every = dict(core)
    for name in FRAMEWORKS:
        every |= FRAMEWORKS[name][2] if name in names else {}
    return {d: ws for d, ws in (every | config.custom).items() if d not in config.disabled}
