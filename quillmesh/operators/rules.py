"""Discovery by convention: rules that add files related to the candidates.

A rule is a function of the candidates (query, path, content), all files (path, content) and the tasks
(query, domains, keywords, symbols) to found files: query, path, signal. The registry applies those
that fit the tree and leaves out paths that are candidates already. Rules are equi-joins on parts of
paths (basename, directory, stem) or on words, so they hold for large trees; the few `contains` rules
go through ``contain.containing``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.contain import containing

# Role suffixes, and what configuration looks like.
ROLES = ("Controller", "Service", "Repository", "Model", "Handler", "Middleware", "Provider")
CONFIG_LIKE = r"\.config\.|config/|\.env\.example$|tsconfig\.json$|package\.json$|composer\.json$|eslint|prettier"
# Words of migrations that say nothing about what they change.
MIGRATION_WORDS = ("add", "create", "remove", "drop", "update", "delete", "modify", "alter", "change", "make", "set", "rename", "nullable", "default", "index", "foreign", "column", "field", "table", "to", "from", "in", "on", "the", "and")

Rule = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
REGISTRY: dict[str, tuple[str | None, str | None, Rule]] = {}


def rule(name: str, marker: str | None = None, requires: str | None = None):
    """Register a rule; it applies where the tree has the file ``marker`` whose content has ``requires``."""
    def register(f: Rule) -> Rule:
        REGISTRY[name] = (marker, requires, f)
        return f
    return register


def found(df: DataFrame, signal: str) -> DataFrame:
    return df.select("query", "path", F.lit(signal).alias("signal")).distinct()


def words_of(text: Column) -> Column:
    """The distinct words of a text in lower case, identifiers as a whole and in their parts."""
    names = F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.concat(F.array(F.lower(n)), F.transform(F.split(n, f"{T.HUMPS}|_"), F.lower)))))


def task_words(words: Column) -> Column:
    """Words of a task that are looked up: in lower case, three letters or more, each once; phrases in their words."""
    return F.array_distinct(F.filter(F.flatten(F.transform(words, lambda w: F.split(F.lower(w), " "))), lambda w: F.length(w) > 2))


@rule("configs")
def configs(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Configuration in a candidate's directory, the one above, or the root."""
    d = T.dirname(F.col("path"))
    dirs = candidates.select("query", F.explode(F.array(d, T.dirname(d), F.lit("."))).alias("dir")).distinct()
    return found(files.filter(F.col("path").rlike(CONFIG_LIKE)).withColumn("dir", d).join(dirs, "dir"), "related_file")


@rule("roles")
def roles(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Files of the same subject in another role: UserController and UserService."""
    stem = T.stem_name(F.col("path"))
    pattern = f"^(.*)({'|'.join(ROLES)})$"
    parts = lambda df, *c: df.select(*c, stem.alias("stem"), F.regexp_extract(stem, pattern, 1).alias("subject"), F.regexp_extract(stem, pattern, 2).alias("role")).filter("role <> ''")
    mine = parts(candidates, "query").filter("subject <> ''").select("query", "subject", F.col("stem").alias("own"))
    return found(parts(files, "path").join(mine, "subject").filter("stem <> own"), "related_file")


@rule("node-tests", "package.json")
def node_tests(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tests named after a candidate, wherever they are."""
    ext, stem, d = F.regexp_extract("path", r"(\.[^./]+)$", 1), T.stem_name(F.col("path")), T.dirname(F.col("path"))
    # Anywhere: name.test.ext and name.spec.ext, so also in __tests__, tests and test; and a file of the very name beside it in __tests__.
    mine = candidates.select("query", F.explode(F.array(*[F.concat(stem, F.lit(x), ext) for x in (".test", ".spec")])).alias("name"))
    other = files.select("path", T.basename(F.col("path")).alias("name"))
    beside = F.when(d == ".", F.lit("")).otherwise(F.concat(d, F.lit("/")))
    plain = candidates.select("query", F.concat(beside, F.lit("__tests__/"), stem, ext).alias("path"))
    return found(other.join(mine, "name").select("query", "path").union(plain.join(files.select("path"), "path").select("query", "path")), "test_file")


@rule("node-index", "package.json")
def node_index(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """The index file of a candidate's directory."""
    d = T.dirname(F.col("path")).alias("dir")
    return found(files.filter(T.basename(F.col("path")).rlike(r"^index\.[jt]sx?$")).select("path", d).join(candidates.select("query", d).distinct(), "dir"), "related_file")


def _controllers(candidates: DataFrame) -> DataFrame:
    return candidates.select("query", F.regexp_extract("path", r"([A-Z][a-zA-Z]*)Controller\.php$", 1).alias("subject")).filter("subject <> ''").distinct()


@rule("laravel-views", "composer.json", "laravel/framework")
def laravel_views(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Views whose path has a controller's subject."""
    views = files.filter(F.col("path").rlike(r"^resources/views/.*\.blade\.php$")).select("path", F.lower("path").alias("low"))
    return found(containing(views, "low", _controllers(candidates).select("query", F.lower("subject").alias("subject")), "subject"), "related_file")


@rule("laravel-requests", "composer.json", "laravel/framework")
def laravel_requests(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Form requests named after a controller's subject."""
    requests = files.filter(F.contains("path", F.lit("app/Http/Requests/"))).select("path", T.stem_name(F.col("path")).alias("name"))
    return found(containing(requests, "name", _controllers(candidates), "subject"), "related_file")


@rule("laravel-routes", "composer.json", "laravel/framework")
def laravel_routes(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Controllers that a candidate route file names."""
    routes = candidates.filter(F.col("path").rlike(r"routes/(web|api|console)\.php$"))
    names = routes.select("query", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Z][a-zA-Z]+Controller)(?:::class|@)"), F.lit(1)))).alias("name"))
    return found(files.select("path", T.stem_name(F.col("path")).alias("name")).filter(F.col("path").endswith(".php")).join(names, "name"), "related_file")


@rule("laravel-routes-by-word", "composer.json", "laravel/framework")
def laravel_routes_by_word(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Route files with a word of the task, and the controllers of the routes with one."""
    words = tasks.select("query", F.explode(task_words(F.concat("keywords", F.transform("domains", lambda d: d["domain"]), "symbols"))).alias("word"))
    routes = files.filter(F.col("path").isin("routes/web.php", "routes/api.php"))
    whole = routes.select("path", F.explode(words_of(F.col("content"))).alias("word")).join(words, "word").select("query", "path")
    each = routes.select(F.explode(F.split("content", ";")).alias("statement")).filter(F.contains("statement", F.lit("Route::")))
    told = F.regexp_replace("statement", r"(?s)^.*?Route::\w+", "")  # without the verb
    each = each.select(F.regexp_extract("statement", r"([A-Z]\w*Controller)\b", 1).alias("name"), F.explode(words_of(told)).alias("word")).filter("name <> ''")
    names = each.join(words, "word").select("query", "name").distinct()
    named = files.select("path", T.stem_name(F.col("path")).alias("name")).join(names, "name")
    return found(whole.union(named.select("query", "path")), "related_file")


def _models(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("path").rlike(r"app/Models/[A-Z][a-zA-Z]+\.php$"))


@rule("laravel-migrations", "composer.json", "laravel/framework")
def laravel_migrations(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Migrations of a model's table."""
    table = T.snake_plural(T.stem_name(F.col("path")))
    mine = _models(candidates).select("query", F.explode(F.array(F.concat(F.lit("_"), table, F.lit("_table")), F.concat(F.lit("_create_"), table))).alias("named"))
    return found(containing(files.filter(F.contains("path", F.lit("database/migrations/"))).select("path"), "path", mine, "named"), "related_file")


# Methods that declare a relation of models.
RELATION_METHODS = ("hasOne", "hasMany", "belongsTo", "belongsToMany", "morphOne", "morphMany", "morphTo", "morphToMany", "morphedByMany")


@rule("laravel-relations", "composer.json", "laravel/framework")
def laravel_relations(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Models that a model is related to."""
    names = _models(candidates).select("query", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(rf"->\s*(?:{'|'.join(RELATION_METHODS)})\(\s*\\?(?:\w+\\)*(\w+)::class"), F.lit(1)))).alias("name"))
    return found(files.filter(F.contains("path", F.lit("app/Models/"))).select("path", T.stem_name(F.col("path")).alias("name")).join(names, "name"), "related_file")


def mute_generic_migrations(merged: DataFrame, tasks: DataFrame) -> DataFrame:
    """``merged`` candidates, where migrations that only match words such as `create` lose their path counts."""
    c = merged.join(tasks.select("query", "keywords"), "query")
    special = F.exists("keywords", lambda w: (F.length(w) >= 3) & F.contains(F.lower("path"), F.lower(w)) & ~F.lower(w).isin(*MIGRATION_WORDS))
    mute = F.contains("path", F.lit("database/migrations/")) & (F.coalesce("raw_path_matches", F.lit(0)) == 0) & (F.coalesce("path_matches", F.lit(0)) > 0) & ~special
    return c.withColumns({n: F.when(mute, 0).otherwise(F.col(n)) for n in ("path_matches", "basename_matches")}).drop("keywords")


COLLECTION = r"content/collections/([^/]+)/"
BLUEPRINT = r"resources/blueprints/collections/([^/.]+)"
TEMPLATE = r"\.(antlers\.html|blade\.php)$"


@rule("statamic-blueprints", "composer.json", "statamic/cms")
def statamic_blueprints(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Blueprints of a candidate's collection."""
    mine = candidates.select("query", F.regexp_extract("path", COLLECTION, 1).alias("name")).filter("name <> ''").distinct()
    return found(files.select("path", F.regexp_extract("path", BLUEPRINT, 1).alias("name")).filter("name <> ''").join(mine, "name"), "related_file")


@rule("statamic-templates", "composer.json", "statamic/cms")
def statamic_templates(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Templates of a candidate's collection."""
    mine = candidates.select("query", F.explode(F.array(F.regexp_extract("path", COLLECTION, 1), F.regexp_extract("path", BLUEPRINT, 1))).alias("name")).filter("name <> ''").distinct()
    own = F.regexp_extract("path", r"^resources/views/(?:collections/)?([^/.]+)", 1)
    return found(files.select("path", own.alias("name")).filter("name <> ''").join(mine, "name"), "related_file")


@rule("statamic-taxonomies", "composer.json", "statamic/cms")
def statamic_taxonomies(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Templates that use a candidate's taxonomy."""
    mine = candidates.select("query", F.regexp_extract("path", r"content/taxonomies/([^/]+)/", 1).alias("name")).filter("name <> ''").distinct()
    used = F.regexp_extract_all("content", F.lit(r"""(?:\b(?:from|taxonomy)=['"]|:)([\w-]+)"""), F.lit(1))
    return found(files.filter(F.col("path").rlike(TEMPLATE)).select("path", F.explode(F.array_distinct(used)).alias("name")).join(mine, "name"), "example_usage")


@rule("statamic-fieldsets", "composer.json", "statamic/cms")
def statamic_fieldsets(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Fieldsets that a candidate blueprint imports."""
    names = candidates.filter(F.contains("path", F.lit("resources/blueprints/"))).select("query", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^[\s-]*(?:fieldset|import):\s*['\"]?(\w+)"), F.lit(1)))).alias("name"))
    return found(files.select("path", F.regexp_extract("path", r"^resources/fieldsets/([a-zA-Z_]+)", 1).alias("name")).filter("name <> ''").join(names, "name"), "related_file")


@rule("statamic-partials", "composer.json", "statamic/cms")
def statamic_partials(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Partials that a candidate template includes."""
    names = candidates.filter(F.col("path").endswith(".antlers.html")).select("query", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"""\{\{[%\s]*partial(?:\s+src=|:)["']?([\w./-]+)"""), F.lit(1)))).alias("name"))
    own = F.regexp_replace(F.regexp_extract("path", r"^resources/views/(?:partials/|components/)?(.+?)(?:\.antlers\.html|\.blade\.php)$", 1), "/_", "/")
    return found(files.select("path", own.alias("name")).filter("name <> ''").join(names, "name"), "related_file")


@rule("statamic-examples", "composer.json", "statamic/cms")
def statamic_examples(candidates: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Templates with two or more of the task's domains and first five keywords."""
    words = tasks.select("query", F.explode(task_words(F.concat(F.transform("domains", lambda d: d["domain"]), F.slice("keywords", 1, 5)))).alias("word"))
    used = files.filter(F.col("path").rlike(TEMPLATE)).select("path", F.explode(words_of(F.col("content"))).alias("word"))
    return found(used.join(words, "word").groupBy("query", "path").agg(F.count("*").alias("n")).filter("n >= 2"), "example_usage")


def needs(package: str) -> Column:
    """Whether a manifest's JSON requires a package, for use or for development."""
    parts = F.from_json("content", "require map<string,string>, `require-dev` map<string,string>")
    has = lambda c: F.coalesce(F.map_contains_key(c, package), F.lit(False))
    return has(parts["require"]) | has(parts["require-dev"])


def apply(candidates: DataFrame, files: DataFrame, tasks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """query, path, signal of all rules that apply to the tree (or of those named), without candidates."""
    if names is None:
        from quillmesh.operators import projects

        names = [r.name for r in projects.detect(files).collect()]  # at most the registry
    parts = [f(candidates, files, tasks) for name, (_, _, f) in REGISTRY.items() if name in names]
    if not parts:
        return candidates.select("query", "path", F.lit("").alias("signal")).limit(0)
    every = reduce(DataFrame.unionByName, parts).distinct()
    return every.join(candidates.select("query", "path"), ["query", "path"], "left_anti")
