"""Queries on source text, tasks, graphs and selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import activity, discover, domains, excerpts, extract, graph, ignore, projects, resolve, rules, score
from quillmesh.plans import project
from quillmesh.plans.retrieval import quoted
from quillmesh.plans.values import Grown, Values
from quillmesh.plans.words import CHANGE_TYPES, DOMAINS, STOPWORDS
from quillmesh.session import staged, table
from quillmesh.sources import packs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern without look-arounds, for texts of ASCII words."""
    return pattern.replace(T.START, r"\b").replace(T.END, r"\b").replace("(?!http)", "")


EXT_SQL = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
LANG_SQL = "CASE " + " ".join(f"WHEN {EXT_SQL} = '{e}' THEN '{x}'" for e, x in T.LANGUAGES.items()) + " ELSE 'unknown' END"
FILES_SQL = f"files AS (SELECT path, content, {LANG_SQL} AS language FROM {project.FILES.sql()})"
LINES_SQL = "ls AS (SELECT path, language, unnest(string_split_regex(content, '\\r?\\n')) AS body, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1)::INT AS line FROM files)"


def files(spark, sf):
    f = project.FILES.frame(spark, sf)
    return f.select("path", "content", T.language(F.col("path")).alias("language"))


SYMBOLS_SQL = f"""s AS (SELECT path, name, kind, line AS start_line, trim(body, chr(9) || chr(32) || chr(13)) AS signature FROM {project.SYMBOLS.sql()} JOIN ls USING (path, line)),
n AS (SELECT path, line, length(regexp_replace(body, '[^{{(]', '', 'g')) AS up, length(regexp_replace(body, '[^)}}]', '', 'g')) AS down FROM ls),
r AS (SELECT s.path, s.start_line, n.line, sum(up - down) OVER w AS bal, sum(up) OVER w AS opened FROM s JOIN n ON n.path = s.path AND n.line BETWEEN s.start_line AND s.start_line + 501 WINDOW w AS (PARTITION BY s.path, s.start_line ORDER BY n.line)),
e AS (SELECT path, start_line, coalesce(min(CASE WHEN opened > 0 AND bal = 0 THEN line END), max(line)) AS end_line FROM r GROUP BY ALL)"""


@query(f"WITH {FILES_SQL}, {LINES_SQL}, {SYMBOLS_SQL} SELECT s.path, s.name, s.kind, s.start_line::INT AS start_line, e.end_line::INT AS end_line, s.signature FROM s JOIN e USING (path, start_line)")
def symbols(spark, sf):
    return extract.symbols(files(spark, sf)).select("path", "name", "kind", "start_line", "end_line", "signature")


@query(f"WITH {FILES_SQL}, {LINES_SQL}, {SYMBOLS_SQL} SELECT path, kind, string_agg(name, ', ' ORDER BY start_line) AS names FROM s GROUP BY ALL")
def symbols_by_kind(spark, sf):
    s = extract.symbols(files(spark, sf))
    return s.groupBy("path", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ", ").alias("names"))


@query(f"WITH {FILES_SQL}, {LINES_SQL}, {SYMBOLS_SQL} SELECT name, path, row_number() OVER (ORDER BY name, path)::INT AS rank FROM (SELECT DISTINCT name, path FROM s WHERE kind IN ('class', 'function', 'method', 'trait', 'interface')) QUALIFY rank <= 5000")
def symbol_catalog(spark, sf):
    s = extract.symbols(files(spark, sf)).filter(F.col("kind").isin("class", "function", "method", "trait", "interface")).select("name", "path").distinct().orderBy("name", "path").limit(5000)
    return s.withColumn("rank", F.row_number().over(Window.orderBy("name", "path")))


IMPORTS_SQL = f"im AS (SELECT * FROM {project.IMPORTS.sql()})"


@query(f"WITH {FILES_SQL}, {IMPORTS_SQL} SELECT path, gr AS language, spec AS specifier FROM im")
def import_specifiers(spark, sf):
    return extract.imports(files(spark, sf))


_PROBES = " UNION ALL ".join(f"SELECT '{lang}' AS gr, {i} AS ord, '{s}' AS suffix" for lang, ss in graph.PROBES.items() for i, s in enumerate(ss))
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"


def _clean(x: str) -> str:
    """A joined path without `.` and up to three `..`."""
    x = f"regexp_replace('/' || ({x}) || '/', '/(\\./)+', '/', 'g')"
    for _ in range(3):
        x = f"regexp_replace({x}, '/[^/.][^/]*/\\.\\./', '/')"
    return f"trim({x}, '/')"


_PARTS = "list_filter(string_split_regex(lower({}), '[/.\\\\:]'), lambda w: length(w) > 2)"
EDGES_SQL = f"""b AS (SELECT path, gr, spec, CASE WHEN gr = 'python' AND starts_with(spec, '.') THEN {_clean(_DIR + " || '/' || replace(ltrim(spec, '.'), '.', '/')")} WHEN starts_with(spec, '.') THEN {_clean(_DIR + " || '/' || spec")}
  WHEN regexp_matches(spec, '^[@~]/') THEN spec[3:] WHEN starts_with(spec, '/') THEN spec[2:] WHEN gr = 'php' THEN regexp_replace(replace(spec, '\\', '/'), '^App/', 'app/') WHEN gr IN ('python', 'java') THEN replace(spec, '.', '/') ELSE spec END AS base FROM im),
pr AS ({_PROBES}), tr AS (SELECT b.*, pr.ord, base || suffix AS target FROM b JOIN pr USING (gr)
  UNION ALL SELECT b.*, 100 + o, regexp_replace(base, '\\.m?jsx?$', '') || x FROM b, (VALUES (0, '.ts'), (1, '.tsx')) v(o, x) WHERE gr IN ('typescript', 'javascript') AND regexp_matches(base, '\\.m?jsx?$')),
hit AS (SELECT tr.path, spec, target, tr.ord FROM tr JOIN files f ON f.path = target QUALIFY row_number() OVER (PARTITION BY tr.path, spec ORDER BY tr.ord) = 1),
st AS (SELECT path AS target, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') AS stem FROM files),
near AS (SELECT b.path, b.spec, st.target FROM b JOIN st ON st.stem = regexp_replace(regexp_extract('x/' || base, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1')
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.path = b.path AND hit.spec = b.spec) AND st.target <> b.path AND stem <> ''
  AND 2 * len(list_filter({_PARTS.format('b.spec')}, lambda w: len(list_filter(list_filter(string_split(lower(st.target), '/'), lambda p: length(p) > 2), lambda p: contains(p, w) OR contains(w, regexp_replace(p, '\\.[^.]+$', '')))) > 0)) >= len({_PARTS.format('b.spec')})
  QUALIFY row_number() OVER (PARTITION BY b.path, b.spec ORDER BY length(target), target) = 1),
ed AS (SELECT src, dst, min(how) AS how FROM (SELECT path AS src, target AS dst, CASE WHEN ord = 0 THEN 'exact' ELSE 'probe' END AS how FROM hit UNION ALL SELECT path, target, 'similar' FROM near) GROUP BY ALL)"""


@query(f"WITH {FILES_SQL}, {IMPORTS_SQL}, {EDGES_SQL} SELECT src, dst, how FROM ed")
def resolve_edges(spark, sf):
    f = files(spark, sf)
    return graph.resolve(extract.imports(f), f)


HREF = """href="([^"]+)\""""


@query("SELECT page_id, href, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY ALL")
def edge_extract(spark, sf):
    e = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    return e.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT href, count(DISTINCT page_id)::BIGINT AS importers FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY href")
def importers(spark, sf):
    return edge_extract(spark, sf).groupBy("href").agg(F.count("*").alias("importers"))


_B2 = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), b2 AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), sd AS (SELECT s_suppkey AS query, 's' || s_suppkey AS node FROM supplier)"


@query(f"""WITH {_B2}, d1 AS (SELECT query, dst AS node, row_number() OVER (PARTITION BY query ORDER BY dst) AS ord FROM sd JOIN b2 ON src = node),
n1 AS (SELECT query, 1 + count(*) AS before FROM d1 GROUP BY query), open_ AS (SELECT query FROM n1 WHERE before < 100),
o2 AS (SELECT d1.query, dst AS node, min(d1.ord) AS via FROM d1 JOIN open_ USING (query) JOIN b2 ON src = node WHERE NOT EXISTS (SELECT 1 FROM d1 x WHERE x.query = d1.query AND x.node = dst) AND dst <> 's' || d1.query GROUP BY d1.query, dst),
c2 AS (SELECT query, via, coalesce(sum(count(*)) OVER (PARTITION BY query ORDER BY via ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM o2 GROUP BY query, via),
d2 AS (SELECT o2.query, o2.node FROM o2 JOIN c2 USING (query, via) JOIN n1 USING (query) WHERE before + earlier < 100)
SELECT query, node, 1 AS depth, 1.0::DOUBLE AS decay FROM d1 UNION ALL SELECT query, node, 2, 0.5::DOUBLE FROM d2""")
def bfs_depth2_decay(spark, sf):
    """Bounded search from each supplier, a task of its own, over the whole supplier-part graph."""
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query"), F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(1).alias("ord"))
    return graph.bfs(s, e)


@query(f"SELECT * FROM {project.MESSAGES.sql()}")
def error_messages(spark, sf):
    return extract.error_messages(project.LOGS.frame(spark, sf))


@query(f"SELECT * FROM {project.FRAMES.sql()}")
def frames(spark, sf):
    return extract.frames(project.LOGS.frame(spark, sf))


_AT = "try_cast(nullif(regexp_extract(body, '(\\d{4}-\\d{2}-\\d{2})[T\\s](\\d{2}:\\d{2}:\\d{2})', 1) || ' ' || regexp_extract(body, '(\\d{4}-\\d{2}-\\d{2})[T\\s](\\d{2}:\\d{2}:\\d{2})', 2), ' ') AS TIMESTAMP)"


@query(f"""WITH t0 AS (SELECT *, {_AT} AS t FROM {project.TIMED.sql()}), w AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY id ORDER BY line) AS last FROM t0)
SELECT 'run' AS mode, id, line, body FROM w WHERE last IS NULL OR last >= TIMESTAMP '2024-01-11 12:00:00' UNION ALL SELECT 'line', id, line, body FROM t0 WHERE t IS NULL OR t >= TIMESTAMP '2024-01-11 12:00:00'""")
def since_filter(spark, sf):
    """Both meanings: untimed lines share the last line's fate, or stay."""
    t, cut = project.TIMED.frame(spark, sf), F.lit("2024-01-11 12:00:00").cast("timestamp")
    both = extract.since(t, cut).select(F.lit("run").alias("mode"), "id", "line", "body")
    return both.unionByName(extract.since(t, cut, keep_untimed=True).select(F.lit("line").alias("mode"), "id", "line", "body"))


_DIFF_SQL = f"""s AS (SELECT id, string_split(unnest(string_split(content, chr(10))), chr(9)) AS p FROM {project.STATUSES.sql()}), n AS (SELECT id, string_split(unnest(string_split(content, chr(10))), chr(9)) AS p FROM {project.NUMSTATS.sql()}),
d AS (SELECT s.id, s.p[-1] AS file, CASE s.p[1][1] WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS status, coalesce(try_cast(n.p[1] AS BIGINT), 0) AS additions, coalesce(try_cast(n.p[2] AS BIGINT), 0) AS deletions
  FROM s LEFT JOIN n ON n.id = s.id AND len(n.p) >= 3 AND n.p[-1] = s.p[-1] WHERE len(s.p) >= 2)"""


@query(f"WITH {_DIFF_SQL} SELECT id, file, status, additions, deletions FROM d")
def diff_entries(spark, sf):
    return extract.diff_entries(project.STATUSES.frame(spark, sf), project.NUMSTATS.frame(spark, sf))


@query(f"WITH {_DIFF_SQL} SELECT id AS query, count(*)::BIGINT AS n, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM d GROUP BY id")
def diff_totals(spark, sf):
    return packs.diff_report(diff_entries(spark, sf).withColumnRenamed("id", "query")).drop("report")


@query(f"""WITH h AS (SELECT id, unnest(regexp_extract_all(content, '@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 0)) AS h FROM {project.HUNKS.sql()}),
r AS (SELECT id, regexp_extract(h, '\\+(\\d+)', 1)::INT AS a, coalesce(nullif(regexp_extract(h, '\\+\\d+,(\\d+) @@', 1), ''), '1')::INT AS n FROM h)
SELECT DISTINCT id, unnest(generate_series(a, a + n - 1))::INT AS line FROM r WHERE n > 0""")
def diff_hunks(spark, sf):
    return extract.changed_lines(project.HUNKS.frame(spark, sf))


@query(f"SELECT * FROM {project.REFERENCES.sql()}")
def references(spark, sf):
    return extract.references(files(spark, sf))


_TASKS = f"tasks AS (SELECT query, text FROM {project.TASKS.sql()} UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations WHERE role = 'user')"


def tasks(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("query"), "text")
    return project.TASKS.frame(spark).unionByName(c)


_PATTERNS = {"route": resolve.ROUTE, "code": resolve.CODE}
#: A file is a whole word of path characters.
_FILES_OF = "list_filter(string_split_regex(text, '[^\\w/.-]+'), lambda w: regexp_matches(w, '(?i)^([\\w-]+/)*[\\w-]+(\\.[\\w-]+)*\\.(php|ts|tsx|js|jsx|py|rb|go|rs|java|vue|svelte)\\.?$'))"
_WORDS_OF = "regexp_extract_all(text, '(?:\\.|::)?[A-Za-z0-9_]+')"
_BARE = f"list_transform({_WORDS_OF}, lambda w: ltrim(w, '.:'))"
#: Kinds of words by how they are spelled.
_SPELLED = {"class": f"list_filter({_BARE}, lambda w: regexp_full_match(w, '(?:[A-Z][a-z]+){{2,}}'))", "snake": f"list_filter({_BARE}, lambda w: regexp_full_match(w, '[a-z][a-z0-9]*(?:_[a-z0-9]+)+'))",
            "camel": f"list_filter({_BARE}, lambda w: regexp_full_match(w, '[a-z][a-zA-Z0-9]*[A-Z][a-z0-9]+'))",
            "member": f"list_filter(list_transform(list_filter({_WORDS_OF}, lambda w: w[1] IN ('.', ':')), lambda w: regexp_extract(ltrim(w, '.:'), '^[a-z][a-zA-Z0-9]+')), lambda w: w <> '')"}
_FOUND = _SPELLED | {k: f"regexp_extract_all(text, {lit(re2(p))}, 1)" for k, p in _PATTERNS.items()} | {"file": f"list_transform({_FILES_OF}, lambda w: rtrim(w, '.'))"}


@query(f"WITH {_TASKS} SELECT DISTINCT query, kind, name FROM (" + " UNION ALL ".join(f"SELECT query, '{k}' AS kind, unnest({x}) AS name FROM tasks" for k, x in _FOUND.items()) + ")")
def task_entities(spark, sf):
    e = resolve.entity_words(F.col("text"))
    found = {"class": e["classes"], "snake": e["snakes"], "camel": e["camels"], "member": e["members"]} | {k: F.regexp_extract_all("text", F.lit(p), F.lit(1)) for k, p in (_PATTERNS | {"file": resolve.FILE}).items()}
    parts = [F.transform(x, _named(k)) for k, x in found.items()]
    return tasks(spark, sf).select("query", F.explode(F.flatten(F.array(*parts))).alias("e")).select("query", "e.kind", "e.name").distinct()


def _named(kind):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"))


@query(f"WITH {_TASKS}, k AS (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{d}' AS domain, unnest([{quoted(ws)}]) AS word" for i, (d, ws) in enumerate(DOMAINS.items())) + """)
SELECT query, domain, count(*)::INT AS weight, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, any_value(ord))::INT AS rank FROM tasks JOIN k ON contains(lower(text), word) GROUP BY query, domain""")
def domain_weights(spark, sf):
    d = resolve.domain_weights(F.col("text"), F.array().cast("array<string>"), DOMAINS)
    return tasks(spark, sf).select("query", F.posexplode(d).alias("i", "d")).select("query", "d.domain", F.col("d.weight").cast("int").alias("weight"), (F.col("i") + 1).alias("rank"))


_TYPE_SCORES = {t: " + ".join(f"contains(lower(text), {lit(w)})::INT" for w in ws) for t, ws in CHANGE_TYPES.items()}
_BEST = "greatest(" + ", ".join(CHANGE_TYPES) + ")"


@query(f"WITH {_TASKS}, s AS (SELECT query, {', '.join(f'{x} AS {t}' for t, x in _TYPE_SCORES.items())} FROM tasks) SELECT query, CASE WHEN {_BEST} = 0 THEN 'unknown' " + " ".join(f"WHEN {t} = {_BEST} THEN '{t}'" for t in CHANGE_TYPES) + " END AS change_type FROM s")
def change_type(spark, sf):
    return tasks(spark, sf).select("query", resolve.change_type(F.col("text"), CHANGE_TYPES).alias("change_type"))


def _has(kind: str) -> str:
    return f"len({_FOUND[kind]}) > 0"


_CONF = f"""{_TASKS}, c AS (SELECT query, {_has('file')} AS f, {_has('class')} OR {_has('snake')} AS c, {_has('member')} AS m, {_has('route')} AS r, {_has('code')} AS e, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2)) AS k FROM tasks),
d AS (SELECT query, f, c OR m AS cm, r, round(least(1.0, 0.3 * f::INT + 0.25 * c::INT + 0.2 * m::INT + 0.2 * r::INT + 0.15 * e::INT + least(0.2, 0.05 * k)), 6)::DOUBLE AS confidence FROM c)"""


def _task_signals(spark, sf):
    some, has = lambda c: F.size(c) > 0, lambda p: F.col("text").rlike(p)
    t = tasks(spark, sf).withColumn("w", resolve.entity_words(F.col("text")))
    return t.select("query", has(resolve.FILE).alias("f"), (some("w.classes") | some("w.snakes")).alias("c"), some("w.members").alias("m"), has(resolve.ROUTE).alias("r"), has(resolve.CODE).alias("e"), F.size(T.keyword_tokens(F.col("text"))).alias("k"))


@query(f"WITH {_CONF} SELECT query, confidence, CASE WHEN confidence < 0.3 THEN 'vague' WHEN confidence < 0.5 THEN 'clarify' ELSE 'clear' END AS clarity FROM d")
def confidence(spark, sf):
    no = F.lit(False)
    c = resolve.confidence(F.col("f"), no, no, F.col("c"), F.col("m"), F.col("r"), F.col("e"), F.col("k"))
    return _task_signals(spark, sf).select("query", c.alias("confidence")).withColumn("clarity", resolve.clarity(F.col("confidence")))


@query(f"""WITH {_CONF} SELECT query, list_filter([CASE WHEN NOT f THEN 'Name a file (for example app/Services/PaymentService.php)' END, CASE WHEN NOT cm THEN 'Name a class or a method' END, CASE WHEN NOT r THEN 'Name a route if there is one (for example /api/checkout)' END,
'Give a log with the error', 'Give a branch to compare with'], lambda x: x IS NOT NULL) AS suggestions FROM d""")
def suggestions(spark, sf):
    return _task_signals(spark, sf).select("query", resolve.suggestions(F.col("f"), F.col("c") | F.col("m"), F.col("r")).alias("suggestions"))


_LOG = "log AS (SELECT 'user/' || user_id || '/' || event_type AS path, ts FROM events)"


def event_log(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("user/"), "user_id", F.lit("/"), "event_type").alias("path"), F.col("ts").alias("at"))


@query(f"WITH {_LOG}, c AS (SELECT path, count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY path), t AS (SELECT * FROM c ORDER BY n DESC, path LIMIT 500) SELECT path, n::BIGINT AS n, round(n / (SELECT max(n) FROM c), 6) AS churn, round(n / (SELECT max(n) FROM c) * 100)::BIGINT AS commits FROM t")
def hotspots(spark, sf):
    return activity.hotspots(event_log(spark, sf), F.lit("2024-01-10").cast("timestamp"))


@query(f"WITH {_LOG} SELECT path, count(*)::BIGINT AS n FROM log WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY path ORDER BY n DESC, path LIMIT 50")
def recent_activity(spark, sf):
    return activity.recent(event_log(spark, sf), F.lit("2024-01-25").cast("timestamp"))


@query(f"WITH {_LOG} SELECT path, count(*)::BIGINT AS commits, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_modified, least(count(*) / 100, 1.0)::DOUBLE AS churn FROM log GROUP BY path")
def detailed_churn(spark, sf):
    return activity.churn(event_log(spark, sf)).withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))


# Candidates made up from documents: flags and counts by residues of the id.
_CAND = {"stacktrace_hit": 11, "diff_hit": 7, "file_hint_hit": 13, "symbol_match": 5, "keyword_match": 3, "graph_related": 4, "test_file": 9, "related_file": 6, "example_usage": 17}
_PATH = "CASE doc_id % 8 WHEN 0 THEN 'app/Models/' || source || '_' || doc_id || '.php' WHEN 1 THEN 'tests/' || source || '_' || (doc_id - 1) || '_test.php' WHEN 2 THEN 'config/' || source || '/auth_' || doc_id || '.php' WHEN 3 THEN 'src/' || source || '/payment' || doc_id || 'Controller.ts' ELSE 'src/' || source || '/file' || doc_id || '.ts' END"
CAND_SQL = f"""cand AS (SELECT q.query, {_PATH} AS path, (doc_id + q.query) % 97 = 0 AS file_hint_exact, (doc_id + q.query) % 101 = 0 AS exact_symbol, false AS git_hotspot, {', '.join(f'(doc_id + q.query) % {m} = 0 AS {f}' for f, m in _CAND.items())},
  ((doc_id + q.query) % 4)::INT AS raw_path_matches, ((doc_id + q.query) % 6)::INT AS path_matches, ((doc_id + q.query) % 3)::INT AS basename_matches, CASE WHEN (doc_id + q.query) % 4 = 0 THEN (1 + doc_id % 2)::INT END AS graph_depth FROM documents, (VALUES (1), (2), (3)) q(query))"""
_DOMAIN_TASKS = {1: [("auth", 3), ("payments", 1)], 2: [("database", 2)], 3: []}


def candidates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("query"))
    n = F.col("doc_id") + F.col("query")
    path = F.expr(_PATH)
    d = d.select(F.col("query").cast("long").alias("query"), path.alias("path"), n.alias("n"), "doc_id")
    return score.signals(d, **{f: F.col("n") % m == 0 for f, m in _CAND.items()}, file_hint_exact=F.col("n") % 97 == 0, exact_symbol=F.col("n") % 101 == 0, raw_path_matches=F.col("n") % 4, path_matches=F.col("n") % 6, basename_matches=F.col("n") % 3,
                         graph_depth=F.when(F.col("n") % 4 == 0, 1 + F.col("doc_id") % 2))


def domain_tasks(spark):
    return spark.createDataFrame([(q, d) for q, d in _DOMAIN_TASKS.items()], "query long, domains array<struct<domain:string,weight:int>>")


def churn_of(spark, sf):
    return table(spark, sf, "documents").select(F.expr(_PATH).alias("path"), (F.col("doc_id") % 10 / 10).alias("churn"))


@query(f"""WITH {CAND_SQL}, u AS (SELECT query, regexp_replace(path, '[0-9]+', '') AS path, * EXCLUDE (query, path) FROM cand)
SELECT query::BIGINT AS query, path, bool_or(stacktrace_hit) AS stacktrace_hit, bool_or(diff_hit) AS diff_hit, bool_or(symbol_match) AS symbol_match, max(raw_path_matches) AS raw_path_matches, max(path_matches) AS path_matches, min(graph_depth) AS graph_depth, 1.0 / min(graph_depth)::DOUBLE AS graph_decay FROM u GROUP BY query, path""")
def signal_merge(spark, sf):
    """Merging the candidates of many sources: here, all files whose paths differ in their number only."""
    m = score.merge(candidates(spark, sf).withColumn("path", F.regexp_replace("path", "^([^0-9]*)[0-9]+", "$1")))
    return m.select("query", "path", "stacktrace_hit", "diff_hit", "symbol_match", "raw_path_matches", "path_matches", "graph_depth", "graph_decay")


def _share_sql() -> str:
    cases = []
    for q, ds in _DOMAIN_TASKS.items():
        total = sum(w for _, w in ds)
        if total:
            hits = " + ".join(f"{w} * ({' OR '.join(f'contains(lower(path), {lit(k)})' for k in DOMAINS[d])})::INT" for d, w in ds)
            cases.append(f"WHEN query = {q} THEN ({hits}) / {total}")
    return "CASE " + " ".join(cases) + " END"


_ENTRY, _MODEL = lit(score.ENTRY_POINT), lit(score.MODEL_FILE)
_COUNT = " + ".join(f"{f}::INT" for f in score.FLAGS)
SCORE_SQL = f"""sh AS (SELECT *, ({_share_sql()})::DOUBLE AS share, 1.0::DOUBLE / graph_depth AS decay, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM cand),
nh AS (SELECT *, sum((stacktrace_hit OR diff_hit)::INT) OVER (PARTITION BY query, dir) - (stacktrace_hit OR diff_hit)::INT > 0 AS near FROM sh),
ch AS (SELECT {_PATH} AS path, doc_id % 10 / 10 AS churn FROM documents),
sc AS (SELECT nh.query, nh.path, nh.file_hint_exact, nh.exact_symbol, nh.share, round((
  CASE WHEN file_hint_exact THEN 2.0 WHEN file_hint_hit THEN 0.4 ELSE 0.0 END + 0.3 * stacktrace_hit::INT + 0.22 * diff_hit::INT + 0.2 * symbol_match::INT + 0.08 * keyword_match::INT + 0.05 * test_file::INT + 0.12 * related_file::INT + 0.04 * example_usage::INT
  + 0.25 * least(raw_path_matches, 3) + CASE WHEN graph_related THEN 0.05 * coalesce(greatest(share, 0.2), 1.0) * coalesce(decay, 1.0) ELSE 0.0 END)::DOUBLE
  * CASE WHEN regexp_matches(nh.path, {_ENTRY}) THEN CASE WHEN file_hint_hit OR stacktrace_hit OR diff_hit OR raw_path_matches >= 1 OR exact_symbol THEN 1.3 ELSE 1.1 END ELSE 1.0 END * CASE WHEN regexp_matches(nh.path, {_MODEL}) THEN 1.2 ELSE 1.0 END * CASE WHEN symbol_match THEN 1.25 ELSE 1.0 END
  * (1 + 0.25 * coalesce(share, 0.0)) * CASE WHEN raw_path_matches >= 2 THEN pow(1.4, raw_path_matches - 1) ELSE 1.0 END * CASE WHEN path_matches >= 2 THEN pow(1.2, path_matches - 1) ELSE 1.0 END * CASE WHEN path_matches >= 4 THEN 1.3 ELSE 1.0 END
  * CASE WHEN basename_matches >= 2 AND raw_path_matches >= 1 THEN pow(1.5, basename_matches - 1) ELSE 1.0 END * CASE WHEN {_COUNT} >= 3 THEN 1.15 ELSE 1.0 END * CASE WHEN near THEN 1.1 ELSE 1.0 END * CASE WHEN churn > 0.5 THEN 1.1 ELSE 1.0 END, 6) AS score
  FROM nh LEFT JOIN ch ON nh.path = ch.path)"""


def scored(spark, sf):
    return score.score(score.merge(candidates(spark, sf)), domain_tasks(spark), churn_of(spark, sf), DOMAINS)


@query(f"WITH {CAND_SQL}, {SCORE_SQL} SELECT query::BIGINT AS query, path, floor(score * 1000 + 0.0001)::BIGINT AS milli FROM sc")
def score_bonus(spark, sf):
    return scored(spark, sf).select("query", "path", F.floor(F.col("score") * 1000 + 0.0001).alias("milli"))


@query(f"""WITH {CAND_SQL}, sh AS (SELECT *, ({_share_sql()})::DOUBLE AS share FROM cand)
SELECT query::BIGINT AS query, path, list_filter([CASE WHEN file_hint_exact THEN 'named exactly in the task' WHEN file_hint_hit THEN 'named in part in the task' END, CASE WHEN stacktrace_hit THEN 'in the stack trace' END, CASE WHEN diff_hit THEN 'changed in the diff' END,
CASE WHEN exact_symbol THEN 'defines a named symbol' WHEN symbol_match THEN 'has a matching symbol' END, CASE WHEN keyword_match THEN 'has matching keywords' END, CASE WHEN raw_path_matches >= 1 THEN 'path has ' || raw_path_matches || ' words of the task' END,
CASE WHEN path_matches >= 2 THEN 'path matches ' || path_matches || ' keywords' END, CASE WHEN basename_matches >= 2 THEN 'file name matches ' || basename_matches || ' keywords' END,
CASE WHEN graph_related AND coalesce(graph_depth, 1) = 1 THEN 'imports or imported' WHEN graph_related THEN 'related by imports over ' || graph_depth || ' steps' END, CASE WHEN test_file THEN 'tests a candidate' END, CASE WHEN related_file THEN 'related by convention or reference' END,
CASE WHEN example_usage THEN 'example of use' END, CASE WHEN regexp_matches(path, {_ENTRY}) THEN 'entry point' END, CASE WHEN regexp_matches(path, {_MODEL}) THEN 'model' END,
CASE WHEN share > 0 THEN 'fits the domains ' || CASE query WHEN 1 THEN 'auth, payments' ELSE 'database' END END], lambda x: x IS NOT NULL) AS reasons FROM sh""")
def score_reasons(spark, sf):
    return scored(spark, sf).select("query", "path", "reasons")


_IS_TEST, _IS_CONFIG = lit(score.TEST), lit(score.CONFIG)
QUOTA_SQL = f"""c AS (SELECT *, CASE WHEN (file_hint_exact OR exact_symbol) AND NOT regexp_matches(path, {_IS_TEST}) THEN 0 WHEN regexp_matches(path, {_IS_TEST}) THEN 2 WHEN regexp_matches(path, {_IS_CONFIG}) THEN 3 ELSE 1 END AS class FROM sc),
r AS (SELECT *, greatest(25 - sum((class = 0)::INT) OVER (PARTITION BY query), 0) AS left_, row_number() OVER (PARTITION BY query, class ORDER BY score DESC, path) AS rank FROM c),
f1 AS (SELECT * FROM r WHERE class = 0 OR class = 1 AND rank <= floor(left_ * 0.7)),
st AS (SELECT DISTINCT query, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[a-z]+$', '')) AS stem FROM f1),
ts AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM r WHERE class = 2 AND EXISTS (SELECT 1 FROM st WHERE st.query = r.query AND (contains(stem, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '_test\\.[a-z]+$', ''))) OR contains(lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '_test\\.[a-z]+$', '')), stem)))),
cf AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM r WHERE class = 3 AND (query = 1 AND (contains(lower(path), 'auth') OR contains(lower(path), 'payments')) OR query = 2 AND contains(lower(path), 'database'))),
al AS (SELECT query, path, class, rank, score FROM f1 UNION ALL SELECT query, path, class, rank, score FROM ts WHERE rank <= floor(left_ * 0.2) UNION ALL SELECT query, path, class, rank, score FROM cf WHERE rank <= floor(left_ * 0.1)),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY class, rank) AS ord FROM al QUALIFY ord <= 25)"""


@query(f"WITH {CAND_SQL}, {SCORE_SQL}, {QUOTA_SQL} SELECT query::BIGINT AS query, path, class::INT AS class, ord::INT AS ord, floor(score / max(score) OVER (PARTITION BY query) * 1000 + 0.001)::BIGINT AS milli FROM o")
def quota_topk(spark, sf):
    return score.select(scored(spark, sf), domain_tasks(spark)).select("query", "path", "class", "ord", F.floor(F.col("score") * 1000 + 0.001).alias("milli"))


@query(f"""WITH {CAND_SQL}, {SCORE_SQL}, {QUOTA_SQL} SELECT path, slug, n_files FROM (SELECT '20240131-120000-task-' || query AS slug, count(*)::INT AS n_files, query FROM o GROUP BY query) JOIN (SELECT query, min(path) AS path FROM o GROUP BY query) USING (query)""")
def pack_catalog(spark, sf):
    """The catalogue read back from JSON manifests."""
    s = score.select(scored(spark, sf), domain_tasks(spark))
    none = F.array().cast("array<string>")
    t = domain_tasks(spark).select("query", F.concat(F.lit("task "), "query").alias("text"), none.alias("keywords"), none.alias("files_hint"), none.alias("symbols"), F.lit("unknown").alias("change_type"), F.lit(0.0).alias("confidence"), "domains")
    m = packs.manifests(t, s, s.select("query", "path", F.lit("x").alias("content")), F.lit("2024-01-31 12:00:00").cast("timestamp"))
    least = m.select("slug", F.array_min(F.from_json("manifest", "files array<struct<path:string>>")["files"]["path"]).alias("path"))
    return packs.catalogue(m).join(least, "slug").select("path", "slug", "n_files")


# Long files: the documents with a word on each line.
_WORDY = "f AS (SELECT 'doc_' || doc_id || '.txt' AS path, 'w ' || regexp_replace(text, '[ \\r\\n]+', chr(10) || 'w ', 'g') AS content FROM documents WHERE text IS NOT NULL)"


def wordy_files(spark, sf):
    content = F.concat(F.lit("w "), F.regexp_replace("text", r"[ \r\n]+", "\nw "))
    return table(spark, sf, "documents").filter("text is not null").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("path"), content.alias("content"))


_CHOSEN = f"""{_WORDY}, ls AS (SELECT path, unnest(string_split(content, chr(10))) AS body, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line, len(string_split(content, chr(10))) AS n FROM f),
pr AS (SELECT *, CASE WHEN line <= 10 OR abs(line - 250) <= 20 THEN 0 WHEN line BETWEEN 400 AND 430 THEN 1 ELSE 3 END AS p FROM ls WHERE n > 200), rk AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p, line) AS rn FROM pr), ch AS (SELECT path, line, body, n FROM rk WHERE rn <= 300 OR p = 0)"""


def _excerpt_inputs(spark, sf):
    f = wordy_files(spark, sf).select("path", "content", F.lit(True).alias("in_trace"), F.lit(False).alias("has_symbol"))
    s = f.select("path", F.lit("block").alias("name"), F.lit("function").alias("kind"), F.lit(400).alias("start_line"), F.least(F.lit(430), F.size(F.split("content", "\n"))).alias("end_line"))
    return f, s, f.select("path", F.lit(250).alias("line"))


@query(f"WITH {_CHOSEN} SELECT path, line, body FROM ch")
def excerpt_lines(spark, sf):
    return excerpts.chosen_lines(*_excerpt_inputs(spark, sf))


@query(f"""WITH {_CHOSEN}, g AS (SELECT *, line > lag(line) OVER (PARTITION BY path ORDER BY line) + 1 AS gap FROM ch)
SELECT path, md5(string_agg(CASE WHEN gap THEN '// ... (lines omitted)' || chr(10) ELSE '' END || line || ': ' || body, chr(10) ORDER BY line)) AS content, min(line)::INT AS start_line, max(line)::INT AS end_line, any_value(n)::INT AS total_lines, count(*) < any_value(n) AS truncated FROM g GROUP BY path
UNION ALL SELECT path, md5(content), 1, len(string_split(content, chr(10)))::INT, len(string_split(content, chr(10)))::INT, false FROM f WHERE len(string_split(content, chr(10))) <= 200""")
def gap_render(spark, sf):
    return excerpts.excerpts(*_excerpt_inputs(spark, sf)).withColumn("content", F.md5("content"))


@query("SELECT ceil(sum(length(text)) / 4)::BIGINT AS budget_tokens FROM documents")
def token_estimate(spark, sf):
    return excerpts.budget_tokens(table(spark, sf, "documents").select(F.col("text").alias("content")))


@query(f"""SELECT path, path IN ('dist/app.js', 'src/dist/app.js', 'a/b.log', 'docs/a.md', 'tests/fixtures/a/b.txt', 'fixtures/c.txt', 'src/a/tmp/f.txt', 'src/a/tmp', '.env.local', 'logs\\win.log') OR regexp_matches(path, '^(dist/unit_\\d+\\.js|logs/unit_\\d+\\.log)$') OR regexp_matches(path, '(^|/)(\\.idea|\\.vscode|\\.quillmesh)/|\\.sw[op]$|(^|/)(\\.DS_Store|Thumbs\\.db)$') AS ignored FROM {project.PATHS.sql()}""")
def ignore_rules(spark, sf):
    return project.PATHS.frame(spark, sf).select("path", ignore.is_ignored(F.col("path"), project.RULES).alias("ignored"))


RULE_CANDIDATES = Values("query long, path string", [(1, "src/cart/cartService.ts"), (1, "src/userController.js"), (2, "app/Http/Controllers/InvoiceController.php"), (2, "app/Models/Invoice.php"), (2, "routes/web.php")])
RULE_CANDIDATES = Grown(RULE_CANDIDATES, ("documents", "doc_id % 30 = 0", ["3", "'gen/d' || (doc_id % 20) || '/unit_' || doc_id || '.ts'"]))


def _rules(spark, sf, *names):
    f = project.FILES.frame(spark, sf)
    t = spark.createDataFrame([(1, [], [], []), (2, [("payments", 2)], ["invoice"], []), (3, [], [], [])], "query long, domains array<struct<domain:string,weight:int>>, keywords array<string>, symbols array<string>")
    return rules.apply(RULE_CANDIDATES.frame(spark, sf).join(f, "path"), f, t, list(names) or None)


@query(f"""WITH {FILES_SQL}, c AS (SELECT * FROM {RULE_CANDIDATES.sql()}), d AS (SELECT query, regexp_replace(path, '/[^/]*$', '') AS dir FROM c UNION SELECT query, regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') FROM c UNION SELECT query, '.' FROM c)
SELECT DISTINCT query, path, 'related_file' AS signal FROM (SELECT path, {_DIR} AS dir FROM files WHERE regexp_matches(path, {lit(rules.CONFIG_LIKE)})) JOIN d USING (dir) WHERE (query, path) NOT IN (SELECT query, path FROM c)""")
def related_config(spark, sf):
    return _rules(spark, sf, "configs")


@query(f"""WITH {FILES_SQL}, c AS (SELECT * FROM {RULE_CANDIDATES.sql()}), n AS (SELECT query, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') || unnest(['.test', '.spec']) || regexp_extract(path, '(\\.[^./]+)$', 1) AS name FROM c),
p AS (SELECT query, {_DIR} || '/__tests__/' || regexp_extract(path, '([^/]*)$', 1) AS path FROM c)
SELECT DISTINCT query, path, 'test_file' AS signal FROM (SELECT query, path FROM files JOIN n ON regexp_extract(path, '([^/]*)$', 1) = name UNION ALL SELECT query, path FROM p WHERE path IN (SELECT path FROM files)) WHERE (query, path) NOT IN (SELECT query, path FROM c)
UNION SELECT DISTINCT query, f.path, 'related_file' FROM files f JOIN (SELECT query, {_DIR} AS dir FROM c) x ON regexp_replace(f.path, '/[^/]*$', '') = dir AND regexp_matches(f.path, '/index\\.[jt]sx?$') WHERE (query, f.path) NOT IN (SELECT query, path FROM c)""")
def node_rules(spark, sf):
    return _rules(spark, sf, "node-tests", "node-index")


@query(f"""WITH {FILES_SQL}, c AS (SELECT * FROM {RULE_CANDIDATES.sql()}), s AS (SELECT query, regexp_extract(path, '([A-Z][a-zA-Z]*)Controller\\.php$', 1) AS s FROM c WHERE regexp_matches(path, 'Controller\\.php$')),
m AS (SELECT query, path FROM c WHERE regexp_matches(path, 'app/Models/[A-Z][a-zA-Z]+\\.php$')),
r AS (SELECT query, path FROM files, s WHERE regexp_matches(path, '^resources/views/.*\\.blade\\.php$') AND contains(lower(path), lower(s)) UNION ALL SELECT query, path FROM files, s WHERE contains(path, 'app/Http/Requests/') AND contains(path, s)
  UNION ALL SELECT query, f.path FROM files f, m WHERE contains(f.path, 'database/migrations/') AND contains(f.path, '_create_' || lower(regexp_extract(m.path, '([^/]+)\\.php$', 1)) || 's')
  UNION ALL SELECT m.query, 'app/Models/' || unnest(regexp_extract_all(f.content, 'belongsTo\\((\\w+)::class', 1)) || '.php' FROM m JOIN files f USING (path))
SELECT DISTINCT query, path, 'related_file' AS signal FROM r WHERE path IN (SELECT path FROM files) AND (query, path) NOT IN (SELECT query, path FROM c)""")
def laravel_rules(spark, sf):
    return _rules(spark, sf, "laravel-views", "laravel-requests", "laravel-migrations", "laravel-relations")


@query()
def discovery_rules(spark, sf):
    """All rules that apply to the tree."""
    return _rules(spark, sf)


TESTED = Values("path string", [(p,) for p in ("tests/user.ts", "src/a.test.ts", "src/__tests__/b.ts", "app/UserTest.php", "pkg/store_test.go", "spec/models/user.rb", "src/contest.ts", "lib/test_util.py")])
TESTED = Grown(TESTED, ("documents", "doc_id % 3 = 0", ["'tests/unit_' || doc_id || '.ts'"]), ("documents", "doc_id % 3 = 1", ["'gen/unit_' || doc_id || '.test.ts'"]), ("documents", "doc_id % 3 = 2", ["'pkg/unit_' || doc_id || '_test.go'"]))


@query(f"""WITH p AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(path, '(?i)tests?/', '', 'g'), '(?i)specs?/', '', 'g'), '(?i)__tests__/', '', 'g') AS t FROM {TESTED.sql()})
SELECT path, regexp_replace(regexp_replace(regexp_replace(t, '\\.(test|spec)\\.', '.', 'g'), 'Test\\.(php|ts|js)$', '.\\1'), '_test\\.(go|py)$', '.\\1') AS tested, regexp_matches(path, {_IS_TEST}) AS scored_as_test FROM p""")
def tested_paths(spark, sf):
    from quillmesh.operators.discover import tested_path

    return TESTED.frame(spark, sf).select("path", tested_path(F.col("path")).alias("tested"), F.col("path").rlike(score.TEST).alias("scored_as_test"))


_GROUPS = Values("lang string, grp long, word string", [("en", 1, "purchase"), ("en", 1, "buy"), ("en", 1, "order"), ("en", 2, "remove"), ("en", 2, "delete"), ("en", 3, "order"), ("en", 3, "sort"), ("it", 4, "comprare"), ("it", 4, "acquistare"), ("it", 5, "utente")])
_STEMS = Values("term string, stem string", [("purchase", "purchas"), ("buy", "buy"), ("order", "order"), ("remove", "remov"), ("delete", "delet"), ("sort", "sort"), ("comprare", "compr"), ("acquistare", "acquist"), ("utente", "utent"), ("removed", "remov"), ("utenti", "utent"), ("orders", "order")])
_TRANSLATIONS = Values("stem string, english string", [("utent", "user"), ("compr", "buy")])
_WORDS = Values("term string", [("removed",), ("utenti",), ("Orders",), ("comprare",), ("unknown",)])
_WORDS = Grown(_WORDS, ("benchmark", "item_id IS NOT NULL", ["regexp_extract(lower(text), '[a-z]+', 0)"]))
_DICT = f"g AS (SELECT * FROM {_GROUPS.sql()}), st AS (SELECT * FROM {_STEMS.sql()}), ky AS (SELECT grp, lang, word AS key FROM g UNION SELECT grp, lang, stem FROM g JOIN st ON st.term = word), dc AS (SELECT DISTINCT key, g.word AS synonym FROM ky JOIN g ON g.grp = ky.grp AND g.lang = ky.lang)"


@query(f"""WITH {_DICT}, w AS (SELECT term FROM {_WORDS.sql()}), b AS (SELECT term, lower(term) AS x FROM w), s AS (SELECT b.term, stem AS x FROM b JOIN st ON st.term = b.x), e AS (SELECT s.term, english AS x FROM s JOIN {_TRANSLATIONS.sql()} t ON t.stem = s.x),
n AS (SELECT * FROM b UNION SELECT * FROM s UNION SELECT * FROM e), c AS (SELECT * FROM n UNION SELECT n.term, synonym FROM n JOIN dc ON key = x UNION SELECT term, term FROM w) SELECT term, x AS expansion FROM c UNION SELECT c.term, synonym FROM c JOIN dc ON key = x""")
def synonym_expand(spark, sf):
    from quillmesh.operators import retrieve

    groups = _GROUPS.frame(spark).withColumnRenamed("grp", "group")
    d = retrieve.dictionary(groups, _STEMS.frame(spark))
    return retrieve.expand_synonyms(_WORDS.frame(spark, sf), _STEMS.frame(spark), d, _TRANSLATIONS.frame(spark))


@query()
def stem_terms(spark, sf):
    """English and Italian stems of the distinct terms of all documents."""
    from quillmesh.functions import stem

    return stem.stems(table(spark, sf, "documents").select(F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term")))


@query()
def pack_tasks(spark, sf):
    """The whole engine on the invented tree: the files selected for each task."""
    from quillmesh import engine

    idx = engine.Index.build(project.FILES.frame(spark, sf), project.RULES)
    frames_ = extract.frames(project.LOGS.frame(spark, sf)).filter("id = 1").select(F.lit(1).cast("long").alias("query"), "file", "function")
    diffs = diff_entries(spark, sf).filter("id = 1").select(F.lit(2).cast("long").alias("query"), "file", "status")
    p = engine.pack(idx, project.TASKS.frame(spark), spark.createDataFrame([("src/index.ts", 0.9)], "path string, churn double"), frames_, diffs)
    return p.selected.select("query", "path", "class", "ord", "score", F.array_join("reasons", "; ").alias("reasons"))


_FRAMEWORKS = {"laravel": domains.LARAVEL, "nodejs": domains.NODE}
_CONFIG = domains.Config().put("billing", ["invoice", "dunning"]).put("queue", ["kafka", "topic"]).put("old", ["x"]).drop("old").disable("sms").disable("nova").enable("nova")
_SOURCES = [("core", 0, DOMAINS), *((n, 1, ds) for n, ds in _FRAMEWORKS.items()), ("custom", 2, _CONFIG.custom)]


@query("WITH d AS (" + " UNION ALL ".join(f"SELECT '{d}' AS domain, '{src}' AS source, {o} AS source_ord, {i} AS ord, [{quoted(ws)}] AS words" for src, o, ds in _SOURCES for i, (d, ws) in enumerate(ds.items()))
       + ") SELECT domain, source, array_to_string(words, ' ') AS words FROM d WHERE domain <> 'sms' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY source_ord DESC, ord) = 1")
def domain_catalog(spark, sf):
    """Core, framework and own domains; later sources replace, disabled ones are out."""
    return domains.active(spark, DOMAINS, _FRAMEWORKS, _CONFIG).select("domain", "source", F.array_join("words", " ").alias("words"))


@query(f"WITH {_DICT}, w AS (SELECT term FROM {_WORDS.sql()}), k AS (SELECT term, lower(term) AS key FROM w UNION SELECT w.term, stem FROM w JOIN st ON st.term = lower(w.term)) SELECT DISTINCT term FROM k WHERE key IN (SELECT key FROM dc) OR key IN (SELECT stem FROM {_TRANSLATIONS.sql()})")
def has_synonyms(spark, sf):
    from quillmesh.operators import retrieve

    d = retrieve.dictionary(_GROUPS.frame(spark).withColumnRenamed("grp", "group"), _STEMS.frame(spark))
    return retrieve.has_synonyms(_WORDS.frame(spark, sf), _STEMS.frame(spark), d, _TRANSLATIONS.frame(spark))


@query(f"""WITH u AS (SELECT item_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({quoted(STOPWORDS)})) AS ts FROM benchmark))
SELECT item_id AS query, term, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, min(i))::INT AS rank FROM u GROUP BY item_id, term QUALIFY rank <= 20""")
def keyword_frequency(spark, sf):
    from quillmesh.operators import retrieve

    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.filter(T.keyword_tokens(F.col("text")), lambda w: ~w.isin(*STOPWORDS)).alias("tokens"))
    return retrieve.frequent_keywords(t)


_REF_TASKS = Values("query long, text string", [(1, "see @cartService.ts and @Invoice"), (2, "@loadUser fails, @jobs/report.py too"), (3, "mail me@example.org or ask @nobody"), (4, "@guide")])


@query(f"""WITH {FILES_SQL}, {LINES_SQL}, {SYMBOLS_SQL}, rf AS (SELECT DISTINCT query, unnest(regexp_extract_all(text, '@([\\w\\-./]*\\w)', 1)) AS ref FROM {_REF_TASKS.sql()}),
f AS (SELECT ref, path FROM (SELECT DISTINCT ref FROM rf), files WHERE contains(lower(path), lower(ref)) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN contains(lower(path), '/' || lower(ref)) THEN 0 ELSE 1 END, length(path), path) = 1),
y AS (SELECT ref, name FROM (SELECT DISTINCT ref FROM rf), (SELECT DISTINCT name FROM s) WHERE contains(lower(name), lower(ref)) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN starts_with(lower(name), lower(ref)) THEN 0 ELSE 1 END, length(name), name) = 1)
SELECT query, rf.ref, CASE WHEN NOT regexp_matches(rf.ref, '\\.\\w+$') AND name IS NOT NULL THEN 'symbol' ELSE 'file' END AS kind, CASE WHEN NOT regexp_matches(rf.ref, '\\.\\w+$') AND name IS NOT NULL THEN name ELSE path END AS target
FROM rf LEFT JOIN f ON f.ref = rf.ref LEFT JOIN y ON y.ref = rf.ref WHERE target IS NOT NULL""")
def at_references(spark, sf):
    from quillmesh.operators import retrieve

    f = files(spark, sf)
    return retrieve.at_references(_REF_TASKS.frame(spark), f, extract.symbols(f))


# Discovery over the tables: documents and pages are files, the benchmark's items and the pages' links are tasks.
_TREE = f"""tree AS (SELECT 'src/' || source || '/doc_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.test' ELSE '' END || '.py' AS path, text AS content, doc_id FROM documents)"""


def tree_of_documents(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("src/"), "source", F.lit("/doc_"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".test").otherwise(""), F.lit(".py"))
    return d.select(name.alias("path"), F.col("text").alias("content"), "doc_id")


@query(f"""WITH {_TREE}, w AS (SELECT item_id AS query, CASE item_id % 4 WHEN 0 THEN 'x/doc_' || item_id || '.py' WHEN 1 THEN './src/web/doc_' || item_id || '.py' WHEN 2 THEN 'Doc_' || item_id ELSE 'DOC_' || item_id || '.test.py' END AS p FROM benchmark),
n AS (SELECT query, regexp_replace(p, '^\\./', '') AS pattern FROM w), whole AS (SELECT query, pattern, path, true AS exact FROM n JOIN tree ON path = pattern),
rest AS (SELECT *, lower(pattern) AS low FROM n WHERE (query, pattern) NOT IN (SELECT query, pattern FROM whole)),
h AS (SELECT * FROM whole UNION ALL SELECT query, pattern, path, true FROM rest JOIN tree ON lower(regexp_extract(path, '([^/]*)$', 1)) = regexp_extract(low, '([^/]*)$', 1)
  UNION ALL SELECT query, pattern, path, false FROM rest JOIN tree ON contains(lower(path), low))
SELECT query, pattern, path, bool_or(exact) AS exact FROM h GROUP BY ALL""")
def discover_paths(spark, sf):
    """Files by path, by basename and by a part of the path."""
    i = F.col("item_id").cast("string")
    pattern = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("x/doc_"), i, F.lit(".py"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit("./src/web/doc_"), i, F.lit(".py"))).when(
        F.col("item_id") % 4 == 2, F.concat(F.lit("Doc_"), i)).otherwise(F.concat(F.lit("DOC_"), i, F.lit(".test.py")))
    return discover.match_paths(table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), pattern.alias("pattern")), tree_of_documents(spark, sf))


@query(f"""WITH {_TREE}, c AS (SELECT doc_id % 10 AS query, path, doc_id FROM tree WHERE doc_id % 3 = 1),
t AS (SELECT path AS test, replace(path, '.test.py', '.py') AS path FROM tree WHERE contains(path, '.test.')),
s AS (SELECT path, 'sym_' || doc_id AS name FROM tree WHERE doc_id % 3 = 1 UNION ALL SELECT path, 'test_sym_' || (doc_id + 1) FROM tree WHERE doc_id % 3 = 0)
SELECT DISTINCT query, test AS path FROM c JOIN t USING (path) UNION SELECT c.query, x.path FROM c JOIN s o ON o.path = c.path JOIN s x ON x.name = 'test_' || o.name WHERE contains(x.path, '.test.')""")
def discover_tests(spark, sf):
    """Tests of candidates: by the symbols that they name (and by path, where a tested file is a candidate)."""
    tree = tree_of_documents(spark, sf)
    c = tree.filter("doc_id % 3 = 1").select((F.col("doc_id") % 10).alias("query"), "path")
    own = tree.filter("doc_id % 3 = 1").select("path", F.concat(F.lit("sym_"), "doc_id").alias("name"))
    tests = tree.filter("doc_id % 3 = 0").select("path", F.concat(F.lit("test_sym_"), F.col("doc_id") + 1).alias("name"))
    return discover.from_tests(c, tree, own.unionByName(tests)).select("query", "path")


@query("""WITH s AS (SELECT 'part_' || p_partkey AS path, 'class' AS kind, replace(p_name, ' ', '_') || '_' || p_size AS name FROM part), n AS (SELECT DISTINCT p_size % 25 AS query, lower(split_part(p_name, ' ', 2)) || '_' || p_size AS needle FROM part WHERE p_partkey % 7 = 0)
SELECT query::BIGINT AS query, path, kind, name AS symbol FROM s JOIN n ON contains(lower(name), needle)""")
def discover_symbols(spark, sf):
    """Symbols that contain a name."""
    p = table(spark, sf, "part")
    symbols = p.select(F.concat(F.lit("part_"), "p_partkey").alias("path"), F.lit("class").alias("kind"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_size").alias("name"))
    names = p.filter("p_partkey % 7 = 0").select((F.col("p_size") % 25).cast("long").alias("query"), F.concat(F.split("p_name", " ")[1], F.lit("_"), "p_size").alias("name"))
    return discover.match_symbols(names, symbols).select("query", "path", "kind", "symbol")


@query(f"""WITH f AS (SELECT 'host/' || regexp_extract(url, '://([^/?#]+)', 1) || '/page_' || page_id || '.html' AS path FROM pages),
seg AS (SELECT DISTINCT path, lower(x) AS term FROM (SELECT path, unnest(string_split_regex(path, '[-_./]')) AS x FROM f) WHERE length(x) >= 2),
w AS (SELECT DISTINCT query, word FROM (SELECT page_id % 20 AS query, unnest(string_split_regex(lower(regexp_extract(url, '://([^/?#]+)', 1)), '[.]')) AS word FROM pages WHERE page_id % 5 = 0) WHERE length(word) >= 3),
e AS (SELECT query, path, count(DISTINCT term)::INT AS n FROM seg JOIN w ON term = word GROUP BY ALL) SELECT query, path, n AS raw_path_matches FROM e""")
def discover_names(spark, sf):
    """Files whose path has words of a task as typed, and how many."""
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    p = table(spark, sf, "pages")
    files_ = p.select(F.concat(F.lit("host/"), host, F.lit("/page_"), "page_id", F.lit(".html")).alias("path"))
    words = F.filter(F.split(F.lower(host), "[.]"), lambda w: F.length(w) >= 3)
    t = p.filter("page_id % 5 = 0").select((F.col("page_id") % 20).alias("query"), F.explode(words).alias("w")).groupBy("query").agg(F.array_distinct(F.collect_list("w")).alias("raw_words"))
    none = F.array().cast("array<string>")
    t = t.select("query", "raw_words", none.alias("symbols"), none.alias("keywords"), F.array().cast("array<struct<domain:string,weight:int>>").alias("domains"))
    return discover.from_names(t, files_).filter("raw_path_matches > 0").select("query", "path", F.col("raw_path_matches").cast("int").alias("raw_path_matches"))


def named_inputs(spark, sf):
    """Tasks of the benchmark's items, and files with paths of the words that documents begin with."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 3))
    none = F.array().cast("array<string>")
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.slice(words, 1, 6).alias("keywords"), F.slice(words, 4, 6).alias("raw_words"), none.alias("symbols"),
                                             F.array().cast("array<struct<domain:string,weight:int>>").alias("domains"))
    d = table(spark, sf, "documents").select("source", "doc_id", F.slice(words, 1, 3).alias("w")).filter(F.size("w") > 2)
    w = lambda i: F.get("w", F.lit(i))
    f = d.select(F.concat_ws("/", F.col("source"), w(0), F.concat(w(1), F.lit("_"), w(2), F.lit("_"), F.col("doc_id"), F.lit(".py"))).alias("path"))
    return t, f


@query()
def discover_name_counts(spark, sf):
    """All three counts of ``from_names`` (words of a path as typed, groups of words in the path and in its name). Without
    SQL, for groups hang on stems; the tests hold it against plain Python."""
    t, f = named_inputs(spark, sf)
    return discover.from_names(t, f).select("query", "path", "raw_path_matches", "path_matches", "basename_matches")


# A tree for each document: its marker file, what was cached of it and its configuration, in SQL for both engines.
_MARKER = "CASE WHEN doc_id % 5 = 2 THEN 'package.json' WHEN doc_id % 5 = 4 THEN 'README.md' ELSE 'composer.json' END"
_MANIFEST = """CASE doc_id % 5 WHEN 0 THEN '{"require": {"laravel/framework": "^11"}}' WHEN 1 THEN '{"require-dev": {"statamic/cms": "5"}}' WHEN 3 THEN 'no json' ELSE '{}' END"""
_CACHED = """CASE WHEN doc_id % 20 = 0 THEN '{"rules": ["configs", "roles", "gone"], "detectedAt": "2024"}' WHEN doc_id % 20 = 1 THEN '{"rules": [' WHEN doc_id % 20 = 4 THEN '{"rules": []}' END"""
_OWN = """CASE WHEN doc_id % 7 = 0 THEN '{"customDomains": [{"name": "queue", "keywords": ["' || source || '"]}, {"name": "react", "keywords": ["x", "y"]}], "disabledDomains": ["auth", "nova"]}' WHEN doc_id % 7 = 1 THEN 'broken' END"""


def _trees(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id AS project", f"{_MARKER} AS path", f"{_MANIFEST} AS content")


_BY_KIND = {k: quoted([n for n in rules.REGISTRY if n.startswith(k)]) for k in ("node", "laravel", "statamic")}


@query(f"""WITH p AS (SELECT doc_id AS project, doc_id % 5 AS k, doc_id % 20 AS c FROM documents)
SELECT project, unnest(CASE WHEN c = 0 THEN ['configs', 'roles'] WHEN c = 4 THEN [] WHEN k = 0 THEN list_concat(['configs', 'roles'], [{_BY_KIND['laravel']}]) WHEN k = 1 THEN list_concat(['configs', 'roles'], [{_BY_KIND['statamic']}])
 WHEN k = 2 THEN list_concat(['configs', 'roles'], [{_BY_KIND['node']}]) ELSE ['configs', 'roles'] END) AS name FROM p""")
def project_rules(spark, sf):
    """The rules that apply to each of many trees, by their cached documents or else by their marker files."""
    kept = table(spark, sf, "documents").selectExpr("doc_id AS project", f"{_CACHED} AS body").filter("body is not null")
    return projects.applied(_trees(spark, sf), kept, "project")


@query(f"""WITH p AS (SELECT doc_id AS project, doc_id % 5 AS k, doc_id % 7 = 0 AS own, source AS word FROM documents),
d AS (""" + " UNION ALL ".join(f"SELECT '{d}' AS domain, '{src}' AS source, {o} AS ord, '{' '.join(ws)}' AS words" for src, o, ds in _SOURCES[:-1] for d, ws in ds.items()) + """),
j AS (SELECT project, domain, d.source, ord, words FROM p JOIN d ON d.source = 'core' OR (d.source = 'laravel' AND k = 0) OR (d.source = 'nodejs' AND k = 2)
  UNION ALL SELECT project, 'queue', 'custom', 2, coalesce(word, '') FROM p WHERE own AND word IS NOT NULL UNION ALL SELECT project, 'react', 'custom', 2, 'x y' FROM p WHERE own AND word IS NOT NULL)
SELECT project, domain, source, words FROM j JOIN p USING (project) WHERE NOT (own AND word IS NOT NULL AND domain IN ('auth', 'nova')) QUALIFY row_number() OVER (PARTITION BY project, domain ORDER BY ord DESC) = 1""")
def project_domains(spark, sf):
    """The domains in force in each of many trees: of the core, of its frameworks and of its own configuration."""
    own = table(spark, sf, "documents").selectExpr("doc_id AS project", f"{_OWN} AS body").filter("body is not null")
    return projects.in_force(_trees(spark, sf), DOMAINS, own, "project").withColumn("words", F.array_join("words", " "))


@query("""WITH p AS (SELECT doc_id, 'gen/d' || (doc_id % 20) || '/unit_' || doc_id || '.php' AS path FROM documents WHERE doc_id % 3 = 2),
s AS (SELECT doc_id, 'gen/d' || (doc_id % 20) || '/unit_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.php' END AS path FROM documents)
SELECT DISTINCT p.doc_id % 5 AS query, s.path FROM p JOIN s ON contains('unit' || s.doc_id, 'unit' || (p.doc_id + 60)) OR contains('run' || s.doc_id, 'run' || p.doc_id)""")
def second_hop(spark, sf):
    """What candidates refer to, in five tasks: files that define their classes and methods."""
    f = files(spark, sf)
    merged = table(spark, sf, "documents").filter("doc_id % 3 = 2").selectExpr("doc_id % 5 AS query", "concat('gen/d', doc_id % 20, '/unit_', doc_id, '.php') AS path")
    return discover.from_references(merged, f, staged(extract.symbol_starts(f).select("path", "kind", "name"), "symbols")).select("query", "path")


_VERB = "CASE doc_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'add' WHEN 2 THEN 'update' ELSE 'split' END"
_MIGRATION = f"CASE WHEN doc_id % 6 = 5 THEN 'app/Models/' ELSE 'database/migrations/2024_' END || {_VERB} || '_' || coalesce(source, 'none') || '_' || doc_id || '_table.php'"


@query(f"""WITH m AS (SELECT doc_id, {_MIGRATION} AS path, doc_id % 9 = 8 AS typed, CASE WHEN doc_id % 2 = 0 THEN source END AS word, {_VERB} AS verb FROM documents)
SELECT doc_id AS query, path, CASE WHEN NOT typed AND starts_with(path, 'database/') AND verb <> 'split' AND NOT coalesce(length(word) >= 3 AND contains(path, lower(word)), false) THEN 0 ELSE doc_id % 3 + 1 END AS path_matches,
CASE WHEN NOT typed AND starts_with(path, 'database/') AND verb <> 'split' AND NOT coalesce(length(word) >= 3 AND contains(path, lower(word)), false) THEN 0 ELSE doc_id % 2 END AS basename_matches FROM m""")
def generic_migrations(spark, sf):
    """Candidates of a task each: migrations that only words such as `create` match lose their counts."""
    d = table(spark, sf, "documents")
    merged = d.selectExpr("doc_id AS query", f"{_MIGRATION} AS path", "if(doc_id % 9 = 8, 1, 0) AS raw_path_matches", "doc_id % 3 + 1 AS path_matches", "doc_id % 2 AS basename_matches")
    tasks_ = d.selectExpr("doc_id AS query", f"array_compact(array({_VERB}, 'table', if(doc_id % 2 = 0, source, null))) AS keywords")
    return rules.mute_generic_migrations(merged, tasks_).select("query", "path", "path_matches", "basename_matches")
