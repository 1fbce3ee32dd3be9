"""Queries on the catalogue, text functions and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import blocks, index, retrieve
from quillmesh.plans.values import Grown, Values
from quillmesh.plans.words import STOPWORDS
from quillmesh.session import staged, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: path, content."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/doc_"), "doc_id", F.lit("."), F.when(F.col("doc_id") % 3 == 0, "md").when(F.col("doc_id") % 3 == 1, "py").otherwise("ts")).alias("path"), F.col("text").alias("content"))


CORPUS_SQL = """corpus AS (SELECT doc_id, 'src/' || source || '/doc_' || doc_id || '.' || CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'py' ELSE 'ts' END AS path, text AS content FROM documents)"""
TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH {CORPUS_SQL} SELECT path, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' ELSE 'typescript' END AS language, strlen(content)::BIGINT AS size, md5(content) AS hash
FROM corpus WHERE strlen(content) BETWEEN 1 AND 1048576""")
def file_catalog(spark, sf):
    """Admitted files with language, size and fingerprint."""
    return index.catalogue(corpus(spark, sf)).drop("mtime")


@query("SELECT page_id, CASE regexp_extract(lower(regexp_extract(url, '^[^?#]*')), '\\.([a-z0-9]+)$', 1) WHEN 'html' THEN 'html' WHEN 'php' THEN 'php' WHEN 'js' THEN 'javascript' ELSE 'unknown' END AS language, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages")
def url_language_dim(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.language(F.regexp_replace(F.regexp_extract("url", r"^([^?#]*)", 1), r"^https?://[^/]+$", "")).alias("language"), F.regexp_extract("url", r"://([^/?#]+)", 1).alias("host"))


@query("SELECT d.doc_id, d.lang, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1")
def pk_lookup(spark, sf):
    keys = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(keys, "doc_id")


@query("SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'orders', count(*)::BIGINT FROM orders UNION ALL SELECT 'lineitem', count(*)::BIGINT FROM lineitem")
def corpus_stats(spark, sf):
    return index.statistics(**{t: table(spark, sf, t) for t in ("documents", "orders", "lineitem")})


def second_version(files: DataFrame) -> DataFrame:
    """Another state of the corpus: every tenth file changed, every eleventh gone, every thirteenth twice under a new name."""
    changed = files.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))).filter("doc_id % 11 <> 0")
    return changed.unionByName(files.filter("doc_id % 13 = 0").withColumn("path", F.concat(F.lit("new/"), "path")))


V2_SQL = CORPUS_SQL + """, v2 AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 0 THEN content || ' changed' ELSE content END AS content FROM corpus WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 'new/' || path, content FROM corpus WHERE doc_id % 13 = 0)"""


@query(f"""WITH {V2_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN md5(a.content) <> md5(b.content) THEN 'changed' ELSE 'unchanged' END AS change
FROM corpus a FULL JOIN v2 b ON a.path = b.path""")
def hash_change_detection(spark, sf):
    old = corpus(spark, sf)
    mark = lambda df: df.select("path", F.md5("content").alias("hash"))
    return index.changes(mark(old), mark(second_version(old)))


@query(f"""WITH {V2_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM corpus a FULL JOIN v2 b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR md5(a.content) <> md5(b.content)""")
def directory_changes(spark, sf):
    """What changed, found by digests of directories."""
    mark = lambda df: df.select("path", F.md5("content").alias("hash"))
    old = corpus(spark, sf)
    return index.tree_changes(mark(old), mark(second_version(old)))


@query(f"""WITH {V2_SQL}, u AS (SELECT path, content, 1 AS v FROM v2 UNION ALL SELECT path, content, 0 FROM corpus)
SELECT path, md5(content) AS hash FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY v DESC) = 1""")
def upsert_latest(spark, sf):
    old = corpus(spark, sf)
    keep = lambda df: df.select("path", F.md5("content").alias("hash"))
    return index.upsert(keep(old), keep(second_version(old)))


@query(f"""WITH {V2_SQL}, p AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest({TOKENS.format('content')}) AS term FROM corpus) GROUP BY ALL)
SELECT path, count(*)::BIGINT AS n_terms, sum(tf)::BIGINT AS n_tokens FROM p WHERE path IN (SELECT path FROM v2) GROUP BY path""")
def delete_cascade(spark, sf):
    """Postings after the vanished files have gone from them."""
    old = corpus(spark, sf)
    gone = index.changes(old.select("path", F.md5("content").alias("hash")), second_version(old).select("path", F.md5("content").alias("hash"))).filter("change = 'deleted'")
    left, = index.delete(gone, index.postings(old.filter("path is not null")))
    return left.groupBy("path").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query("SELECT md5(text) AS hash, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("""SELECT p_partkey, p_name, row_number() OVER (ORDER BY CASE WHEN starts_with(lower(p_name), 'red') THEN 0 ELSE 1 END, length(p_name), p_name, p_partkey)::INT AS rank
FROM part WHERE contains(lower(p_name), 'wi') QUALIFY rank <= 50""")
def like_search_ranked(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.lower("p_name").alias("low")).filter(F.contains("low", F.lit("wi")))
    w = Window.orderBy(F.when(F.col("low").startswith("red"), 0).otherwise(1), F.length("p_name"), "p_name", "p_partkey")
    top = p.orderBy(F.when(F.col("low").startswith("red"), 0).otherwise(1), F.length("p_name"), "p_name", "p_partkey").limit(50)
    return top.withColumn("rank", F.row_number().over(w)).drop("low")


NAMES = Values("path string", [(p,) for p in (
    "app/Http/Controllers/UserController.php", "app/Http/Controllers/UserContractController.php", "app/Models/User.php", "src/user/user-service.ts", "src/UserCard.tsx",
    "web/vendor/UserController.php", "lib/node_modules/uc/index.js", "docs/unit_cost.md", "src/utils/urlCache.ts", "src/UIComponents/UCButton.tsx", "tests/UserControllerTest.php", "a/b/c/usercontrol.py", "src/undoCommand.ts")])
NAMES = Grown(NAMES, ("part", "p_partkey IS NOT NULL", ["'shop/x_' || replace(p_name, ' ', '_') || '_' || p_partkey || '.ts'"]))


@query(f"""WITH n AS (SELECT DISTINCT path AS name FROM {NAMES.sql()} WHERE NOT contains(path, '/vendor/') AND NOT contains(path, '/node_modules/')),
s AS (SELECT name, list_transform(regexp_extract_all(regexp_replace(regexp_extract(name, '([^/]*)$', 1), '\\.[^.]+$', ''), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) AS seg FROM n),
h AS (SELECT name, 0 AS source, CASE WHEN contains(lower(name), '/ucon') THEN 0 ELSE 1 END AS o1, length(name) AS o2 FROM n WHERE contains(lower(name), 'ucon')
  UNION ALL SELECT name, 1, 0, length(name) FROM s WHERE contains(lower(name), '/u') AND regexp_matches(array_to_string(seg, ' '), '^u([a-z0-9]* )?c([a-z0-9]* )?o([a-z0-9]* )?n')),
g AS (SELECT name, min({{'source': source, 'o1': o1, 'o2': o2}}) AS o FROM h GROUP BY name)
SELECT name, o.source::INT AS source, row_number() OVER (ORDER BY o.source, o.o1, o.o2, name)::INT AS rank FROM g QUALIFY rank <= 8""")
def completion_topk(spark, sf):
    return retrieve.complete(NAMES.frame(spark, sf), "ucon", 8, "file", "path")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), '^r([a-z0-9]* )?w')")
def acronym_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").filter(T.matches_acronym(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " "), "rw"))


IDENTIFIERS = Values("id long, name string", list(enumerate((
    "manage_credit", "ManageCredit", "userProfileID", "SMSService", "HTTPServerError2", "simple", "a_b", "x", "kebab-case.name", "Category", "TaxBox", "branch", "__init__", "parseJSONFile"))))
IDENTIFIERS_SQL = f"""(SELECT * FROM {IDENTIFIERS.sql()} UNION ALL SELECT 100 + p_partkey, CASE p_partkey % 3 WHEN 0 THEN a || '_' || b || '_' || p_size WHEN 1 THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] || 'ID' ELSE a || '-' || b || '.v' || p_size END
  FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))"""


def identifiers(spark, sf):
    """Invented names, and those of all parts in three styles."""
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat(a, F.lit("_"), b, F.lit("_"), "p_size")).when(kind == 1, F.concat(F.initcap(a), F.initcap(b), F.lit("ID"))).otherwise(F.concat(a, F.lit("-"), b, F.lit(".v"), "p_size"))
    return IDENTIFIERS.frame(spark).unionByName(table(spark, sf, "part").select((F.col("p_partkey") + 100).alias("id"), name.alias("name")))


SPLIT_SQL = "regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"


@query(f"""SELECT id, name, list_filter(list_transform(string_split_regex({SPLIT_SQL.format('name')}, '[ \\-_.]'), lambda x: lower(x)), lambda x: length(x) >= 2) AS segments FROM {IDENTIFIERS_SQL}""")
def segment_identifiers(spark, sf):
    return identifiers(spark, sf).select("id", "name", T.identifier_segments(F.col("name")).alias("segments"))


PASCAL_SQL = "array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || w[2:]), '')"
SNAKE_SQL = "regexp_replace(lower(regexp_replace(name, '([A-Z])', '_\\1', 'g')), '^_', '')"


@query(f"""WITH f AS (SELECT id, name, contains(name, '_') AS s, regexp_matches(name, '[a-z][A-Z]|^[A-Z][a-z]') AS c FROM {IDENTIFIERS_SQL}),
v AS (SELECT id, name, unnest([name, lower(name), CASE WHEN s THEN string_split(name, '_')[1] || substr({PASCAL_SQL}, length(string_split(name, '_')[1]) + 1) END,
  CASE WHEN s THEN {PASCAL_SQL} END, CASE WHEN s THEN replace(name, '_', '') END, CASE WHEN c THEN {SNAKE_SQL} END]) AS variant FROM f)
SELECT DISTINCT id, name, variant FROM v WHERE variant <> ''""")
def case_variants(spark, sf):
    return identifiers(spark, sf).select("id", "name", F.explode(T.case_variants(F.col("name"))).alias("variant"))


@query(f"""WITH s AS (SELECT id, {SNAKE_SQL} AS s FROM {IDENTIFIERS_SQL})
SELECT id, CASE WHEN s LIKE '%y' THEN s[:-2] || 'ies' WHEN regexp_matches(s, '(s|x|ch|sh)$') THEN s || 'es' ELSE s || 's' END AS table_name FROM s""")
def snake_plural(spark, sf):
    return identifiers(spark, sf).select("id", T.snake_plural(F.col("name")).alias("table_name"))


@query("""WITH s AS (SELECT page_id, strlen(html) * (1 + page_id % 3 * 2000) AS n FROM pages)
SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round((n / 1024)::DECIMAL(24,6), 1)) || ' KB' ELSE printf('%.1f', round((n / 1048576)::DECIMAL(24,6), 1)) || ' MB' END AS size FROM s""")
def bytes_pretty(spark, sf):
    n = F.octet_length("html") * (1 + F.col("page_id") % 3 * 2000)
    return table(spark, sf, "pages").select("page_id", T.pretty_bytes(n).alias("size"))


@query("""WITH s AS (SELECT item_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM benchmark)
SELECT item_id, '20240131-120000-' || regexp_replace(s[:40], '-$', '') AS slug FROM s""")
def slugify(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.slug(F.col("text"), F.lit("2024-01-31 12:00:00").cast("timestamp")).alias("slug"))


SEARCHES = Values("id long, search string", list(enumerate(("user AND login", "test()", '"quoted" phrase', "return -1", "x", "", "NOT near or android", "a*b^c~d", "not"))))
SEARCHES = Grown(SEARCHES, ("benchmark", "item_id IS NOT NULL", ["1000 + item_id", "substr(text, 1, 60)"]))


@query(f"""WITH s AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(search, '[''"():\\-^~*]', ' ', 'g'), '(?i)\\b(AND|OR|NOT|NEAR)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM {SEARCHES.sql()})
SELECT id, CASE WHEN length(s) < 2 THEN '' ELSE s END AS clean FROM s""")
def sanitize_search(spark, sf):
    return SEARCHES.frame(spark, sf).select("id", T.sanitize_query(F.col("search")).alias("clean"))


KEYWORDS_SQL = "list_filter(string_split_regex(regexp_replace(lower({}), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2)"


@query(f"SELECT doc_id, len({KEYWORDS_SQL.format('text')})::INT AS n, md5(array_to_string({KEYWORDS_SQL.format('text')}, ' ')) AS tokens FROM documents")
def keyword_tokens(spark, sf):
    t = T.keyword_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query("""WITH w AS (SELECT conv_id, turn, i, regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g') AS w FROM (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '\\s+')) AS w, generate_subscripts(string_split_regex(lower(text), '\\s+'), 1) AS i FROM conversations)),
f AS (SELECT conv_id, turn, w, min(i) AS i FROM w WHERE length(w) >= 3 OR w IN ('ip', 'id', 'ui', 'db', 'api', 'cdn', 'sms', 'otp', 'ai', 'ml', 'io') GROUP BY ALL)
SELECT conv_id, turn, count(*)::INT AS n, md5(string_agg(w, ' ' ORDER BY i)) AS words FROM f GROUP BY ALL""")
def raw_words(spark, sf):
    w = T.raw_words(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("words")).filter("n > 0")


POSTINGS_SQL = f"p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL)"


@query(f"WITH {POSTINGS_SQL} SELECT doc_id, count(*)::BIGINT AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf)::BIGINT AS max_tf FROM p GROUP BY doc_id")
def term_frequency(spark, sf):
    p = index.postings(table(spark, sf, "documents"), "doc_id", "text")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


@query(f"WITH {POSTINGS_SQL} SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term")
def document_frequency(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("df"))


TFIDF_SQL = f"""own AS (SELECT item_id AS query, term, count(*) / any_value(n) AS tf FROM (SELECT item_id, len({TOKENS.format('text')}) AS n, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term),
w AS (SELECT query, own.term, round(tf * (ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) + 1), 6) AS tfidf FROM own LEFT JOIN df ON own.term = df.term),
k AS (SELECT query, term, tfidf, row_number() OVER (PARTITION BY query ORDER BY tfidf DESC, term)::INT AS rank FROM w)"""


def indexed(spark, sf) -> blocks.BlockIndex:
    """The stored index of the documents: written by the first query that asks for it."""
    return blocks.BlockIndex.stored(table(spark, sf, "documents"), "doc_id", "text")


def tfidf(spark, sf, n: int, of: blocks.BlockIndex) -> DataFrame:
    tasks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), T.search_tokens(F.col("text")).alias("tokens"))
    return retrieve.top(retrieve.tf_idf(None, None, tasks, of), n, "query", "tfidf", "term").select("query", "term", "tfidf", "rank")


@query(f"WITH {POSTINGS_SQL}, {TFIDF_SQL} SELECT query, term, tfidf, rank FROM k WHERE rank <= 20")
def tfidf_topk(spark, sf):
    return tfidf(spark, sf, 20, indexed(spark, sf))


@query(f"""WITH t AS (SELECT item_id, list_filter({KEYWORDS_SQL.format('text')}, lambda w: w NOT IN ({quoted(STOPWORDS)})) AS tokens FROM benchmark),
u AS (SELECT item_id, len(tokens) AS n, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS i FROM t),
o AS (SELECT item_id AS query, term, count(*) / any_value(n) AS tf, min(i) - 1 AS ord FROM u GROUP BY ALL),
s AS (SELECT query, term, ord::INT AS ord, round(tf * (1.0 + CASE WHEN length(term) > 8 THEN 0.5 ELSE 0 END + CASE WHEN length(term) > 12 THEN 0.3 ELSE 0 END + CASE WHEN contains(term, '_') OR regexp_matches(term, '[a-z][A-Z]') THEN 0.8 ELSE 0 END
  + CASE WHEN regexp_matches(term, '[0-9]') THEN 0.4 ELSE 0 END + CASE WHEN term = upper(term) AND length(term) > 2 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS tfidf FROM o)
SELECT query, term, ord, tfidf, row_number() OVER (PARTITION BY query ORDER BY tfidf DESC, ord)::INT AS rank FROM s QUALIFY rank <= 20""")
def tfidf_heuristic(spark, sf):
    """The top keywords of each task where there is no corpus."""
    kept = F.filter(T.keyword_tokens(F.col("text")), lambda w: ~w.isin(*STOPWORDS))
    tasks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), kept.alias("tokens"))
    return retrieve.top(retrieve.tf_idf_heuristic(tasks), 20, "query", "tfidf", "ord").select("query", "term", "ord", "tfidf", "rank")


@query(f"""WITH s AS (SELECT item_id AS query, unnest(string_split_regex(lower(text), '[.!?;:\\n\\r]+')) AS s, generate_subscripts(string_split_regex(lower(text), '[.!?;:\\n\\r]+'), 1) AS si FROM benchmark),
w AS (SELECT query, si, unnest(ws) AS w, generate_subscripts(ws, 1) AS wi FROM (SELECT query, si, list_filter(string_split_regex(s, '[^a-z0-9_-]+'), lambda x: length(x) >= 2) AS ws FROM s)),
i AS (SELECT query, si, wi, w, w IN ({quoted(STOPWORDS)}) AS stop, sum((w IN ({quoted(STOPWORDS)}))::INT) OVER (PARTITION BY query, si ORDER BY wi) AS isl FROM w),
r AS (SELECT query, si, isl, list(w ORDER BY wi) AS ws, min(wi) AS wi FROM i WHERE NOT stop GROUP BY ALL),
p AS (SELECT query, si, wi, 0 AS k, ws[:1] AS ws FROM r UNION ALL SELECT query, si, wi, 1, ws FROM r WHERE len(ws) <= 4),
d AS (SELECT query, w, (sum(n - 1) + count(*)) / count(*) AS score FROM (SELECT query, unnest(ws) AS w, len(ws) AS n FROM p) GROUP BY ALL),
f AS (SELECT query, ws, row_number() OVER (PARTITION BY query ORDER BY si, wi, k) - 1 AS ord FROM p),
m AS (SELECT query, ws, min(ord) AS ord FROM f WHERE len(ws) > 1 GROUP BY ALL),
x AS (SELECT m.query, array_to_string(m.ws, ' ') AS phrase, m.ord, round(sum(d.score), 6) AS score FROM (SELECT *, unnest(ws) AS w FROM m) m JOIN d ON m.query = d.query AND m.w = d.w GROUP BY ALL)
SELECT query, phrase, score::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord)::INT AS rank FROM x QUALIFY rank <= 10""")
def rake_topk(spark, sf):
    tasks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieve.top(retrieve.rake(tasks, STOPWORDS), 10, "query", "score", "ord").select("query", "phrase", "score", "rank")


BM25_SQL = """n AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM l),
b AS (SELECT q.query, p.doc_id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score, count(*) AS n_terms
  FROM q JOIN p ON q.term = p.term JOIN df ON df.term = p.term JOIN l ON l.doc_id = p.doc_id, n GROUP BY ALL)"""
LEN_SQL = f"l AS (SELECT doc_id, len({TOKENS.format('text')}) AS len FROM documents)"


@query(f"""WITH {POSTINGS_SQL}, {TFIDF_SQL}, {LEN_SQL}, q AS (SELECT query, term FROM k WHERE rank <= 8), {BM25_SQL},
t AS (SELECT query, doc_id, round(score, 6) AS score, n_terms FROM b)
SELECT query, doc_id, score, n_terms::BIGINT AS n_terms, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INT AS rank FROM t QUALIFY rank <= 10""")
def bm25_topk(spark, sf):
    """Flagship: the ten best documents for each benchmark item by the BM25 of its eight best keywords."""
    of = indexed(spark, sf)
    found = of.top(staged(tfidf(spark, sf, 8, of).select("query", "term"), "terms"), 10)
    return found.select("query", F.col("key").alias("doc_id"), "score", "n_terms", "rank")


@query(f"""WITH {POSTINGS_SQL}, {TFIDF_SQL}, {LEN_SQL}, q AS (SELECT query, term FROM k WHERE rank <= 3), {BM25_SQL}
SELECT query, doc_id, round(score, 6) AS score FROM b WHERE n_terms = (SELECT count(*) FROM q q2 WHERE q2.query = b.query)""")
def bm25_and_query(spark, sf):
    """Documents with all of each item's three best keywords."""
    of = indexed(spark, sf)
    terms = staged(tfidf(spark, sf, 3, of).select("query", "term"), "terms")
    found = retrieve.bm25(of.postings(terms.select("term").distinct()), of.docs, terms, "key", every=True)
    return found.select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
