"""Retrieval: BM25, TF-IDF, RAKE, synonyms and completion, for many tasks at once.

Corpus-side work reads the index (postings and lengths, see ``index``), which is written once; documents are
not tokenised again for a batch of tasks. The terms of the tasks restrict the postings first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.contain import containing
from quillmesh.session import staged

K1, B = 1.2, 0.75


def idf_bm25(n_docs: Column, df: Column) -> Column:
    """Robertson's idf, kept above zero."""
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


#: Terms that are broadcast to the postings; of more, the postings meet them by a shuffle.
MOST_TERMS = 100_000


def matches(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (key, term, tf) of the terms (a column term, each once). Terms are broadcast behind a check of
    their number. Beyond it both sides are dealt by term: a posting is a row per document and term already."""
    small = terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    return postings.join(F.broadcast(terms) if small else terms, "term")


def bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame, key: str = "path", k1: float = K1, b: float = B, every: bool = False) -> DataFrame:
    """``postings``: key, term, tf; ``lengths``: key, len; ``queries``: query, term (distinct). query, key, score,
    n_terms of all documents with any term (with ``every``: with all). Documents themselves are not read."""
    found = staged(matches(postings, staged(queries.select("term").distinct(), "terms")), "found")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).first()
    weighed = found.join(df, "term").join(lengths, key)
    part = idf_bm25(F.lit(corpus.n_docs), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(corpus.avg_len or 1.0))))
    scores = weighed.select(key, "term", part.alias("part")).join(queries, "term").groupBy("query", key).agg(F.sum("part").alias("score"), F.count("*").alias("n_terms"))
    if every:
        wanted = queries.groupBy("query").agg(F.count("*").alias("wanted"))
        scores = scores.join(wanted, "query").filter("n_terms = wanted").drop("wanted")
    return scores


def top(scored: DataFrame, n: int, group: str, score: str, tie: str) -> DataFrame:
    """The ``n`` best of each group with their rank; scores are rounded first, so ties are ties."""
    s = scored.withColumn(score, F.round(score, 6))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).filter(F.col("rank") <= n)


def tf_idf(postings: DataFrame | None, lengths: DataFrame | None, terms_of: DataFrame, stored=None) -> DataFrame:
    """``postings``, ``lengths`` of the corpus, or its ``stored`` index (see ``blocks``); ``terms_of``: query, tokens.
    query, term, tf, idf, tfidf."""
    own = terms_of.select("query", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("query", "term").agg((F.count("*") / F.first("len")).alias("tf"))
    own = staged(own, "own")
    terms = own.select("term").distinct()
    if stored is not None:
        df, n_docs = stored.frequency(terms), stored.n_docs
    else:
        df, n_docs = matches(postings, terms).groupBy("term").agg(F.count("*").alias("df")), lengths.count()
    idf = F.log(F.lit(n_docs + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    return own.join(df, "term", "left").select("query", "term", "tf", idf.alias("idf"), (F.col("tf") * idf).alias("tfidf"))


def weights(terms_of: DataFrame, postings: DataFrame | None = None, lengths: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """query, term, tfidf: by the corpus where there is one that has documents, else by the look of the terms."""
    if postings is not None and lengths is not None and not lengths.isEmpty():
        return tf_idf(postings, lengths, terms_of).select("query", "term", "tfidf")
    return tf_idf_heuristic(terms_of, baseline).select("query", "term", "tfidf")


def specificity(term: Column) -> Column:
    """What stands in for an idf where there is no corpus."""
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    return (F.lit(1.0) + add(F.length(term) > 8, 0.5) + add(F.length(term) > 12, 0.3) + add(F.contains(term, F.lit("_")) | term.rlike("[a-z][A-Z]"), 0.8)
            + add(term.rlike("[0-9]"), 0.4) + add((term == F.upper(term)) & (F.length(term) > 2), 0.3))


def tf_idf_heuristic(terms_of: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``terms_of``: query, tokens; ``baseline``: term, freq. query, term, ord (first place), tf, tfidf."""
    own = terms_of.select("query", F.size("tokens").alias("len"), F.posexplode("tokens").alias("ord", "raw")).withColumn("term", F.lower("raw"))
    own = own.groupBy("query", "term").agg((F.count("*") / F.first("len")).alias("tf"), F.min("ord").alias("ord"))
    idf = specificity(F.col("term"))
    if baseline is not None:
        own = own.join(baseline, "term", "left")
        idf = F.coalesce(F.log(1 / (F.col("freq") + 0.01)) + 1, idf)
    return own.select("query", "term", "ord", "tf", (F.col("tf") * idf).alias("tfidf"))


def candidate_phrases(text: Column, stopwords: list[str], most: int = 4, least: int = 2) -> Column:
    """RAKE's phrases of a text in order: runs of words between stop words and sentence ends, and each
    run's first word by itself; longer runs than ``most`` words drop out."""
    stop = F.array(*[F.lit(s) for s in stopwords])
    sentences = F.filter(F.split(F.lower(text), r"[.!?;:\n\r]+"), lambda s: F.btrim(s) != "")
    tokens = F.transform(sentences, lambda s: F.filter(F.split(s, r"[^a-z0-9_-]+"), lambda w: F.length(w) >= least))
    # Stop words become separators of a string of words, which is split at them.
    runs = F.flatten(F.transform(tokens, lambda ws: F.split(F.array_join(F.transform(ws, lambda w: F.when(F.array_contains(stop, w), F.lit("|")).otherwise(w)), " "), r"\|")))
    words = F.filter(F.transform(runs, lambda r: F.filter(F.split(r, " "), lambda w: w != "")), lambda ws: F.size(ws) > 0)
    return F.flatten(F.transform(words, lambda ws: F.when(F.size(ws) <= most, F.array(F.slice(ws, 1, 1), ws)).otherwise(F.array(F.slice(ws, 1, 1)))))


def rake(tasks: DataFrame, stopwords: list[str]) -> DataFrame:
    """``tasks``: query, text. query, phrase, ord, score of the phrases of several words."""
    p = tasks.select("query", F.posexplode(candidate_phrases(F.col("text"), stopwords)).alias("ord", "words"))
    w = p.select("query", F.explode("words").alias("word"), (F.size("words") - 1).alias("degree"))
    w = w.groupBy("query", "word").agg(((F.sum("degree") + F.count("*")) / F.count("*")).alias("word_score"))
    several = p.filter(F.size("words") > 1).groupBy("query", "words").agg(F.min("ord").alias("ord"))
    parts = several.select("query", "words", "ord", F.explode("words").alias("word")).join(w, ["query", "word"])
    return parts.groupBy("query", "words", "ord").agg(F.sum("word_score").alias("score")).select("query", F.array_join("words", " ").alias("phrase"), "ord", "score")


def expand_synonyms(terms: DataFrame, stems: DataFrame, dictionary: DataFrame, translations: DataFrame) -> DataFrame:
    """``terms``: term; ``stems``: term, stem; ``dictionary``: lang, key, synonym; ``translations``: stem,
    english. term, expansion: the term, its stems and their translations, the synonyms of all these, and
    one more hop of synonyms."""
    base = terms.select("term", F.lower("term").alias("expansion"))
    own_stems = base.join(stems.select(F.col("term").alias("expansion"), "stem"), "expansion").select("term", F.col("stem").alias("expansion"))
    english = own_stems.join(translations.select(F.col("stem").alias("expansion"), "english"), "expansion").select("term", F.col("english").alias("expansion"))
    near = base.union(own_stems).union(english).distinct()
    synonyms = dictionary.select(F.col("key").alias("expansion"), "synonym").distinct()
    first = near.join(synonyms, "expansion").select("term", F.col("synonym").alias("expansion"))
    collected = near.union(first).union(terms.select("term", F.col("term").alias("expansion"))).distinct()
    second = collected.join(synonyms, "expansion").select("term", F.col("synonym").alias("expansion"))
    return collected.union(second).distinct()


def dictionary(groups: DataFrame, stems: DataFrame) -> DataFrame:
    """``groups``: lang, group, word. lang, key (word or stem), synonym."""
    members = groups.select("lang", "group", F.lower("word").alias("synonym"))
    keys = groups.select("lang", "group", F.lower("word").alias("key"))
    by_stem = keys.join(stems.select(F.col("term").alias("key"), "stem"), "key").select("lang", "group", F.col("stem").alias("key"))
    return keys.union(by_stem).distinct().join(members, ["lang", "group"]).select("lang", "key", "synonym").distinct()


def complete(names: DataFrame, query: str, n: int, kind: str, name: str = "name") -> DataFrame:
    """Completion: names that contain the query, those that begin with it first (paths: whose basename
    or a directory does), then shorter ones; topped up by acronym matches among the ACRONYM_POOL
    shortest names that begin with its first letter. ``kind`` is file or symbol. name, source, rank."""
    q = query.lower()
    low = F.lower(F.col(name))
    rows = names.select(F.col(name).alias("name")).distinct()
    if kind == "file":
        rows = rows.filter(~F.contains(F.col("name"), F.lit("/vendor/")) & ~F.contains(F.col("name"), F.lit("/node_modules/")))
    low = F.lower("name")
    begins = F.contains(low, F.lit("/" + q)) if kind == "file" else low.startswith(q)
    hits = rows.filter(F.contains(low, F.lit(q))).select("name", F.lit(0).alias("source"), F.when(begins, 0).otherwise(1).alias("o1"), F.length("name").alias("o2"))
    hits = hits.orderBy("o1", "o2", "name").limit(n)
    if len(query) >= 3:
        first = next((c for c in q if c.isascii() and c.isalnum()), None)
        own = F.contains(low, F.lit(f"/{first}")) if kind == "file" else low.startswith(first or "")
        pool = rows.filter(own).orderBy(F.length("name"), "name").limit(ACRONYM_POOL)
        shown = T.basename(F.col("name")) if kind == "file" else F.col("name")
        more = pool.filter(T.matches_acronym(shown, query)).select("name", F.lit(1).alias("source"), F.lit(0).alias("o1"), F.length("name").alias("o2"))
        hits = hits.unionByName(more).groupBy("name").agg(F.min(F.struct("source", "o1", "o2")).alias("o")).select("name", "o.source", "o.o1", "o.o2")
    rank = F.row_number().over(Window.orderBy("source", "o1", "o2", "name"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= n).select("name", "source", "rank")


ACRONYM_POOL = 200


def has_synonyms(terms: DataFrame, stems: DataFrame, dictionary: DataFrame, translations: DataFrame) -> DataFrame:
    """``terms`` that the dictionary or a translation knows, by themselves or by a stem."""
    base = terms.select("term", F.lower("term").alias("key"))
    keys = base.union(base.join(stems.select(F.col("term").alias("key"), "stem"), "key").select("term", "stem")).distinct()
    known = dictionary.select("key").union(translations.select(F.col("stem").alias("key"))).distinct()
    return keys.join(known, "key", "left_semi").select("term").distinct()


def frequent_keywords(terms_of: DataFrame, most: int = 20) -> DataFrame:
    """``terms_of``: query, tokens. query, term, n, rank by frequency alone, equal ones in order."""
    own = terms_of.select("query", F.posexplode("tokens").alias("ord", "term")).groupBy("query", "term").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "ord"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= most).select("query", "term", "n", "rank")


REFERENCE = r"@([\w\-./]*\w)"


def at_references(tasks: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``tasks``: query, text. query, ref, kind (file, symbol), target of every @name: with an extension the
    best file that contains it, else the best symbol, else the best file. Shorter targets are better."""
    refs = tasks.select("query", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)))).alias("ref")).withColumn("low", F.lower("ref"))
    refs = refs.withColumn("ext", F.col("ref").rlike(r"\.\w+$"))
    each = refs.select("ref", "low").distinct()
    file = containing(files.select("path", F.lower("path").alias("hay")), "hay", each, "low").select("ref", "path", F.when(F.contains(F.lower("path"), F.concat(F.lit("/"), "low")), 0).otherwise(1).alias("o"))
    file = file.groupBy("ref").agg(F.min(F.struct("o", F.length("path").alias("n"), "path")).alias("f"))
    symbol = containing(symbols.select("name", F.lower("name").alias("hay")).distinct(), "hay", each, "low").select("ref", "name", F.when(F.lower("name").startswith(F.col("low")), 0).otherwise(1).alias("o"))
    symbol = symbol.groupBy("ref").agg(F.min(F.struct("o", F.length("name").alias("n"), "name")).alias("s"))
    both = refs.join(file, "ref", "left").join(symbol, "ref", "left")
    as_symbol = ~F.col("ext") & F.col("s").isNotNull()
    out = both.select("query", "ref", F.when(as_symbol, "symbol").otherwise("file").alias("kind"), F.when(as_symbol, F.col("s.name")).otherwise(F.col("f.path")).alias("target"))
    return out.filter("target is not null")
