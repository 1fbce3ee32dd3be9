"""Quality rules: base counts and the divergence of a text's histograms from its language's.

Base counts are those of common heuristics: words, characters in words, markup symbols, lines that
repeat an earlier line, and words inside eight-word windows that occur again in the text. Beyond
them, two histograms of a text are held against references of its language, which are summed over
the whole corpus: the shares of character classes, and the shares of the language's common words
among the text's words. The measure is the Jensen-Shannon distance (base 2, between 0 and 1).
Short texts give coarse histograms, so a text is judged by its characters only from MIN_CHARS and by
its words only from MIN_WORDS on, and the limits widen as 1/sqrt(length) above that.

A word of the histogram is a run of letters and marks of any length in lower case. A first pass works out the
base counts and writes them with those words of the text; of the texts that pass the base rules all words are
counted there, which gives the COMMON_WORDS most frequent of each language; a second pass counts those in
each text, and their shares in texts that pass the base rules make the reference.

Everything is computed inside the row, apart from the word counts and the references (aggregates by
language and word); no text is shuffled. The words that are written take about 0.6 times the input until the second pass is done. Defined results: null and empty texts have no words and fail
the base rules; rows without a language are held against the reference of all such rows; a language whose
common words are rare (MIN_REFERENCE) is judged by characters only; ties among common words go to the
first in order; rows that repeat are judged each; extra columns are ignored unless they are named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import SPACE, let, words, written

WINDOW = 8
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Character classes, each counted in what the former leave.
CLASSES = (("lower", r"\p{Ll}+"), ("space", SPACE + "+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{N}+"), ("symbol", r"[#*$%&|<>]+"), ("letter", r"[\p{L}\p{M}]+"), ("stop", r"[.,;:!?]+"))
COMMON_WORDS = 24
#: Common words of all languages together that are listed in the plan.
MAX_LISTED = 4000
MIN_CHARS, MIN_WORDS = 100, 80
#: Limits for long texts, and what is added for short ones, divided by the root of the characters or words.
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.14, 3.0
MAX_WORD_DISTANCE, WORD_SLACK = 0.15, 2.2
MIN_REFERENCE = 0.05
MAX_BROADCAST = 5000


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Of a text given as the hashes of its words: how many words lie in windows that occur more than once."""
    n = F.size(hashes)
    keys = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(window)]))

    def covered(pairs):
        """pairs: sorted (key, place)."""
        last = F.size(pairs) - 1
        repeated = F.filter(pairs, lambda p, j: ((j > 0) & (F.get(pairs, j - 1)["k"] == p["k"])) | ((j < last) & (F.get(pairs, j + 1)["k"] == p["k"])))
        places = F.array_sort(F.transform(repeated, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        step = lambda acc, i: F.struct((i + window).alias("end"), (acc["sum"] + F.least(F.lit(window), i + window - acc["end"])).alias("sum"))
        return F.aggregate(places, start, step, lambda acc: acc["sum"])

    def count(k):
        sorted_pairs = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(sorted_pairs, covered))

    return F.when(n < window, F.lit(0)).otherwise(let(keys, count)).cast("long")


def spaced(text: Column) -> Column:
    """The runs of letters and marks of a text in lower case, with two spaces between any two of them."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", "  "))


def fails(n: Column, repeated: Column) -> Column:
    """The base rules, of the number of words and of those in repeated windows."""
    return (n < MIN_BASE_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def base(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, the base counts, the language's key, the counts of character classes and the words of the histogram
    with two spaces between them (__spaced)."""
    rows = docs.select(*carry, F.col("lang").alias("__lang"), F.coalesce("text", F.lit("")).alias("__t"))
    rows = rows.withColumn("__w", words(F.col("__t"))).withColumn("__n", F.length("__t"))
    left, counts = F.col("__t"), []
    for name, pattern in CLASSES:
        rows = rows.withColumn(f"__without_{name}", F.regexp_replace(left, pattern, "")).withColumn(f"__left_{name}", F.length(f"__without_{name}"))
        left = F.col(f"__without_{name}")
    before = F.col("__n")
    for name, _ in CLASSES:
        counts.append((before - F.col(f"__left_{name}")).cast("long"))
        before = F.col(f"__left_{name}")
    counts.append(before.cast("long"))
    place = {name: i for i, (name, _) in enumerate(CLASSES)}
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    rows = rows.select(
        *carry, "__lang", F.size("__w").cast("long").alias("n_words"), F.array(*counts).alias("__classes"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(F.transform("__w", lambda w: F.xxhash64(w)), repeat_words).alias("n_repeat_words"), spaced(F.col("__t")).alias("__spaced"),
    )
    rows = rows.withColumn("word_chars", F.aggregate("__classes", F.lit(0).cast("long"), lambda a, x: a + x) - F.get("__classes", F.lit(place["space"])))
    rows = rows.withColumn("n_symbols", F.get("__classes", F.lit(place["symbol"])))
    return rows.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))


def most_frequent(rows: DataFrame, most: int = COMMON_WORDS) -> DataFrame:
    """``rows`` of ``base``. Per language the most frequent words of its texts that pass the base rules: __of, __words (in
    order of frequency)."""
    every = rows.filter("not base_failed").select(F.col("__lang").alias("lang"), F.explode(F.split("__spaced", "  ")).alias("word")).filter("word <> ''")
    counts = every.groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= most)
    return top.groupBy(F.col("lang").alias("__of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("__words"))


def frequent(docs: DataFrame, most: int = COMMON_WORDS) -> DataFrame:
    """``most_frequent`` of texts."""
    return most_frequent(base(docs, []), most)


def _by_language(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``side`` has a row of fixed size per language, and is broadcast up to MAX_BROADCAST of them."""
    small = side.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return rows.join(F.broadcast(side) if small else side, F.col("__lang").eqNullSafe(F.col(key)), "left").drop(key)


def n_words(x: Column) -> Column:
    """Of words with two spaces between them."""
    return F.when(x == "", F.lit(0)).otherwise(F.length(F.replace(x, F.lit("  "), F.lit("   "))) - F.length(x) + 1)


def occurrences(x: Column, word: Column) -> Column:
    """How often a word is among them: each has a space of its own on either side."""
    own = F.concat(F.lit(" "), word, F.lit(" "))
    whole = F.concat(F.lit(" "), x, F.lit(" "))
    return ((F.octet_length(whole) - F.octet_length(F.replace(whole, own, F.lit("")))) / (F.octet_length(word) + 2)).cast("long")


def measure(rows: DataFrame, words_of: DataFrame) -> DataFrame:
    """``rows`` of ``base`` with the histogram of words in place of the words. ``words_of``: see ``most_frequent``."""
    listed = [r.w for r in words_of.select(F.explode("__words").alias("w")).distinct().limit(MAX_LISTED + 1).collect()]
    common = (lambda w: w.isin(*listed)) if 0 < len(listed) <= MAX_LISTED else (lambda w: F.array_contains("__words", w))
    among = lambda x: F.array_join(F.filter(F.split(x, "  "), common), "  ")  # the common words, so that counting reads less
    own = let(among(F.col("__spaced")), lambda c: F.transform("__words", lambda w: occurrences(c, w)))
    histogram = F.struct(n_words(F.col("__spaced")).alias("all"), own.alias("of"))
    return _by_language(rows, words_of, "__of").withColumn("__histogram", histogram).drop("__spaced", "__words")


def references(measured: DataFrame, words_of: DataFrame) -> DataFrame:
    """Per language: shares of character classes, the places of its common words among the frequent ones and
    their shares of all words (with the rest as the last share). One row per language; texts that fail the
    base rules don't count."""
    good = measured.filter(~F.col("base_failed"))
    k = len(CLASSES) + 1
    sums = [F.sum(F.get("__classes", F.lit(i))).alias(f"c{i}") for i in range(k)]
    hits = [F.sum(F.get("__histogram.of", F.lit(i))).alias(f"w{i}") for i in range(COMMON_WORDS)]
    total = sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0"))
    sums = good.groupBy(F.col("__lang").alias("__ref")).agg(*sums, *hits, F.sum("__histogram.all").alias("all_words"))
    sums = sums.join(words_of, F.col("__ref").eqNullSafe(F.col("__of")), "left")
    ranked = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"w{i}") > 0, F.struct((-F.col(f"w{i}")).alias("less"), F.get("__words", F.lit(i)).alias("word"), F.lit(i).alias("place"))) for i in range(COMMON_WORDS)])))
    rows = sums.select("__ref", "all_words", F.array(*[F.col(f"c{i}") / F.greatest(total, F.lit(1)) for i in range(k)]).alias("ref_chars"), ranked.alias("top"))
    share = F.transform("top", lambda x: -x["less"] / F.col("all_words"))
    return rows.select("__ref", "ref_chars", F.transform("top", lambda x: x["place"]).alias("ref_places"),
                       let(share, lambda s: F.concat(s, F.array(F.greatest(F.lit(0.0), 1 - _total(s))))).alias("ref_shares"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), _total(terms) / 2))


def judge(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds char_distance, word_distance (null where a text is too short to tell) and kept."""
    rows = _by_language(measured, refs, "__ref")
    n_chars = _total(F.transform("__classes", lambda x: x.cast("double")))
    p_chars = let(n_chars, lambda n: F.transform("__classes", lambda x: x / F.greatest(n, F.lit(1.0))))
    hits = F.transform("ref_places", lambda i: F.get("__histogram.of", i) / F.greatest("__histogram.all", F.lit(1)))
    p_words = let(hits, lambda h: F.concat(h, F.array(F.greatest(F.lit(0.0), 1 - _total(h)))))
    usable = (F.col("n_words") >= MIN_WORDS) & (1 - F.element_at("ref_shares", -1) >= MIN_REFERENCE)
    rows = rows.withColumn("char_distance", F.when(n_chars >= MIN_CHARS, js_distance(p_chars, F.col("ref_chars"))))
    rows = rows.withColumn("word_distance", F.when(usable, js_distance(p_words, F.col("ref_shares"))))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE + CHAR_SLACK / F.sqrt(F.greatest(n_chars, F.lit(1.0)))) | (
        F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE + WORD_SLACK / F.sqrt(F.greatest("n_words", F.lit(1))))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)


def assess(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, the base counts, base_failed, the two distances and kept."""
    rows = written(base(docs, carry), "base", compression="zstd")
    words_of = written(most_frequent(rows), "frequent")
    measured = written(measure(rows, words_of), "quality", spent=[rows])
    out = judge(measured, written(references(measured, words_of), "references", spent=[words_of]))
    return out.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
