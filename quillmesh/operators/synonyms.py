"""Synonyms of the words of tasks, and their use: a task in other words than the code's still finds it.

The groups are words that are used for each other when people talk about software; the translations lead
from stems of Italian words to English words. Both are text files of words; other ones can be given.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import stem as S
from quillmesh.operators import retrieve
from quillmesh.session import staged

WORDS = Path(__file__).resolve().parent.parent / "functions" / "words"
#: Files of groups, one a line, by language.
GROUPS = {"en": WORDS / "synonyms_en.txt", "it": WORDS / "synonyms_it.txt"}
#: Italian words and the English word of the same meaning, a pair a line.
TRANSLATIONS = WORDS / "translations_it.txt"
#: Expansions of a task's words that are looked for too.
MOST = 40


def lines(path: Path) -> list[list[str]]:
    """The words of each line of a file on the driver; blank lines and comments (#) are left out."""
    rows = (line.split("#")[0].split() for line in path.read_text(encoding="utf-8").splitlines())
    return [words for words in rows if words]


def tables(spark: SparkSession, groups: dict[str, Path] | None = None, translations: Path | None = None) -> tuple[DataFrame, DataFrame]:
    """The dictionary (lang, key, synonym) and the translations (stem, english), of the files given or those of the library."""
    words = [(lang, i, w) for lang, path in (groups or GROUPS).items() for i, line in enumerate(lines(path)) for w in line]
    groups = spark.createDataFrame(words, "lang string, group int, word string")
    pairs = spark.createDataFrame([(line[0], english) for line in lines(translations or TRANSLATIONS) for english in line[1:]], "term string, english string")
    dictionary = staged(retrieve.dictionary(groups, S.stems(groups.select(F.col("word").alias("term")))), "dictionary")
    return dictionary, pairs.join(S.stems(pairs.select("term")).filter("lang = 'it'"), "term").select("stem", "english").distinct()


def statistics(dictionary: DataFrame) -> DataFrame:
    """lang, n_keys, n_words, n_pairs of each language's dictionary."""
    return dictionary.groupBy("lang").agg(F.countDistinct("key").alias("n_keys"), F.countDistinct("synonym").alias("n_words"), F.count("*").alias("n_pairs"))


def widen(tasks: DataFrame, dictionary: DataFrame | None = None, translations: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """``tasks`` of ``resolve`` with the expansions of the keywords, and of the words of phrases, after them."""
    if dictionary is None or translations is None:
        dictionary, translations = tables(tasks.sparkSession)
    words = tasks.select("query", F.explode(F.array_distinct(F.flatten(F.transform("keywords", lambda k: F.split(F.lower(k), " "))))).alias("term"))
    each = staged(words.select("term").distinct(), "words")
    stems = staged(S.stems(each).select("term", "stem"), "stems")
    expanded = retrieve.expand_synonyms(each, stems, dictionary, translations).filter((F.length("expansion") > 2) & (F.col("expansion") != F.col("term")))
    more = words.join(expanded, "term").groupBy("query").agg(F.slice(F.array_sort(F.collect_set("expansion")), 1, most).alias("__more"))
    return tasks.join(more, "query", "left").withColumn("keywords", F.array_distinct(F.concat("keywords", F.coalesce("__more", F.array().cast("array<string>"))))).drop("__more")
