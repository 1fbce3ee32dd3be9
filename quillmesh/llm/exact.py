"""Exact deduplication by content-defined chunk recipes.

Texts count as equal when they agree after deleting white space. Each normalised text is cut into
chunks at content-defined places; the distinct chunks are gathered once (each task first drops the
chunks it has already seen, so a copied text is moved about once per task and not once per copy),
and it is verified that every 128-bit chunk identifier stands for one content. A text is then its ordered
list of identifiers, its recipe; recipes are compared, texts are not moved again. Should contents share an
identifier, these chunks alone, in all recipes, stand for themselves, and the result stays exact (with
more than MAX_REPAIRS such identifiers, which takes an attack on the hash, all chunks do).

Defined results: null counts as the empty text, and all texts without a visible character form one
group with an empty recipe; of equal texts the row with the most code points in the original text,
then the smallest doc_id (null first) stays, and of rows that repeat both one (``keep_first``: the one whose
other columns are first as JSON); extra columns are ignored by ``groups`` and carried by ``keep_first``; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import SPACE, one_of, written

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Identifiers with more than one content that are listed in the plan.
MAX_REPAIRS = 1000
#: A chunk ends after the first of these, beyond MIN_CHUNK characters.
BOUNDARY = "(?:[ae][nrst]|[io][nrs]|[0-9][02468])"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK, boundary: str = BOUNDARY) -> Column:
    """Content-defined chunks, which together are the whole text."""
    return F.regexp_extract_all(norm, F.lit(f"(?s).{{{least},{most}}}?{boundary}|.{{1,{most}}}"), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def ambiguous_ids(docs: DataFrame, **sizes) -> DataFrame:
    """Chunk identifiers that stand for more than one content."""
    c = docs.select(F.explode(chunks(normalised(F.col("text")), **sizes)).alias("chunk"))
    return c.select(chunk_id(F.col("chunk")).alias("id"), "chunk").distinct().groupBy("id").count().filter("count > 1")


def recipes(docs: DataFrame, **sizes) -> DataFrame:
    """A row per document: row_id, doc_id, n_points, text_sha256 and the recipe."""
    shared = [r.id for r in ambiguous_ids(docs, **sizes).limit(MAX_REPAIRS + 1).collect()]
    itself = lambda c: F.encode(F.concat(F.lit("=" * 17), c), "UTF-8")  # longer than an identifier
    if not shared:
        one = chunk_id
    elif len(shared) <= MAX_REPAIRS:
        one = lambda c: F.when(chunk_id(c).isin(*[F.lit(x) for x in shared]), itself(c)).otherwise(chunk_id(c))
    else:
        one = itself
    base = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised(F.col("text")).alias("norm"))
    return written(base.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"),
                               F.transform(chunks(F.col("norm"), **sizes), one).alias("recipe")), "recipes")


def groups(docs: DataFrame, **sizes) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points, n_chunks."""
    r = recipes(docs, **sizes)
    best = F.min(F.struct((-F.col("n_points")).alias("less"), "doc_id", "row_id"))
    # Written, so that the join has two plain exchanges and Spark can split the partition of a group with a third of all rows.
    g = written(r.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1"), "groups")
    out = r.join(g.withColumnRenamed("recipe", "of"), F.col("recipe") == F.col("of"), "left")
    alone = F.col("of").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("row_id") == F.col("best.row_id"))).alias("kept"), "text_sha256", "n_points", F.size("recipe").alias("n_chunks"))


def keep_first(docs: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = docs.columns
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    stay = groups(docs, **sizes).filter("kept").select(text_id.alias("__d"), F.col("text_sha256").alias("__h"), F.col("n_points").alias("__n"))
    keyed = docs.select(*names, text_id.alias("__d"), F.sha2(normalised(F.col("text")), 256).alias("__h"),
                        F.length(F.coalesce("text", F.lit(""))).alias("__n"))
    # Rows that repeat id, text and length are one document; the keys are those of the join, so nothing is dealt out anew.
    return one_of(keyed.join(stay, ["__d", "__h", "__n"], "left_semi"), ["__d", "__h", "__n"], names).select(*names)


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS rn
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_points", "n_chunks")
