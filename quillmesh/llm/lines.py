"""Line deduplication by range-partitioned hashes.

A line's key is the line without the white space at its ends and with A to Z in lower case. A first pass over the
texts writes, per document, the 128-bit digests of its lines' keys. These become narrow rows of digest, document
and position, which are range-partitioned by digest and document and sorted by digest, document and position: a
digest's rows lie together, a very common one is cut into ranges by its documents, and each task streams over its
rows and meets the first occurrence of a digest in each document when the document changes. The counts of first
occurrences are added up by task before they are shuffled, so a digest costs at most a row in each range that it
reaches.

What is found goes back to the documents as bitmaps: of each document a bit per line, in words of 64 lines, and
only the words with a line to drop, so a document that keeps everything has none. ``bitmaps`` returns them; texts
move once, in ``apply``, to meet their bitmap. With ``keep_first`` the first of all lines with
a key stays, in the order of doc_id (null first), digest of the text and position.

Defined results: null and empty texts have one empty line; lines without ``min_chars`` code points in their key
always stay; a row is a document of its own, also where rows repeat an id or a text; rows that repeat both share a
bitmap (under ``keep_first`` all of them keep what one keeps); texts and lines may have any length; extra columns
are ignored by ``bitmaps`` and carried by ``apply``; an empty table gives an empty result.
Lines whose keys share a 128-bit digest count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import SPACE_CHARS, let, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Digests of 16 bytes that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What Unicode's lower case leaves as it is, beside ASCII; with other characters A to Z are mapped one by one.
UNCASED = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Zs}]"
WORD = 64


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    return F.when(text.rlike(UNCASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def digests(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """The digest of each line's key, null for lines that always stay."""
    key = lambda line: let(trimmed(line), lambda k: F.when(F.length(k) >= max(1, min_chars), F.unhex(F.md5(k))))
    return F.transform(F.split(ascii_lower(text), "\n"), key)


def identity(docs_text: Column, doc_id: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("__d"), F.unhex(F.md5(docs_text)).alias("__h")]


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row per document, written: row, doc_id, its identity __d and __h, keys."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *identity(t, F.col("doc_id")), digests(t, min_chars).alias("keys"))
    return written(rows, "lines")


def common(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys in at least ``min_docs`` documents, written: key, n_docs, first (doc_id, __h and at of the first occurrence)."""
    rows = lines.select("row", "doc_id", "__h", F.posexplode("keys").alias("at", "key")).filter("key is not null")
    dealt = rows.repartitionByRange(_partitions(rows), "key", "doc_id", "__h", "row")
    # Partitioned by all columns of the ranges, so the window needs no further exchange; it holds one row at a time.
    stream = Window.partitionBy("key", "doc_id", "__h", "row").orderBy("at")
    firsts = dealt.withColumn("nth", F.row_number().over(stream)).filter("nth = 1")
    counts = firsts.groupBy("key").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "__h", "at")).alias("first"))
    return written(counts.filter(F.col("n_docs") >= min_docs), "common-lines")


def bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """A row per identity (__d, __h) of documents that lose lines: n_dropped and ``keep``, an array of (word, bits) in
    ascending order, where bit i of word w tells whether line 64 w + i stays; words that are not in it keep all their lines."""
    lines = occurrences(docs, min_chars)
    keys = common(lines, min_docs)
    rows = lines.select("doc_id", "__d", "__h", F.posexplode("keys").alias("at", "key")).filter("key is not null")
    small = keys.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    of = keys.select(F.col("key").alias("k"), *(["first"] if keep_first else []))
    hit = rows.join(F.broadcast(of) if small else of, F.col("key") == F.col("k"), "inner" if keep_first else "left_semi")
    if keep_first:
        hit = hit.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__h") == F.col("first.__h")) & (F.col("at") == F.col("first.at"))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % WORD)
    bits = hit.groupBy("__d", "__h", F.floor(F.col("at") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("drop"))
    keep = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits"))))
    return written(bits.groupBy("__d", "__h").agg(F.sum(F.bit_count("drop")).alias("n_dropped"), keep.alias("keep")), "bitmaps", spent=[lines, keys])


def dense(keep: Column, n_words: Column) -> Column:
    """A bitmap with all its words."""
    ones = lambda n: F.array_repeat(F.lit(-1).cast("long"), n.cast("int"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"])
    filled = F.flatten(F.transform(keep, lambda x, i: F.concat(ones(x["word"] - before(i) - 1), F.array(x["bits"]))))
    return F.concat(filled, ones(n_words - F.element_at(keep, -1)["word"] - 1))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of a text that its bitmap keeps; all for a null bitmap."""
    def pick(lines):
        return let(dense(keep, F.ceil(F.size(lines) / WORD)), lambda words: F.filter(lines, lambda _, i: F.getbit(F.get(words, F.floor(i / WORD).cast("int")), i % WORD) == 1))
    return F.when(keep.isNull(), text).otherwise(F.array_join(let(F.split(text, "\n"), pick), "\n"))


def _meet(docs: DataFrame, carry: list[str], packed: DataFrame) -> DataFrame:
    """``carry`` (as c0, c1, ..), __text and each row's bitmap, with which the texts move once."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], t.alias("__text"), *identity(t, F.col("doc_id")))
    return rows.join(packed, ["__d", "__h"], "left")


def apply(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """``docs`` without the lines that are dropped; a null text stays null."""
    names = docs.columns
    packed = bitmaps(docs, min_docs, min_chars, keep_first)
    rows = _meet(docs, names, packed)
    given = F.col(f"c{names.index('text')}")
    new = F.when(given.isNotNull(), kept_text(F.col("__text"), F.col("keep")))
    return rows.select(*[(new if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), k AS (
  SELECT r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), a AS (
  SELECT r, count(c.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL) AS kept FROM k LEFT JOIN c ON k.key = c.key GROUP BY r
)
SELECT doc_id, len(ls)::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN a USING (r)
"""


def op12_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = bitmaps(docs)
    rows = _meet(docs, ["doc_id"], packed)
    n_lines = F.length("__text") - F.length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1
    return rows.select(F.col("c0").alias("doc_id"), n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                       F.sha2(kept_text(F.col("__text"), F.col("keep")), 256).alias("kept_sha256"))
