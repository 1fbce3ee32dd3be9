"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a weight schedule g(t) over training time t in
[0, 1]. The schedule's integral G(t), scaled to the target, is the source's cumulative demand for
words; a document whose copy begins at cumulative word y of its source is trained on at the time t
at which the demand reaches y. Sorting by t interleaves the sources in the scheduled proportions.

The cumulative word counts are prefix sums in two levels (per source and bucket of the order key,
then within a bucket), so that no task holds a source: a source with a third of all rows is spread
over as many buckets as the row count asks for. The order key is a digest of id and text; rows that
repeat both are one row with a count until they have their places. Sources are numbered by range and place
in the range, and targets are found by resharing in rounds, so no task holds all sources either.

Defined results: a null or empty text has size 0, is taken 0 words and has no position; a null
source is a source of its own, the last in order; rows that repeat an id are separate documents (``mix`` takes
the other columns of the one of those that repeat the text and the source too that is first as JSON);
extra columns are ignored by ``plan`` and carried by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import one_of, word_count, written

WEIGHTS = (3, 1, 2)
#: Weight at the start and the end of training, in the order of WEIGHTS; linear in between.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
SHARE, CAP = 1.5, 2
ROWS_PER_BUCKET = 4000
#: Rows that repeat are expanded by so many at a time.
COPIES_AT_ONCE = 4096


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``__k``, the place of each source in the order of code points, null last."""
    order = F.col("source").asc_nulls_last()
    dealt = written(sizes.repartitionByRange(_partitions(sizes), order).withColumn("__range", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("__range").count()  # a row per range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    rows = dealt.join(F.broadcast(counts), F.col("__range") == F.col("__r"))
    return rows.withColumn("__k", F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1).drop("__range", "__r", "__before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
            schedules: Sequence[tuple[float, float]] = SCHEDULES) -> DataFrame:
    """``sizes``: one row per source with its ``source_size``. Adds ``target`` (shares by weight; what exceeds
    ``cap`` times a source's size is reshared until none does) and the schedule's ends ``g0``, ``g1``."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("__k") % len(values) + 1).cast("int"))
    s = ranked(sizes).select("source", "source_size", pick(weights).alias("w"), pick([a for a, _ in schedules]).alias("g0"), pick([b for _, b in schedules]).alias("g1"))
    s = written(s, "weights")
    of = lambda rows: [x or 0 for x in rows.agg(F.sum("source_size"), F.sum("w"), F.count("*")).first()]
    words, w, _ = of(s)
    level, full = share * words / w if w else 0.0, 0
    while True:
        over = F.lit(level) * F.col("w") > cap * F.col("source_size")
        full_words, full_w, n = of(s.filter(over))
        if n == full or full_w == w:
            return s.select("source", "source_size", "g0", "g1", F.when(over, (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))
        level, full = (share * words - cap * full_words) / (w - full_w), n


def _keyed(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and what places a row: the digest of its id and text orders a source at random, the same in each run."""
    tie = F.concat(F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select(*keep, F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"), F.md5(tie).alias("__key"), tie.alias("__tie"))


def _placed(docs: DataFrame, carry: Sequence[str], weights, share, cap, schedules) -> DataFrame:
    """``carry``, __source, __size, __tie and __mix, a struct of source_size, target, taken and positions (one per
    copy taken), for each row of ``docs``."""
    rows = _keyed(docs, carry).groupBy(*carry, "__source", "__size", "__key", "__tie").agg(F.count("*").alias("__n"))
    rows = written(rows, "mix")
    about = rows.agg(F.sum("__n").alias("rows"), F.max("__n").alias("most")).first()
    digits = max(1, min(7, math.ceil(math.log(max((about.rows or 0) / ROWS_PER_BUCKET, 1), 16))))
    rows = rows.withColumn("__bucket", F.substring("__key", 1, digits))
    buckets = rows.groupBy("__source", "__bucket").agg(F.sum(F.col("__size") * F.col("__n")).alias("__words"))
    sources = targets(buckets.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size")), weights, share, cap, schedules)
    running = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("__source", "__bucket", F.coalesce(F.sum("__words").over(running), F.lit(0)).alias("__start"))
    starts = starts.join(sources, F.col("__source").eqNullSafe(F.col("source")), "inner").select(
        F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__start", "source_size", "target", "g0", "g1")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(F.col("__size") * F.col("__n")).over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    if (about.most or 0) > 1:
        rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
        if about.most > COPIES_AT_ONCE:  # a group of any number of rows is written by many tasks
            rows = rows.repartition(_partitions(rows), "__tie", "__from")
        rows = rows.withColumn("__nth", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + COPIES_AT_ONCE, F.col("__n")) - 1))).drop("__from")
    else:
        rows = rows.withColumn("__nth", F.lit(0))
    begin = F.col("__start") + F.col("__in") + F.col("__nth") * F.col("__size")
    middles = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: k * F.col("source_size") + begin + F.col("__size") / F.lit(2.0))
    used = F.when(F.col("__size") > 0, F.filter(middles, lambda y: y < F.col("target"))).otherwise(F.array().cast("array<double>"))

    def when_due(y):
        u, g0, g1 = y / F.col("target"), F.col("g0"), F.col("g1")
        return F.when(g0 == g1, u).otherwise((F.sqrt(g0 * g0 + (g1 * g1 - g0 * g0) * u) - g0) / (g1 - g0))

    rows = rows.withColumn("__used", used)
    mix = F.struct("source_size", "target", (F.size("__used") * F.col("__size")).alias("taken"), F.transform("__used", when_due).alias("positions"))
    return rows.withColumn("__mix", mix).select(*carry, "__source", "__size", "__tie", "__mix")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position (of the first
    copy, null if none), range-sorted by position. Texts are read once and never shuffled."""
    out = _placed(docs, ["doc_id"], weights, share, cap, schedules)
    out = out.select("doc_id", F.col("__size").alias("size"), "__mix.source_size", "__mix.target", "__mix.taken",
                     F.size("__mix.positions").alias("copies"), F.round(F.get("__mix.positions", F.lit(0)), 9).alias("position"), "__tie")
    order = [F.col("position").asc_nulls_last(), F.col("__tie")]
    return out.repartitionByRange(_partitions(out), *order).sortWithinPartitions(*order).drop("__tie")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """The mixed training set itself: the columns of ``docs``, a row per copy taken, range-sorted by
    training position."""
    names = docs.columns
    # Positions are computed without the texts, which move twice: to their positions, and in their order.
    # Rows that repeat id, text and source are one text with the positions of all of them.
    origin = F.concat(F.when(F.col("__source").isNull(), "-").otherwise("+"), F.coalesce("__source", F.lit("")))
    placed = _placed(docs, [], weights, share, cap, schedules)
    # Written, so that the join meets plain columns and the texts stay dealt as they are for picking one of those that repeat.
    placed = written(placed.select("__tie", origin.alias("__from"), F.explode("__mix.positions").alias("__position")), "positions")
    every = one_of(_keyed(docs, names).withColumn("__from", origin), ["__tie", "__from"], names)
    copies = every.join(placed, ["__tie", "__from"]).select(*names, "__tie", "__position")
    return copies.repartitionByRange(_partitions(docs), "__position", "__tie").sortWithinPartitions("__position", "__tie").select(*names)


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         md5(coalesce(lpad(doc_id::VARCHAR, 20, '0'), '') || md5(coalesce(text, ''))) AS k
  FROM documents
), src AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][i % 3 + 1] AS w, [1.0, 1.5, 0.5][i % 3 + 1]::DOUBLE AS g0, [1.0, 0.5, 1.5][i % 3 + 1]::DOUBLE AS g1 FROM src
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - 2 * coalesce(sum(source_size) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, g0, g1,
         CASE WHEN level * w > 2 * source_size THEN 2.0 * source_size::DOUBLE
              ELSE max(CASE WHEN level * w <= 2 * source_size THEN level END) OVER () * w END AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.g0, t.g1,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (mid < target)::INT + (mid + source_size < target)::INT END AS copies, mid / target AS u FROM p
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target, (copies * size)::BIGINT AS taken, copies::INT AS copies,
       CASE WHEN copies = 0 THEN NULL WHEN g0 = g1 THEN round(u, 9) ELSE round((sqrt(g0 * g0 + (g1 * g1 - g0 * g0) * u) - g0) / (g1 - g0), 9) END AS position
FROM c
"""


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
