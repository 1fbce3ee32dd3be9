"""Joining rows to the needles that they contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import staged

#: Characters of a gram, and how many different ones are broadcast to the rows; more meet them by a shuffle.
GRAM, MAX_BROADCAST = 3, 100_000
#: Needles up to which grams have GRAM characters, and each GRAM more.
PER_GRAM = 10_000


def _grams(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def containing(rows: DataFrame, hay: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs of ``rows`` and ``needles`` where the column ``hay`` contains ``needle``; empty needles are in no row. Rows
    meet a needle by its rarest gram, the one that the fewest rows have, and the pairs are looked at then: the work is in
    proportion to the rows and to what is nearly found, and no gram that all rows have brings them together unless it is
    the whole of a needle. The more needles there are the longer are the grams, so that not many needles share one.
    Needles that queries share are looked for once."""
    needles = staged(needles, "asked")
    each = staged(needles.select(F.col(needle).alias("__needle")).filter(F.length(needle) > 0).distinct(), "needles")
    gram, n, most = GRAM, each.count(), PER_GRAM
    while n > most:
        gram, most = gram + GRAM, most * 1000
    sizes = sorted(r.n for r in each.select(F.least(F.length("__needle"), F.lit(gram)).alias("n")).distinct().collect())  # gram rows at most
    own = F.when(F.length("__needle") >= gram, _grams(F.col("__needle"), gram)).otherwise(F.array("__needle"))
    of_needle = each.select("__needle", F.explode(F.array_distinct(own)).alias("__gram"))
    wanted = of_needle.select("__gram").distinct()
    small = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    every = F.array_distinct(F.flatten(F.array(*[_grams(F.col(hay), n) for n in sizes or [gram]])))
    # Of the rows only their grams are counted; they come themselves in the second pass, to the grams that stand for needles.
    met = rows.select(F.explode(every).alias("__gram"))
    counts = (met.join(F.broadcast(wanted), "__gram", "left_semi") if small else met).groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = of_needle.join(counts, "__gram", "left").groupBy("__needle").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("g"))
    rarest = staged(rarest.filter("g.n > 0").select("__needle", F.col("g.__gram").alias("__gram")), "rarest")
    few = rarest.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    meet = lambda some, stand: some.withColumn("__gram", F.explode(every)).join(stand, "__gram").filter(F.contains(hay, F.col("__needle"))).drop("__gram")
    if few:
        found = meet(rows, F.broadcast(rarest))
    else:  # what has grams is shuffled once for each of them: only the different hays, and the rows join what they contain
        found = rows.join(meet(rows.select(hay).distinct(), rarest.hint("shuffle_hash")).hint("shuffle_hash"), hay)
    asked = needles.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return found.join(F.broadcast(needles) if asked else needles.hint("shuffle_hash"), F.col("__needle") == F.col(needle)).drop("__needle")
