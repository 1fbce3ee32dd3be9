"""What several operators share: the word pattern, the shared folder, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import fresh_path, staged as written  # noqa: F401

#: Characters between words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

def one_of(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``keys`` and ``names``: one row for each value of ``keys``; where several rows have the same keys, the one
    whose other columns come first as JSON, so that reruns agree. Rows stay dealt by ``keys``."""
    other = F.to_json(F.struct(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names) if n != "text"], F.lit(0).alias("none")))
    whole = F.struct(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)])
    best = rows.groupBy(*keys).agg(F.min_by(whole, other).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.c{i}").alias(n) for i, n in enumerate(names)])


def words(text: Column) -> Column:
    """The runs of non-space characters of a text; an empty array for null and for texts without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE + "+"))).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether models must not learn from a row: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text each (a longer text is a range of its own), so that a
    batch of long texts is turned into Python objects a little at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi
    pa.default_memory_pool().release_unused()
