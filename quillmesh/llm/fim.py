"""Fill-in-middle: a text is cut at two places and its middle goes to the end.

Units are words with the space before them, and the space at the end of a text. A text is matched twice. The
first pass counts its units; from the count and a digest of seed and id follow two ranks. The second pass moves
a lazy iterator of matches on to the lower rank, and from there to the upper one, where it stops. No list of units
is made: beside the text and its output there are two offsets.

A text stays plain if it is empty, holds one of the sentinels (so that an output has each of them once, and the
text can be rebuilt from output and form), or is not chosen. ``restored`` rebuilds texts with column functions.

Rows are independent: nothing is shuffled, and a batch is worked off in slices of BATCH_CHARS bytes of text, so a
batch of long texts needs no more memory than its longest text or one slice. Defined results: a null text counts
as empty, is plain with no units and stays null in ``transform``; the digest of a null id is that of the seed and an
empty id; rows that repeat are each cut, at the same places; ties of the two ranks give an empty middle; texts of any
length are cut as a whole; extra columns are ignored by ``cut`` unless named in ``carry`` and carried by
``transform``, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import slices

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of texts that are cut, and percent of those with the suffix first.
CUT_PERCENT, SPM_PERCENT = 50, 80
#: Bytes of text that are Python objects at a time.
BATCH_CHARS = 4_000_000
CUT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def offsets(text: str, lower: int, upper: int) -> tuple[int, int]:
    """Where the units of the ranks ``lower`` <= ``upper`` end; rank 0 ends at the start."""
    matches = UNIT.finditer(text)

    def after(units: int, at: int) -> int:
        match = next(islice(matches, units - 1, None), None) if units else None
        return match.end() if match else at

    first = after(lower, 0)
    return first, after(upper - lower, first)


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def cut_text(doc_id: int | None, text: str | None, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> dict:
    text = text or ""
    n = count_units(text)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= cut_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    a, b = offsets(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    spm = h4 % 100 < spm_percent
    before, after = PREFIX + text[:a], SUFFIX + text[b:]
    output = "".join((after, before, MIDDLE, text[a:b]) if spm else (before, after, MIDDLE, text[a:b]))
    return {"n": n, "form": "spm" if spm else "psm", "prefix_chars": a, "middle_chars": b - a, "output": output}


def cut(docs: DataFrame, carry: list[str], seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The columns ``carry`` of ``docs``, then n, form, prefix_chars, middle_chars and output. A carried column of
    one of these names gives way to the result."""
    carry = [c for c in carry if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    inner = docs.select(*carry, F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    kept = len(carry)
    result = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(kept + 1), BATCH_CHARS):
                part = batch.slice(lo, hi - lo)
                ids, texts = part.column(kept).to_pylist(), part.column(kept + 1)
                rows = pa.array((cut_text(i, t.as_py(), seed, cut_percent, spm_percent) for i, t in zip(ids, texts)), result)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], rows], names=[*batch.schema.names[:kept], "__cut"])

    types = ", ".join([*(f"`{c}` {t}" for c, t in inner.dtypes[:kept]), f"__cut {CUT}"])
    return inner.mapInArrow(run, types).select(*carry, "__cut.*")


def transform(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with the texts as a model is trained on them."""
    names = docs.columns
    safe = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], "doc_id", "text")
    out = cut(safe, [f"c{i}" for i in range(len(names))], seed, cut_percent, spm_percent)
    given = f"c{names.index('text')}"
    return out.select(*[(F.when(F.col(given).isNotNull(), F.col("output")) if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: what lies between its sentinels, in the old order."""
    mark = len(PREFIX)
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    rest = lambda start: F.substr(output, start + mark)
    between = lambda start, end: F.substr(output, start + mark, end - start - mark)
    psm = F.concat(between(p, s), rest(m), between(s, m))
    spm = F.concat(between(p, m), rest(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS u
  FROM documents
), r AS (
  SELECT doc_id, t, u, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d
), f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op11_fim(spark, sf_dir: str) -> DataFrame:
    rows = cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
