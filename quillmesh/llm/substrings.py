"""Suffix-array deduplication: remove every byte in a 200-byte string that also starts elsewhere.

Sorting the suffixes of a whole corpus in one array is not needed, for a 200-byte string and its copies
agree in everything, so also in where their smallest 40-byte gram (by hash, the leftmost of equal
ones) stands: the anchor. Equal strings have equal anchors at equal offsets, so the suffixes that can
match are those of the texts around equal anchors, and there the suffix arrays are built.

1. Each text is cut by anchors. An anchor owns the run of 200-byte strings whose anchor it is; its
   row has the gram's hash, a hash of the owned text, and how often the row occurs (texts are known by
   a 128-bit digest, so rows that repeat are one row with a count). Anchors whose gram is unique drop out.
2. The owned texts of a gram are a group. They are recoded: their left and right sides are cut wherever
   any two of them part, a piece between cuts is one symbol, and the core that none of them cuts is one
   symbol. If the offsets of the owned strings fall into E classes by that, a 200-byte string is a gram of
   E symbols. An owned text that occurs more than once stands in the group twice.
3. The suffix array of the group (by linear grouping, see ``suffixes``) and its LCP array show which
   grams of E symbols start more than once: neighbours with a common prefix of E symbols.
4. Two kinds of repeats are counted, and no array is built for them. Where all owned texts of a gram are equal
   there is nothing to order: each string has as many copies as the text. And where very many different owned
   texts meet (over MAX_SIDES), whose array would be too large for a task, the strings at each offset of the gram
   are grouped by their digests, so a group is small whatever a text is shared by.
5. Repeated strings lead back, by gram and owned text, to all texts that have them; each is cut once.

Rows of step 1 are a few numbers per about 80 bytes of text. Texts move twice, compressed. Owned texts
of a gram count as equal by a 64-bit hash, strings at one offset of a gram by another; a false match
needs a collision within a gram.

Defined results: null is the empty text; a text below 200 bytes loses nothing; removed runs that
touch are one span; rows that repeat are copies of each other, and all lose what they share; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import slices, written
from quillmesh.llm.shingles import _power, mix
from quillmesh.llm.suffixes import repeated_grams

LENGTH, GRAM = 200, 40
OFFSETS = LENGTH - GRAM + 1
#: Different owned texts that are gathered as one group; of more, each offset is a group.
MAX_SIDES = 4000
BATCH_BYTES = 1_000_000
#: Symbols sorted in one suffix array; a group is in one.
SORT_SYMBOLS = 20_000
#: Low bits of an anchor's place: how far the owned strings begin before it, at most and at least.
_BITS = np.int64(8)


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums, down


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts after each other: per anchor its text, gram hash, hash of the owned text, place in the
    text and the largest and smallest offset of an owned string's start before it."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return (empty,) * 6
    sums, down = prefix_hashes(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    packed = (grams & ~np.uint64((1 << 32) - 1)) | np.arange(len(grams), dtype=np.uint64)
    # Sliding minimum over OFFSETS grams, from prefix and suffix minima of blocks.
    padded = np.full(-(-len(packed) // OFFSETS) * OFFSETS + OFFSETS, np.iinfo(np.uint64).max)
    padded[: len(packed)] = packed
    blocks = padded.reshape(-1, OFFSETS)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    at = (np.minimum(behind[:n], ahead[OFFSETS - 1 : OFFSETS - 1 + n]) & np.uint64((1 << 32) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    begin = np.arange(n)
    inside = begin + LENGTH <= starts[1:][text]
    begin, at, text = begin[inside], at[inside], text[inside]
    if not len(begin):
        return (empty,) * 6
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    lo, hi, p, t = begin[first], begin[last], at[first], text[first]
    end = hi + LENGTH
    owned = mix((sums[end] - sums[lo]) * down[lo] + mix(((end - lo) * 256 + (p - lo)).astype(np.uint64)))
    return t, grams[p].view(np.int64), owned.view(np.int64), p - starts[t], p - lo, p - hi


TEXT = ["t1", "t2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """t1, t2 (together the text's digest), doc_id and the text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col("doc_id").cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("raw"))


def find_anchors(docs: DataFrame) -> DataFrame:
    """t1, t2, gram, owned, place (of the anchor, with the two offsets in its low bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2), BATCH_BYTES):
                raw = b.column(2).slice(lo, hi - lo).to_pylist()
                starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                t, gram, owned, p, most, least = anchors(np.frombuffer(b"".join(raw), dtype=np.uint8), starts)
                take = pa.array(t + lo)
                place = (p << (2 * _BITS)) | (most << _BITS) | least
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(gram), pa.array(owned), pa.array(place)], names=[*TEXT, "gram", "owned", "place"])

    return _keyed(docs).select(*TEXT, "raw").mapInArrow(run, "t1 long, t2 long, gram long, owned long, place long")


def _compressed(keyed: DataFrame, *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            last = b.num_columns - 1
            for lo, hi in slices(b.column(last), BATCH_BYTES):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array([z.compress(r) for r in part.column(last).to_pylist()], pa.binary())], names=[*b.schema.names[:last], "packed"])

    names = [*TEXT, *more]
    return keyed.select(*names, "raw").mapInArrow(run, ", ".join([*(f"{n} long" for n in names), "packed binary"]))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


def _from_members(docs: DataFrame, members: DataFrame, schema: str, rows_of: Callable) -> DataFrame:
    """``members``: gram, owned, copied and member, a text and a place in it. ``rows_of``: text, gram, owned,
    copied, place of the anchor, largest and smallest offset -> rows."""
    anchor = F.struct("gram", "owned", "copied", F.col("member.place").alias("place"))
    wanted = members.groupBy("member.t1", "member.t2").agg(F.collect_list(anchor).alias("anchors"))  # of one text
    texts = _compressed(_keyed(docs)).dropDuplicates(TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for packed, found in zip(b.column(0), b.column(1)):
                text = z.decompress(packed.as_py())
                for x in found.as_py():
                    place = x["place"]
                    rows += rows_of(text, x["gram"], x["owned"], x["copied"], place >> 16, place >> 8 & 255, place & 255)
                if len(rows) > 4000:
                    yield _rows(rows, schema)
                    rows = []
            if rows:
                yield _rows(rows, schema)

    return texts.join(wanted, TEXT).select("packed", "anchors").mapInArrow(run, schema)


SIDES = "gram long, owned long, copied boolean, most int, least int, left binary, right binary"


def sides(text: bytes, gram: int, owned: int, copied: bool, p: int, most: int, least: int) -> list[tuple]:
    """The owned text on either side of the anchor."""
    return [(gram, owned, copied, most, least, text[p - most : p], text[p : p - least + LENGTH])]


STRINGS = "gram long, owned long, copied boolean, o int, d1 long, d2 long"


def strings(text: bytes, gram: int, owned: int, copied: bool, p: int, most: int, least: int) -> list[tuple]:
    """A row per owned string: its offset and digest."""
    out = []
    for o in range(least, most + 1):
        d = hashlib.blake2b(text[p - o : p - o + LENGTH], digest_size=16).digest()
        out.append((gram, owned, copied, o, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
    return out


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def recode(group: list[tuple]) -> tuple[list[int], list[list[tuple]], list[tuple[int, int]]]:
    """Of the rows (of SIDES) of a gram: the offsets at which the classes of offsets begin (and the end of the
    last), and per row its symbols and the first and last class of its owned strings. The strings of a class of
    a row repeat, or do not, together."""
    cuts = {x for r in group for x in (r[4], r[3] + 1)}
    lefts = sorted(r[5][::-1] for r in group)
    rights = sorted(r[6] for r in group)
    for a, b in zip(lefts, lefts[1:]):
        cuts.add(common(a, b) + 1)
    for a, b in zip(rights, rights[1:]):
        cuts.add(LENGTH - common(a, b))
    low, high = min(r[4] for r in group), max(r[3] for r in group) + 1
    at = sorted(c for c in cuts if low <= c <= high)
    n = len(at) - 1
    place = {c: k for k, c in enumerate(at)}
    out, classes = [], []
    for _, _, _, most, least, left, right in group:
        first, last = place[least], place[most + 1] - 1
        # Left pieces from the outermost to the core, the core, right pieces outwards. A string at the k-th cut
        # reaches at[k] bytes to the left of the anchor and LENGTH - at[k] to the right.
        own = [("l", k, left[most - at[k] : most - at[k - 1]]) for k in range(last, 0, -1)]
        own.append(("c", 0, left[most - at[0] :], right[: LENGTH - at[n - 1]]))
        own += [("r", k, right[LENGTH - at[k] : LENGTH - at[k - 1]]) for k in range(n - 1, first, -1)]
        out.append(own)
        classes.append((first, last))
    return at, out, classes


DECIDED = "gram long, owned long, low int, high int"


def settle(groups: list[list[tuple]]) -> list[tuple]:
    """Per repeated run of owned strings (gram, owned, the smallest and largest offset), of groups of rows of SIDES."""
    texts, sizes, about = [], [], []
    known: dict[tuple, int] = {}
    for nth, group in enumerate(groups):
        at, coded, classes = recode(group)
        for row, own, (first, last) in zip(group, coded, classes):
            symbols = [known.setdefault((nth, *x), len(known)) for x in own]
            for again in range(2 if row[2] else 1):  # the last one's marks hold for both
                texts.append(symbols)
                sizes.append(len(at) - 1)
                about.append((row, at, last) if not again else None)
    out = []
    for here, seen in zip(about, repeated_grams(texts, sizes)):
        if here is None:
            continue
        (gram, owned, *_), at, last = here
        high = None  # of the run of repeated strings; the k-th gram is the string of class last - k
        for k, x in enumerate([*seen, False]):
            if x and high is None:
                high = at[last - k + 1] - 1
            elif not x and high is not None:
                out.append((gram, owned, at[last - k + 1], high))
                high = None
    return out


def by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle groups of sorted rows of SIDES."""
    groups: list[list[tuple]] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if not groups or groups[-1][0][0] != row[0]:
                if size >= SORT_SYMBOLS:
                    yield _rows(settle(groups), DECIDED)
                    groups, size = [], 0
                groups.append([])
            groups[-1].append(row)
            size += 8  # symbols of a row, most often
    if groups:
        yield _rows(settle(groups), DECIDED)


def decide(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts``: gram, owned, n, kinds, member. The repeated strings: DECIDED."""
    owned = texts.withColumn("copied", F.col("n") > 1)
    most, least = F.shiftrightunsigned("member.place", 8).bitwiseAND(F.lit(255)), F.col("member.place").bitwiseAND(F.lit(255))
    # Counted: one owned text at a gram, in all its copies.
    lone = owned.filter("kinds = 1 and copied").select("gram", "owned", least.cast("int").alias("low"), most.cast("int").alias("high"))
    few = _from_members(docs, owned.filter(f"kinds between 2 and {MAX_SIDES}"), SIDES, sides)
    few = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(by_gram, DECIDED)
    out = lone.unionByName(few)
    many = owned.filter(f"kinds > {MAX_SIDES}")
    if many.isEmpty():
        return out
    single = written(_from_members(docs, many, STRINGS, strings), "strings")
    key = ["gram", "o", "d1", "d2"]
    # Counted: the strings at each offset of a very common gram.
    counts = single.groupBy(*key).agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("times"))
    again = written(counts.filter("times > 1").select(*key), "repeated")
    return out.unionByName(single.join(again, key).select("gram", "owned", F.col("o").alias("low"), F.col("o").alias("high")))


def repeated(docs: DataFrame) -> DataFrame:
    """Per text with repeats: t1, t2, spans (array of begin, end in bytes; they may overlap)."""
    found = written(find_anchors(docs), "anchors")
    # Written, so that the join below has two plain exchanges and Spark can split a very common gram's partition.
    twice = written(found.groupBy("gram").agg(F.count("*").alias("grams")).filter("grams > 1").select("gram"), "twice")
    met = written(found.join(twice, "gram"), "met", spent=[found, twice])
    shared = written(met.groupBy(*TEXT, "gram", "owned", "place").agg(F.count("*").alias("n")), "shared", spent=[met])
    texts = written(shared.groupBy("gram", "owned").agg(F.sum("n").alias("n"), F.min(F.struct(*TEXT, "place")).alias("member")), "owned")
    varied = written(texts.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "varied")
    kinded = written(texts.join(varied, "gram", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))), "kinds", spent=[texts, varied])
    decided = written(decide(docs, kinded), "decided")
    p = F.shiftrightunsigned("place", 16)
    spans = shared.join(decided, ["gram", "owned"]).select(*TEXT, (p - F.col("high")).alias("b"), (p - F.col("low") + LENGTH).alias("e"))
    return written(spans.groupBy(*TEXT).agg(F.collect_list(F.struct("b", "e")).alias("spans")), "spans", spent=[shared, kinded, decided])


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the spans, the number of bytes and of runs removed."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for b, e in sorted(spans):
        if b > end:
            runs += 1
            kept.append(text[at:b])
            removed += e - b
        elif e > end:
            removed += e - end
        at = end = max(end, e)
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def remove(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        last, done = None, ()
        for b in batches:
            for lo, hi in slices(b.column(1), BATCH_BYTES):
                rows = []
                part = b.slice(lo, hi - lo)
                for doc_id, packed, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    if packed != last:  # copies of a text come after each other
                        text = z.decompress(packed)
                        kept, removed, runs = cut(text, [(s["b"], s["e"]) for s in spans.as_py() or ()])
                        last, done = packed, (len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
                    rows.append((doc_id, *done))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _compressed(_keyed(docs), "doc_id").join(repeated(docs), TEXT, "left").select("doc_id", "packed", "spans")
    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
