"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds CAPACITY words. Documents are placed in descending order of size, each into the bin with
the least room that takes it and that holds neither a document of the same source nor one of the
same duplicate cluster. Open bins are kept in order of their residual room and carry two bitmaps, of
the sources and of the clusters inside; the search starts at the successor of the document's size
and goes on until the first, and so tightest, compatible bin. The order is kept in blocks of bins, each
with the bits that all of its bins have, so a search passes a block in one step where every bin has the
document's source or cluster.

Bins are independent of each other, so the documents are dealt, by a hash of their place in the written
table of sizes, to shards of about ROWS_PER_SHARD rows, whose number grows with the table, and every shard
is packed by itself: sources, clusters and rows that repeat, of any number, are spread evenly over
shards, and a shard's bitmaps number its own sources and clusters only. A document longer than a bin is
cut into full bins and a rest, which is packed.

Defined results: a null text or one without words is one row of size 0 without a bin; documents
without a source or cluster conflict by the other alone; equal sizes go in order of doc_id (null
first), cluster and place; rows that repeat are packed each, in different bins (they are duplicates of each
other); extra columns are ignored; an empty table gives an empty result. The result has a row per
piece: doc_id, piece, start (first word), size, bin_id, bin_start (the piece's offset in the bin).
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import SPACE, word_count, written

CAPACITY = 2048
ROWS_PER_SHARD = 4096
SHARD_BITS = 24
#: Bins of a block of the order; blocks are split at twice as many.
PER_BLOCK = 32
OUT = "doc_id long, piece int, start long, size long, bin_id long, bin_start long"


class Bins:
    """Bins in order of (residual room, number), in blocks with the bits that all bins of a block have."""

    def __init__(self):
        self.blocks: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []  # of each block
        self.shared: list[tuple[int, int]] = []  # of each block: sources, clusters
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def new(self) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.sources) - 1

    def _refresh(self, k: int) -> None:
        block = self.blocks[k]
        if not block:
            del self.blocks[k], self.last[k], self.shared[k]
            return
        s, c = self.sources[block[0][1]], self.clusters[block[0][1]]
        for _, b in block:
            s &= self.sources[b]
            c &= self.clusters[b]
            if not (s or c):
                break
        self.last[k], self.shared[k] = block[-1], (s, c)

    def put(self, room: int, b: int) -> None:
        if not self.blocks:
            self.blocks, self.last, self.shared = [[]], [(0, 0)], [(0, 0)]
        k = min(bisect_left(self.last, (room, b)), len(self.blocks) - 1)
        block = self.blocks[k]
        block.insert(bisect_left(block, (room, b)), (room, b))
        if len(block) == 1:
            self.shared[k] = self.sources[b], self.clusters[b]
        else:
            self.shared[k] = self.shared[k][0] & self.sources[b], self.shared[k][1] & self.clusters[b]
        self.last[k] = block[-1]
        if len(block) > 2 * PER_BLOCK:
            self.blocks.insert(k + 1, block[PER_BLOCK:])
            del block[PER_BLOCK:]
            self.last.insert(k + 1, (0, 0))
            self.shared.insert(k + 1, (0, 0))
            self._refresh(k + 1)
            self._refresh(k)

    def take(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """The tightest compatible bin, taken out: (room, bin)."""
        first = bisect_left(self.last, (size, -1))
        for k in range(first, len(self.blocks)):
            s, c = self.shared[k]
            if s & source or c & cluster:
                continue
            block = self.blocks[k]
            for at in range(bisect_left(block, (size, -1)) if k == first else 0, len(block)):
                b = block[at][1]
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    found = block.pop(at)
                    self._refresh(k)
                    return found
        return None


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """``items``: (size, source bit, cluster bit), bits of 0 for none, in the order of placing. The bin
    and the offset in it of each."""
    bins = Bins()
    out = []
    for size, source, cluster in items:
        left, b = bins.take(size, source, cluster) or (capacity, bins.new())
        bins.sources[b] |= source
        bins.clusters[b] |= cluster
        out.append((b, capacity - left))
        if left > size:
            bins.put(left - size, b)
    return out


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """``rows``: doc_id, size, source, cluster, shard of one shard."""
    shard = int(rows["shard"].iloc[0])
    source_bit = {s: 1 << i for i, s in enumerate(sorted(x for x in rows["source"].unique() if x is not None))}
    counts = rows["cluster"].value_counts()
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(counts.index[counts > 1]))}
    pieces, items = [], []
    for doc, size, source, cluster in zip(rows["doc_id"], rows["size"], rows["source"], rows["cluster"]):
        full, rest = divmod(int(size), capacity)
        for k in range(full):
            pieces.append((doc, k, k * capacity, capacity))
        if rest or not full:
            pieces.append((doc, full, full * capacity, rest))
            if rest:
                items.append((rest, source, cluster, len(pieces) - 1))
    items.sort(key=lambda x: (-x[0], x[3]))
    placed = best_fit([(n, source_bit.get(s, 0), cluster_bit.get(c, 0)) for n, s, c, _ in items], capacity)
    n_bins = 1 + max((b for b, _ in placed), default=-1)
    bins = {at: (b, o) for (_, _, _, at), (b, o) in zip(items, placed)}
    out = []
    for i, (doc, k, start, size) in enumerate(pieces):
        if i in bins:
            b, o = bins[i]
        elif size:
            b, o, n_bins = n_bins, 0, n_bins + 1
        else:
            b, o = None, None
        out.append((doc, k, start, size, None if b is None else (shard << SHARD_BITS) + b, o))
    frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "size", "bin_id", "bin_start"])
    return frame.astype({"doc_id": "Int64", "bin_id": "Int64", "bin_start": "Int64"})


def pack(docs: DataFrame, capacity: int = CAPACITY, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``docs``: doc_id, text, source; documents with the same text, white space aside, are a cluster."""
    cluster = F.xxhash64(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), "source", cluster.alias("cluster"))
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "sizes")
    return pack_sized(rows, rows.count(), capacity, rows_per_shard)


def pack_sized(rows: DataFrame, n_rows: int, capacity: int = CAPACITY, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``rows``: doc_id, size, source, cluster (any label of its duplicates), place (a number of its own)."""
    shards = max(1, math.ceil(n_rows / rows_per_shard))
    dealt = rows.select("doc_id", "size", "source", "cluster", "place", F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.astype({"doc_id": "Int64"}).sort_values(["doc_id", "cluster", "size", "place"], na_position="first", kind="stable")
        part["source"] = part["source"].astype(object).where(part["source"].notna(), None)
        return pack_shard(part, capacity)

    return dealt.groupBy("shard").applyInPandas(run, OUT)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
