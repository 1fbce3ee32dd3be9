"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; two are linked if their sets have a Jaccard
similarity of at least 0.8. Documents with equal sets are one class, and only one member of each
takes part in the join. A set is embedded as COORDINATES minwise tokens, of which similar sets share
most. Each run picks a token position, so that the sets fall into buckets by their token there, and
large buckets are split again and again by further sampled positions (two a level, so that a pair of
similar sets stays together in one of them). A bucket is compared by brute force when it is small,
when its sets are so alike that splitting does not separate them, or at the last level; large ones
in blocks of BLOCK rows, pair of blocks by pair of blocks.

Runs are repeated, RUNS at a time, until the recall that is measured reaches TARGET: SAMPLE sets, chosen by
a hash of their digest, are held against the tokens of all sets, and of the pairs that agree in at least
SEEN tokens (an estimated similarity of 0.78 or more) the share is counted that some bucket holds. A
pair of similarity 0.8 shares a given token with probability 0.8, so eight runs without splits miss it with
probability 0.2^8, about 3 in a million; each split keeps it with probability 0.96, so with three splits
in all runs it is (1 - 0.8 * 0.96^3)^8, about 5 in 100 000. More similar pairs are missed less often.

A pair that several buckets hold is compared in the first of them alone. First, the buckets are read
with the tokens only, and rows that have no partner of fitting size and tokens drop out; then the
shingle sets of the others are recomputed from their texts and compared exactly. Comparing yields
one row per member and bucket (its number of links, and a member that it is connected to), never the
pairs. Classes are the connected components of the links. The number of links of each document is
exact, so among n different texts that are all alike n^2 / 2 pairs are compared, in blocks, by many tasks.

Defined results: null texts and texts without words link to nothing and are classes of their own; a
text of one to four words is one shingle; rows that repeat an id are documents of their own (of wholly repeated ones ``keep_one`` keeps one, of those that
repeat id and text the one whose other columns are first as JSON), and the
class id is the smallest doc_id in the class (null if it has only null ids), which classes share where
ids repeat or are null; the class key, the smallest digest of a shingle set in the class, is a class's
own (null for texts without words); extra columns are ignored by ``join`` and carried by ``keep_one``;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import one_of, slices, written
from quillmesh.llm.shingles import mix, shingle_sets

SHINGLE = 5
#: Similarity as a fraction, so that comparing is exact.
NUM, DEN = 4, 5
COORDINATES, RUNS = 32, 8
#: Repeat runs until this share of the sample's pairs is found. The sample's size, and what counts as a pair in it.
TARGET, SAMPLE, SEEN = 0.999, 256, 25
#: A pair of similarity 0.8 agrees in fewer tokens than this once in a million.
LEAST_TOKENS = 14
SMALL, LEVELS, CHILDREN, ALIKE = 256, 4, 2, 0.5
BLOCK = 1024
TEXTS_AT_ONCE = 1_000_000
#: Rows of tokens that are Python objects, or rows of a matrix, at a time.
ROWS_AT_ONCE = 1024


def tokens(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens of each set (0 for empty sets)."""
    n = len(starts) - 1
    out = np.zeros((n, COORDINATES), dtype=np.int64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        for j in range(COORDINATES):
            x = mix(h ^ np.uint64(0x5851F42D4C957F2D * (j + 1) % (1 << 64)))
            out[full, j] = np.minimum.reduceat(x, starts[full]).view(np.int64)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, set_key (digest of the shingle set, null without words), n, tokens."""
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2), TEXTS_AT_ONCE):
                h, starts = shingle_sets(b.column(2).slice(lo, hi - lo).to_pylist(), SHINGLE)
                t = tokens(h, starts)
                n = np.diff(starts)
                keys = [hashlib.blake2b(h[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(starts[:-1], starts[1:])]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, COORDINATES), pa.int32()), pa.array(t.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), flat],
                                                 names=["doc_id", "text_id", "set_key", "n", "tokens"])

    return inner.mapInArrow(run, "doc_id long, text_id long, set_key binary, n long, tokens array<long>")


def buckets(reps: DataFrame, runs: range) -> DataFrame:
    """``reps``: rid, tokens. The buckets of these runs that are to be compared: key, rid, size."""
    first = [F.xxhash64(F.lit(r), F.get("tokens", F.lit(r * 5 % COORDINATES))) for r in runs]  # every run has a token of its own
    nodes = reps.select("rid", F.explode(F.array(*first)).alias("key"))
    leaves, spent = None, []
    for level in range(LEVELS):
        # Written, so that the join has two plain exchanges and Spark can split a large bucket's partition.
        sizes = written(nodes.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        nodes = written(nodes.join(sizes, "key"), "nodes", spent=[sizes])
        spent.append(nodes)
        large = nodes.filter(F.col("size") > SMALL)
        done = nodes if level == LEVELS - 1 else nodes.filter(F.col("size") <= SMALL)
        leaves = done if leaves is None else leaves.unionByName(done)
        if level == LEVELS - 1 or large.isEmpty():
            break
        full = large.join(reps, "rid")
        # The share of pairs that agree in a token, here one drawn by the key, estimates the mean similarity of the bucket.
        drawn = F.element_at("tokens", (F.pmod(F.xxhash64("key", F.lit("alike")), F.lit(COORDINATES)) + 1).cast("int"))
        seen = full.groupBy("key", "size", drawn.alias("token")).count()
        alike = seen.groupBy("key", "size").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
        alike = alike.filter(F.col("pairs") / (1.0 * F.col("size") * F.col("size")) >= ALIKE).select("key")
        leaves = leaves.unionByName(large.join(alike, "key", "left_semi"))
        loose = full.join(alike, "key", "left_anti")
        child = [F.xxhash64("key", F.lit(j), F.element_at("tokens", (F.pmod(F.xxhash64("key", F.lit(j)), F.lit(COORDINATES)) + 1).cast("int"))) for j in range(CHILDREN)]
        nodes = loose.select("rid", F.explode(F.array(*child)).alias("key"))
    return written(leaves.select("key", "rid", "size"), "buckets", spent=spent)


def with_leaves(reps: DataFrame, leaves: DataFrame) -> DataFrame:
    """rid, n, tokens, leaves (the keys of its buckets), of sets that are in any."""
    own = leaves.groupBy("rid").agg(F.collect_set("key").alias("leaves"))  # at most CHILDREN ** (LEVELS - 1) keys a run
    return reps.select("rid", "n", "tokens").join(own, "rid")


def measured(reps: DataFrame, about: DataFrame, size: int = SAMPLE) -> tuple[int, int]:
    """``about``: see ``with_leaves``. Of the pairs of a sample of sets with any set: how many agree in SEEN tokens
    and are of fitting size, and how many of these some bucket holds. Sets without a bucket count as missed."""
    spark = reps.sparkSession
    n_sets = reps.count()
    drawn = reps.filter(F.pmod(F.xxhash64("set_key"), F.lit(1 << 40)) < int(min(1.0, size / max(1, n_sets)) * (1 << 40))).select("rid", "n", "tokens").limit(4 * size)
    held = drawn.join(about.select("rid", "leaves"), "rid", "left").collect()  # about `size` rows
    asked = spark.sparkContext.broadcast((np.array([r.rid for r in held]), np.array([r.n for r in held]), np.array([r.tokens for r in held], dtype=np.int64).reshape(-1, COORDINATES), [set(r.leaves or ()) for r in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, sizes, tokens_, leaves = asked.value
        every = hits = 0
        for b in (b.slice(lo, ROWS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, ROWS_AT_ONCE)):
            t = np.array(b.column(2).flatten()).reshape(-1, COORDINATES)
            n = b.column(1).to_numpy()
            same = np.zeros((len(t), len(rids)), dtype=np.int8)
            for j in range(COORDINATES):
                same += t[:, j, None] == tokens_[None, :, j]
            fits = np.greater_equal.outer(DEN * n, NUM * sizes) & np.less_equal.outer(NUM * n, DEN * sizes)
            where, who = np.nonzero((same >= SEEN) & fits & (b.column(0).to_numpy()[:, None] != rids[None, :]))
            every += len(where)
            for i in np.unique(where):
                mine = set(b.column(3)[int(i)].as_py() or ())
                hits += sum(not mine.isdisjoint(leaves[k]) for k in who[where == i])
        yield pa.RecordBatch.from_arrays([pa.array([every]), pa.array([hits])], names=["every", "hits"])

    rows = reps.select("rid", "n", "tokens").join(about.select("rid", "leaves"), "rid", "left")
    got = rows.mapInArrow(run, "every long, hits long").agg(F.sum("every"), F.sum("hits")).first()
    return (got[0] or 0, got[1] or 0) if held else (0, 0)


def repeat_runs(reps: DataFrame, target: float = TARGET) -> tuple[DataFrame, DataFrame, float]:
    """The buckets of as many runs as reach the target, ``with_leaves`` of them, and the measured recall. Runs beyond
    COORDINATES begin with a token that an earlier one had and split by others. There is no last run: one finds
    a pair that agrees in SEEN tokens with a probability of 0.6 or more, so what is missing falls by half or more a run."""
    leaves, runs = None, 0
    while True:
        more = buckets(reps.select("rid", "tokens"), range(runs, runs + RUNS))
        leaves, runs = more if leaves is None else leaves.unionByName(more), runs + RUNS
        about = written(with_leaves(reps, leaves), "leaves")
        every, hits = measured(reps, about)
        if hits >= target * every:
            return leaves, about, hits / every if every else 1.0


def blocks(found: DataFrame) -> DataFrame:
    """Adds what a bucket's rows are dealt by: ``part`` (a pair of blocks) and ``side``, the row's block."""
    n = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    side = F.when(F.col("size") <= BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("rid"), n)).cast("int")
    rows = found.select("key", "rid", "size", side.alias("side"))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(j, F.col("side")).cast("long") * (1 << 31) + F.greatest(j, F.col("side")))
    return rows.select("key", "rid", "side", F.explode(pairs).alias("part"))


def groups_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their first ``n_keys`` columns."""
    held: list[tuple] = []
    for b in (b.slice(lo, ROWS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, ROWS_AT_ONCE)):
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:n_keys] != held[0][:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def may_link(n: np.ndarray, t: np.ndarray, leaves: list[list[int]], key: int, side: np.ndarray) -> np.ndarray:
    """Which pairs of a bucket (or of two blocks) are to be compared here."""
    m = len(n)
    ok = np.greater_equal.outer(DEN * n, NUM * n)
    ok &= ok.T.copy()
    same = np.zeros((m, m), dtype=np.int8)
    for j in range(t.shape[1]):
        same += np.equal.outer(t[:, j], t[:, j])
    ok &= same >= LEAST_TOKENS
    if side.min() != side.max():
        ok &= np.not_equal.outer(side, side)
    ok = np.triu(ok, 1)
    if ok.any():  # not those that an earlier bucket holds too
        earlier: dict[int, list[int]] = {}
        for i, mine in enumerate(leaves):
            for k in mine:
                if k < key:
                    earlier.setdefault(k, []).append(i)
        for members in earlier.values():
            if len(members) > 1:
                ok[np.ix_(members, members)] = False
    return ok


def intersections(sets: list[np.ndarray], ok: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row with partners: the row, the partners and the sizes of the intersections."""
    whole = np.concatenate(sets)
    _, where, counts = np.unique(whole, return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1
    shared = counts[where] > 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared]
    place = rank[where[shared]]
    width = (int(rank[-1]) + 64) // 64 if len(rank) else 1
    bits = np.zeros((len(sets), max(width, 1)), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    for i in np.flatnonzero(ok.any(axis=1)):
        partners = np.flatnonzero(ok[i])
        yield int(i), partners, np.bitwise_count(bits[partners] & bits[i]).sum(axis=1, dtype=np.int64)


def compare(n: np.ndarray, copies: np.ndarray, rids: np.ndarray, sets: list[np.ndarray], ok: np.ndarray) -> list[tuple[int, int, int]]:
    """(rid, links, a connected rid) of the rows that have links."""
    links = np.zeros(len(n), dtype=np.int64)
    top = list(range(len(n)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, partners, inter in intersections(sets, ok):
        good = partners[(NUM + DEN) * inter >= NUM * (n[i] + n[partners])]
        if len(good):
            links[i] += copies[good].sum()
            links[good] += copies[i]
            for j in good:
                a, b = find(i), find(int(j))
                if a != b:
                    top[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i in range(len(n)):
        r = find(i)
        least[r] = min(least.get(r, int(rids[i])), int(rids[i]))
    return [(int(rids[i]), int(links[i]), least[find(i)]) for i in np.flatnonzero(links)]


def linked(reps: DataFrame, docs: DataFrame) -> tuple[DataFrame, float]:
    """``reps``: rid, set_key, doc_id, text_id, copies, n, tokens. Per rid and bucket with links: rid, links, other; and
    the measured recall."""
    leaves, about, recall = repeat_runs(reps)
    rows = blocks(leaves).join(about, "rid").repartition("key", "part").sortWithinPartitions("key", "part")
    cols = ["key", "part", "rid", "side", "n", "tokens", "leaves"]

    def matrix(group):
        return (np.array([r[4] for r in group], dtype=np.int64), np.array([r[5] for r in group], dtype=np.int64), [r[6] for r in group], group[0][0], np.array([r[3] for r in group]))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=cols)

        for group in groups_of(batches, 2):
            if len(group) > 1:
                ok = may_link(*matrix(group))
                out += [group[i] for i in np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))]
                if len(out) >= 2000:
                    yield flush()
                    out.clear()
        if out:
            yield flush()

    schema = "key long, part long, rid long, side int, n long, tokens array<long>, leaves array<long>"
    candidates = written(rows.select("key", F.col("part").cast("long").alias("part"), "rid", "side", "n", "tokens", "leaves").mapInArrow(narrow, schema), "candidates")

    needed = candidates.select("rid").distinct().join(reps.select("rid", "doc_id", "text_id", "copies"), "rid")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    texts = keyed.join(needed, keyed.doc_id.eqNullSafe(needed.doc_id) & (keyed.text_id == needed.text_id)).select("rid", "copies", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2), TEXTS_AT_ONCE):
                h, starts = shingle_sets(b.column(2).slice(lo, hi - lo).to_pylist(), SHINGLE)
                packed = [h[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["rid", "copies", "shingles"])

    sets = written(texts.mapInArrow(shingled, "rid long, copies long, shingles binary").dropDuplicates(["rid"]), "shingles")
    full = candidates.join(sets, "rid").select(*cols, "copies", "shingles").repartition("key", "part").sortWithinPartitions("key", "part")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 2):
            ok = may_link(*matrix(group))
            found = compare(np.array([r[4] for r in group], dtype=np.int64), np.array([r[7] for r in group], dtype=np.int64), np.array([r[2] for r in group], dtype=np.int64),
                            [np.frombuffer(r[8], dtype=np.uint64) for r in group], ok)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["rid", "links", "other"])

    return written(full.mapInArrow(exact, "rid long, links long, other long"), "links"), recall


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b. The smallest id of each id's connected component: id, label. Every round takes
    the least label of the neighbours and of the label itself, so distances halve."""
    both = written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        new = written(step.join(jump, "to", "left").select("id", "old", F.least("to", "far").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def join(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, class_id, class_key, n_links (other documents that are similar), n_shingles, text_id;
    and in every row the recall of the sample's pairs that the runs reached."""
    marks = written(sketches(docs), "sketches")
    sets = marks.filter("set_key is not null").groupBy("set_key").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_id")).alias("first"), F.min("n").alias("n"),
                                                                       F.min("doc_id").alias("least"), F.first("tokens").alias("tokens"))
    reps = written(sets.select(F.monotonically_increasing_id().alias("rid"), "set_key", "copies", "first.doc_id", "first.text_id", "n", "least", "tokens"), "classes")
    found, recall = linked(reps, docs)
    labels = components(found.select(F.col("rid").alias("a"), F.col("other").alias("b")))
    ids = reps.select(F.col("rid").alias("id"), "least", "set_key").join(labels, "id").groupBy("label").agg(F.min("least").alias("class_id"), F.min("set_key").alias("class_key"))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    placed = reps.select("rid", "set_key", "copies", "least").join(counts, "rid", "left").join(labels.withColumnRenamed("id", "rid"), "rid", "left").join(ids, "label", "left")
    placed = placed.select("set_key", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("class_key", "set_key").alias("class_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = marks.select("doc_id", "text_id", "set_key", "n").join(placed, "set_key", "left")
    return out.select("doc_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.hex("class_key").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.col("n").alias("n_shingles"), "text_id", F.col("set_key").isNull().alias("alone"), F.lit(recall).alias("recall"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest doc_id."""
    names = docs.columns
    rows = written(join(docs), "near")
    best = rows.filter("not alone").groupBy("class_key").agg(F.min(F.struct("doc_id", "text_id")).alias("best")).select(F.col("best.doc_id").alias("__d"), F.col("best.text_id").alias("__t"))
    stay = best.unionByName(rows.filter("alone").select(F.col("doc_id").alias("__d"), F.col("text_id").alias("__t"))).distinct()
    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__d"), F.xxhash64("text").alias("__t"))
    stay = stay.withColumn("__d", F.coalesce("__d", F.lit(-(1 << 63))))
    # Rows that repeat id and text are one document.
    return one_of(keyed.join(stay, ["__d", "__t"], "left_semi"), ["__d", "__t"], names).select(*names)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_id", "alone")
