"""Merkle manifest of a dataset: a tree of digests per source and one over the sources.

A row's leaf is the digest of its fields. Leaves are numbered by source and doc_id without a task that holds a
source: they are range-partitioned in that order, counted by range, and numbered within their range. Then level
after level, a window partitioned by (source, parent), ordered by place and framed over all of it, collects the
digests of a run of ARITY nodes: the list is the preimage of the parent, and holds the siblings of each node. One
row of each run is kept, which is the parent in the next level and, written, the run of this one. The number of
levels is the logarithm of the largest source.

Proofs are made top-down: a run meets the path of its parent and hands each of its nodes that path with the node's
own siblings in front, so each level is joined once, with itself at the level above, and the rows shuffled are a
third of the leaves. The last level gives the leaves' paths without a further join, for runs of leaves carry the
rows' ids. A path is an array of (before, after), the siblings on either side, from the leaf to the root.

Digests are lower-case hex SHA-256 where they are hashed or returned, and 32 bytes where they are stored.

Defined results: a null field counts as "-", any other as its size in bytes, ":" and the value, so texts of any
length, empty ones and nulls differ; null ids come first, and are never tampered with; rows that repeat an id go in
the order of their leaves, and equal rows are leaves each; a null source is a source, the first; extra columns
are not part of a leaf unless ``fields`` names them; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
PATH = "array<struct<before: binary, after: binary>>"
#: Sources whose roots (100 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    own = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(*[own(c.cast("string")) for c in fields])


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and ``found``: the leaf of the row with ``tampered`` for its text, null where that is null."""
    own = [F.col(f) for f in fields]
    other = [tampered if f == "text" else F.col(f) for f in fields] if tampered is not None else None
    found = F.when(tampered.isNotNull(), leaf(other)) if other else F.lit(None).cast("binary")
    return docs.select("doc_id", "source", leaf(own).alias("leaf"), found.alias("found"))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` without ``group``, written, with ``g``, the number of the row's group, ``i``, its place in the group,
    from 0, both in ascending order with nulls first, and ``n``, the rows of the group. And the written groups: their
    columns, g, n."""
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = written(rows.repartitionByRange(_partitions(rows), *by).withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*group, "range").agg(F.count("*").alias("own"))  # a group has a row in each range that it reaches
    here = Window.partitionBy(*group)
    counts = counts.withColumn("start", F.sum("own").over(here.orderBy("range")) - F.col("own")).withColumn("n", F.sum("own").over(here))
    counts = written(counts, "range-counts")
    groups = _numbers(counts.select(*group, "n").distinct(), group)
    same = _all(F.col(f"c.{c}").eqNullSafe(F.col(f"n.{c}")) for c in group)
    starts = counts.alias("c").join(groups.alias("n"), same).select(F.col("c.range").alias("r"), "n.g", "c.n", "c.start", *[F.col(f"c.{c}").alias(f"__{c}") for c in group])
    out = dealt.join(starts, (F.col("range") == F.col("r")) & _all(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group))
    place = F.row_number().over(Window.partitionBy("range", "g").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    out = out.withColumn("i", F.col("start") + place - 1).drop("range", "r", "start", *group, *[f"__{c}" for c in group])
    return written(out, "numbered", spent=[dealt, counts]), groups


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _numbers(groups: DataFrame, group: Sequence[str]) -> DataFrame:
    """``groups`` with their numbers g, in order; by ranges too, as there may be any number of them."""
    by = [F.col(c).asc_nulls_first() for c in group]
    dealt = written(groups.repartitionByRange(_partitions(groups), *by).withColumn("range", F.spark_partition_id()), "group-ranges")
    counts = dealt.groupBy("range").agg(F.count("*").alias("own"))  # a row per range
    counts = counts.select(F.col("range").alias("r"), (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("start"))
    rows = dealt.join(F.broadcast(counts), F.col("range") == F.col("r"))
    return written(rows.withColumn("g", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1).drop("range", "r", "start"), "group-numbers")


def tree(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """``nodes``: g, i (from 0 in each g), n (nodes of g), h and any ``item`` of a node. The written runs of each
    level, from the leaves up (g, p, and nodes, an array of the run's h and item in order), and the written roots: g, h."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    runs, roots, level = [], [], nodes.withColumn("p", F.floor(F.col("i") / arity))
    while True:
        roots.append(level.filter("n = 1").select("g", "h"))
        if most <= 1:
            break
        run = Window.partitionBy("g", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        node = F.struct("h", "item") if not runs else F.struct("h")
        whole = level.filter("n > 1").withColumn("nodes", F.collect_list(node).over(run)).filter(F.col("i") % arity == 0)
        runs.append(written(whole.select("g", "p", "n", "nodes"), "runs"))
        up = runs[-1].select("g", F.col("p").alias("i"), F.ceil(F.col("n") / arity).alias("n"),
                             digest(F.array_join(F.transform("nodes", lambda x: hexed(x["h"])), "")).alias("h"))
        level, most = up.withColumn("p", F.floor(F.col("i") / arity)), -(-most // arity)
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return runs, written(out, "roots")


def paths(runs: list[DataFrame], tops: DataFrame, nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """The items of all ``nodes`` (see ``tree``) with their h and path. ``tops``: g, n and the path of g's root."""
    alone = nodes.filter("n = 1").select("g", "item", "h").join(tops.select("g", "path"), "g")
    out = alone.select("g", "item", "h", "path")
    none = F.lit("").cast("binary")
    together = lambda some: F.aggregate(some, none, lambda a, x: F.concat(a, x["h"]))
    above = None
    for level in range(len(runs) - 1, -1, -1):
        # Roots at this level: of groups that have more than one node here, and one in the next level.
        here = tops.filter((F.col("n") > arity ** level) & (F.col("n") <= arity ** (level + 1))).select(F.col("g").alias("ag"), F.lit(0).cast("long").alias("ai"), "path")
        above = here if above is None else above.unionByName(here)
        met = runs[level].join(above, (F.col("g") == F.col("ag")) & (F.col("p") == F.col("ai")))
        j = F.col("j")
        step = F.struct(together(F.slice("nodes", F.lit(1), j)).alias("before"), together(F.slice("nodes", j + 2, F.lit(arity))).alias("after"))
        rows = met.select("g", "p", "path", "nodes", F.posexplode("nodes").alias("j", "node"))
        rows = rows.withColumn("path", F.concat(F.array(step), F.col("path")))
        if level == 0:
            return out.unionByName(rows.select("g", "node.item", "node.h", "path"))
        above = rows.select(F.col("g").alias("ag"), (F.col("p") * arity + j).alias("ai"), "path")
    return out


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda h, s: F.unhex(F.sha2(F.concat(hexed(s["before"]), hexed(h), hexed(s["after"])), 256)))


def proof(path: Column) -> Column:
    """The digest of all siblings along a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tampered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A row per document: doc_id, found (see ``leaves``), leaf, path, subroot and root; and a row per source: source,
    n, subroot, root. Digests are binary."""
    rows, groups = numbered(leaves(docs, fields, tampered), ["source"], ["doc_id", "leaf"])
    nodes = rows.select("g", "i", "n", F.col("leaf").alias("h"), F.struct("doc_id", "found").alias("item"))
    runs, subroots = tree(nodes)
    n_groups = subroots.count()
    upper = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n_groups).cast("long").alias("n"), "h", F.struct("g").alias("item"))
    upper_runs, root = tree(upper)
    tops = root.select("g", F.lit(n_groups).cast("long").alias("n"), F.array().cast(PATH).alias("path"))
    of_source = paths(upper_runs, tops, upper).select("item.g", F.col("h").alias("subroot"), "path").join(groups, "g")
    one = root.first()
    of_source = written(of_source.withColumn("root", F.lit(bytes(one.h) if one else None).cast("binary")), "sources")
    known = of_source.select(F.col("g").alias("kg"), "subroot", "root")
    every = paths(runs, of_source.select("g", "n", "path"), nodes)
    out = every.join(F.broadcast(known) if n_groups <= MAX_BROADCAST else known, F.col("g") == F.col("kg"))
    return out.select("item.doc_id", "item.found", F.col("h").alias("leaf"), "path", "subroot", "root"), of_source.select("source", "n", "subroot", "root")


def _oracle(levels: int = 12, upper: int = 6) -> str:
    """SQL with a table for each level: enough for 3^levels rows a source and 3^upper sources."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    row = lambda t: f"sha256({' || '.join(field(x) for x in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', t))})"
    crc = "list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')])), lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1)))"
    out = [f"d AS MATERIALIZED (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN text IS NOT NULL AND xor({crc}, 4294967295::BIGINT) % 2 = 0 THEN {row("replace(text, chr(10), '')")} END AS found FROM documents)",
           "s AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g FROM d)",
           "w0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS sib, coalesce(found, leaf) AS f FROM s)",
           "l0 AS MATERIALIZED (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM w0)"]
    for k in range(levels + upper):
        if k == levels:
            out.append(f"sub AS MATERIALIZED (SELECT g, h AS subroot FROM l{k})")
            out.append(f"l{k}u AS MATERIALIZED (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM l{k})")
        g, i, l = ("g", f"i // {3 ** k}", f"l{k}") if k < levels else ("0", f"g // {3 ** (k - levels)}", f"l{k}u" if k == levels else f"l{k}")
        left, right = (f"coalesce(array_to_string(hs[{x}], ''), '')" for x in (f"1:({i}) % 3", f"({i}) % 3 + 2:"))
        out += [f"r{k} AS MATERIALIZED (SELECT g AS rg, i // 3 AS p, max(n) AS n, list(h ORDER BY i) AS hs FROM {l} GROUP BY g, i // 3)",
                f"l{k + 1} AS MATERIALIZED (SELECT rg AS g, p AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 2) // 3 AS n FROM r{k})",
                f"w{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, found, g, i, CASE WHEN n = 1 THEN sib ELSE sib || {left} || {right} END AS sib, "
                f"CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f FROM w{k} JOIN r{k} ON rg = {g} AND p = ({i}) // 3)"]
    last = levels + upper
    return ("WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified\n"
            f"FROM w{last} JOIN sub USING (g), (SELECT h AS root FROM l{last})")


ORACLE = _oracle()


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    rows, _ = manifest(docs, tampered=tampered)
    again = folded(F.coalesce("found", "leaf"), F.col("path"))
    rows = rows.withColumn("folded", again)
    return rows.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
                       proof(F.col("path")).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
