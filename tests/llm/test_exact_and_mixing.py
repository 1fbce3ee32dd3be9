import hashlib
import re

import pytest
from compare import connect, differences

from quillmesh.llm import exact, mixing

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b", "s"), (2, "ab", None), (3, None, "t"), (4, "", "s"), (5, " \n\t\x0b\x0c\r ", "t"), (6, "a b", "s"), (7, "a b c", "s"), (None, "a  b", "s"), (8, "ab" * 9000, "u"), (9, "ab " * 9000, "u"), (2, "ab", None)]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_groups(rows):
    out = []
    for d, t, *_ in rows:
        same = [(len(u or ""), e) for e, u, *_ in rows if normal(u) == normal(t)]
        most = max(n for n, _ in same)
        ids = [e for n, e in same if n == most]
        keep = None if None in ids else min(ids)
        out.append((d, keep, len(same), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows=ODD):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, source string, norm string, recipe int")


def test_exact_groups_of_odd_rows(spark):
    got = exact.groups(frame(spark)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_groups(ODD)
    assert sum(r.kept for r in got) == len({normal(t) for _, t, _ in ODD})


def test_exact_small_chunks_and_collisions(spark, monkeypatch):
    """With identifiers that collide, recipes hold the chunks themselves and the groups stay the same."""
    rows = [(i, f"{'xyz' * 50}{i % 3} {'en' * 40}{i % 2}", "s") for i in range(12)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact.groups(frame(spark, rows), least=8, most=32).collect()), key=str) == brute_groups(rows)
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "chunk_id", lambda c: F.unhex(F.md5(F.length(c).cast("string"))))
    assert exact.ambiguous_ids(frame(spark, rows), least=8, most=32).count() > 0
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact.groups(frame(spark, rows), least=8, most=32).collect()), key=str) == brute_groups(rows)


def test_only_colliding_chunks_stand_for_themselves(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "chunk_id", lambda c: F.unhex(F.md5(F.when(c.isin("aaaa", "bbbb"), F.lit("?")).otherwise(c))))
    df = spark.createDataFrame([(1, "aaaa", "s"), (2, "bbbb", "s"), (3, "cccc", "s"), (4, "a aaa", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: len(r.recipe[0]) for r in exact.recipes(df).collect()} == {1: 21, 2: 21, 3: 16, 4: 21}
    assert {r.doc_id: r.keep_id for r in exact.groups(df).collect()} == {1: 4, 2: 2, 3: 3, 4: 4}
    monkeypatch.setattr(exact, "MAX_REPAIRS", 0)
    assert {r.doc_id: r.keep_id for r in exact.groups(df).collect()} == {1: 4, 2: 2, 3: 3, 4: 4}


def test_chunks_are_the_whole_text(spark):
    from pyspark.sql import functions as F

    t = "né" * 3000 + "\U0001F600" * 700 + "\x00x" + "zz" * 9000
    parts = spark.createDataFrame([(t,)], "t string").select(exact.chunks(F.col("t"))).first()[0]
    assert "".join(parts) == t and all(len(p) <= exact.MAX_CHUNK for p in parts) and len(parts) > 5


def test_exact_keep_first(spark):
    kept = exact.keep_first(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["5", "6", "7", "9", "None"])
    assert exact.groups(frame(spark).limit(0)).count() == 0
    assert exact.keep_first(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["exact", "mixing"])
def test_oracles(spark, name):
    q, sql = {"exact": (exact.op7_exact_dedup, exact.ORACLE), "mixing": (mixing.op10_mixing, mixing.ORACLE)}[name]
    assert differences(q(spark, SF), connect(SF), sql) == ""


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_mixing_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 2)
    rows = [(i, "w " * (i % 7 * 5), ["a", "b", None, "c"][0 if i % 3 else i % 4], 0.5) for i in range(200)] + [(None, None, "a", 1.0), (5, "x", "empty", 1.0), (6, "", "empty2", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, position double")
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = fill(sizes)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in got)
    by_source = {}
    for r in got:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size and (r.position is None) == (r.copies == 0)
        by_source.setdefault((r.source_size, r.target), []).append(r)
    assert sorted(round(t, 6) for _, t in by_source for _ in [0]) == sorted(round(t, 6) for t in {(sizes[s], round(t, 9)): t for s, t in targets.items()}.values())
    for (_, target), rs in by_source.items():
        n = sum(1 for s in targets if abs(targets[s] - target) < 1e-6)
        assert abs(sum(r.taken for r in rs) - n * target) <= n * max(r.size for r in rs)
    assert sorted(map(str, mixing.plan(df).collect())) == sorted(map(str, got))
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_mixing_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 64)
    df = spark.createDataFrame([(None, "x y", "a")] * 1000 + [(1, "x", "a")] * 300 + [(i, "u v w", "b") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.plan(df).collect()
    assert len(got) == 1350 and sorted(r.copies for r in got if r.size == 2 or r.size == 1)[0] >= 1
    places = [r.position for r in got if r.size == 2]
    assert len(set(places)) == 1000 and mixing.mix(df).count() == sum(r.copies for r in got)
    got = [r.position for r in mixing.plan(df).select("position").toLocalIterator()]
    assert got == sorted(got, key=lambda x: (x is None, x))


def test_targets_with_many_sources(spark):
    sizes = {f"s{i:03}": (i * 37) % 91 + 1 for i in range(300)} | {None: 5}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes)
    assert len(got) == 301 and all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_mixing_order_follows_position(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.doc_id: r.position for r in mixing.plan(df).collect() if r.copies == 1}
    order = [first[r.doc_id] for r in mixing.mix(df).select("doc_id").collect() if r.doc_id in first]
    assert order == sorted(order)
