import hashlib
import re
import zlib

import pytest
from compare import connect, differences

from quillmesh.llm import catalog, fim, lines, merkle

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fim", "op12_lines", "op13_merkle"])
def test_oracles(spark, name):
    assert differences(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLES[name]) == ""


# Fill-in-middle

TEXTS = [None, "", " ", "\n\t \x0b", "a", " a b ", "x  y\nz\r\n", "é ü \U0001F600 ß", "has <P> inside", "has <S>", "<M>", "a<", "<S < P> <P", "w " * 50_000, "q" * 300_000, " " * 100_000 + "z"]


def cut_by_lists(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cut_equals_lists_of_units(spark):
    rows = [(i, t, f"n{i}", i) for i in [*range(12), None, 3, 3] for t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = fim.cut(df, ["doc_id", "form"])
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(got.output, got.form).alias("again")).collect()
    assert sorted((str(r[0]), *map(str, r[1:6])) for r in kinds) == sorted((str(i), *map(str, cut_by_lists(i, t))) for i, t, *_ in rows)
    assert sorted(r.again for r in kinds) == sorted(t or "" for _, t, *_ in rows)
    assert {r.form for r in kinds} == {"plain", "spm", "psm"}


def test_transform_keeps_columns(spark):
    df = spark.createDataFrame([(i, t, "o", "f") for i, t in enumerate(TEXTS)], "doc_id long, text string, output string, c0 string")
    got = fim.transform(df, cut_percent=100)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: None if t is None else fim.cut_text(i, t, cut_percent=100)["output"] for i, t in enumerate(TEXTS)}
    assert all(r.output == "o" and r.c0 == "f" for r in got.collect())
    assert fim.cut(df.limit(0), ["doc_id"]).count() == 0 and fim.transform(df.limit(0)).count() == 0


def test_matcher_holds_no_units():
    """The memory of a cut does not grow with the number of units, beyond the text, its parts and the output."""
    import tracemalloc

    text = "w " * 400_000
    tracemalloc.start()
    assert fim.count_units(text) == 400_001
    fim.offsets(text, 10, 399_000)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
    assert fim.offsets("a b c", 0, 0) == (0, 0) and fim.offsets("a b c", 1, 3) == (1, 5) and fim.offsets("a b c", 2, 2) == (3, 3)


# Lines

def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def lines_by_loops(rows, min_docs, keep_first=False):
    texts = [(d, t or "") for d, t in rows]
    where = {}
    for n, (d, t) in enumerate(texts):
        for at, line in enumerate(t.split("\n")):
            if key(line):
                where.setdefault(key(line), []).append((n, at))
    out = []
    first = {k: min(((texts[n][0] is not None, texts[n][0] or 0, hashlib.md5(texts[n][1].encode()).digest(), at)) for n, at in w) for k, w in where.items()}
    for n, (d, t) in enumerate(texts):
        kept, dropped = [], 0
        for at, line in enumerate(t.split("\n")):
            drop = key(line) and len({m for m, _ in where[key(line)]}) >= min_docs
            if drop and keep_first and first[key(line)] == (d is not None, d or 0, hashlib.md5(t.encode()).digest(), at):
                drop = False
            dropped += bool(drop)
            kept += [] if drop else [line]
        out.append((d, "\n".join(kept), dropped))
    return out


COMMON = ["Common  Line", "  common  line\t", "COMMON  LINE", "ÉCOLE x", "école x"]
ROWS = [(i, "\n".join([f"own {i}", COMMON[i % 5], "", f"pair {i // 2}", " \r", "Two "])) for i in range(12)]
ROWS += [(100, None), (101, ""), (102, "\n"), (None, "pair 1\ncommon  line\ncommon  line"), (7, ROWS[7][1]), (7, ROWS[7][1]), (103, "\n".join(f"l{i % 90}" for i in range(5000))), (104, "\n".join(f"L{i}" for i in range(200)) + "\nÀ"),
         (105, "z" * 400_000 + "\npair 1")]


@pytest.mark.parametrize("min_docs", [1, 2, 4, 10])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_equal_loops(spark, min_docs, keep_first, monkeypatch):
    if min_docs == 2:
        monkeypatch.setattr(lines, "MAX_BROADCAST", 0)
    df = spark.createDataFrame([(*r, "k", 1) for r in ROWS], "doc_id long, text string, keep string, __h int").repartition(3)
    got = lines.apply(df, min_docs=min_docs, keep_first=keep_first)
    assert got.columns == df.columns
    want = lines_by_loops(ROWS, min_docs, keep_first)
    given = dict((d, t) for d, t in ROWS)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(d), str(None if given[d] is None else t)) for d, t, _ in want)
    maps = lines.bitmaps(df, min_docs=min_docs, keep_first=keep_first).collect()
    assert sum(r.n_dropped for r in maps) == sum({(d, t): n for d, t, n in want}.values())
    for r in maps:  # only words that lose a line, in order
        assert [w.word for w in r.keep] == sorted({w.word for w in r.keep}) and all(w.bits != -1 for w in r.keep)


def test_lines_of_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").limit(0)
    assert lines.apply(df).count() == 0 and lines.bitmaps(df).count() == 0


def test_a_very_common_line_is_in_many_ranges(spark):
    """The rows of one digest are dealt to several ranges, and counted once for each document all the same."""
    df = spark.range(4000).selectExpr("id AS doc_id", "'same\nsame\nsame' AS text")
    rows = lines.occurrences(df)
    got = lines.common(rows).collect()
    assert len(got) == 1 and got[0].n_docs == 4000
    from pyspark.sql import functions as F

    dealt = rows.select("row", "doc_id", "__h", F.posexplode("keys").alias("at", "key")).repartitionByRange(4, "key", "doc_id", "__h", "row")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 6000


def test_window_over_ranges_needs_no_exchange(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = lines.occurrences(df).select("row", "doc_id", "__h", F.posexplode("keys").alias("at", "key"))
    dealt = rows.repartitionByRange(4, "key", "doc_id", "__h", "row").withColumn("nth", F.row_number().over(Window.partitionBy("key", "doc_id", "__h", "row").orderBy("at")))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


# Merkle manifest

def merkle_by_loops(rows, arity=3):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def up(nodes):
        """Levels of a tree and its root."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            cur = levels[-1]
            levels.append([sha("".join(cur[i:i + arity])) for i in range(0, len(cur), arity)])
        return levels

    def path(levels, i):
        steps = []
        for level in levels[:-1]:
            lo = i // arity * arity
            steps.append(("".join(level[lo:i]), "".join(level[i + 1:lo + arity])))
            i //= arity
        return steps

    by = {}
    for d, s, lang, n, t in rows:
        own = sha("".join(field(x) for x in (d, s, lang, n, t)))
        found = own
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % 2 == 0:
            found = sha("".join(field(x) for x in (d, s, lang, n, t.replace("\n", ""))))
        by.setdefault(s, []).append((d is not None, d or 0, own, found))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [up([x[2] for x in sorted(by[s])]) for s in names]
    tops = up([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (has, d, own, found) in enumerate(sorted(by[s])):
            steps = path(trees[k], i) + path(tops, k)
            for before, after in steps:
                found = sha(before + found + after)
            out.append((d if has else None, own, trees[k][-1][0], tops[-1][0], sha("".join(b + a for b, a in steps)), found, found == tops[-1][0]))
    return sorted(out, key=str)


SOURCES = [None, "", "a", "ä", "z", "Z", "\U0001F600", "￮"]


@pytest.mark.parametrize("n", [1, 4, 10, 130])
def test_manifest_equals_loops(spark, n, tmp_path):
    rows = [(i * 7 % n if i % 11 else None, SOURCES[0] if n < 5 else SOURCES[i * i % 8] if i % 3 else "hot", None if i % 5 == 0 else "en", i if i % 4 else None, None if i % 9 == 0 else "x\ny" * (i % 6)) for i in range(n)]
    rows += rows[:n // 4]
    df = spark.createDataFrame([(*r, "e", b"p", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, path binary, leaf int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == merkle_by_loops(rows)
    _, sources = merkle.manifest(df)
    assert sources.count() == len({r[1] for r in rows}) and {r.root.hex() for r in sources.collect()} == {r.root for r in got}


def test_manifest_of_many_sources_and_none(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_BROADCAST", 5)
    rows = [(i, f"s{i % 40}", "en", 1, "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got, sources = merkle.manifest(df)
    want = merkle_by_loops(rows)
    assert {r.root.hex() for r in got.collect()} == {want[0][3]} and sources.count() == 40
    got, sources = merkle.manifest(df.limit(0))
    assert got.count() == 0 and sources.count() == 0


def test_manifest_tells_what_was_changed(spark):
    from pyspark.sql import functions as F

    rows = [(i, "s", "en", 1, f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got, _ = merkle.manifest(df, tampered=F.when(F.col("doc_id") == 17, F.lit("other")))
    bad = got.filter(merkle.folded(F.coalesce("found", "leaf"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [17]
