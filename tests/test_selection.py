"""Substring joins, groups of words, excerpts and selection against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import stem as S
from quillmesh.operators import contain, discover, excerpts, score
from quillmesh.plans import code, project

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_containing(spark, monkeypatch, broadcast):
    monkeypatch.setattr(contain, "MAX_BROADCAST", broadcast)
    rows = [(i, f"src/app_{i}/x{i % 7}.py") for i in range(200)] + [(900, ""), (901, "a"), (902, None), (903, "ü_é")]
    needles = [(q, n) for q in range(3) for n in ("app_1", "x3", "_", "none", "x5.py", "app_19/x5", "src/app_", "é", "", "a")] + [(5, None)]
    got = contain.containing(spark.createDataFrame(rows, "id long, hay string"), "hay", spark.createDataFrame(needles, "query long, needle string"), "needle")
    assert sorted((r.id, r.query, r.needle) for r in got.collect()) == sorted((i, q, n) for i, h in rows for q, n in needles if h is not None and n and n in h)
    assert "NestedLoop" not in physical(got) and "Cartesian" not in physical(got)


def greedy(words):
    """``words``: lists of forms in order."""
    groups = []
    for forms in words:
        for g in groups:
            if g & set(forms):
                g |= set(forms)
                break
        else:
            groups.append(set(forms))
    return groups


def test_groups_of_words_are_greedy(spark):
    rng = random.Random(1)
    tasks = {0: [["x"], ["x", "y"], ["y"]], 1: [["a"], ["b"], ["a", "b"], ["b", "c"], ["c"]]}
    tasks |= {q: [[rng.choice("abcdefghij") for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 12))] for q in range(2, 60)}
    rows = [(q, f"w{i}", i, f) for q, ws in tasks.items() for i, fs in enumerate(ws) for f in fs]
    got = {}
    for r in discover.grouped(spark.createDataFrame(rows, "query long, word string, ord int, form string").repartition(5)).collect():
        got.setdefault(r.query, {}).setdefault(r.group, set()).add(r.form)
    assert {q: [g[k] for k in sorted(g)] for q, g in got.items()} == {q: greedy(ws) for q, ws in tasks.items()}


def test_name_counts(spark):
    tasks, files = code.named_inputs(spark, SF)
    tasks, paths = [r.asDict() for r in tasks.collect()], [r.path for r in files.collect()]
    terms = {w for t in tasks for w in t["keywords"]} | {x for p in paths for x in re.split(r"[-_./]|(?<=[a-z])(?=[A-Z])", p.lower())}
    stems = {}
    for r in S.stems(spark.createDataFrame([(t,) for t in sorted(terms)], "term string")).collect():
        stems.setdefault(r.term, set()).add(r.stem)
    forms = lambda w: {w} | stems.get(w, set())
    parts = lambda x, seps: {y for y in re.split(seps, x.lower()) if len(y) >= 2}
    want = {}
    for t in tasks:
        groups = greedy([sorted(forms(w)) for w in t["keywords"]])
        for p in paths:
            own = set().union(*(forms(x) for x in parts(p, r"[-_./\\]")))
            base = set().union(set(), *(forms(x) for x in parts(p.rsplit("/", 1)[1].rsplit(".", 1)[0], r"[-_]")))
            n = (len(set(t["raw_words"]) & parts(p, r"[-_./\\]")), sum(1 for g in groups if g & own or any(f in p.lower() for f in g)), sum(1 for g in groups if g & base))
            if n[0] or n[1]:
                want[t["query"], p] = n
    got = {(r.query, r.path): (r.raw_path_matches, r.path_matches, r.basename_matches) for r in code.discover_name_counts(spark, SF).collect()}
    assert got == want and len(want) > 100 and any(c > 0 for _, _, c in want.values())


def excerpt_by_lines(ls, in_trace, has_symbol, symbols, near):
    """Every line with its priority, sorted."""
    if len(ls) <= excerpts.SMALL:
        return None
    head = 10
    best = {}
    def put(p, a, b):
        for x in range(max(a, 1), min(b, len(ls)) + 1):
            best[x] = min(best.get(x, (9, 0)), p)
    put((0, 0), 1, head)
    for x in near:
        put((0, 0), x - 20, x + 20)
    for kind, a, b in symbols:
        if a <= b:
            if in_trace:
                put((1, a), a, b)
            if has_symbol:
                put((2, excerpts.KIND_ORDER.index(kind) * 10 ** 7 + a), a, b)
    put((3, 0), 1, len(ls))
    order = sorted(best, key=lambda x: (best[x], x))
    return sorted(x for n, x in enumerate(order) if n < excerpts.MOST or best[x] == (0, 0))


def test_excerpts_equal_sorting_all_lines(spark):
    rng = random.Random(2)
    files, symbols, near, want = [], [], [], {}
    for i in range(40):
        n, path = rng.choice([50, 200, 201, 320, 900, 1500]), f"f{i}"
        ls = [f"line {x}" for x in range(n)]
        own = []
        for _ in range(rng.randrange(9)):
            a = rng.randrange(1, n + 1)
            own.append((rng.choice(excerpts.KIND_ORDER), a, a + rng.randrange(-1, 300)))
        lit = [rng.randrange(1, n + 1) for _ in range(rng.choice([0, 1, 3, 12]))]
        files.append((path, "\n".join(ls), rng.random() < 0.5, rng.random() < 0.5))
        symbols += [(path, f"s{k}", *s) for k, s in enumerate(own)]
        near += [(path, x) for x in lit + lit[:1]]
        want[path] = excerpt_by_lines(ls, *files[-1][2:], own, lit)
    f = spark.createDataFrame(files, "path string, content string, in_trace boolean, has_symbol boolean")
    s = spark.createDataFrame(symbols, "path string, name string, kind string, start_line int, end_line int")
    h = spark.createDataFrame(near, "path string, line int")
    got = {}
    for r in excerpts.chosen_lines(f, s, h).collect():
        got.setdefault(r.path, []).append(r.line)
        assert r.body == f"line {r.line - 1}"
    assert got == {p: x for p, x in want.items() if x}
    for r in excerpts.excerpts(f, s, h).collect():
        kept = want[r.path]
        if kept is None:
            assert not r.truncated and r.start_line == 1
            continue
        text = "\n".join(("// ... (lines omitted)\n" if k and kept[k - 1] + 1 < x else "") + f"{x}: line {x - 1}" for k, x in enumerate(kept))
        assert (r.content, r.start_line, r.end_line, r.truncated) == (text, kept[0], kept[-1], len(kept) < r.total_lines)
    assert "hashpartitioning(path, line" not in physical(excerpts.chosen_lines(f, s, h))


def test_selection_limits_before_it_shuffles(spark):
    tasks = code.domain_tasks(spark)
    chosen = score.select(code.scored(spark, SF), tasks)
    plan = physical(chosen)
    assert "WindowGroupLimit" in plan
    rows = chosen.collect()
    assert rows and max(r.ord for r in rows) <= score.MAX_FILES
    assert project.TASKS  # the invented tasks stay the ones of the queries
    assert chosen.filter(F.col("score") > 1).count() == 0
