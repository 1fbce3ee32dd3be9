import random
import re

import pytest

from quillmesh.llm import similarity, shingles

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (class_id, n_links) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            low = min([label[i], *(label[j] for j in js)])
            if low < label[i]:
                label[i], changed = low, True
    least = {}
    for i, (d, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], d), d)
    return {d: (least[label[i]], len(links[i])) for i, (d, _) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in similarity.join(df).collect()}


def test_test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_large_groups_match_brute_force(spark, monkeypatch):
    """A tight group and a loosely alike one, both beyond the size that is compared at once, in blocks."""
    monkeypatch.setattr(similarity, "SMALL", 16)
    monkeypatch.setattr(similarity, "BLOCK", 20)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(i % 4):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    passage = [rng.choice(words) for _ in range(70)]
    rows += [(100 + i, " ".join(passage + [rng.choice(words) for _ in range(60)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    """2000 pairs of similarity 0.8 to 0.86 among 4000 texts of one vocabulary, at production settings."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows, pairs = [], 0
    while pairs < 2000:
        t = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        u = list(t)
        while True:
            u[rng.randrange(len(u))] = rng.choice(words)
            a, b = shingle_set(" ".join(t)), shingle_set(" ".join(u))
            if len(a & b) / len(a | b) < .86:
                break
        if 5 * len(a & b) >= 4 * len(a | b):
            rows += [(2 * pairs, " ".join(t)), (2 * pairs + 1, " ".join(u))]
            pairs += 1
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sum(got[2 * i + 1] == (2 * i, 1) for i in range(pairs))
    assert found >= 0.999 * pairs and max(n for _, n in got.values()) == 1


def test_runs_are_repeated_until_the_target(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(300):
        t = [rng.choice(words) for _ in range(80)]
        rows.append((2 * i, " ".join(t)))
        t[3], t[50] = "other", "words"
        rows.append((2 * i + 1, " ".join(t)))
    marks = similarity.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    reps = similarity.written(marks.selectExpr("doc_id AS rid", "set_key", "n", "tokens"), "reps")
    monkeypatch.setattr(similarity, "RUNS", 1)
    recalls = [similarity.repeat_runs(reps, target)[2] for target in (0.0, 0.9, 0.999)]
    assert recalls[0] < 0.97 and recalls[1] >= 0.9 and recalls[2] >= 0.999 and recalls == sorted(recalls)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "one two", "a"), (5, "one  two", "b"), (6, "one two three", "b"), (7, long, "b"), (8, long + " end", None),
            (9, "ä ö ü ß é", "a"), (10, "ä ö ü ß é", "a"), (None, "one two", "a"), (11, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long".replace("n long", "label string"))
    got = {(r.doc_id): (r.class_id, r.n_links) for r in similarity.join(df).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 2), 5: (4, 2), None: (4, 2), 6: (6, 0), 7: (7, 1), 8: (7, 1), 9: (9, 1), 10: (9, 1), 11: (11, 0)}
    kept = similarity.keep_one(df)
    assert kept.columns == df.columns
    # Of the class with a null id, the null comes first.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 6, 7, 9, 11]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")] * 3, "doc_id long, text string")
    assert [(r.class_id, r.n_links) for r in similarity.join(df).collect()] == [(1, 2)] * 3
    assert similarity.keep_one(df).count() == 1
    assert similarity.join(df.limit(0)).count() == 0


def test_classes_that_share_an_id_stay_apart(spark):
    """Unrelated texts with null ids, or with one id, are classes of their own: none is dropped."""
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(None, "alpha beta gamma"), (None, "delta epsilon"), (None, long), (None, long + " end"), (7, "one text of it"), (7, "quite another one"), (7, "one text of it"), (8, "quite another one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = similarity.keep_one(df).collect()
    near = [r.text for r in kept if r.text.startswith(long)]
    assert len(near) == 1
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text != near[0]) == [(0, "alpha beta gamma"), (0, "delta epsilon"), (7, "one text of it"), (7, "quite another one")]
    classes = {}
    for r in similarity.join(df).collect():
        classes.setdefault(r.class_key, []).append((r.class_id, r.n_links))
    assert sorted(classes.values(), key=str) == [[(7, 1)] * 2, [(7, 1)] * 2, [(None, 0)], [(None, 0)], [(None, 1)] * 2]


@pytest.mark.parametrize("texts", [["a b c d e f", None, "", "a b", "é x  y\tz w\nq a b c d e f"]])
def test_shingle_sets_agree_with_strings(texts):
    h, starts = shingles.shingle_sets(texts)
    assert [int(n) for n in starts[1:] - starts[:-1]] == [len(shingle_set(t)) for t in texts]
    first, last = set(h[starts[0]:starts[1]]), set(h[starts[4]:starts[5]])
    assert len(first & last) == len(shingle_set(texts[0]) & shingle_set(texts[4]))
