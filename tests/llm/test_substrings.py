import hashlib
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import substrings
from quillmesh.llm.suffixes import lcp_array, repeated_grams, suffix_array

SF = "/root/testdata/sf0.001"


def brute(rows, w=200):
    """doc -> (n_bytes, n_removed, n_spans, sha256) by a table of all strings of w bytes."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    times = {}
    for _, r in raw:
        for i in range(len(r) - w + 1):
            s = r[i:i + w]
            times[s] = times.get(s, 0) + 1
    out = []
    for d, r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if times[r[i:i + w]] > 1:
                gone[i:i + w] = b"\x01" * w
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in substrings.remove(df).collect()), key=str)


def test_test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def odd_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(90))
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 500), (5, "a" * 199), (6, "a" * 200), (7, passage), (8, passage), (None, passage), (9, "ab" * 300 + "c" * 250), (7, "again " + passage[5:])]
    # The same passage with different surroundings, whole and in part, twice in one text, and shifted by a byte.
    for i in range(40):
        cut = rng.randrange(0, 60)
        rows.append((100 + i, " ".join(word() for _ in range(rng.randrange(40))) + passage[cut:len(passage) - rng.randrange(0, 60)] + word() * rng.randrange(1, 30) + (passage if i % 7 == 0 else "")))
    rows.append((200, "x" + passage[:199] + "y" + passage[100:299]))
    rows.append((201, "".join(rng.choice("01") for _ in range(40_000))))
    rows.append((202, rows[-1][1][10_000:10_230] + "." + rows[-1][1][20_000:20_199]))
    return rows


def test_odd_rows_match_brute_force(spark):
    df = spark.createDataFrame([(d, t, "z") for d, t in odd_rows()], "doc_id long, text string, core string")
    assert result(df) == brute(odd_rows())


def test_many_sides_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MAX_SIDES", 3)
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    assert result(df) == brute(odd_rows())


def test_what_the_arrays_find_and_what_is_counted(spark, monkeypatch):
    """Texts that share a passage and differ around it are settled by the arrays, and by nothing else; copies of whole
    texts are counted. Neither of them finds what the other does."""
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, whole = line(500), line(700)
    df = spark.createDataFrame([(1, line(300) + passage + line(300)), (2, line(250) + passage + line(350)), (3, whole), (4, whole)], "doc_id long, text string")
    removed = lambda: {r.doc_id: r.n_removed for r in substrings.remove(df).collect()}
    every = removed()
    assert 500 <= every[1] <= 504 and every[1] == every[2] and every[3] == every[4] == 700
    monkeypatch.setattr(substrings, "by_gram", lambda batches: iter(()))
    without = removed()
    assert without[3] == without[4] == 700 and without[1] < 500 and without[2] < 500


def test_rows_that_repeat_many_times(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    own = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(1, text)] * 2000 + [(None, text)] * 2000 + [(2, own), (3, own[:150] + text[1000:1300])]
    took = time.time()
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    took = time.time() - took
    want = brute([(1, text), (None, text), (2, own), (3, own[:150] + text[1000:1300])])
    assert sorted(set(got), key=str) == want and len(got) == len(rows)
    apart = time.time()
    assert len(result(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))) == len(rows)
    assert took < 2 * (time.time() - apart) + 5


def test_empty_table_and_kept_text(spark):
    df = spark.createDataFrame([(1, "b" * 300 + "tail")], "doc_id long, text string")
    assert substrings.remove(df.limit(0)).count() == 0
    assert bytes(substrings.remove(df, keep_text=True).first().kept) == b"tail"


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array_is_the_order_of_suffixes(s):
    sa = suffix_array(s)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    common = lambda a, b: next((k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), 0)
    assert all(x == common(a, b) for x, a, b in zip(lcp_array(s, sa)[1:], sa, sa[1:]))


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_repeated_grams(strings):
    grams = [[tuple(t[i:i + 3]) for i in range(len(t) - 2)] for t in strings]
    every = [g for gs in grams for g in gs]
    assert repeated_grams(strings, [3] * len(strings)) == [[every.count(g) > 1 for g in gs] for gs in grams]
