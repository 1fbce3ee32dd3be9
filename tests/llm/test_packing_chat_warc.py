import hashlib
import itertools
import random
import re
import time
from collections import defaultdict

from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import chat, packing, warc
from quillmesh.llm.common import fresh_path

SF = "/root/testdata/sf0.001"


def naive_best_fit(items, capacity):
    """By looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(left, b) for b, (left, ss, cs) in enumerate(bins) if left >= size and left > 0 and not ss & source and not cs & cluster]
        if fits:
            left, b = min(fits)
        else:
            bins.append((capacity, 0, 0))
            left, b = capacity, len(bins) - 1
        _, ss, cs = bins[b]
        bins[b] = (left - size, ss | source, cs | cluster)
        out.append((b, capacity - left))
    return out


@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([0, 1, 2, 4]), st.sampled_from([0, 0, 1, 2])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_best_fit_takes_the_tightest_compatible_bin(items):
    items = sorted(items, key=lambda x: -x[0])
    assert packing.best_fit(items, 20) == naive_best_fit(items, 20)


@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from([0, 1, 1, 1, 2, 4, 8]), st.sampled_from([0, 1, 1, 2])), max_size=120))
@settings(max_examples=150, deadline=None)
def test_best_fit_in_small_blocks(items):
    packing.PER_BLOCK, before = 2, packing.PER_BLOCK
    try:
        assert packing.best_fit(items, 40) == naive_best_fit(items, 40)
    finally:
        packing.PER_BLOCK = before


def test_packing_many_equal_rows(spark):
    began = time.time()
    df = spark.range(100_000).selectExpr("cast(null as long) AS doc_id", "'a b c' AS text", "'s' AS source")
    out = packing.pack(df)
    assert out.count() == out.select("bin_id").distinct().count() == 100_000
    assert out.selectExpr("bin_id >> 24 AS shard").groupBy("shard").count().agg({"count": "max"}).first()[0] < 2 * packing.ROWS_PER_SHARD
    assert time.time() - began < 90


def test_packing_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    about = {r.doc_id: (r.source, "".join((r.text or "").split()), len((r.text or "").split())) for r in docs.collect()}
    rows = packing.pack(docs, capacity=500, rows_per_shard=64).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert set(pieces) == set(about)
    for d, rs in pieces.items():
        rs.sort(key=lambda r: r.piece)
        assert sum(r.size for r in rs) == about[d][2] and [r.start for r in rs] == [sum(x.size for x in rs[:i]) for i in range(len(rs))]
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_start)
        assert all(a.bin_start + a.size == b.bin_start for a, b in zip(rs, rs[1:])) and rs[0].bin_start == 0 and rs[-1].bin_start + rs[-1].size <= 500
        for i in (0, 1):
            seen = [about[r.doc_id][i] for r in rs]
            assert len(set(seen)) == len(seen)


def test_packing_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 25, None), (4, "w " * 10, None), (5, "w " * 10, "a"), (None, "x y", "a"), (7, "z", None), (7, "z", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    out = packing.pack(df, capacity=10).collect()
    assert sum(r.size for r in out) == 25 + 10 + 10 + 2 + 1 + 1 and sum(r.bin_id is None for r in out) == 2
    twins = [r for r in out if r.doc_id == 7]
    assert len(twins) == 2 and twins[0].bin_id != twins[1].bin_id
    # The same text: never in a bin together, though neither has a source.
    assert len({r.bin_id for r in out if r.doc_id in (3, 4)}) == 4
    assert packing.pack(df.limit(0)).count() == 0


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")


def test_chat_links_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nHow do I  join\ntwo tables?"), (1, 1, "assistant", "Anna wrote:\n> How do I join two tables?\nUse a join.\nIt is easy."), (1, 2, "user", "> use a join.\n> It is easy.\n\nThanks!"),
        (1, 3, "user", ">> How do I join\n>> two tables?\n> Use a join.\nAlso me."), (1, 4, None, None), (1, 5, "user", "> Also me.\n> Thanks!\nBoth."), (2, 0, "user", "> nobody said this\nok"), (None, 1, "user", "x"), (1, None, "user", "> Also me."), (1, 2, "user", "dup"),
        (3, 0, "user", "> > deep\n>\n> quote\n"), (3, 1, "user", ""), (3, 2, "user", "a > b\nx wrote: y"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.format_messages(messages(spark, rows)).collect()}
    pick = lambda *k: (got[k].parent_turn, got[k].root_turn, got[k].depth)
    assert pick(1, 0) == (None, 0, 0) and pick(1, 1) == (0, 0, 1) and pick(1, 2) == (1, 0, 2) and pick(1, 3) == (1, 0, 2)
    assert pick(1, 4) == (None, 4, 0) and pick(2, 0) == (None, 0, 0)
    assert pick(1, 5)[0] in (2, 3) and pick(1, 5)[1:] == (0, 3)
    text = lambda *k: got[k].content
    assert text(1, 1) == "<|im_start|>assistant\nUse a join.\nIt is easy.<|im_end|>\n"
    assert text(2, 0) == "<|im_start|>user\nok<|im_end|>\n" and text(3, 0) == "<|im_start|>user\n<|im_end|>\n" and text(3, 2) == "<|im_start|>user\na > b\nx wrote: y<|im_end|>\n"
    assert (got[3, 0].quoted, got[3, 0].linked) == (2, 0)
    assert chat.format_messages(messages(spark, rows)).count() == len(rows)
    whole = {(r.conv_id, r.root_turn): r.content for r in chat.conversations(chat.format_messages(messages(spark, rows[:4]))).collect()}
    assert whole[1, 0].index("Hello") < whole[1, 0].index("It is easy") < whole[1, 0].index("Thanks") < whole[1, 0].index("Also me")


def test_chat_long_chain_and_empty(spark):
    rows = [(9, 0, "user", "start of it")] + [(9, i, "user", f"> {'start of it' if i == 1 else f'answer {i - 1}'}\nanswer {i}") for i in range(1, 40)]
    got = chat.format_messages(messages(spark, rows)).collect()
    assert all(r.root_turn == 0 and r.depth == r.turn and r.parent_turn == (r.turn - 1 if r.turn else None) for r in got)
    assert chat.format_messages(messages(spark, rows).limit(0)).count() == 0


def brute_chat(rows):
    """(conv, turn) -> parent, root, depth, content, by comparing every quote with all messages, for (conv, turn) that do not repeat."""
    squeeze = lambda x: " ".join(x.lower().split())
    parsed = {}
    for c, t, role, text in rows:
        lines = []
        for x in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", x)[0]
            lines.append((marks.count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", x)))
        lines = [x for x, after in zip(lines, [*lines[1:], (0, "")]) if not (x[0] == 0 and after[0] > 0 and re.search(r"(wrote|said)\s*:\s*$", x[1]))]
        runs = [list(g) for _, g in itertools.groupby(lines, key=lambda x: (x[0], x[1].strip(" ") == ""))]
        found = {(r[0][0], squeeze(" ".join(b for _, b in r)), True) for r in runs} | {(n, squeeze(b), False) for r in runs if len(r) > 1 for n, b in r}
        parsed[c, t] = {p for p in found if p[1]}, f"<|im_start|>{role or 'user'}\n" + re.sub(r"\n{3,}", "\n\n", "\n".join(b for n, b in lines if n == 0)).strip(" \t\r\n") + "<|im_end|>\n"
    parent = {}
    for (c, t), (ps, _) in parsed.items():
        votes = {}
        for level, said, _ in ps:
            origins = [u for (d, u), (qs, _) in parsed.items() if d == c and any(n == 0 and x == said for n, x, _ in qs)]
            if level and origins and min(origins) < t:
                near, chars = votes.get(min(origins), (-99, 0))
                votes[min(origins)] = max(near, -level), chars + len(said)
        parent[c, t] = max(votes, key=lambda u: (*votes[u], u)) if votes else None
    out = {}
    for (c, t), (_, content) in parsed.items():
        root, depth = t, 0
        while parent[c, root] is not None:
            root, depth = parent[c, root], depth + 1
        out[c, t] = parent[c, t], root, depth, content
    return out


def test_chat_matches_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(6):
        said = []
        for t in range(20):
            lines = [f"{'>' * rng.randrange(1, 3)} {rng.choice(said)}" for _ in range(rng.randrange(4)) if said]
            if lines and rng.random() < .3:
                lines.insert(0, "Anna wrote:")
            mine = [f"line {rng.randrange(30)} of {'x' * rng.randrange(9)}" for _ in range(rng.randrange(1, 4))]
            rows.append((c, t, rng.choice(["user", None]), "\n".join([*lines, *[""] * rng.randrange(4), *mine])))
            said += [*mine, "\n> ".join(mine)]
    want = brute_chat(rows)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.content) for r in chat.format_messages(messages(spark, rows)).collect()}
    assert got == want
    threads = defaultdict(list)
    for (c, t), (parent, root, depth, content) in sorted(want.items()):
        threads[c, root].append((t, parent, depth, content))
    for r in chat.conversations(chat.format_messages(messages(spark, rows))).collect():
        assert list(zip(r.turns, r.parents, r.depths)) == [x[:3] for x in threads[r.conv_id, r.root_turn]] and r.content == "".join(x[3] for x in threads.pop((r.conv_id, r.root_turn)))
    assert not threads


def test_chat_oracle(spark):
    assert differences(chat.op3_chat(spark, SF), connect(SF), chat.ORACLE) == ""


def test_chat_repeated_turns_and_null_ids(spark):
    rows = [(1, 0, "user", "start")] + [(1, 1, "user", f"> start\nreply {i % 7}") for i in range(3000)] + [(1, 2, "user", "> reply 3\nend")] + [(None, 1, "user", "lost")] * 900 + [(1, None, "user", "lost")] * 900
    got = chat.conversations(chat.format_messages(messages(spark, rows))).collect()
    assert sum(r.n_messages for r in got) == len(rows) and max(r.n_messages for r in got) < 600
    assert sorted(r.n_messages for r in got if r.conv_id is None or r.root_turn is None) == [1] * 1800
    parts = sorted((r for r in got if r.root_turn == 0), key=lambda r: (r.part, r.at, r.piece))
    assert [t for r in parts for t in r.turns] == [0] + [1] * 3000 + [2]


def test_warc_oracle(spark):
    assert differences(warc.op5_warc(spark, SF), connect(SF), warc.ORACLE) == ""


def test_warc_round_trip(spark):
    rng = random.Random(1)
    big = "é" * 200
    rows = [(5, "http://a/5", big), (3, "http://a/3", big), (9, None, big), (1, "http://x/\r\nWARC-Type: no", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (None, "n", big), (8, "u", "z" * 300_000), (3, "again", big)]
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choice("abc\n") for _ in range(rng.randrange(400)))) for i in range(60)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder = fresh_path(spark, "warc-test")
    index = warc.write(df, folder)
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    html = {(i, u): h or "" for i, u, h in rows}
    for r in got:
        key = next(k for k in html if k[0] == r.page_id and (k[0] != 3 or (r.url == (k[1] or ""))))
        body = html[key].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    kind = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in got}
    assert kind[5, "http://a/5"] == kind[9, "about:blank"] == ("revisit", 3) and kind[3, "http://a/3"] == kind[3, "again"] == ("response", None) and kind[1, "http://x/%0D%0AWARC-Type: no"] == ("response", None)
    some = warc.read(index.filter("page_id % 7 = 0"), folder).collect()
    assert sorted(r.page_id for r in some) == sorted(i for i, _, _ in rows if i is not None and i % 7 == 0)
    assert warc.read(warc.write(df.limit(0), folder), folder).count() == 0


@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 30)), max_size=20), st.integers(0, 20), st.integers(30, 200))
@settings(max_examples=200, deadline=None)
def test_ranges_cover_all_spans(spans, gap, chunk):
    spans = sorted(spans)
    found = warc.ranges(spans, gap, chunk)
    assert sorted(i for _, _, inside in found for i in inside) == list(range(len(spans)))
    for at, n, inside in found:
        assert n <= chunk and all(at <= spans[i][0] and spans[i][0] + spans[i][1] <= at + n for i in inside)
