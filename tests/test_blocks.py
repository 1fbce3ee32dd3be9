"""The block index: its k best against scoring all postings, and what it reads."""

import pytest

from quillmesh.operators import blocks, index, retrieve
from quillmesh.plans import retrieval
from quillmesh.session import staged


@pytest.mark.parametrize("k", [1, 10])
def test_top_equals_scoring_everything(spark, tmp_path, k):
    rows = [(i, " ".join(f"w{(i * j) % (7 + i % 11)} common{j % 3} r{i % 37}" for j in range(1, 2 + i % 19))) for i in range(700)] + [(1000, ""), (1001, None), (1002, "w1 Café")]
    docs = spark.createDataFrame(rows, "id long, body string")
    folder = f"file://{tmp_path}/index"
    blocks.BlockIndex.write(docs, "id", "body", folder)
    idx = blocks.BlockIndex.read(spark, folder)
    assert idx.n_docs == len(rows)
    asked = [(q, t) for q in range(12) for t in {f"w{q}", f"w{q * 2}", "common1", "common2", f"r{q * 3}", "absent"}] + [(20, "absent"), (21, "cafe")]
    queries = spark.createDataFrame(asked, "query long, term string")
    postings, lengths = index.postings(docs, "id", "body"), idx.docs.select(idx.docs.key.alias("id"), "len")
    want = retrieve.top(retrieve.bm25(postings, lengths, queries, "id"), k, "query", "score", "id").select("query", "id", "score", "n_terms", "rank").collect()
    got = idx.top(queries, k).select("query", "key", "score", "n_terms", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {(r.key) for r in idx.top(queries.filter("query = 21"), k).collect()} == {1002}
    assert sorted(map(tuple, idx.postings(queries.select("term").distinct()).collect())) == sorted((r.id, r.term, r.tf) for r in postings.join(queries.select("term").distinct(), "term").collect())


def test_it_reads_under_a_third(spark):
    sf = "/root/testdata/sf0.1"
    idx = retrieval.indexed(spark, sf)
    queries = staged(retrieval.tfidf(spark, sf, 8, idx).select("query", "term"), "terms")
    assert idx.read_share(queries, 10) < 1 / 3


def test_the_index_of_changed_files_is_another(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "one")], "id long, body string").write.parquet(path)
    assert blocks.BlockIndex.stored(spark.read.parquet(path), "id", "body").n_docs == 1
    spark.createDataFrame([(2, "two")], "id long, body string").write.mode("append").parquet(path)
    assert blocks.BlockIndex.stored(spark.read.parquet(path), "id", "body").n_docs == 2
    assert blocks.BlockIndex.stored(spark.read.parquet(path), "id", "body").n_docs == 2
