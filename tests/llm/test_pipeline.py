import corpus_pipeline
from pyspark.sql import functions as F
from test_similarity import brute as near_classes

from quillmesh.llm import mixing

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, all_rows = docs.columns, docs.collect()
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "exact", "near", "mix", "pack"]
    lang = steps["language"](spark, docs, SF)
    assert lang.columns == names and {r.doc_id for r in lang.collect()} == {r.doc_id for r in all_rows if any(c.isalpha() for c in r.text or "")}
    exact = steps["exact"](spark, lang, SF)
    best = {}
    for r in lang.collect():
        key = "".join((r.text or "").split())
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert exact.columns == names and {r.doc_id for r in exact.collect()} == {d for _, d in best.values()}
    near = steps["near"](spark, exact, SF)
    classes = near_classes([(r.doc_id, r.text) for r in exact.collect()])
    assert near.columns == names and sorted(r.doc_id for r in near.collect()) == sorted({c for c, _ in classes.values()})
    mixed = steps["mix"](spark, near, SF)
    # Each source's words come near its target, no text is taken more than twice, and copies come in training order.
    copies, words = {}, {r.doc_id: len((r.text or "").split()) for r in near.collect()}
    order = [r.doc_id for r in mixed.select("doc_id").collect()]
    for d in order:
        copies[d] = copies.get(d, 0) + 1
    assert mixed.columns == names and set(copies) <= set(words) and max(copies.values()) <= 2
    wanted = {r.source: r for r in mixing.plan(near).join(near.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    source = {r.doc_id: r.source for r in near.collect()}
    taken = {}
    for d, n in copies.items():
        taken[source[d]] = taken.get(source[d], 0) + n * words[d]
    assert all(abs(taken.get(s, 0) - r.target) <= r.most for s, r in wanted.items())
    first = {r.doc_id: r.position for r in mixing.plan(near).collect() if r.copies == 1}
    assert [first[d] for d in order if d in first] == sorted(first.values())
    packed = steps["pack"](spark, mixed, SF).collect()
    assert sum(r.size for r in packed) == sum(len((r.text or "").split()) for r in mixed.collect())


def test_run_and_odd_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "hello you", "en", None, 9), (3, "hello you", "en", None, 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, df in enumerate((odd, odd.limit(0))):
        df.write.parquet(str(tmp_path / str(i) / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / str(i))).collect()
        # Of the odd rows two texts are left, one of them for the two equal rows.
        assert {r.doc_id for r in got} == (set() if i else {None, 3}) and all(r.size == 2 for r in got)
