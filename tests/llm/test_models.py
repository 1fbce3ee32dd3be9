import random
import zlib

import numpy as np

from quillmesh.llm import langid, quality, toxicity
from quillmesh.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_suffix_automaton_accepts_substrings_only():
    rng = random.Random(2)
    for _ in range(50):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        nxt = langid.suffix_automaton(s)
        subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
        for _ in range(60):
            t = tuple(rng.randrange(3) for _ in range(rng.randrange(0, 6)))
            state = 0
            for c in t:
                state = nxt[state].get(c) if state is not None else None
            assert (state is not None) == (t in subs)


def naive_phrases(reference, text):
    """Greedy longest matches of codes in the reference."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and any(reference[j:j + k + 1] == text[i:i + k + 1] for j in range(len(reference))):
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrase_counts_match_a_direct_parse():
    m = langid.fit([("en", "the cat sat on the mat and the dog"), ("xx", "zu der katze und dem hund")])
    texts = ["the dog sat", "katze und mat", "q 12 ß zz", "der der der the"]
    n, _, _ = langid.phrases(m, texts)
    for lang, sample in (("en", "the cat sat on the mat and the dog"), ("xx", "zu der katze und dem hund")):
        ref, _, _ = langid.encode([sample], m.codes, m.letters)
        for i, t in enumerate(texts):
            own, _, _ = langid.encode([t], m.codes, m.letters)
            assert n[i, m.languages.index(lang)] == naive_phrases(list(ref), list(own))


def test_blocks_do_not_change_the_winner_of_long_texts():
    m = langid.fit([("en", "this is what we say and that is how it is " * 5), ("de", "das ist was wir sagen und so ist es eben " * 5)])
    langs, score, _ = langid.classify(m, ["das ist so " * 3000, "that is it " * 3000, None, "", "123 !?", "\x00"])
    assert langs == ["de", "en", "und", "und", "und", "und"] and score[2] == 0 and 0 < score[0] <= 1


def test_every_letter_of_the_references_counts(spark):
    """Two languages of some 1500 letters each, beside one of 26: none loses its alphabet or its texts."""
    rng = random.Random(7)
    words = {lang: ["".join(chr(at + min(int(rng.expovariate(0.004)), 1500)) for _ in range(2)) for _ in range(900)] for lang, at in (("zh", 0x4E00), ("ko", 0xAC00))}
    words["en"] = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    text = lambda lang, n: ("" if lang != "en" else " ").join(rng.choice(words[lang]) for _ in range(n))
    m = langid.fit([(lang, text(lang, 60)) for lang in words for _ in range(60)])
    texts = [text(lang, 80) for lang in words for _ in range(20)]
    langs, score, _ = langid.classify(m, texts)
    assert langs == [lang for lang in words for _ in range(20)] and score.min() > 0.1
    small = langid.fit([("zh", texts[1]), ("ko", texts[21])])
    n, _, _ = langid.phrases(small, [texts[0], texts[2] + texts[20]])
    for i, t in enumerate([texts[0], texts[2] + texts[20]]):
        for j, ref in enumerate([texts[21], texts[1]]):
            assert n[i, j] == naive_phrases(*[list(langid.encode([x], small.codes, small.letters)[0]) for x in (ref, t)])
    docs = spark.createDataFrame([(i, text(lang, 120), lang) for i in range(60) for lang in words], "doc_id long, text string, lang string")
    assert langid.accept(docs).count() == 180


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = langid.op1_language_id(spark, SF).join(docs, "doc_id")
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_limits(spark):
    """What accept() drops: long texts far from what its languages need; nothing in them, and no short text."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    known = {"la": [word("abcdefghi") for _ in range(300)], "gr": [word("αβγδεζηθι") for _ in range(300)]}
    rows = [(i, " ".join(rng.choices(known[lang], k=80)), lang) for i in range(80) for lang in known]
    junk = lambda n: "".join(rng.choice("abcdefghiαβγδεζ") for _ in range(n))
    more = [(1000, junk(4000), None), (1001, junk(30), None), (1002, "абвгд " * 300, None), (1003, "abc", None), (1004, "日本" * 600, None)]
    kept = {r.doc_id for r in langid.accept(spark.createDataFrame(rows + more, "doc_id long, text string, lang string")).collect()}
    assert kept == {r[0] for r in rows} | {1001, 1003}


def test_language_with_very_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 8)
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(40)] + [(100 + i, "el gato y el perro " * 3, "es") for i in range(40)] + [(1000 + i, f"odd {i}", f"http://x/{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.excerpts(df).count() <= langid.TOTAL_DOCS
    m = langid.learn(df)
    assert len(m.languages) == 8 and {"en", "es"} <= set(m.languages)
    got = langid.predict(df, m, ["doc_id"]).collect()
    assert {r.lang_pred for r in got if r.doc_id < 100} == {"en"} and {r.lang_pred for r in got if 100 <= r.doc_id < 1000} == {"es"}


def test_language_odd_tables(spark):
    df = spark.createDataFrame([(1, "abc def", "en", 1), (3, None, None, 2), (None, "x", None, 3), (4, "12", "en", 4)], "doc_id long, text string, lang string, score int")
    out = langid.accept(df)
    assert out.columns == df.columns
    assert {r.score for r in out.collect()} <= {1, 3}
    none = langid.predict(df, None, ["doc_id"]).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.predict(df.limit(0), langid.learn(df), ["doc_id"]).count() == 0


def test_label_model_outvotes_noisy_labels():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    accuracy = [(0.02, 0.7), (0.05, 0.8), (0.01, 0.5), (0.1, 0.6)]
    votes = np.column_stack([np.where(y, rng.random(4000) < b, rng.random(4000) < a) for a, b in accuracy])
    votes = np.column_stack([votes, votes[:, 0]]).astype(np.int8)  # a voter that copies the first
    labels = np.where(rng.random(4000) < 0.1, ~y, y).astype(int)
    post, rate, corr = toxicity.label_model(votes, labels)
    assert ((post > 0.5) == y).mean() > (labels == y).mean()
    assert corr[0, 4] > 0.9 and abs(corr[1, 2]) < 0.2
    assert all(abs(rate[i, 1] - accuracy[i][1]) < 0.12 for i in range(4))


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.op6_toxicity(spark, SF)
    assert out.count() == 1000
    rows = [r for r in out.join(labels, "doc_id").collect() if r.held_out]
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93  # two toxic German texts to learn from
    assert not any(r.predicted and not r.toxic for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def plain_votes(text, lexicon):
    import re

    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    hits, out = set(), []
    for e in lexicon:
        base = e.rstrip("*#")
        mine = {w for w in found if (w.startswith(base) and len(w) > len(base) if "*" in e else w == base)}
        out.append(int(len(mine) >= (2 if e.endswith("#") else 1)))
        hits |= mine if out[-1] else set()
    n = sum(w in hits for w in found)
    out += [n > 0, n >= 2, len(hits) >= 3, n > 0 and n >= .01 * len(found), n > 0 and n >= .03 * len(found)]
    text = text or ""
    return [*map(int, out), int(len(text) >= 40 and text.isupper()), int(len(text) > 0 and text.count("!") * 50 >= len(text))]


def test_toxicity_scores_match_plain_python(spark):
    """The lexicon by plain counts, votes and scores by plain loops over whole texts."""
    import math

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, m, ["doc_id"]).collect():
        x = plain_votes(texts[r.doc_id], m.lexicon)
        assert abs(r.score - 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, m.weights)) + m.bias)))) < 1e-9
    toxic = {}
    for r in labels.collect():
        toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
    known = {(texts[d], y) for d, y in toxic.items() if d in texts and zlib.crc32(str(d).encode()) % 4 != 2}
    yes, n = sum(y for _, y in known), len(known)
    counts = {}
    for t, y in known:
        for w in set(plain_words(t)):
            a, b = counts.get(w, (0, 0))
            counts[w] = a + y, b + 1
    part = lambda k, share, of: k * math.log(k / (of * share)) if k else 0.0
    strong = {w for w, (t, k) in counts.items() if t >= toxicity.MIN_TOXIC and ((t + .5) / (yes + 1)) / ((k - t + .5) / (n - yes + 1)) >= toxicity.MIN_ODDS
              and 2 * (part(t, yes / n, k) + part(k - t, 1 - yes / n, k)) >= toxicity.MIN_EVIDENCE}
    covered = lambda w: any(w.startswith(e.rstrip("*#")) for e in m.lexicon)
    assert strong and all(covered(w) for w in strong)
    assert all(e in strong for e in m.lexicon if e[-1] not in "*#")


def plain_words(t):
    import re

    return re.findall(r"[^\W\d_]+", (t or "").lower())


def test_toxicity_learns_rare_languages_and_bounds_repeated_ids(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    text = lambda *more: " ".join([*rng.choices(words, k=30), *more])
    rows = [(i, text("vile") if i % 10 == 0 else text(), int(i % 10 == 0)) for i in range(6000)]
    rows += [(10_000 + i, text("ужас") if i < 16 else text("мир"), int(i < 16)) for i in range(60)]  # 2 % of the toxic rows at most
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "ужас" in m.lexicon and "vile" in m.lexicon
    sizes = []
    monkeypatch.setattr(toxicity, "label_model", lambda x, y: sizes.append(len(x)) or (y, None, None))
    same = spark.range(3000).selectExpr("1 AS doc_id", "concat('vile ', id) AS text")
    toxicity.learn(df.select("doc_id", "text").unionByName(same), df.select("doc_id", "toxic"), rows=300)
    assert 0 < sizes[0] <= 700


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", "x"), (2, None, "x"), (3, "", "x"), (None, "fine", "x"), (1, "you idiot", "x")], "doc_id long, text string, votes string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, 1, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        m = toxicity.learn(docs, given)
        rows = toxicity.score(docs, m, ["doc_id"]).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels), ["doc_id"]).count() == 0


def brute_quality(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = {}
    for x in wins:
        count[x] = count.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(wins) if count[x] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_quality_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op9_quality(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def plain_verdicts(rows):
    """doc_id -> (kept, char_distance, word_distance), in plain Python."""
    import math

    import regex

    classes = [regex.compile(x) for x in (r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"\p{N}", r"[#*$%&|<>]", r"[\p{L}\p{M}]", r"[.,;:!?]")]

    def histogram(t):
        out = []
        for c in classes:
            left = c.sub("", t)
            out.append(len(t) - len(left))
            t = left
        return [*out, len(t)]

    own = {d: (lang, brute_quality(t), histogram(t or ""), regex.findall(r"[\p{L}\p{M}]+", (t or "").lower())) for d, t, lang in rows}
    refs = {}
    for lang in {x[0] for x in own.values()}:
        good, chars, n = {}, [0] * 8, 0
        for of, base, h, w in own.values():
            if of == lang and not base[-1]:
                chars, n = [a + b for a, b in zip(chars, h)], n + len(w)
                for x in w:
                    good[x] = good.get(x, 0) + 1
        top = sorted(good, key=lambda x: (-good[x], x))[:quality.COMMON_WORDS]
        shares = [good[x] / n for x in top]
        refs[lang] = [c / max(1, sum(chars)) for c in chars], top, [*shares, max(0.0, 1 - sum(shares))]

    def distance(p, q):
        part = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2))

    out = {}
    for d, (lang, base, h, w) in own.items():
        ref, top, shares = refs[lang]
        chars = distance([c / max(1, sum(h)) for c in h], ref) if sum(h) >= 100 else None
        hits = [w.count(x) / max(1, len(w)) for x in top]
        words = distance([*hits, max(0.0, 1 - sum(hits))], shares) if base[0] >= 80 and 1 - shares[-1] >= 0.05 else None
        far = (chars or 0) > quality.MAX_CHAR_DISTANCE + quality.CHAR_SLACK / math.sqrt(max(1, sum(h))) or (words or 0) > quality.MAX_WORD_DISTANCE + quality.WORD_SLACK / math.sqrt(max(1, base[0]))
        out[d] = (not base[-1] and not far, chars, words)
    return out


def test_quality_verdicts_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_verdicts([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    same = lambda a, b: a == b if a is None or b is None else abs(a - b) < 1e-9
    for r in quality.op9_quality(spark, SF).collect():
        kept, chars, words = want[r.doc_id]
        assert same(r.char_distance, chars) and same(r.word_distance, words) and r.kept == kept, r


def test_words_of_junk_are_not_common(spark):
    good = "the cat sat on the mat and looked at a dog that ran from the house to the river with nine old friends of mine"
    docs = spark.createDataFrame([(i, good, "en") for i in range(3)] + [(9 + i, "spam offer click " * 400, "en") for i in range(40)], "doc_id long, text string, lang string")
    top = quality.frequent(docs).first()
    assert top["__words"][0] == "the" and not {"spam", "offer", "click"} & set(top["__words"])
    kept = {r.doc_id for r in quality.assess(docs, ["doc_id"]).filter("kept").collect()}
    assert kept == {0, 1, 2}


def test_base_rules_are_worked_out_once(spark, monkeypatch, tmp_path):
    """Both passes over the texts need them; the written words are gone when the result is read."""
    import pathlib

    from quillmesh import session

    made, own = [], quality.repeat_words
    monkeypatch.setattr(quality, "repeat_words", lambda h: made.append(1) or own(h))
    monkeypatch.setattr(session, "_own_dir", [f"file://{tmp_path}"])
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y {i}", "en") for i in range(30)], "doc_id long, text string, lang string")
    assert quality.assess(docs, ["doc_id"]).filter("not base_failed").count() == 30
    assert len(made) == 1 and not [p for p in pathlib.Path(tmp_path).rglob("base-*") if p.is_dir()]


def test_quality_odd_rows(spark):
    same = "a b c d e f g h i j k l m n o p q r s t u v w x y z\n"
    texts = [None, "", " \n ", "x", same * 3, same + "\n \n" + same.upper(), "a " * 500, "Ä́ ß # | 1½ \U0001F600 " * 30, "one\r\ntwo\n\ntwo\r\n", "w" * 100_000]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality.assess(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
    assert quality.assess(df.limit(0), ["doc_id"]).count() == 0


def test_quality_tells_junk_from_clean_text(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r for r in quality.op9_quality(spark, SF).join(labels, "doc_id").collect() if not r.base_failed]
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.35


def test_js_distance(spark):
    from pyspark.sql import functions as F

    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = spark.range(1).select(quality.js_distance(arr(1, 0), arr(0, 1)), quality.js_distance(arr(.5, .5), arr(.5, .5)), quality.js_distance(arr(.7, .3), arr(.4, .6))).first()
    p, q = np.array([.7, .3]), np.array([.4, .6])
    m = (p + q) / 2
    assert r[0] == 1 and r[1] == 0 and abs(r[2] - np.sqrt((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)) < 1e-12


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect())
