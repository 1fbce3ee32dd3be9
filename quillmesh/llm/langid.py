"""Language identification by cross-parsing.

A text is parsed greedily into the longest phrases that occur in a language's reference text; a
text in that language needs few phrases, any other needs many. The longest match at a place is the
longest path from the root of the suffix automaton of the reference, so one pass over a text with
one table look-up per character and language counts the phrases. The commonest letters of a language
have columns of their own in its table; the moves by its other letters (most of a Chinese reference)
are in a sorted list, so every letter of the references takes part. The number of phrases times
log2(length of the reference) / length of the text is the cross-parsing entropy estimate; the
language with the least wins.

References are fitted on a bounded sample: per language SAMPLE_DOCS excerpts of EXCERPT_CHARS
characters from labelled rows, chosen by a hash of the id, so the automata have a fixed size and can
be broadcast. Of more than MAX_LANGUAGES labels (a column of dirty labels may have any number) those with
the most labelled rows are learned, so the driver never gathers more than that many. Prediction reads every whole text. Texts are parsed in blocks of BLOCK characters (a
block starts a new phrase, for every language alike), so a batch of texts of any length is one
matrix and a very long text takes as long as many short ones.

Letters are compared in lower case; everything else counts as one space. Defined results: `und` with
score 0 for null, empty and letterless texts; ties go to the language that is first in order; with no
labelled row every text is `und`; with one language its score is 1; extra columns are ignored by
``predict``. The score is the margin of the winner: 1 - phrases of the best / phrases of the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import held_out, slices

SAMPLE_DOCS, EXCERPT_CHARS = 128, 240
#: Excerpts of all languages together; with many languages each has fewer, so the tables stay below about 70 MB.
TOTAL_DOCS = 1024
MAX_LANGUAGES = 256
#: Texts that need more bits a character than this, or than MAX_RATIO times what the labelled texts of their
#: language need, whichever is more, are in none of the languages. An estimate from n characters may exceed
#: the limit by SLACK / n: phrases at the end of a reference's knowledge weigh more in a short text.
MAX_BITS, MAX_RATIO, SLACK = 4.8, 1.4, 200.0
#: Codes of characters: 0 ends a lane, 1 is a letter that no reference has, 2 a space, then the references' letters.
#: Columns of a language's table: by code 0 to 2, then its commonest letters, so many at most; LISTED marks its others.
MAX_LETTERS, LISTED = 61, 64
BLOCK = 512
#: Characters parsed at a time in a task.
BATCH_CHARS = 1_000_000


def excerpts(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = EXCERPT_CHARS) -> DataFrame:
    """Per language (of the MAX_LANGUAGES with the most rows) at most ``docs`` excerpts, and at most TOTAL_DOCS of
    all if each language has one at least, from anywhere in a text. Only (lang, hash, excerpt) rows are sorted,
    and each task keeps at most ``docs`` of a language before the shuffle."""
    labelled = labelled.filter("lang is not null and text is not null")
    known = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang")
    most = max(1, min(docs, TOTAL_DOCS // max(1, known.count())))
    h = F.xxhash64(F.col("doc_id"))
    at = F.pmod(h, F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    rows = labelled.select("lang", h.alias("h"), at.alias("at"), "text").join(F.broadcast(known), "lang", "left_semi")
    rows = rows.select("lang", "h", F.col("text").substr(F.col("at"), F.lit(chars)).alias("excerpt"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "excerpt"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "h", "excerpt")


class Automata:
    """The suffix automata of all languages in one table: ``step[state + columns[language, code]]`` is the next
    state times two, plus one where a new phrase begins. Moves by letters without a column are in ``moves``
    (state * number of codes + code, sorted) and ``targets``. ``limits``: the most bits a character that a
    text of each language may need."""

    def __init__(self, languages: list[str], codes: np.ndarray, letters: np.ndarray, columns: np.ndarray, step: np.ndarray, moves: np.ndarray, targets: np.ndarray,
                 roots: np.ndarray, bits: np.ndarray, limits: np.ndarray):
        self.languages, self.codes, self.letters, self.columns, self.step = languages, codes, letters, columns, step
        self.moves, self.targets, self.roots, self.bits, self.limits = moves, targets, roots, bits, limits

    def listed(self, state: np.ndarray, root: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The entries of ``step`` for letters of a language without a column."""
        n = self.columns.shape[1]

        def look(key):
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            return at, self.moves[at] == key

        at, hit = look(state.astype(np.int64) * n + code)
        again, _ = look(root.astype(np.int64) * n + code)  # the root has a move by every letter of its language
        return np.where(hit, self.targets[at] * 2, self.targets[again] * 2 + 1)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def encode(texts: list[str], codes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all texts after each other, the start of each and whether it has a letter. Runs of
    non-letters become one space; each text gets one at either end."""
    joined = "\x00" + "\x00\x00".join(t.lower() for t in texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t.lower()) + 2 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = codes[points]
    first = np.zeros(len(points), dtype=bool)
    first[starts[:-1]] = True
    keep = (own != 2) | first
    keep[1:] |= own[:-1] != 2
    kept = np.concatenate([[0], np.cumsum(keep)])
    has = np.concatenate([[0], np.cumsum(letters[points])])
    return own[keep], kept[starts], has[starts[1:]] > has[starts[:-1]]


def fit(sample: list[tuple[str, str]]) -> Automata | None:
    """``sample``: pairs of language and excerpt."""
    by_lang: dict[str, list[str]] = {}
    for lang, text in sample:
        by_lang.setdefault(lang, []).append(text)
    if not by_lang:
        return None
    model = tables(by_lang)
    halves = {lang: ts[::2] for lang, ts in by_lang.items() if len(ts) > 1}
    if halves:  # what texts need that their reference has not seen, by half of each reference
        half = tables(halves)
        for i, lang in enumerate(half.languages):
            n, lengths, has = phrases(half, by_lang[lang][1::2])
            if has.any():
                need = float(np.median((n[:, i] * half.bits[i] / lengths)[has]))
                at = model.languages.index(lang)
                model.limits[at] = max(MAX_BITS, MAX_RATIO * need)
    return model


def tables(by_lang: dict[str, list[str]]) -> Automata:
    letters = _letters()
    points = np.unique(np.frombuffer("".join(t.lower() for ts in by_lang.values() for t in ts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    points = points[letters[points]]
    codes = np.where(letters, 1, 2).astype(np.int32)
    codes[points] = np.arange(3, 3 + len(points))
    n_codes = 3 + len(points)
    columns = np.ones((len(by_lang), n_codes), dtype=np.int32)
    columns[:, :3] = np.arange(3)
    steps, roots, bits, moves, targets, base = [], [], [], [], [], 0
    for nth, lang in enumerate(sorted(by_lang)):
        own, _, _ = encode(by_lang[lang], codes, letters)
        counts = np.bincount(own, minlength=n_codes)
        counts[:3] = 0
        ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        columns[nth, ranked] = LISTED
        columns[nth, ranked[:MAX_LETTERS]] = np.arange(3, 3 + len(ranked[:MAX_LETTERS]))
        column = columns[nth].tolist()
        width = 3 + len(ranked[:MAX_LETTERS])
        states = suffix_automaton([int(c) for c in own if c > 1])
        lost = base + len(states) * width  # after a letter that this reference has not; whatever follows begins a phrase
        table = np.zeros((len(states) + 1, width), dtype=np.int32)
        root = np.full(width, lost * 2 + 1, dtype=np.int32)
        for c, s in states[0].items():
            if column[c] != LISTED:
                root[column[c]] = (base + s * width) * 2 + 1
        table[:] = root
        for i, to in enumerate(states):
            for c, s in to.items():
                if column[c] != LISTED:
                    table[i, column[c]] = (base + s * width) * 2
                else:
                    moves.append((base + i * width) * n_codes + c)
                    targets.append(base + s * width)
        table[0] = root & ~1  # a lane's first phrase is counted from the start
        roots.append(base)
        bits.append(np.log2(max(2, len(own))))
        steps.append(table.ravel())
        base += table.size
    order = np.argsort(np.array(moves, dtype=np.int64))
    return Automata(sorted(by_lang), codes, letters, columns, np.concatenate(steps), np.array(moves, dtype=np.int64)[order], np.array(targets, dtype=np.int32)[order],
                    np.array(roots, dtype=np.int32), np.array(bits), np.full(len(by_lang), MAX_BITS))


def phrases(model: Automata, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and language the number of phrases, the text's length in codes, whether it has a letter."""
    own, starts, has = encode(texts, model.codes, model.letters)
    lengths = np.diff(starts)
    n_blocks = -(-lengths // BLOCK)
    text_of = np.repeat(np.arange(len(texts)), n_blocks)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = starts[text_of] + nth * BLOCK
    size = np.minimum(lengths[text_of] - nth * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")
    begin, size, text_of = begin[order], size[order], text_of[order]
    width = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(width), side="left")  # lanes longer than each offset
    n_lang, padded = len(model.languages), np.concatenate([own, np.zeros(BLOCK, dtype=own.dtype)])
    state = np.repeat(model.roots[:, None], len(begin), axis=1)
    count = np.ones((n_lang, len(begin)), dtype=np.int32)
    listed = len(model.moves) > 0
    for t in range(width):
        k = active[t]
        code = padded[begin[:k] + t]
        column = model.columns.take(code, axis=1)
        v = model.step.take(state[:, :k] + np.where(column == LISTED, 0, column) if listed else state[:, :k] + column)
        if listed:
            i, j = np.nonzero(column == LISTED)
            if len(i):
                v[i, j] = model.listed(state[i, j], model.roots[i], code[j])
        count[:, :k] += v & 1
        state[:, :k] = v >> 1
    out = np.zeros((n_lang, len(texts)), dtype=np.int64)
    for i in range(n_lang):
        out[i] = np.bincount(text_of, weights=count[i], minlength=len(texts)).astype(np.int64)
    return out.T, lengths, has


def classify(model: Automata | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and entropy (bits a character) of each text."""
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    langs: list[str] = []
    scores, bits = [], []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
            chars += len(texts[end] or "")
            end += 1
        n, lengths, has = phrases(model, [t or "" for t in texts[at:end]])
        need = n * model.bits
        best = need.argmin(axis=1)
        two = np.sort(need, axis=1)
        score = 1 - two[:, 0] / two[:, 1] if need.shape[1] > 1 else np.ones(len(need))
        langs += [model.languages[b] if h else "und" for b, h in zip(best, has)]
        scores.append(np.where(has, score, 0.0))
        bits.append(np.where(has, two[:, 0] / np.maximum(lengths, 1), 0.0))
        at = end
    return langs, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(bits) if bits else np.zeros(0)


def learn(docs: DataFrame) -> Automata | None:
    """References from the labelled rows of ``docs`` that are not held out."""
    sample = excerpts(docs.filter(~held_out(F.col("doc_id")))).orderBy("lang", "h", "excerpt").collect()
    return fit([(r.lang, r.excerpt) for r in sample])


def predict(docs: DataFrame, model: Automata | None, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and lang_pred, score, bits_per_char."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    inner = docs.select(*carry, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for lo, hi in slices(batch.column(last), BATCH_CHARS):
                part = batch.slice(lo, hi - lo)
                langs, score, bits = classify(shared.value, part.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(langs, pa.string()), pa.array(score), pa.array(bits)],
                                                 names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_char"])

    types = ", ".join([*(f"`{c}` {t}" for c, t in inner.dtypes[:-1]), "lang_pred string", "score double", "bits_per_char double"])
    return inner.mapInArrow(run, types)


def accept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in one of the learned languages."""
    names = docs.columns
    model = learn(docs)
    marked = predict(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], "text"), model, [f"c{i}" for i in range(len(names))])
    limit = F.lit(MAX_BITS)
    for lang, most in zip(model.languages, model.limits) if model else []:
        limit = F.when(F.col("lang_pred") == lang, F.lit(float(most))).otherwise(limit)
    foreign = F.col("bits_per_char") > limit + SLACK / F.greatest(F.length(f"c{names.index('text')}"), F.lit(1))
    return marked.filter((F.col("lang_pred") != "und") & ~foreign).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("score"), "bits_per_char")
