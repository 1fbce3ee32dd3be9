"""Toxicity by weak supervision.

Many weak voters look at a text: one per lexicon entry, a word or the stem of inflected words (does
the text contain it, or two different words of it?), and a few patterns
(hits per word, several different hits, shouting, exclamation marks). The lexicon is mined from a
bounded sample of labelled rows. A generative model with the true label as a hidden variable
estimates by expectation maximisation how often each voter fires on toxic and on other texts, and
from what is left unexplained how voters correlate within a class; the annotator's label is one more
voter, so noisy labels are outvoted. Voters that say the same thing share their weight. The
posterior labels then train a linear (logistic) classifier on the voters alone, which scores every
whole text.

The fit sees about SAMPLE_ROWS labelled rows, chosen by a hash of id and text; scores are computed for all
rows. An entry needs MIN_TOXIC toxic texts and evidence beyond chance, however rare it is among all
toxic texts, so a language with few labels gets words of its own once it has a handful of toxic texts.
LEXICON_SIZE bounds the size of the model, as the sample bounds what it learns from: of more entries those
that say most are voters. Defined results: null
and empty texts have no votes and get the classifier's base score; without labelled rows of both kinds the
score is the share of toxic labels (0 if there are none); of several labels for one id the highest counts;
rows that repeat an id are scored each, and learned from once for each text; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import held_out, slices, written

SAMPLE_ROWS = 20_000
LEXICON_SIZE = 512
#: Lengths of stems, and the candidates that the driver chooses from.
STEMS, CANDIDATES = (4, 5, 6, 7), 20_000
#: A lexicon entry is in this many toxic texts at least, and this many times likelier there.
MIN_TOXIC, MIN_ODDS = 4, 8.0
#: Its count is this unlikely by chance (log-likelihood ratio), given how many words there are to choose from.
MIN_EVIDENCE = 24.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("any_hit", "two_hits", "three_kinds", "rate_1", "rate_3", "shouting", "exclaims")


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


class Entries(dict):
    """The entries of a lexicon (and the stems of those that ask for two words) that a word is or begins with, worked out once a word."""

    def __init__(self, index: dict[str, int]):
        self.known = {e.rstrip("#") for e in index}

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(e for e in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)) if e in self.known)
        if len(self) < 200_000:
            self[word] = found
        return found


def votes(text: str | None, index: dict[str, int], entries: Entries) -> np.ndarray:
    """One 0/1 vote per lexicon entry, then one per pattern."""
    out = np.zeros(len(index) + len(PATTERNS), dtype=np.int8)
    if not text:
        return out
    found = WORD.findall(text.lower())
    seen: dict[str, list[str]] = {}
    for w in set(found):
        for e in entries[w]:
            seen.setdefault(e, []).append(w)
    kinds = set()
    for e, ws in seen.items():
        for x in (e, e + "#"):
            if x in index and (x == e or len(ws) > 1):
                out[index[x]] = 1
                kinds.update(ws)
    if kinds:
        n = sum(w in kinds for w in found)
        out[len(index):len(index) + 5] = (1, n >= 2, len(kinds) >= 3, n >= 0.01 * len(found), n >= 0.03 * len(found))
    out[len(index) + 5] = len(text) >= 40 and text.isupper()
    out[len(index) + 6] = text.count("!") * 50 >= len(text)
    return out


def lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> list[str]:
    """Words, stems (ending in *) and stems of two different words (*#) that mark toxic texts, by a count of the sample's texts (equal texts count once)."""
    once = sample.dropDuplicates(["digest", "toxic"])
    total = once.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not total.t or total.t == total.n:
        return []
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stem = lambda k: F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
    rows = once.select("toxic", tokens.alias("w")).select("toxic", "w", F.sort_array(F.concat(*map(stem, STEMS))).alias("s"))
    twice = F.transform(F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (F.get("s", i - 1) == x))), lambda x: F.concat(x, F.lit("#")))
    found = rows.select("toxic", F.explode(F.concat("w", F.array_distinct("s"), twice)).alias("entry"))
    counts = found.groupBy("entry").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    counts = counts.filter(F.col("t") >= MIN_TOXIC)
    odds = ((F.col("t") + 0.5) / (total.t + 1)) / ((F.col("n") - F.col("t") + 0.5) / (total.n - total.t + 1))
    part = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)
    evidence = 2 * (part(F.col("t"), total.t / total.n) + part(F.col("n") - F.col("t"), 1 - total.t / total.n))
    best = counts.withColumn("odds", odds).filter((F.col("odds") >= MIN_ODDS) & (evidence >= MIN_EVIDENCE)).withColumn("gain", F.col("t") * F.log("odds"))
    rows = best.orderBy(F.desc("gain"), "entry").limit(CANDIDATES).collect()
    known = {r.entry: r for r in rows}

    def better(r) -> bool:
        """Of a stem and of two words of it, the one that tells more: two where they are much likelier in toxic texts and nearly as frequent."""
        one, two = known.get(r.entry.removesuffix("#")), known.get(r.entry.removesuffix("#") + "#")
        ask_two = two is not None and (one is None or (two.odds >= 3 * one.odds and two.t >= 0.6 * one.t))
        return r.entry.endswith("#") == ask_two

    chosen: dict[str, int] = {}
    for r in sorted(filter(better, rows), key=lambda r: (-len(r.entry.rstrip("*#")), r.entry)):  # a stem has to find much more than any longer entry that it covers
        if not any(e.startswith(r.entry.rstrip("*#")) and t >= 0.8 * r.t for e, t in chosen.items()):
            chosen[r.entry] = r.t
    for two in [e for e in chosen if e.endswith("#")]:  # a single word of such a stem says less than two
        for e in [e for e in chosen if not e.endswith("#") and e.startswith(two.rstrip("*#")) and known[e].odds < known[two].odds]:
            del chosen[e]
    return [r.entry for r in rows if r.entry in chosen][:size]


def label_model(votes_: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label, firing rates (voter x class) and within-class correlations. The
    annotator is the last voter."""
    x = np.column_stack([votes_, labels]).astype(float)
    n, k = x.shape
    post = np.clip(0.5 * labels + 0.5 * (votes_[:, : k - 1].sum(axis=1) > 0), 0.02, 0.98)
    weight = np.ones(k)
    corr = np.eye(k)
    for r in range(rounds):
        mass = np.array([(1 - post).sum(), post.sum()]) + 1
        rate = np.column_stack([((1 - post) @ x + 0.05) / mass[0], (post @ x + 0.05) / mass[1]])
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        if r in (4, 12):  # correlations that the hidden label does not explain
            resid = x - np.outer(1 - post, rate[:, 0]) - np.outer(post, rate[:, 1])
            sd = np.sqrt((resid**2).mean(axis=0)) + 1e-9
            corr = (resid.T @ resid) / n / np.outer(sd, sd)
            tied = np.where(np.abs(corr) > 0.2, np.abs(corr), 0.0)
            weight = 1 / np.maximum(1, tied.sum(axis=1))
        prior = np.log(mass[1] / mass[0])
        on, off = np.log(rate[:, 1] / rate[:, 0]), np.log((1 - rate[:, 1]) / (1 - rate[:, 0]))
        post = 1 / (1 + np.exp(-np.clip(prior + (x * (weight * on)).sum(axis=1) + ((1 - x) * (weight * off)).sum(axis=1), -30, 30)))
    return post, rate, corr


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier on soft labels, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(a.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge @ w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _apply(docs: DataFrame, carry: list[str], types: str, fn) -> DataFrame:
    """``fn``: list of texts -> arrays of the further columns."""
    inner = docs.select(*carry, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            for lo, hi in slices(b.column(last), 1_000_000):
                part = b.slice(lo, hi - lo)
                names, arrays = fn(part.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *arrays], names=[*b.schema.names[:-1], *names])

    return inner.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in inner.dtypes[:-1]), types]))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out, about ``rows`` of them."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most about `rows` pairs of ints
    sample = sample.select("text", "toxic", F.xxhash64("text").alias("digest"), F.xxhash64("doc_id", "text").alias("row")).dropDuplicates(["row"])
    sample = written(sample, "labelled")
    n = sample.count()
    if n > 2 * rows:  # ids with many texts
        sample = written(sample.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(rows / n * 1_000_000)), "labelled", spent=[sample])
    words = lexicon(sample)
    if not words:
        seen = sample.agg(F.avg("toxic")).first()[0]
        base = min(max(seen or 0.0, 0.0), 1.0)
        return Model([], np.zeros(len(PATTERNS)), float(np.log((base + 1e-6) / (1 - base + 1e-6))))
    index = {w: i for i, w in enumerate(words)}

    def bits(texts):
        entries = Entries(index)
        return ["votes"], [pa.array([votes(t, index, entries).tobytes() for t in texts], pa.binary())]

    got = _apply(sample, ["toxic"], "votes binary", bits).toPandas()
    x = np.frombuffer(b"".join(got.votes), dtype=np.int8).reshape(len(got), -1)
    y = got.toxic.to_numpy()
    post, rate, corr = label_model(x, y)
    w, bias = logistic(x, post)
    return Model(words, w, bias, rate, corr)


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    held: list = []  # of a task: the index and the entries of words seen so far

    def run(texts):
        m = shared.value
        if not held:
            index = {w: i for i, w in enumerate(m.lexicon)}
            held.extend((index, Entries(index)))
        x = np.stack([votes(t, *held) for t in texts]) if texts else np.zeros((0, len(m.weights)))
        return ["score"], [pa.array(1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -30, 30))), pa.float64())]

    return _apply(docs, carry, "score double", run)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
