"""Toxicity: logistic regression regularised by counterfactuals.

Features are the words of a text and their beginnings of four to six letters,
as present or absent, so that scores follow what a text says and not its
length.  It is trained on a bounded sample of labelled rows
(``MAX_TOXIC`` + ``MAX_CLEAN``; rows in the order of a hash of doc_id).  For each
identity term in a sampled sentence, the sentence is rewritten with every other
term of its group and without the term, and squared score changes between the
two are added to the loss.  So a term cannot carry a score by itself, and
neutral mentions of groups stay clean; each pair of terms counts once at least,
even if no sampled sentence has them.  Swaps that change the same features are
summed up before they reach the driver: a term has at most four features, so a
pair of terms has at most 256 such rows, however long the texts are.

The candidate features come from counts over the whole sample (distributed);
the ``MAX_FEATURES`` most telling ones are fitted on the driver by proximal
gradient steps, and all texts are scored whole, in one pass without a shuffle.

Defined cases: null and empty texts have no feature and get the intercept's
score.  A doc_id with several labels is toxic if any label is; null labels are
none.  Rows with a null doc_id are not learnt from and are scored.  With no
labelled row of either kind every score is the share of toxic labels (0 if
there are no labels).  Repeated rows are scored alike, and learnt from once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, forget, held_out, stored, table, text_bytes

MAX_TOXIC = 6_000
MAX_CLEAN = 9_000
MAX_FEATURES = 4_000
LEAST_SUPPORT = 4
L1, L2, PAIR_WEIGHT, STEPS = 5e-5, 1e-5, 1.0, 400

IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "indigenous", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("americans", "mexicans", "chinese", "indians", "russians", "germans", "french", "turks", "poles"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_GROUP = {t: g for g in IDENTITY_GROUPS for t in g}
_CUTS = (4, 5, 6)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _features(ws: set[str]) -> set[str]:
    """Words, and beginnings marked by a star."""
    return ws.union(*({w[:k] + "*" for w in ws if len(w) > k} for k in _CUTS))


@dataclass
class Model:
    """``weights`` by feature."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._whole = {k: v for k, v in self.weights.items() if k[-1] != "*"}
        self._starts = [(n, {k[:-1]: v for k, v in self.weights.items() if k[-1] == "*" and len(k) == n + 1}) for n in _CUTS]

    def score(self, text: str | None) -> float:
        ws = words(text)
        z = self.bias + math.fsum(self._whole[w] for w in ws & self._whole.keys())
        for n, starts in self._starts:
            if starts:
                z += math.fsum(starts[p] for p in {w[:n] for w in ws if len(w) > n} & starts.keys())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _sample(docs: DataFrame, labels: DataFrame, split: bool) -> DataFrame:
    """text, toxic: at most MAX_TOXIC + MAX_CLEAN labelled ids, equal texts once."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if split:
        known = known.filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    few = known.filter("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most 15,000 ids
    return found.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        names = list(count[0].keys() | count[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[x] for x in part], pa.int64()) for c in count)], ["feature", "clean", "toxic"])
        count[0].clear()
        count[1].clear()

    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            count[y].update(_features(words(text)))
            if len(count[0]) + len(count[1]) > 1_000_000:
                yield from out()
    yield from out()


def _pairs(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """What a swap takes from and adds to a sentence's features."""
    for s in _SENTENCE.split(text.lower()):
        ws = words(s)
        for t in ws & _GROUP.keys():
            before = _features(ws)
            for other in (*(x for x in _GROUP[t] if x not in ws), None):
                after = _features((ws - {t}) | ({other} if other else set()))
                yield before - after, after - before


def _encoded(index: dict[str, int]):
    """Features of each text (y is its label), and the feature changes of its swaps (y is -1), with how often they are meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for b in batches:
            ys, plus, minus, n = [], [], [], []
            swaps: Counter = Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                ys.append(y)
                plus.append(sorted(index[f] for f in _features(words(text)) & index.keys()))
                minus.append([])
                n.append(1)
                for gone, come in _pairs(text or ""):
                    swaps[tuple(sorted(index[f] for f in come & index.keys())), tuple(sorted(index[f] for f in gone & index.keys()))] += 1
            for (come, gone), k in swaps.items():
                ys.append(-1)
                plus.append(list(come))
                minus.append(list(gone))
                n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(plus, kind), pa.array(minus, kind), pa.array(n, pa.int64())], ["y", "plus", "minus", "n"])

    return run


class _Rows:
    """A sparse matrix of ones (or signs)."""

    def __init__(self, rows: list[list[int]], cols: int, signs: list[list[int]] | None = None):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.val = np.array([c for r in signs for c in r], float) if signs else np.ones(len(self.col))
        self.shape = (len(rows), cols)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.shape[1])


def fit(x: list[list[int]], y: np.ndarray, swaps: list[tuple[list[int], list[int], float]], n: int, pair_weight: float = PAIR_WEIGHT, often: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Bias and weights: logistic loss + L1 + L2 + the mean squared score change of ``swaps`` (added, taken, how often); ``often`` weighs the rows."""
    rows = _Rows(x, n)
    pairs = _Rows([[*a, *b] for a, b, _ in swaps], n, [[1] * len(a) + [-1] * len(b) for a, b, _ in swaps]) if swaps else None
    share = np.array([k for _, _, k in swaps], float) / sum(k for _, _, k in swaps) * pair_weight if swaps else None
    part = np.full(len(y), 1 / len(y)) if often is None else often / often.sum()
    mean = float(part @ y)
    w, b = np.zeros(n), float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    # step: one over a bound of the curvature, by power iteration
    u = np.ones(n)
    for _ in range(15):
        u = rows.back(part * rows.dot(u)) / 4 + (pairs.back(share * pairs.dot(u)) if pairs else 0)
        size = np.linalg.norm(u)
        u /= size or 1
    step = 1 / (1.5 * size + 0.25 + L2)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows.dot(v) + c, -60, 60)))
        g = rows.back(part * (p - y)) + L2 * v
        if pairs:
            g += pairs.back(share * pairs.dot(v))
        w2 = v - step * g
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * L1, 0)
        b2 = c - step * float(part @ (p - y))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def train(docs: DataFrame, labels: DataFrame, split: bool = True, pair_weight: float = PAIR_WEIGHT) -> Model:
    """With ``split`` from rows only whose crc32(doc_id as text) mod 5 is not 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = stored(_sample(docs, labels, split), "labelled")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        share = min(max(toxic / max(1, clean + toxic), 1e-6), 1 - 1e-6)
        forget(sample)
        return Model(math.log(share / (1 - share)))
    a, b = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    telling = F.abs(F.log(a / b)) * F.abs(a - b)
    counts = sample.mapInArrow(_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counts.filter(F.col("clean") + F.col("toxic") >= LEAST_SUPPORT).orderBy(telling.desc(), "feature").limit(MAX_FEATURES).select("feature").collect()
    names = sorted({r.feature for r in best} | {f for t in _GROUP for f in _features({t})})
    index = {f: i for i, f in enumerate(names)}
    # equal rows are one with a count: at most MAX_TOXIC + MAX_CLEAN texts, and a bounded number of swaps
    rows = sample.mapInArrow(_encoded(index), "y int, plus array<int>, minus array<int>, n long").groupBy("y", "plus", "minus").agg(F.sum("n").alias("n")).collect()
    forget(sample)
    rows.sort(key=lambda r: (r.y, r.plus, r.minus))
    swaps = [(r.plus, r.minus, float(r.n)) for r in rows if r.y < 0]
    for t, group in _GROUP.items():  # each pair once at least
        for other in (*(g for g in group if g > t), None):
            swaps.append(([index[f] for f in _features({other})] if other else [], [index[f] for f in _features({t})], 1.0))
    known = [r for r in rows if r.y >= 0]
    bias, w = fit([r.plus for r in known], np.array([r.y for r in known], float), swaps, len(names), pair_weight, np.array([r.n for r in known], float))
    return Model(bias, {f: float(w[i]) for f, i in index.items() if w[i]})


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t.decode("utf-8", "replace") if t else None) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` that score below ``threshold``, all columns."""
    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("row").field(at).to_pylist()
            yield b.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))

    return packed.mapInArrow(run, packed.schema).select("row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
