"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; documents of the labelled training side,
whose labels are then forgotten, are the unlabelled text, which holds toxic ones
at the class prior. A linear model over the presence of words, word
beginnings and word endings is fitted in numpy by the non-negative risk
estimator: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

The fit takes a bounded sample of labelled rows, chosen by a hash of the id: the
bounds are the fields ``max_positive`` and ``max_unlabelled`` of :class:`Fit`.
The features are the ``max_words`` (a parameter of the model as its learning rate
is) whose document frequencies in the two samples (of distinct texts) differ
most. Scoring covers every whole text.

Labels are read only for ids whose crc32 leaves a remainder modulo 5 other than
0, both for the positives and for the prior. Edge cases: null texts count as
empty and score by the bias alone; a null doc_id counts as the empty string for
the remainder and is never labelled; without positives or without unlabelled
text every score is next to 0 (4e-18); repeated rows have equal scores; repeated
labels count once, toxic if any is. Extra columns, and labels, lang, source and
doc_id, are no input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import drop_materialized, materialize, table

BEGINNINGS, ENDINGS = (4, 5, 6), (4, 5)
FOLDS = 5
SEED = 13


@dataclass(frozen=True)
class Fit:
    """Parameters of the fit."""

    #: Bounds of the sample of labelled rows: positives, and rows whose labels are forgotten.
    max_positive: int = 4096
    max_unlabelled: int = 16384
    #: Size of the model, documents that a feature must be in, and standard errors by which its frequencies must differ.
    max_words: int = 512
    min_df: int = 4
    min_z: float = 5.0
    epochs: int = 600
    rate: float = 0.05
    decay: float = 1e-4


_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def features(text: str | None) -> set[str]:
    """Distinct words of a text, their beginnings (``x-``) and endings (``-x``), and beginnings of two (``x-2``) or four (``x-4``) words."""
    out = set(_WORD.findall((text or "").lower()))
    more: set[str] = set()
    for n in BEGINNINGS:
        for x, times in Counter([w[:n] for w in out if len(w) > n]).items():
            more.add(x + "-")
            if times > 1:
                more.add(x + "-2")
                if times > 3:
                    more.add(x + "-4")
    for n in ENDINGS:
        more.update(["-" + w[-n:] for w in out if len(w) > n])
    return out | more


def _frequencies(batches):
    """word, documents of positives and of unlabelled ones with it: summed by batch."""
    for batch in batches:
        by = (Counter(), Counter())
        for p, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            by[p].update(features(t.as_py()))
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][w] for w in names], pa.int64()), pa.array([by[0][w] for w in names], pa.int64())], names=["word", "np", "nu"])


def _vectors(vocabulary: dict[str, int]):
    def run(batches):
        for batch in batches:
            rows = [sorted(vocabulary[w] for w in vocabulary.keys() & features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["p", "hits"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float, decay: float) -> tuple[float, float]:
    """The positive part of the risk with half the decay's penalty, and the negative part, which the estimator keeps from falling below 0 (sigmoid loss)."""
    sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
    return prior * float((1 - sp).mean()) + 0.5 * decay * float(w @ w), float(su.mean() - prior * sp.mean())


def gradient(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """Gradient (weights, then bias) of the whole risk, or, where the negative part is below 0, of minus that part: the estimate overfits there and climbs back."""
    sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
    dp, du = prior * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    gp, gu = (-2 * dp, du) if su.mean() - prior * sp.mean() >= 0 else (dp, -du)
    return np.concatenate((gp @ xp + gu @ xu + decay * w, [gp.sum() + gu.sum()]))


def fit(x: np.ndarray, positive: np.ndarray, prior: float, how: Fit = Fit()) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk estimator, by Adam on whole batches."""
    xp, xu = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1]), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, how.epochs + 1):
        g = gradient(w, b, xp, xu, prior, how.decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = how.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> tuple[dict[str, float], float]:
    """Word weights and bias. ``labels`` has doc_id and toxic; its held-out rows are not read."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return {}, -40.0
    prior = toxic / n if toxic < n else 0.5
    order = F.xxhash64("doc_id", F.lit(SEED))
    pos = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(how.max_positive).withColumn("p", F.lit(1))
    pos = materialize(pos, "positives", how.max_positive)
    # unlabelled text: labelled rows whatever their labels, so that toxic ones are in it at the prior
    some = known.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").limit(how.max_unlabelled).withColumn("p", F.lit(0))
    chosen = materialize(pos.unionByName(some), "chosen", how.max_positive + how.max_unlabelled)  # at most so many ids
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(sample.select("p", "text").distinct(), "sample")
    counts = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = counts.get(1, 0), counts.get(0, 0)
    if not n_pos or not n_unl:
        return {}, -40.0
    df = sample.mapInArrow(_frequencies, "word string, np long, nu long").groupBy("word").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
    a, u, all_ = F.col("np") / n_pos, F.col("nu") / n_unl, (F.col("np") + F.col("nu")) / (n_pos + n_unl)
    z = (a - u) / F.sqrt(all_ * (1 - all_) * (1 / n_pos + 1 / n_unl) + 1e-9)
    top = df.filter(F.col("np") + F.col("nu") >= how.min_df).select("word", z.alias("z")).filter(F.abs("z") >= how.min_z).orderBy(F.abs("z").desc(), "word").limit(how.max_words)
    vocabulary = {r["word"]: i for i, r in enumerate(top.collect())}
    rows = sample.mapInArrow(_vectors(vocabulary), "p int, hits array<int>").toArrow()
    drop_materialized(sample)
    x = np.zeros((rows.num_rows, len(vocabulary)), np.float32)
    hits = rows.column("hits").combine_chunks()
    x[np.repeat(np.arange(rows.num_rows), np.asarray(hits.value_lengths())), hits.flatten().to_numpy()] = 1
    positive = rows.column("p").to_numpy() == 1
    # sums in an order of the rows' own, whatever the partitions, so that reruns agree
    rank = [(bool(p), r.tobytes()) for p, r in zip(positive, np.packbits(x > 0, axis=1))]
    order = sorted(range(len(rank)), key=rank.__getitem__)
    w, b = fit(x[order], positive[order], prior, how)
    return {word: float(w[i]) for word, i in vocabulary.items()}, b


def _scorer(weights: dict[str, float], bias: float):
    names = weights.keys()

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            f = np.array([bias + sum(weights[w] for w in sorted(names & features(texts[i].as_py()))) for i in range(len(texts))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(f, -40, 40))), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights, bias = train(docs, labels, how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(_scorer(weights, bias), "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _filter(weights: dict[str, float], bias: float, at: int):
    names = weights.keys()

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            keep = [bias + sum(weights[w] for w in sorted(names & features(texts[i].as_py()))) < 0 for i in range(len(texts))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    weights, bias = train(docs, labels, how)
    return docs.mapInArrow(_filter(weights, bias, docs.columns.index("text")), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
