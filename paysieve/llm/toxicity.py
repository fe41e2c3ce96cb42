"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train linear classifiers on hashed words and word beginnings. The risk is corrected
by the class prior: prior * E_P[loss(+1)] + max(0, E_U[loss(-1)] - prior * E_P[loss(-1)]) with the logistic loss; where the second
term turns negative the step goes against it, so the classifiers cannot profit from calling confirmed examples negative.

The classifiers are trained in tasks, one per bag of a bounded sample; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix
from .decontaminate import _FOLD
from .language_id import is_held_out

#: Documents that training reads at most, about (rows are taken by a hash of the id): confirmed toxic and unlabelled ones, and bags.
SAMPLE_TOXIC, SAMPLE_UNLABELLED, BAGS = 6000, 18000, 3
#: Hashed features, those that a classifier may weigh, and the confirmed documents that must hold one (fewer, 3 at least, of a small sample).
WIDTH, CHOSEN, LEAST = 1 << 18, 256, 8
#: The share of confirmed documents among those with a feature, by the prior, that lets a classifier weigh it.
POSTERIOR = 0.6
#: Bytes of a word's beginning.
STEM = 4
_BLANK = np.arange(256) == 32


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words (whole words, then their first bytes) and the number of the text each is in."""
    w = Words([t.encode().translate(_FOLD) for t in texts], _BLANK | (np.arange(256) == 10))
    whole = w.hashes()
    w.ends = np.minimum(w.ends, w.starts + STEM)
    doc = w.doc_of_word()
    idx = np.concatenate([mix(whole), mix(w.hashes() ^ np.uint64(0xA5A5A5A5))]) % np.uint64(WIDTH)
    return idx.astype(np.int64), np.concatenate([doc, doc])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen features, their weights and the bias of one classifier. Examples are arrays of distinct features."""
    def rates(rows):
        return np.bincount(np.concatenate(rows or [np.zeros(0, np.int64)]), minlength=WIDTH)

    in_p, in_u = rates(positive), rates(unlabelled)
    p, u = in_p / max(1, len(positive)), in_u / max(1, len(unlabelled))
    able = np.flatnonzero((in_p >= max(3, min(LEAST, len(positive) // 50))) & (prior * p >= POSTERIOR * u))
    chosen = np.sort(able[np.lexsort((able, -(p - u)[able]))[:CHOSEN]])

    def matrix(rows):
        m = np.zeros((len(rows), len(chosen)), np.float32)
        for k, r in enumerate(rows):
            at = np.minimum(np.searchsorted(chosen, r), max(0, len(chosen) - 1))
            if len(chosen):
                m[k, at[chosen[at] == r]] = 1
        return m

    xp, xu = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (xp, xu))
        # logistic loss: the slope of loss(+1) is s - 1, that of loss(-1) is s
        grad = lambda d, x: np.append(d @ x, d.sum()) / max(1, len(d))
        zp, zu = xp @ w + b, xu @ w + b
        negative = (np.logaddexp(0, zu).mean() if len(zu) else 0.0) - prior * (np.logaddexp(0, zp).mean() if len(zp) else 0.0)
        risk_p, risk_n = prior * grad(sp - 1, xp), grad(su, xu) - prior * grad(sp, xp)
        g = risk_p + risk_n if negative >= 0 else -risk_n
        g[:-1] += decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return chosen, w, b


class Classifiers:
    """The bags' weights side by side; a score is the mean of their probabilities."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, float]]):
        self.weights = np.zeros((WIDTH, len(parts)), np.float32)
        for k, (chosen, w, _) in enumerate(parts):
            self.weights[chosen, k] = w
        self.bias = np.array([b for _, _, b in parts])
        self.used = self.weights.any(axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        idx, doc = features(texts)
        keep = self.used[idx]
        pairs = np.unique(doc[keep] * WIDTH + idx[keep])                      # a feature counts once a text
        z = np.tile(self.bias, (len(texts), 1))
        np.add.at(z, pairs // WIDTH, self.weights[pairs % WIDTH])
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(axis=1)


def _slices(texts: list[str], limit: int = 500_000):
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> Classifiers | None:
    """Classifiers from the rows whose CRC-32 of the id is not 0 modulo ``modulus``; None without a confirmed toxic document.

    The prior is the share of toxic rows among the labelled ones; rows without a label, with null or conflicting labels confirm nothing.
    """
    taken = lambda df: df.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), modulus, 0))
    marks = taken(labels.select("doc_id", "toxic").filter("toxic is not null")).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    n = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    if not n["p"]:
        return None
    rows = taken(docs.select("doc_id", "text"))
    total = rows.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).cast("long")
    share = lambda most, of: F.lit(min(1_000_000, -(-1_000_000 * most // max(1, of))))
    toxic = marks.filter((F.col("toxic") == 1) & (place < share(SAMPLE_TOXIC, n["p"]))).select("doc_id")
    bag = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(BAGS)).cast("int").alias("bag")
    every = F.explode(F.array(*(F.lit(k) for k in range(BAGS)))).alias("bag")                    # each bag has all confirmed examples
    sample = rows.join(F.broadcast(toxic), "doc_id", "left_semi").select(F.lit(1).alias("y"), every, "text").unionByName(       # the sample's size bounds the broadcast
        rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share(SAMPLE_UNLABELLED, total)).select(F.lit(0).alias("y"), bag, "text"))

    def extract(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in _slices(texts):
                idx, doc = features(texts[a:b])
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(b - a + 1))
                own = [np.unique(idx[order[x:y]]).astype(np.int32).tobytes() for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(own, pa.binary())], names=["y", "bag", "idx"])

    prior = min(0.9, n["p"] / n["n"])

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        rows_of = lambda y: [np.frombuffer(x, np.int32).astype(np.int64) for x in sorted(g.loc[g["y"] == y, "idx"].unique())]  # noqa: E731  copies count once
        chosen, w, b = train(rows_of(1), rows_of(0), prior)
        return pd.DataFrame({"bag": [g["bag"].iloc[0]], "chosen": [chosen.astype(np.int64).tobytes()], "w": [w.tobytes()], "b": [b]})

    fitted = sample.mapInArrow(extract, "y int, bag int, idx binary").groupBy("bag").applyInPandas(fit, "bag int, chosen binary, w binary, b double")
    return Classifiers([(np.frombuffer(r["chosen"], np.int64), np.frombuffer(r["w"]), r["b"]) for r in sorted(fitted.collect(), key=lambda r: r["bag"])])


def score(docs: DataFrame, model: Classifiers | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null text counts as empty; without a model every score is 0."""
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = [model.score(texts[a:b]) for a, b in _slices(texts)] if model else [np.zeros(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
