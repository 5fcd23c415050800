"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic models on the presence of telling words. Each later
model also gets the probabilities of the categories before it; in training these are out-of-fold predictions, so
that the later model sees them as wrong as they will be.

Labels give two categories: ``low_quality`` (quality 0), first in the chain, and ``toxic``, last. Two narrower ones
between them are derived from the labelled sample by marker words, which the sample has almost only in toxic
documents: ``insult`` (toxic, with at least one of every second marker) and ``severe`` (toxic, with at least SEVERE of
these). The markers that define them are no inputs of the models before ``toxic``, which have to tell these
categories by all other words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import id_and_text, stored

#: Labelled documents that training reads (chosen by a hash of their id), words that the models see, folds.
SAMPLE_ROWS, FEATURES, FOLDS = 6000, 256, 5
#: A word is a marker if so many toxic sample documents have it, and this share of its documents are toxic.
MARKER_DOCS, MARKER_SHARE, SEVERE = 4, 0.95, 2
CATEGORIES = ("low_quality", "insult", "severe", "toxic")
RIDGE, STEPS = 0.3, 25
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic model by Newton's method; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5
    #: Out-of-fold probabilities of the training documents, by category.
    outside: np.ndarray | None = None

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        """``present``: rows of 0/1 by vocabulary word. Columns: the categories in order."""
        found = np.empty((len(present), 0))
        one = np.ones((len(present), 1))
        for w in self.weights:
            z = np.hstack([present, found, one]) @ w
            found = np.hstack([found, 1 / (1 + np.exp(-np.clip(z, -30, 30)))[:, None]])
        return found


def fit_chain(vocabulary: list[str], x: np.ndarray, y: np.ndarray, fold: np.ndarray, apart: list[int] | None = None) -> Chain:
    """``x``: documents by words; ``y``: documents by categories in chain order; ``fold``: each document's fold;
    ``apart``: the words that only the last model sees (the others' weights of them are 0)."""
    chain = Chain({w: k for k, w in enumerate(vocabulary)})
    one, outside = np.ones((len(x), 1)), np.empty((len(x), 0))
    narrow = x.copy()
    narrow[:, apart or []] = 0
    for j in range(y.shape[1]):
        seen = np.hstack([x if j == y.shape[1] - 1 else narrow, outside, one])
        own = np.zeros(len(x))
        for f in np.unique(fold):
            test = fold == f
            z = seen[test] @ logistic(seen[~test], y[~test, j]) if (~test).any() else np.zeros(test.sum())
            own[test] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        chain.weights.append(logistic(seen, y[:, j]))
        outside = np.hstack([outside, own[:, None]])
    chain.threshold, chain.outside = best_threshold(outside[:, -1], y[:, -1]), outside
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds with the best F1 on out-of-fold probabilities; 1 (rejects nothing) without positives."""
    if not y.any():
        return 1.0
    grid = np.arange(0.05, 0.96, 0.01)
    f1 = np.array([2 * (y * (p >= t)).sum() / (y.sum() + (p >= t).sum()) for t in grid])
    best = grid[f1 >= f1.max() - 0.002]
    return float(best[len(best) // 2])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Chain | None:
    """Train on at most ``sample_rows`` labelled documents; repeated texts of the sample count once. None without labels."""

    @F.pandas_udf("array<string>")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(words(t)))

    told = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), (F.min("quality").cast("int") if "quality" in labels.columns else F.lit(None).cast("int")).alias("quality"))
    picked = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = id_and_text(docs).where("text is not null").join(F.broadcast(picked), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = sample.select("doc_id", "toxic", (F.coalesce("quality", F.lit(1)) == 0).cast("int").alias("low"), distinct_words("text").alias("words"))
    rows = stored(rows)
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not total["n"]:
        return None
    seen = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    excess = F.abs(F.col("pos") / max(total["p"], 1) - F.col("neg") / max(total["n"] - total["p"], 1))
    spread = F.sqrt((F.col("pos") + F.col("neg") + 1) / F.lit(float(total["n"])))
    telling = seen.where(F.col("pos") + F.col("neg") >= MARKER_DOCS).orderBy((excess / spread).desc(), "word").limit(features).collect()
    vocabulary = [r["word"] for r in telling]
    markers = [r["word"] for r in telling if r["pos"] >= MARKER_DOCS and r["pos"] >= MARKER_SHARE * (r["pos"] + r["neg"])]
    keep = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])) if vocabulary else F.array().cast("array<string>")
    known = rows.select("doc_id", "toxic", "low", keep.alias("words")).orderBy("doc_id").collect()
    place = {w: k for k, w in enumerate(vocabulary)}
    x = np.zeros((len(known), len(vocabulary)))
    for i, r in enumerate(known):
        x[i, [place[w] for w in r["words"]]] = 1
    toxic = np.array([r["toxic"] for r in known], float)
    apart = [place[w] for w in markers[::2]]
    marks = x[:, apart].sum(axis=1)
    y = np.stack([np.array([r["low"] for r in known], float), toxic * (marks >= 1), toxic * (marks >= SEVERE), toxic], axis=1)
    return fit_chain(vocabulary, x, y, np.arange(len(known)) % FOLDS, apart)


def applied(chain: Chain | None) -> Chain | None:
    """What predictions need of a chain."""
    return chain and Chain(chain.vocabulary, chain.weights, chain.threshold)


def predict(text: Column, shared) -> Column:
    """struct(p_low_quality, p_insult, p_severe, p_toxic, rejected) of each whole text; all zero and kept where null or without a model."""

    @F.pandas_udf("p_low_quality double, p_insult double, p_severe double, p_toxic double, rejected boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        chain: Chain | None = shared.value
        p = np.zeros((len(texts), len(CATEGORIES)))
        if chain is None:
            return pd.DataFrame(p, columns=[f"p_{c}" for c in CATEGORIES]).assign(rejected=False)
        known = chain.vocabulary.keys()
        x = np.zeros((len(texts), len(chain.vocabulary)))
        for i, t in enumerate(texts):
            x[i, [chain.vocabulary[w] for w in known & words(t)]] = 1
        p = chain.probabilities(x)
        p[texts.isna().to_numpy()] = 0
        return pd.DataFrame(p, columns=[f"p_{c}" for c in CATEGORIES]).assign(rejected=p[:, -1] >= chain.threshold)

    return judged(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, p_low_quality, p_insult, p_severe, p_toxic, rejected.

    Null texts score 0 and are kept. Labels of unknown documents, and null labels, are ignored; of several labels
    of a document the most toxic and the lowest quality hold; without quality it is not low. Without labels nothing is
    rejected. A very long text is the set of its words. Words that tell equally much are taken in the order of the
    alphabet. Repeated rows give a row each, an empty table none; other columns are not read, whatever they are called.
    """
    shared = docs.sparkSession.sparkContext.broadcast(applied(fit(docs, labels)))
    return id_and_text(docs).select("doc_id", predict(F.col("text"), shared).alias("r")).select("doc_id", "r.*")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the chain does not reject, with all their columns, whatever their names. See classify."""
    shared = docs.sparkSession.sparkContext.broadcast(applied(fit(docs, labels)))
    return docs.where(~predict(docs[text_col], shared)["rejected"])
