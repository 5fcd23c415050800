"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams of its lower-cased letters, word boundaries included, hashed into BUCKETS
rows of an embedding table. The mean of a text's embeddings goes through a linear softmax. Both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts. Since the softmax is linear in the
mean, prediction needs only the product of table and weights: one row of class scores for each bucket, which is
small enough to broadcast whatever the corpus.

A part of the sample is kept from training to fit the temperature, and the probability below which a prediction
counts as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import id_and_text

BUCKETS, DIMENSIONS, LONGEST = 1 << 15, 8, 4
#: Labelled texts that training reads, chosen by a hash of their id.
SAMPLE_ROWS = 2000
EPOCHS, RATE, BATCH, SEED = 6, 2.0, 32, 7
#: Accuracy that predictions just above the rejection threshold have at least.
ACCEPT = 0.9
#: Bytes of a text whose n-grams are held at once.
CHUNK = 1 << 20


#: Runs of characters that are no letters, but for numbers such as ² and Ⅷ, which count as word characters.
_GAPS = re.compile(r"[\W\d_]+")


@cache
def _numbers() -> dict[str, str]:
    """Those numbers, as blanks."""
    return {c: " " for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}


def letters_only(text: str) -> str:
    """The lower-cased letters of a text, with one blank for each run of other characters. Few texts have numbers beside digits; only these are looked at twice."""
    lowered = text.lower()
    if not _numbers().keys().isdisjoint(lowered):
        lowered = lowered.translate(str.maketrans(_numbers()))
    return _GAPS.sub(" ", lowered).strip()


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a whole text's n-grams, in pieces of bounded size; nothing where it is null or has no letter."""
    plain = letters_only(text) if text else ""
    if not plain:
        return
    raw = np.frombuffer(f" {plain} ".encode(), np.uint8)
    for begin in range(0, len(raw), CHUNK):
        block = raw[begin : begin + CHUNK + LONGEST - 1].astype(np.uint32)
        own, parts = min(CHUNK, len(raw) - begin), []
        h = np.full(len(block), 0x9E3779B1, np.uint32)
        for n in range(1, LONGEST + 1):
            h = (h[: len(block) - n + 1] ^ block[n - 1 :]) * np.uint32(0x01000193)
            mixed = h[:own] * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            parts.append(mixed & np.uint32(BUCKETS - 1))
        yield np.concatenate(parts)


def counts(text: str | None) -> np.ndarray | None:
    """Occurrences of each bucket in a whole text; None where it is null or has no letter."""
    total = None
    for buckets in subwords(text):
        own = np.bincount(buckets, minlength=BUCKETS)
        total = own if total is None else total + own
    return total


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """By language; None where the text is null or has no letter."""
        total, n = 0, 0
        for buckets in subwords(text):
            total = total + self.scores.take(buckets, axis=0).sum(axis=0)
            n += len(buckets)
        if not n:
            return None
        z = total / n / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model | None:
    """``rows``: (buckets, counts, lang) of each labelled text. None without rows."""
    if not rows:
        return None
    langs = sorted({r[2] for r in rows})
    if len(langs) == 1:
        return Model(langs, np.zeros((BUCKETS, 1), np.float32))
    label = np.array([langs.index(r[2]) for r in rows])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    kept = order[: len(rows) // 5]
    fit = order[len(rows) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.5, (DIMENSIONS, len(langs))).astype(np.float32)
    mean = [(r[0], (r[1] / r[1].sum()).astype(np.float32)) for r in rows]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for begin in range(0, len(fit), BATCH):
            batch = rng.permutation(fit)[:BATCH] if begin + BATCH > len(fit) else fit[begin : begin + BATCH]
            hidden = np.stack([mean[i][1] @ table[mean[i][0]] for i in batch])
            z = hidden @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), label[batch]] -= 1
            back = p @ weights.T
            weights -= rate * hidden.T @ p / len(batch)
            for i, g in zip(batch, back, strict=True):
                table[mean[i][0]] -= rate * mean[i][1][:, None] * g  # each text by itself: its buckets are distinct
        rng.shuffle(fit)
    model = Model(langs, (table @ weights).astype(np.float32))
    if len(kept):
        z = np.stack([mean[i][1] @ model.scores[mean[i][0]] for i in kept])
        model.temperature = min((2.0**k for k in np.arange(-12, 3.5, 0.5)), key=lambda t: _loss(z / t, label[kept]))
        p = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        model.reject = _threshold(p.max(axis=1), p.argmax(axis=1) == label[kept])
    return model


def _loss(z: np.ndarray, label: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), label]))


def _threshold(score: np.ndarray, right: np.ndarray, width: int = 25) -> float:
    """The lowest score from which each run of ``width`` predictions is right often enough."""
    order = np.argsort(-score)
    good = right[order]
    for k in range(0, len(good) - width + 1, width):
        if good[k : k + width].mean() < ACCEPT:
            return float(score[order[k]])
    return 0.0


def is_held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on at most ``sample_rows`` documents with id, text and lang outside the held-out fold, those whose ids hash least."""

    @F.pandas_udf("buckets array<int>, times array<int>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            total = counts(t)
            b = np.empty(0, np.int32) if total is None else np.flatnonzero(total).astype(np.int32)
            rows.append((b, b if total is None else total[b].astype(np.int32)))
        return pd.DataFrame(rows, columns=["buckets", "times"])

    named = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).where("text is not null and lang is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    picked = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    one = F.min(F.struct(F.xxhash64("text", "lang").alias("h"), "lang", "text")).alias("one")  # of rows with one id, always the same
    sample = named.join(F.broadcast(picked), "doc_id", "left_semi").groupBy("doc_id").agg(one).select("doc_id", "one.lang", sparse("one.text").alias("s"))
    rows = [(np.array(r["s"]["buckets"], np.int64), np.array(r["s"]["times"], np.float32), r["lang"]) for r in sorted(sample.collect(), key=lambda r: (r["doc_id"], r["lang"])) if r["s"]["buckets"]]
    return train(rows)


def predict(text: Column, shared) -> Column:
    """struct(lang_pred, score, rejected) of each whole text; ``und`` with score 0 where there is no letter or no model."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        model, rows = shared.value, []
        for t in texts:
            p = model.probabilities(t) if model else None
            if p is None:
                rows.append(("und", 0.0, True))
            else:
                k = int(p.argmax())
                rows.append((model.langs[k], float(p[k]), bool(p[k] < model.reject)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return judged(text)


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected; learned from the documents outside the held-out fold.

    Null texts and texts without a letter are ``und``. Without any labelled text everything is ``und``; of languages
    with equal probabilities the first in the alphabet is given. Very long texts are read in pieces of CHUNK bytes.
    Repeated rows give a row each, an empty table none; other columns than doc_id, text and lang are not read, and lang only to learn. One
    narrow pass predicts; training takes a bounded sample to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    rows = id_and_text(docs)
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), shared).alias("r")).select("doc_id", "held_out", "r.*")
