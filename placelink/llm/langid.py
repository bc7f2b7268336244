"""Language ID by error-correcting output codes (operator 3).

Each language has a codeword of bits; for each bit a logistic classifier over byte n-gram profiles
tells which half of the languages a text belongs to. Decoding sums, over the bits, the logistic
loss of a codeword's bit under the classifier's margin, weighted by the bit's training accuracy;
the language with the least loss is chosen, and a close second flags the text as ambiguous.
The classifiers are fitted on ``train_rows`` labelled documents at most; every text is predicted whole.

Defined cases: null text and text without a letter give ``und`` with score 0; a null language is
never learned; without any labelled row every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngrams, shared

TRAIN_ROWS, AMBIGUOUS = 4000, 0.15


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 / -1: all distinct splits for up to 6 languages, else the random code of
    several with the largest least distance."""
    if k <= 1:
        return np.ones((max(k, 1), 1), np.float32)
    if k <= 6:
        bits = [c for c in itertools.product([1, -1], repeat=k) if c[0] == 1 and -1 in c]
        return np.array(bits, np.float32).T
    rng, best, most = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        c = rng.choice([1.0, -1.0], (k, length)).astype(np.float32)
        apart = (length - c @ c.T) / 2 + length * np.eye(k)
        if apart.min() > most and (abs(c.sum(0)) < k).all():
            best, most = c, apart.min()
    return best


class Model:
    """Codewords, bit classifiers and bit weights."""

    def __init__(self, langs: list[str], x: np.ndarray):
        self.names = sorted(set(langs))
        self.code = codewords(len(self.names))
        at = {n: i for i, n in enumerate(self.names)}
        y = self.code[[at[v] for v in langs]] if langs else np.zeros((0, self.code.shape[1]), np.float32)
        if not langs:
            self.w, self.c, self.weight = np.zeros((ngrams.DIM, 1), np.float32), np.zeros(1, np.float32), np.ones(1)
            return
        self.w, self.c = ngrams.fit(x, lambda f: -y / (1 + np.exp(np.clip(y * f, -30, 30))), y.shape[1])
        right = (np.sign(x @ self.w + self.c) == y).mean(0)
        self.weight = np.maximum(right - 0.5, 0.01) / np.maximum(right - 0.5, 0.01).sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the probability, and the runner-up's."""
        f = np.clip(x @ self.w + self.c, -30, 30)
        loss = np.stack([(np.log1p(np.exp(-c * f)) * self.weight).sum(1) for c in self.code], 1) * self.code.shape[1]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        rest = p.copy()
        rest[np.arange(len(p)), best] = 0
        return best, p[np.arange(len(p)), best], rest.max(1)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """``labelled``: doc_id, text, lang."""
    shared.prepare(labelled.sparkSession)
    labelled = labelled.where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("label"), "text")
    return Model(*ngrams.training_set(ngrams.sample(labelled, train_rows, 3), True))


def _predict(model: Model, ambiguous: float):
    def run(it):
        for rb in shared.batches(it, ["doc_id", "text"]):
            best, p, second = model.decode(ngrams.profiles(rb.column(1)))
            text = pa.compute.fill_null(rb.column(1), "")
            known = pa.compute.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            known &= len(model.names) > 0
            lang = [model.names[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, p, 0.0).astype(float)), pa.array(~known | (p - second < ambiguous))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    shared.prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_predict(model, ambiguous), "doc_id long, lang_pred string, score double, ambiguous boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = predict(docs, fit(docs.where(~shared.held_out(F.col("doc_id")))))
    return out.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
