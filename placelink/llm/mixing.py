"""Mixing to target weights with soft domain membership (operator 9).

A classifier fitted on the labelled table (``labels`` with ``documents``; domain = language and
quality label) predicts each document's domain posteriors from byte n-gram profiles of its whole
text. Document rates r >= 0 then solve the least-squares problem

    minimise | A r - t |^2,    A[d, i] = tokens_i * p(d | i) / tokens in all,

starting from r = 1, by projected gradient steps in the metric of the document's tokens with a
small domain-by-domain preconditioner, so that the expected tokens of each domain match the
targets t with rates close to 1. A step needs sums over all documents of domain-sized vectors and
matrices only; a document's rate follows from its posteriors and the steps so far, so no rates
are rewritten between steps and nothing but those sums reaches the driver.

Defined cases: null or empty text has no tokens and rate 1; labels that are null are not learned;
target domains that no labelled row has are left out and the others' weights scaled up; without a
labelled row all rates are ``budget``; copies are the rate rounded up or down by a hash of the row's
doc_id, which keeps the expectation; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngrams, shared
from .vectext import utf8, word_spans

TRAIN_ROWS, STEPS, TOLERANCE = 4000, 40, 1e-6
#: Shares of languages and of quality 1 within each; the product is a domain's target.
LANGUAGES, GOOD = {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10}, 0.95
TARGETS = {f"{lang}:{q}": w * (GOOD if q else 1 - GOOD) for lang, w in LANGUAGES.items() for q in (0, 1)}
#: Tokens wanted in all, as a share of the input's: above 1, so that good documents stay.
BUDGET = 1.1


class Classifier:
    """Multinomial logistic regression over profiles of raw bytes."""

    def __init__(self, labels: list[str], x: np.ndarray):
        self.names = sorted(set(labels))
        if not self.names:
            return
        y = np.eye(len(self.names), dtype=np.float32)[[self.names.index(v) for v in labels]]
        self.w, self.c = ngrams.fit(x, lambda f: self.softmax(f) - y, len(self.names), steps=200, rate=20.0)

    @staticmethod
    def softmax(f):
        e = np.exp(f - f.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posteriors(self, col: pa.Array) -> np.ndarray:
        return self.softmax(ngrams.profiles(col, fold=False) @ self.w + self.c).astype(np.float64)


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain (language and quality label) of the labelled documents; no texts."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL")
    langs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL")
    return langs.join(ids, "doc_id").select("doc_id", F.concat_ws(":", "lang", "quality").alias("domain")).distinct()


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """``labels``: doc_id, quality. Fitted on about ``train_rows`` labelled documents at most, chosen by id."""
    shared.prepare(docs.sparkSession)
    known = shared.stored(domains(docs, labels), "labelled-ids")
    rows = ngrams.documents_of(docs, ngrams.sample(known, train_rows, 29)).select("doc_id", F.col("domain").alias("label"), "text")
    return Classifier(*ngrams.training_set(rows, False))


def _members(model):
    def run(it):
        m = model.value
        for rb in shared.batches(it, ["doc_id", "text"], 1 << 20):
            b, off = utf8(rb.column(1))
            tokens = np.bincount(word_spans(b, off)[2], minlength=rb.num_rows)
            p = m.posteriors(rb.column(1))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posteriors"])

    return run


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens, posteriors in the order of ``model.names``."""
    shared.prepare(docs.sparkSession)
    found = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_members(found), "doc_id long, n_tokens long, posteriors array<double>")


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return r


def _read(rb):
    p = rb.column(rb.schema.get_field_index("posteriors"))
    p = p.flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, -1)
    return rb.column(rb.schema.get_field_index("n_tokens")).to_numpy(zero_copy_only=False).astype(float), p


def _sums(steps):
    def run(it):
        total = None
        for rb in it:
            if not rb.num_rows:
                continue
            n, p = _read(rb)
            r = rates_of(p, steps)
            active = n * (r > 0)
            part = np.concatenate([[n.sum()], (n * r) @ p, ((p * active[:, None]).T @ p).ravel()])
            total = part if total is None else total + part
        if total is not None:
            at = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["at", "value"])

    return run


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], budget: float = BUDGET, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The steps whose application to a document's posteriors gives its rate."""
    want = np.array([targets.get(n, 0.0) for n in names])
    if not want.sum():
        return []
    want = budget * want / want.sum()
    out: list[np.ndarray] = []
    for _ in range(steps):
        got = members.mapInArrow(_sums(list(out)), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        if not got:
            return []
        v = np.array([r.value for r in sorted(got, key=lambda r: r["at"])])
        total, have, gram = v[0], v[1 : len(want) + 1], v[len(want) + 1 :].reshape(len(want), -1)
        if not total:
            return []
        rest = have / total - want
        if np.abs(rest).max() < tolerance:
            break
        out.append(np.linalg.solve(gram / total + 1e-9 * np.eye(len(want)), rest))
    return out


def _rates(steps, names, base: float):
    def run(it):
        for rb in it:
            n, p = _read(rb)
            r = rates_of(p, steps) if steps else np.full(rb.num_rows, base)
            r = np.where(n > 0, r, 1.0)
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(2), pa.array([names[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(r)], ["doc_id", "n_tokens", "posteriors", "domain", "domain_posterior", "rate"])

    return run


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, n_tokens, posteriors, domain, domain_posterior, rate, copies. ``labels``: doc_id, quality."""
    model = fit(docs, labels)
    copies = F.floor(F.col("rate") + F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("int")
    if not model.names:
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("posteriors"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("domain_posterior"), F.lit(float(budget)).alias("rate"))
        return plain.withColumn("copies", copies)
    members = shared.stored(memberships(docs, model), "members")
    steps = fit_rates(members, model.names, targets or TARGETS, budget)
    out = members.mapInArrow(_rates(steps, model.names, budget), "doc_id long, n_tokens long, posteriors array<double>, domain string, domain_posterior double, rate double")
    return out.withColumn("copies", copies)


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its copies say; a null doc_id once."""
    own = uuid.uuid4().hex  # so that no column of docs has these names
    rows = shared.stored(mix(docs, labels, targets, budget).select("doc_id", "copies"), "rates").where("doc_id IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.max("copies").alias(f"copies_{own}")).withColumnRenamed("doc_id", f"id_{own}")
    out = docs.join(rows.hint("merge"), docs["doc_id"].cast("long") == F.col(f"id_{own}"), "left")
    times = F.coalesce(F.col(f"copies_{own}"), F.lit(1))
    times = F.explode(F.when(times > 0, F.sequence(F.lit(1), times))).alias(f"n_{own}")
    return out.select(*[docs[c] for c in docs.columns], times).drop(f"n_{own}")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.documents(spark, sf_dir), shared.labels(spark, sf_dir))
