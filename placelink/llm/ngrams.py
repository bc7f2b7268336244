"""Hashed byte n-gram profiles of whole texts, and bounded training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .vectext import LOWER, utf8

DIM = 4096
#: Letters folded: A-Z lower-cased, other ASCII as white space.
FOLD = LOWER.copy()
FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def profiles(col: pa.Array, orders=(1, 2, 3), fold: bool = True, dim: int = DIM) -> np.ndarray:
    """Square roots of the relative frequencies of each order's byte n-grams, hashed to ``dim``
    columns; a row of zeros for an empty text."""
    b, off = utf8(col)
    n = len(off) - 1
    if fold:
        b = FOLD[b]
    out = np.zeros((n, dim), np.float32)
    if not len(b):
        return out
    row = np.repeat(np.arange(n), np.diff(off))
    x = b.astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    for k in range(1, max(orders) + 1):
        code = code[: len(b) - k + 1] * np.uint32(257) + x[k - 1 :]
        if k not in orders or not len(code):
            continue
        h = (code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)
        same = row[: len(code)] == row[k - 1 :]
        at = row[: len(code)][same] * dim + (h[same] % dim)
        out += np.bincount(at, minlength=n * dim).reshape(n, dim)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def sample(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, by a hash of doc_id: the same rows in every run."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def documents_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id and more; from ``sample``, so of bounded size) with the texts of their documents; no text moves."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")


def _profile_rows(fold: bool):
    def run(it):
        for rb in shared.batches(it, ["label", "text"], 1 << 20):
            x = profiles(rb.column(1), fold=fold).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    return run


def training_set(df: DataFrame, fold: bool) -> tuple[list[str], np.ndarray]:
    """Labels and profiles of the (bounded) rows of ``df`` (label, text), on the driver."""
    got = df.select("label", "text").mapInArrow(_profile_rows(fold), "label string, x binary").toArrow()
    labels = got.column("label").to_pylist()
    if not labels:
        return [], np.zeros((0, DIM), np.float32)
    return labels, np.stack([np.frombuffer(v.as_py(), np.float16) for v in got.column("x")]).astype(np.float32)


def fit(x: np.ndarray, grad, k: int, steps: int = 120, rate: float = 40.0, l2: float = 1e-5):
    """Weights (dim x k) and intercepts by accelerated gradient steps; ``grad(f)`` is the loss's
    derivative by the outputs, for each row."""
    w, c = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    vw, vc = np.zeros_like(w), np.zeros_like(c)
    for i in range(steps):
        m = i / (i + 3)
        lw, lc = w + m * vw, c + m * vc
        g = grad(x @ lw + lc).astype(np.float32) / len(x)
        nw, nc = lw - rate * (x.T @ g + l2 * lw), lc - 1.0 * g.sum(0)
        vw, vc, w, c = nw - w, nc - c, nw, nc
    return w, c
