"""Mergeable pair of Bloom filters for keys seen once and keys seen twice.

Each task keeps two bit arrays over its own keys: ``once`` and, for keys whose bits were set
already, ``twice``. Tasks send their arrays as compressed chunks; chunk by chunk they merge as
``twice = t1 | t2 | (o1 & o2)``, ``once = o1 | o2``. A key that two tasks saw has all its bits
in both ``once`` arrays, so there are no false negatives. The merged ``twice`` filter has a
fixed size, which bounds what is sent to the driver and broadcast; when the input outgrows it,
more keys are only suspected, and exact confirmation follows anyway.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

CHUNK_BITS = 18
SCHEMA = "chunk int, once binary, twice binary"


def filter_bits(docs: DataFrame, low: int = 24, high: int = 30) -> int:
    """log2 of a filter's bits: a bit for four bytes of input, 2**30 (128 MB) at most."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(high, max(low, math.ceil(math.log2(max(2, size))) - 2))


class Filter:
    """Bit array with two bits for each key."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(1 << (bits - 3), np.uint8) if data is None else data

    def places(self, keys: np.ndarray):
        shift = np.uint64(64 - self.bits)
        return keys >> shift, (keys * np.uint64(0x9E3779B97F4A7C15)) >> shift

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys):
            out &= (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def put(self, keys: np.ndarray) -> None:
        for p in self.places(keys):
            np.bitwise_or.at(self.data, p >> np.uint64(3), np.left_shift(1, (p & np.uint64(7))).astype(np.uint8))


class Pair:
    """``once`` and ``twice`` of one task; ``see`` takes distinct keys of one document or several
    documents' keys with repeats between them."""

    def __init__(self, bits: int):
        self.once, self.twice = Filter(bits), Filter(bits)

    def see(self, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.twice.put(keys[(n > 1) | self.once.has(keys)])
        self.once.put(keys)

    def chunks(self):
        size = 1 << (min(CHUNK_BITS, self.once.bits) - 3)
        for i in range(0, len(self.once.data), size):
            if self.once.data[i : i + size].any():
                yield i // size, zlib.compress(self.once.data[i : i + size].tobytes(), 1), zlib.compress(self.twice.data[i : i + size].tobytes(), 1)

    def record_batches(self, schema_fields=None):
        rows = []
        for c in self.chunks():
            rows.append(c)
            if len(rows) == 64:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        c, o, t = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(o, pa.binary()), pa.array(t, pa.binary())], ["chunk", "once", "twice"])


def _fold(key, it):
    once = twice = None
    for rb in it:
        for o, t in zip(rb.column("once"), rb.column("twice")):
            o = np.frombuffer(zlib.decompress(o.as_py()), np.uint8)
            t = np.frombuffer(zlib.decompress(t.as_py()), np.uint8)
            if once is None:
                once, twice = o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if once is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["chunk", "twice"])


def _fold_table(key, table):
    return pa.Table.from_batches(list(_fold(key, table.to_batches())), schema=pa.schema([("chunk", pa.int32()), ("twice", pa.binary())]))


def merged_twice(parts: DataFrame, bits: int) -> Filter:
    """The ``twice`` filter of all tasks, on the driver: 2**bits bits at most."""
    out = Filter(bits)
    size = 1 << (min(CHUNK_BITS, bits) - 3)
    for r in parts.groupBy("chunk").applyInArrow(_fold_table, "chunk int, twice binary").collect():
        out.data[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.twice)), np.uint8)
    return out


def share(spark, found: Filter):
    """The filter as a broadcast variable under a name of its own; ``opened`` gives it back in a task."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, found.bits, zlib.compress(found.data.tobytes(), 1)))


_opened: dict[str, Filter] = {}


def opened(shared_filter) -> Filter:
    """The broadcast filter, decoded once in each worker. Python workers outlive a query, so the
    decoded filter is kept by its name, never by an object's identity."""
    name, bits, data = shared_filter.value
    if name not in _opened:
        _opened.clear()
        _opened[name] = Filter(bits, np.frombuffer(zlib.decompress(data), np.uint8))
    return _opened[name]


def filter_of(keys: DataFrame, high: int = 30):
    """A shared filter of the longs in the one column of ``keys`` (written): 16 bits for each, 2**30
    (128 MB) at most, beyond which it only lets more through."""
    bits = max(16, min(high, (16 * keys.count()).bit_length()))

    def run(it):
        pair = Pair(bits)
        for rb in it:
            values = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            pair.once.put(values)
            pair.twice.put(values)
        yield from pair.record_batches()

    return share(keys.sparkSession, merged_twice(keys.mapInArrow(run, SCHEMA), bits))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (doc_id: long, not null; written). Only rows that a
    filter of the ids suspects are shuffled for the exact anti-join; the others stay where they are."""
    if gone.isEmpty():
        return docs
    found = filter_of(gone.select(F.xxhash64("doc_id").alias("key")))
    suspect = F.pandas_udf(lambda h: pd.Series(opened(found).has(h.to_numpy().view(np.uint64))), "boolean")
    hit = F.coalesce(suspect(F.xxhash64(F.col("doc_id").cast("long"))), F.lit(False))
    marked = docs.withColumn("__hit", hit)
    some = marked.where("__hit").drop("__hit")
    some = some.join(gone.hint("merge"), some["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    return marked.where("NOT __hit").drop("__hit").union(some)


__all__ = ["Filter", "Pair", "SCHEMA", "filter_bits", "filter_of", "merged_twice", "opened", "share", "shared", "without"]
