"""Line dedup by two Bloom filters (operator 7).

Pass 1 gives a filter of line keys that may stand in two documents or more; pass 2 sends only
suspected keys, as 8-byte hashes with the key's length and doc_id, to an exact count; pass 3
rewrites the documents. A line that a third of all documents hold is pre-aggregated in each task.

Defined cases: null or empty text is one empty line; keys under ``min_chars`` code points stay;
a repeated doc_id is one document; a document with a null doc_id counts as one and loses no
line; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, shared
from .vectext import CODE, LOWER, SPACE, prefix_hash, span_hash, utf8, word_spans  # noqa: F401

MIN_CHARS, MIN_DOCS = 20, 3


def line_keys(col: pa.Array, min_chars: int):
    """For each line: its row, byte span [start, end), key hash and whether the key counts."""
    b, off = utf8(col)
    nl = np.flatnonzero(b == 10)
    rows = np.arange(len(off) - 1)
    start = np.concatenate([off[:-1], nl + 1])
    end_nl_row = np.searchsorted(off, nl, side="right") - 1
    row = np.concatenate([rows, end_nl_row])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty(len(start), np.int64)
    last = np.ones(len(start), bool)
    last[:-1] = row[:-1] != row[1:]
    end[:-1] = start[1:] - 1
    end[last] = off[1:][row[last]]
    low = LOWER[b]
    ws, we, _ = word_spans(low, off)
    a = np.searchsorted(ws, start)
    z = np.searchsorted(ws, end)
    some = z > a
    ks, ke = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    if len(ws):
        ks[some], ke[some] = ws[a[some]], we[z[some] - 1]
    points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    long = (points[ke] - points[ks]) >= max(1, min_chars)
    h = np.zeros(len(start), np.uint64)
    h[long] = span_hash(prefix_hash(low), ks[long], ke[long])
    return b, row, start, end, h, long


def _seen(bits: int, min_chars: int):
    def run(it):
        pair = bitmaps.Pair(bits)
        for rb in shared.batches(it, ["doc_id", "text"]):
            _, row, _, _, h, long = line_keys(rb.column(1), min_chars)
            pair.see(np.unique(np.stack([row[long].astype(np.uint64), h[long]]), axis=1)[1] if long.any() else h[long])
        yield from pair.record_batches()

    return run


def _suspects(found, min_chars: int):
    def run(it):
        twice = bitmaps.opened(found)
        for rb in shared.batches(it, ["doc_id", "text"]):
            _, row, _, _, h, long = line_keys(rb.column(1), min_chars)
            row, h = row[long], h[long]
            hit = twice.has(h)
            if hit.any():
                pairs = np.unique(np.stack([row[hit].astype(np.uint64), h[hit]]), axis=1)
                ids = rb.column(0).take(pa.array(pairs[0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), ids], ["key", "doc_id"])

    return run


def _rewrite(min_chars: int, keep_text: bool):
    def run(it):
        for rb in shared.batches(it, ["doc_id", "text"]):
            b, row, start, end, h, long = line_keys(rb.column(1), min_chars)
            at = np.searchsorted(row, np.arange(rb.num_rows + 1))
            gone_col = rb.column(2)
            n_dropped, shas, texts = [], [], []
            raw = b.tobytes()
            for i in range(rb.num_rows):
                a, z = at[i], at[i + 1]
                gone = gone_col[i].values if gone_col[i].is_valid else None
                if gone is None:
                    kept, n = raw[start[a] : end[z - 1]], 0
                else:
                    g = np.asarray(gone.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                    bad = long[a:z] & np.isin(h[a:z], g)
                    n = int(bad.sum())
                    kept = b"\n".join(raw[s:e] for s, e in zip(start[a:z][~bad], end[a:z][~bad]))
                n_dropped.append(n)
                shas.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode())
            cols = [rb.column(0), pa.array(np.diff(at), pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text. Lines
    whose key (stripped, A-Z lower-cased) has ``min_chars`` code points and stands in ``min_docs``
    documents go, but in the largest doc_id that holds them."""
    spark = docs.sparkSession
    shared.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = bitmaps.filter_bits(docs)
    parts = docs.mapInArrow(_seen(bits, min_chars), bitmaps.SCHEMA)
    found = bitmaps.share(spark, bitmaps.merged_twice(parts, bits))
    pairs = shared.stored(docs.mapInArrow(_suspects(found, min_chars), "key long, doc_id long"), "line-suspects")
    counts = pairs.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    counts = shared.stored(counts, "hot-lines")  # the join then reads both sides by exchanges that Spark can split at a hot line
    gone = pairs.join(counts.hint("merge"), "key").where("doc_id <> keep").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * keep_text
    return docs.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_rewrite(min_chars, keep_text), out)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(shared.documents(spark, sf_dir), keep_text=False)


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents)),
hot AS (SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL AND doc_id <> keep) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE hot.k IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (k) GROUP BY doc_id
"""
