"""Substring dedup by sliding sentence spans (operator 2).

Texts are cut into sentences at ``.``, ``!``, ``?`` and line ends; a sentence of more than
``LONG`` words is cut further after each word whose hash is the least of some ``WINDOW`` consecutive
words, which is the same place in every copy. Two kinds of spans are hashed over their lower-cased
words: every run of ``SPAN`` consecutive whole sentences, however short, and from each piece on the
run of ``SPAN`` pieces that grows until it has ``MIN_WORDS`` words, so a few common words in a row
are no span. A passage of over 50 words, wherever it begins and whatever its punctuation, holds a
whole span: a cut more than six words inside it doesn't depend on the words around it, cuts are at
most seven words apart, and a span is 22 words long at most. Spans join globally by hash, and all
pieces of a span that is not the first of its hash (by doc_id, then place) are removed.

Two Bloom filters set aside the spans that stand once; beyond what they hold (``bitmaps``) more
spans are only suspected, and the exact join decides.
The first span of a hash is an aggregate that combines before its shuffle, and the join that marks
the other spans can be split at a frequent one, so a passage that a third of all documents hold
meets in no single task. A document's removed sentences are bounded by the document.

Defined cases: null or empty text has no sentence; of repeated rows (same doc_id and text) the
first keeps its sentences only if no earlier document has them, as rows are told apart by doc_id
and text; a null doc_id comes last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, shared
from .vectext import LOWER, SPACE, U, mix, powers, prefix_hash, span_hash, utf8, word_spans

SPAN, MIN_WORDS, LONG, WINDOW = 3, 16, 7, 7
#: Text in one step of a task: the arrays over its words take some hundred bytes a word.
STEP_BYTES = 1 << 20
_NULL = 2**63 - 1
_CUT = SPACE.copy()
_CUT[[ord(c) for c in ".!?,;:\"'()[]{}"]] = True


def least_of_window(h: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Which words have the least hash (the last of equal ones) of ``window`` consecutive words of a row."""
    out = np.zeros(len(h), bool)
    n = len(h) - window + 1
    if n > 0:
        best, at = h[:n].copy(), np.arange(n)
        for i in range(1, window):
            less = h[i : i + n] <= best
            best[less] = h[i : i + n][less]
            at[less] = np.flatnonzero(less) + i
        out[at[row[:n] == row[window - 1 :]]] = True
    return out


def sentences(b: np.ndarray, off: np.ndarray, long: int = LONG, window: int = WINDOW):
    """Row, first byte, end byte of each piece, whether it begins a sentence, the place of its first
    word and the hashes of all words. The bytes of a text belong to its pieces without gaps, but for
    white space before the first."""
    low = LOWER[b]
    ws, we, row = word_spans(low, off, _CUT)
    if not len(ws):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(bool), z, z.astype(np.uint64)
    h = span_hash(prefix_hash(low), ws, we)
    ends = np.concatenate([[0], np.cumsum((b == 46) | (b == 33) | (b == 63) | (b == 10))])
    stop = np.ones(len(ws), bool)  # this word is the last of its sentence
    stop[:-1] = (ends[ws[1:]] > ends[we[:-1]]) | (row[1:] != row[:-1])
    begins = np.append(True, stop[:-1])
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(ws)))
    stop |= np.repeat(size > long, size) & least_of_window(h, row, window)
    first = np.flatnonzero(np.append(True, stop[:-1]))
    s_row = row[first]
    start = ws[first]
    end = np.append(start[1:], 0)
    last = np.append(s_row[1:] != s_row[:-1], True)
    end[last] = off[1:][s_row[last]]
    return s_row, start, end, begins[first], first, h


def spans(b: np.ndarray, off: np.ndarray, span: int = SPAN, min_words: int = MIN_WORDS):
    """Row, first piece, end piece (both counted within the row) and hash of each span."""
    row, _, _, begins, first, h = sentences(b, off)
    if not len(row):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    bound = np.append(first, len(h))
    row_end = np.searchsorted(row, row, side="right")
    to = np.maximum(np.arange(len(row)) + span, np.searchsorted(bound, first + min_words))
    grown = np.flatnonzero(to <= row_end)
    whole = np.append(np.flatnonzero(begins), len(row))
    n = max(0, len(whole) - span)
    whole_at, whole_to = whole[:n], whole[span : span + n]
    inside = whole_to <= row_end[whole_at]
    both = np.concatenate([grown * (len(row) + 1) + to[grown], whole_at[inside] * (len(row) + 1) + whole_to[inside]])
    at, to = np.divmod(np.unique(both), len(row) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(b) + 1)[: len(h)], out=total[1:])
    i, j = bound[at], bound[to]
    key = mix((total[j] - total[i]) * powers(len(b) + 1, True)[i] + U(7) * (j - i).astype(np.uint64))
    zero = np.searchsorted(row, row[at])
    return row[at], at - zero, to - zero, key


def _seen(bits: int, span: int, min_words: int):
    def run(it):
        pair = bitmaps.Pair(bits)
        for rb in shared.batches(it, None, STEP_BYTES):
            pair.see(spans(*utf8(rb.column(1)), span, min_words)[3])
        yield from pair.record_batches()

    return run


def _spans(found, span: int, min_words: int):
    def run(it):
        twice = bitmaps.opened(found)
        for rb in shared.batches(it, None, STEP_BYTES):
            row, at, to, key = spans(*utf8(rb.column(1)), span, min_words)
            ok = np.flatnonzero(twice.has(key))
            for i in range(0, len(ok), 1 << 16):
                s = ok[i : i + (1 << 16)]
                take = pa.array(row[s])
                yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), rb.column(0).take(take), rb.column(2).take(take), pa.array(at[s].astype(np.int32)), pa.array(to[s].astype(np.int32))], ["hash", "doc_id", "fp", "at", "to"])

    return run


def _rewrite(keep_text: bool):
    def run(it):
        for rb in shared.batches(it, None, STEP_BYTES):
            b, off = utf8(rb.column(1))
            row, start, end, *_ = sentences(b, off)
            at = np.searchsorted(row, np.arange(rb.num_rows + 1))
            raw, hits = b.tobytes(), rb.column(2)
            removed, shas, texts = [], [], []
            for i in range(rb.num_rows):
                a, z = at[i], at[i + 1]
                whole = raw[off[i] : off[i + 1]]
                gone = np.zeros(z - a, bool)
                if hits[i].is_valid:
                    edge = np.zeros(z - a + 1, np.int64)
                    for name, step in (("at", 1), ("to", -1)):
                        np.add.at(edge, hits[i].values.field(name).to_numpy(zero_copy_only=False), step)
                    gone = np.cumsum(edge[:-1]) > 0
                    head = raw[off[i] : start[a]]
                    whole = head + b"".join(raw[s:e] for s, e in zip(start[a:z][~gone], end[a:z][~gone]))
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(whole).hexdigest())
                texts.append(whole)
            cols = [rb.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_sentences", "n_removed", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array([t.decode() for t in texts], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def dedup_sentences(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_sentences, n_removed, kept_sha256 and, if asked for, kept_text."""
    spark = docs.sparkSession
    shared.prepare(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    bits = min(30, bitmaps.filter_bits(docs) + 2)  # a bit for each byte of input: there is a span for some 15 bytes
    found = bitmaps.share(spark, bitmaps.merged_twice(docs.mapInArrow(_seen(bits, span, min_words), bitmaps.SCHEMA), bits))
    spans = docs.mapInArrow(_spans(found, span, min_words), "hash long, doc_id long, fp long, at int, to int")
    first = spans.groupBy("hash").agg(F.min(F.struct("doc_id", "fp", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    first = shared.stored(first, "first-spans")
    shared.release(spark)
    again = spans.join(first.hint("merge"), "hash").where(F.struct("doc_id", "fp", "at") != F.col("first"))
    again = shared.stored(again.select("doc_id", "fp", "at", "to"), "repeated-spans")
    shared.release(spark)
    hits = again.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("at", "to")).alias("hits"))
    out = "doc_id long, n_sentences long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    done = docs.join(hits.hint("merge"), ["doc_id", "fp"], "left").select("doc_id", "text", "hits").mapInArrow(_rewrite(keep_text), out)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _NULL, F.col("doc_id")))


def op2_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_sentences(shared.documents(spark, sf_dir), keep_text=False)
