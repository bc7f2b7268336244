"""Best-fit packing with large-item matching (operator 5).

Tokenization gives each document's pieces; only their lengths decide the packing. There are at
most ``capacity`` different lengths, so the plan is made on the driver from their histogram,
whatever the number of documents: lengths above a third of the capacity pair at most twice a bin
by greedy matching (largest with the largest that fits), smaller lengths go, largest first, to
the bins with the smallest gap that holds them. Runs of equal bins are kept as one block. Each
piece then finds its bin from its length and its rank among the pieces of that length; ranks come
from per-task counts and a running sum over tasks, so no task gathers the pieces of one length.

Defined cases: a null text is empty (one piece with the closing id alone); a document longer than
the capacity is cut, its first piece being the shorter one; equal rows are packed separately; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .bpe import encoder

CAPACITY, END_ID = 2048, 0
#: Text in one step of a task.
STEP_BYTES = 1 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(it):
        enc = encoder(path)
        pid = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rb in shared.batches(it, ["doc_id", "text"], STEP_BYTES):
            ids, off = enc.encode([t or "" for t in rb.column(1).to_pylist()])
            n = np.diff(off) + 1
            docs = np.repeat(np.arange(len(n)), n)
            all_ids = np.full(int(n.sum()), end_id, "<u4")
            last = np.cumsum(n) - 1
            body = np.ones(len(all_ids), bool)
            body[last] = False
            all_ids[body] = ids
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            base = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(all_ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(base.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            srt = length[order]
            at = np.searchsorted(srt, srt)
            rank = np.empty(len(srt), np.int64)
            rank[order] = np.arange(len(srt)) - at
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [rb.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), pid), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"]
            if keep_ids:
                cols.append(pa.array([all_ids[a : a + m].astype(np.int32) for a, m in zip(base, length)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
            del docs

    return run


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, task_rank and, if asked
    for, the ids."""
    shared.prepare(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long" + ", ids array<int>" * keep_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id, keep_ids), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements ``(length, first_rank, n, first_bin, per_bin, offset)``: the n pieces of that
    length from that rank on go to bins from first_bin on, per_bin to a bin, the first at offset."""
    left = {k: n for k, n in counts.items() if n > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    blocks: dict[int, list[tuple[int, int]]] = {}  # by gap: first bin, number of bins
    bins = 0

    def take(length: int, n: int, first_bin: int, per_bin: int, offset: int) -> None:
        out.append((length, used[length], n, first_bin, per_bin, offset))
        used[length] += n
        left[length] -= n

    def close(gap: int, first: int, n: int) -> None:
        if gap and n:
            blocks.setdefault(gap, []).append((first, n))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for k in large:
        while left[k]:
            mate = next((m for m in large if m <= k and m + k <= capacity and left[m] > (m == k)), None)
            if mate is None:
                n = left[k]
                take(k, n, bins, 1, 0)
                close(capacity - k, bins, n)
            else:
                n = left[k] // 2 if mate == k else min(left[k], left[mate])
                take(k, n, bins, 1, 0)
                take(mate, n, bins, 1, k)
                close(capacity - k - mate, bins, n)
            bins += n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        open_gaps = [g for g in blocks if g >= k]
        heapq.heapify(open_gaps)
        while left[k]:
            while open_gaps and not blocks.get(open_gaps[0]):
                heapq.heappop(open_gaps)
            if open_gaps:
                gap = open_gaps[0]
                first, n = blocks[gap].pop()
            else:
                gap, first = capacity, bins
                n = -(-left[k] // (capacity // k))
                bins += n
            per = gap // k
            full = min(n, left[k] // per)
            if full:
                take(k, full * per, first, per, capacity - gap)
                close(gap - per * k, first, full)
            rest = left[k]
            if full < n:
                if rest:
                    take(k, rest, first + full, rest, capacity - gap)
                    close(gap - rest * k, first + full, 1)
                    full += 1
                close(gap, first + full, n - full)
    return out


def _place(placements):
    table = np.array(sorted(placements), np.int64).reshape(-1, 6)

    def run(it):
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for rb in it:
            length = rb.column(rb.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = rb.column(rb.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            t = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            r = rank - t[:, 1]
            cols = [c for n, c in zip(rb.schema.names, rb.columns) if n != "rank"]
            names = [n for n in rb.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t[:, 3] + r // t[:, 4]), pa.array(t[:, 5] + (r % t[:, 4]) * length)], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, task, task_rank; written to storage, so that tasks and ranks
    hold) with sequence_id and offset."""
    tally = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    tally = shared.stored(tally, "length-counts")
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = tally.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = pieces.join(before.hint("merge"), ["length", "task"]).withColumn("rank", F.col("task_rank") + F.col("before")).drop("before", "task", "task_rank")
    fields = [*ranked.drop("rank").schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(plan(counts, capacity)), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    pieces = shared.stored(tokenized_pieces(docs, capacity, path, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(shared.documents(spark, sf_dir))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
