"""Substring dedup by suffix arrays (operator 6): bytes under a repeated ``width``-byte string go.

Every window of ``width`` bytes has a key that depends on its bytes alone: the least hash of the
k-grams in it. Equal windows have equal keys, so a run of windows with one key (a region, some 290
bytes) needs to meet only regions of that key. Two Bloom filters drop keys that occur once (but runs in which
a window may recur). Regions are first compared by key and hash alone: where all regions of a key
are equal and several, all their windows are repeated. Only the other regions' texts are fetched, each
distinct one once, and dealt by key to shards of bounded size. Each shard builds the suffix array
of its text by Larsson-Sadakane refinement (prefix doubling that re-sorts only the groups still
tied), and the common prefixes by Kasai's rule in its permuted form (a prefix length is one less
than the one before it unless the characters in front differ); a window is repeated when a
neighbour in the array shares ``width`` bytes with it, or its region occurs several times.

A key with more text than a shard holds (``KEY_BYTES``) is spread over shards of its own, which are merged
by binary search: each shard's windows are looked up in the suffix arrays of the others. A key with
more than ``MERGED`` such shards is cut finer with longer k-grams first, at last by the window itself,
where a key has one region.

Defined cases: null text is empty; texts under ``width`` bytes have no window; repeated rows are
each other's copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, shared
from .vectext import mix, prefix_hash, ragged, span_hash, utf8

WIDTH, SHARD_BYTES, KEY_BYTES = 200, 2 << 20, 1 << 20
#: Shards of one key that are merged by binary search; a key with more is cut by longer k-grams.
MERGED = 8
#: Regions that a task remembers so as to send their text once; it starts anew beyond.
REMEMBERED = 1 << 16
#: Text in one step of a task: its arrays take some hundred bytes for a byte, and should stay in the cache.
STEP_BYTES = 1 << 18
_NULL = -(2**63)


def grams(width: int) -> tuple[int, int, int]:
    """Lengths of the k-grams of the three levels."""
    return max(1, width // 10), max(1, width - width // 9), width


def regions(b: np.ndarray, off: np.ndarray, k: int, width: int):
    """Runs of windows with one key: row, first start, number of windows, key, hash of the bytes,
    and whether a window may occur in the run again (the least k-gram occurs in it again)."""
    starts = off[:-1]
    count = np.maximum(off[1:] - starts - width + 1, 0)
    pre = prefix_hash(b)
    s = ragged(starts, count)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool)
    at = np.arange(len(b) - k + 1)
    h = span_hash(pre, at, at + k)
    w = width - k + 1
    if w > 1:  # least of w neighbours: prefix and suffix minima of blocks of w
        full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        full[: len(h)] = h
        block = full.reshape(-1, w)
        left = np.minimum.accumulate(block, 1).ravel()
        right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
        m = np.minimum(right[s], left[np.minimum(s + w - 1, len(full) - 1)])
    else:
        m = h[s]
    row = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(s), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(s)))
    a = s[first]
    inner = np.append((h[s[:-1]] == m[:-1]) & ~new[1:], False)
    return row[first], a, n, mix(m[first]), span_hash(pre, a, a + n - 1 + width), np.logical_or.reduceat(inner, first)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes by Larsson-Sadakane refinement, from the first eight bytes on."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    pad = np.concatenate([t, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | pad[i : i + n].astype(np.uint64)
    sa = np.argsort(key)
    k = key[sa]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(tied):
        members = sa[tied]
        over = n - 1 - members - h  # negative past the end: the shorter suffix sorts first
        second = np.where(over >= 0, rank[np.minimum(members + h, n - 1)], over) + h + 1
        major = rank[members]
        both = (major.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(both)
        members, both = members[order], both[order]
        sa[tied] = members
        start = np.ones(len(tied), bool)
        start[1:] = both[1:] != both[:-1]
        rank[members] = np.maximum.accumulate(np.where(start, tied, 0))
        tied = tied[~start | ~np.append(start[1:], True)]
        h *= 2
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``sa`` with the one before it."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    follows = np.zeros(n, bool)  # one less than at the position before
    ok = (i > 0) & (phi > 0)
    follows[ok] = t[i[ok] - 1] == t[phi[ok] - 1]
    follows &= phi >= 0
    own = np.flatnonzero(~follows & (phi >= 0))
    length = np.zeros(n, np.int64)
    pad = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.zeros(n + 1, np.uint64)
    for j in range(8):
        words[:n] = (words[:n] << np.uint64(8)) | pad[j : j + n].astype(np.uint64)
    active = own
    while len(active):
        x, y = active + length[active], phi[active] + length[active]
        inside = (x <= n - 8) & (y <= n - 8)
        same = inside & (words[np.minimum(x, n)] == words[np.minimum(y, n)])
        length[active[same]] += 8
        rest = active[~same]
        while len(rest):
            x, y = rest + length[rest], phi[rest] + length[rest]
            step = (x < n) & (y < n)
            step[step] = t[x[step]] == t[y[step]]
            rest = rest[step]
            length[rest] += 1
        active = active[same]
    at = np.maximum.accumulate(np.where(follows, 0, i))
    plcp = np.where(phi >= 0, np.maximum(length[at] - (i - at), 0), 0)
    return plcp[sa]


def window_starts(lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the joined texts begins (one byte between two), and whether a window starts at a byte."""
    begin = np.cumsum(lens + 1) - lens - 1
    valid = np.zeros(int(lens.sum() + max(0, len(lens) - 1)), bool)
    valid[ragged(begin, np.maximum(lens - width + 1, 0))] = True
    return begin, valid


def runs(hit: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """For each joined text the runs of marked bytes, as flat [start, end) pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    owner = np.searchsorted(begin, lo, side="right") - 1
    a, z = np.searchsorted(owner, np.arange(len(begin))), np.searchsorted(owner, np.arange(len(begin)), side="right")
    return [np.stack([lo[x:y], hi[x:y]], 1).ravel() - f for f, x, y in zip(begin, a, z)]


def repeated_windows(texts: list[bytes], times: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each distinct text (``times``: its occurrences) the runs of window starts whose window
    occurs again, the text joined and its suffix array."""
    t = np.frombuffer(b"\0".join(texts), np.uint8)
    lens = np.array([len(x) for x in texts], np.int64)
    begin, valid = window_starts(lens, width)
    sa = suffix_array(t)
    group = np.cumsum(common_prefixes(t, sa) < width) - 1
    ok = valid[sa]
    size = np.bincount(group[ok], minlength=group[-1] + 1 if len(group) else 0)
    hit = np.zeros(len(t), bool)
    hit[sa[ok & (size[group] > 1)]] = True
    again = np.flatnonzero(times > 1)
    hit[ragged(begin[again], np.maximum(lens[again] - width + 1, 0))] = True
    return runs(hit, begin), t, sa


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number in their order."""
    pad = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t) + 1, np.uint64)
    for j in range(8):
        out[: len(t)] = (out[: len(t)] << np.uint64(8)) | pad[j : j + len(t)].astype(np.uint64)
    return out


def merge_shards(text: np.ndarray, starts: np.ndarray, other: np.ndarray, other_sa: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``text`` (at ``starts``) stand in ``other``, by binary search among ``other_sa``:
    the window starts of ``other`` in the order of its suffix array."""
    if not len(other_sa) or not len(starts):
        return np.zeros(len(starts), bool)
    ours, theirs = _words(text), _words(other)

    def order(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """-1, 0, 1: their window before ours, equal, after."""
        out, open_ = np.zeros(len(s), np.int8), np.arange(len(s))
        for at in range(0, width, 8):
            x, y = ours[s[open_] + at], theirs[t[open_] + at]
            if width - at < 8:
                rest = np.uint64(64 - 8 * (width - at))
                x, y = x >> rest, y >> rest
            out[open_[y < x]], out[open_[y > x]] = -1, 1
            open_ = open_[x == y]
            if not len(open_):
                break
        return out

    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(other_sa))
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) // 2
        before = order(starts[open_], other_sa[mid]) < 0
        lo[open_[before]] = mid[before] + 1
        hi[open_[~before]] = mid[~before]
    out = lo < len(other_sa)
    out[out] = order(starts[out], other_sa[lo[out]]) == 0
    return out


def _keys(bits: int, width: int):
    def run(it):
        pair = bitmaps.Pair(bits)
        for rb in shared.batches(it, None, STEP_BYTES):
            _, _, _, key, _, inner = regions(*utf8(rb.column(1)), grams(width)[0], width)
            pair.see(np.concatenate([key, key[inner]]))
        yield from pair.record_batches()

    return run


def _regions(found, width: int):
    def run(it):
        twice = bitmaps.opened(found)
        for rb in shared.batches(it, None, STEP_BYTES):
            b, off = utf8(rb.column(1))
            found_here = regions(b, off, grams(width)[0], width)
            hit = twice.has(found_here[3])
            row, a, n, key, h, inner = (x[hit] for x in found_here)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), rb.column(0).take(take), rb.column(2).take(take), pa.array((a - off[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(inner)], ["key", "hash", "doc_id", "fp", "at", "n", "inner"])

    return run


def _texts(found, width: int):
    """Texts of the regions whose hash the filter has; those that this task has sent lately not again."""

    def run(it):
        wanted, had = bitmaps.opened(found), set()
        for rb in shared.batches(it, None, STEP_BYTES):
            b, off = utf8(rb.column(1))
            _, a, n, key, h, _ = regions(b, off, grams(width)[0], width)
            raw, keys, hashes, texts = b.tobytes(), [], [], []
            if len(had) > REMEMBERED:
                had.clear()
            for i in np.flatnonzero(wanted.has(h)).tolist():
                if (x := int(h[i])) not in had:
                    had.add(x)
                    keys.append(key[i])
                    hashes.append(h[i])
                    texts.append(raw[a[i] : a[i] + n[i] - 1 + width])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(texts, pa.binary())], ["key", "hash", "text"])

    return run


def _finer(k: int, width: int):
    def run(it):
        for rb in it:
            b, off = utf8(rb.column(2))
            row, a, n, key, h, inner = regions(b, off, k, width)
            raw = b.tobytes()
            texts = [raw[s:e] for s, e in zip(a.tolist(), (a + n - 1 + width).tolist())]
            take = pa.array(row)
            for i in range(0, len(row), 4096):
                s = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([rb.column(0).take(take[s]), rb.column(1).take(take[s]), rb.column(3).take(take[s]), pa.array((a - off[row])[s]), pa.array(key.view(np.int64)[s]), pa.array(h.view(np.int64)[s]), pa.array(inner[s]), pa.array(texts[s], pa.binary())], ["up_key", "up_hash", "n", "at", "key", "hash", "inner", "text"])

    return run


def _some(table: pa.Table, spans: list[np.ndarray]) -> pa.Table:
    some = np.array([len(x) > 0 for x in spans], bool)
    return table.select(["key", "hash"]).filter(pa.array(some)).append_column("spans", pa.array([x for x in spans if len(x)], pa.list_(pa.int64())))


def _shard(width: int):
    """Repeated windows of one shard."""

    def run(_, table):
        texts = [x.as_py() for x in table.column("text")]
        return _some(table, repeated_windows(texts, table.column("n").to_numpy(), width)[0])

    return run


def _part(width: int):
    """One of the shards of a key with its own repeated windows and its suffix array."""

    def run(key, table):
        texts = [x.as_py() for x in table.column("text")]
        spans, t, sa = repeated_windows(texts, table.column("n").to_numpy(), width)
        _, valid = window_starts(np.array([len(x) for x in texts], np.int64), width)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "hashes": one(table.column("hash").to_pylist(), pa.int64()), "lens": one([len(x) for x in texts], pa.int64()), "spans": one([x.tolist() for x in spans], pa.list_(pa.int64())), "text": pa.array([t.tobytes()], pa.binary()), "sa": pa.array([sa[valid[sa]].astype(np.int32).tobytes()], pa.binary())})

    return run


PART = "key long, part long, hashes array<long>, lens array<long>, spans array<array<long>>, text binary, sa binary"


def _merge(width: int):
    """Windows of one shard that another holds."""

    def run(it):
        for rb in it:
            for r in rb.to_pylist():
                begin, valid = window_starts(np.array(r["lens"], np.int64), width)
                starts = np.flatnonzero(valid)
                found = merge_shards(np.frombuffer(r["text"], np.uint8), starts, np.frombuffer(r["other"], np.uint8), np.frombuffer(r["sa"], np.int32).astype(np.int64), width)
                hit = np.zeros(len(valid), bool)
                hit[starts[found]] = True
                rows = pa.table({"key": pa.array([r["key"]] * len(begin), pa.int64()), "hash": pa.array(r["hashes"], pa.int64())})
                yield from _some(rows, runs(hit, begin)).to_batches()

    return run


def _solve(texts: DataFrame, width: int, levels) -> DataFrame:
    """key, hash, spans for the regions in ``texts`` (key, hash, n: occurrences, bytes: those of the
    key's regions, text; written) that have repeated windows."""
    sums = texts.agg(F.sum(F.length("text")).alias("b"), F.max("bytes").alias("most")).first()
    if sums.b is None:
        return texts.sparkSession.createDataFrame([], SPANS)
    limit = KEY_BYTES
    shards = max(1, -(-2 * sums.b // SHARD_BYTES))
    cool = texts.where(F.col("bytes") <= limit).select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "hash", "n", "text")
    out = cool.groupBy("shard").applyInArrow(_shard(width), SPANS)
    if sums.most <= limit:
        return out
    # a warm key: shards of their own, merged by binary search of each one's windows in the others
    several = F.ceil(F.col("bytes") / limit)
    warm = texts.where((F.col("bytes") > limit) & ((several <= MERGED) | F.lit(not levels)))
    parts = warm.withColumn("part", F.pmod(F.xxhash64("hash"), several)).groupBy("key", "part").applyInArrow(_part(width), PART)
    parts = shared.stored(parts, "key-shards")
    others = parts.select("key", F.col("part").alias("p"), F.col("text").alias("other"), "sa")
    pairs = parts.select("key", "part", "hashes", "lens", "text").join(others.hint("merge"), "key").where("part <> p")
    own = parts.select("key", F.explode(F.arrays_zip("hashes", "spans")).alias("x")).select("key", F.col("x.hashes").alias("hash"), F.col("x.spans").alias("spans")).where(F.size("spans") > 0)
    out = out.union(own).union(pairs.mapInArrow(_merge(width), SPANS))
    if not levels or sums.most <= limit * MERGED:
        return out
    # a hot key: cut by longer k-grams
    hot = texts.where(F.col("bytes") > limit * MERGED).select("key", "hash", "text", "n")
    sub = shared.stored(hot.mapInArrow(_finer(levels[0], width), "up_key long, up_hash long, n long, at long, key long, hash long, inner boolean, text binary"), "finer")
    fine = sub.groupBy("key", "hash").agg(F.sum("n").alias("n"), F.max("inner").alias("inner"), F.first("text").alias("text"), F.length(F.first("text")).alias("len"))
    fine = shared.stored(fine, "finer-regions")
    whole, open_ = _sorted_out(fine.withColumn("windows", F.col("len") - width + 1), width)
    got = _solve(shared.stored(fine.join(open_.select("key", "hash", "bytes").hint("merge"), ["key", "hash"]).select("key", "hash", "n", "bytes", "text"), "finer-texts"), width, levels[1:])
    got = shared.stored(got.union(whole), "finer-spans")
    return out.union(_lifted(sub.select("up_key", "up_hash", "at", "key", "hash"), got, "up_key", "up_hash").toDF("key", "hash", "spans"))


SPANS = "key long, hash long, spans array<bigint>"


def _sorted_out(uniq: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct regions (key, hash, n: occurrences, inner, windows): the spans of those whose
    windows are all repeated and which no other region of their key needs, and those (key, hash, n,
    bytes) whose text has to be compared."""
    stat = uniq.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.col("inner") & (F.col("n") == 1)).alias("in_one"), F.max("n").alias("most"), F.sum(F.col("windows") + (width - 1)).alias("bytes"))
    stat = shared.stored(stat.where("kinds > 1 OR in_one OR most > 1"), "keys")
    known = uniq.join(stat.hint("merge"), "key")
    alone = (F.col("kinds") == 1) & (F.col("n") > 1)
    whole = known.where(alone).select("key", "hash", F.array(F.lit(0).cast("long"), F.col("windows").cast("long")).alias("spans"))
    return whole, known.where(~alone).select("key", "hash", "n", "bytes")


def _lifted(members: DataFrame, spans: DataFrame, *ids: str) -> DataFrame:
    """Spans of the regions moved to the texts that hold them, together for each text."""
    both = members.join(spans.hint("merge"), ["key", "hash"]).select(*ids, F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
    return both.groupBy(*ids).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _rewrite(width: int, keep_text: bool):
    def run(it):
        for rb in shared.batches(it, None):
            b, off = utf8(rb.column(1))
            raw, spans = b.tobytes(), rb.column(2)
            removed, n_spans, shas, texts = [], [], [], []
            for i in range(rb.num_rows):
                whole = raw[off[i] : off[i + 1]]
                if spans[i].is_valid:
                    s = spans[i].values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                    s = s[np.argsort(s[:, 0], kind="stable")]
                    lo, hi = s[:, 0], np.maximum.accumulate(s[:, 1] - 1 + width)
                    new = np.append(True, lo[1:] > hi[:-1])
                    lo, hi = lo[new], hi[np.append(new[1:], True)]
                    kept, at = [], 0
                    for x, y in zip(lo.tolist(), hi.tolist()):
                        kept.append(whole[at:x])
                        at = y
                    kept = b"".join([*kept, whole[at:]])
                    n_spans.append(len(lo))
                else:
                    kept = whole
                    n_spans.append(0)
                removed.append(len(whole) - len(kept))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            cols = [rb.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(texts, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept
    bytes (which may cut a character)."""
    spark = docs.sparkSession
    shared.prepare(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    bits = bitmaps.filter_bits(docs)
    found = bitmaps.share(spark, bitmaps.merged_twice(docs.mapInArrow(_keys(bits, width), bitmaps.SCHEMA), bits))
    rows = shared.stored(docs.mapInArrow(_regions(found, width), "key long, hash long, doc_id long, fp long, at int, n int, inner boolean"), "regions")
    uniq = rows.groupBy("key", "hash").agg(F.count("*").alias("n"), F.max("inner").alias("inner"), F.max("n").alias("windows"))
    uniq = shared.stored(uniq, "distinct-regions")
    whole, open_ = (shared.stored(x, name) for x, name in zip(_sorted_out(uniq, width), ("whole-regions", "open-regions")))
    shared.release(spark)
    # only now the texts, and only of regions that have to be compared, each once
    wanted = bitmaps.filter_of(open_.select("hash"))
    texts = docs.mapInArrow(_texts(wanted, width), "key long, hash long, text binary").groupBy("key", "hash").agg(F.first("text").alias("text"))
    texts = shared.stored(texts.join(open_.hint("merge"), ["key", "hash"]).select("key", "hash", "n", "bytes", "text"), "region-texts")
    shared.discard(uniq, open_)
    shared.release(spark)
    spans = shared.stored(_solve(texts, width, grams(width)[1:]).union(whole), "spans")
    shared.discard(texts, whole)
    shared.release(spark)
    by_doc = _lifted(rows.select("key", "hash", "doc_id", "fp", F.col("at").cast("long").alias("at")), spans, "doc_id", "fp")
    by_doc = shared.stored(by_doc, "document-spans")
    shared.discard(rows, spans)
    shared.release(spark)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    done = docs.join(by_doc.hint("merge"), ["doc_id", "fp"], "left").select("doc_id", "text", "spans").mapInArrow(_rewrite(width, keep_text), out)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _NULL, F.col("doc_id")))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(shared.documents(spark, sf_dir), keep_text=False)
