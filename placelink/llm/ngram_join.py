"""N-gram Jaccard join by T-occurrence search with DivideSkip (operator 1).

A document's set is its distinct word shingles; equal sets are one node. Two nodes are linked when
they share the T shingles that the Jaccard threshold asks for. Seen from a node, T-occurrence
search merges its short inverted lists and probes its long ones (DivideSkip). Here the lists are
distributed:

1. One pass gives each set's size and fingerprint and a count sketch of all shingles of all
   documents. The sketch (2**20 counters, whatever the input) only fixes a global order, rare
   shingles first; any order is correct.
2. With T - s lists left aside as long ones, a partner must stand in s of the n - T + s short
   lists, those of the node's rarest shingles. Short lists are merged by a shuffle on the shingle;
   lists of one node go, then nodes with fewer than s lists, which are nearly all that have no near
   copy.
3. What may be linked hangs together by short lists (``candidate_groups``): these groups are the
   connected components of a graph with at most ``PAIRED`` - 1 edges for each list entry.
4. The whole sets of a group, each once, go to one task, or where a group is large to a task for every two
   blocks of it. There each set is a query to the inverted lists of the others: DivideSkip merges
   the short lists and probes the long ones for what they leave in reach of T. T and the counts
   are exact integers. A task gives counts of links and the components of its links, no pairs.
5. Only components found by several tasks of a large group are joined by rounds over all tasks.

``n_links`` of a document is the number of sets other than its own that are linked to its set; rows
with an equal set are one node and no link.

Hashes of shingles have 64 bits. Defined cases: null, empty and wordless texts have an empty set and
no link; shorter texts are one shingle; repeated rows share a component; a null doc_id never names
a component unless all its rows have one; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitmaps, shared
from .components import components
from .vectext import U, mix, shingles

SKETCH_BITS, SKETCH_CHUNK = 20, 1 << 14
#: Text in one step of a task: its arrays take some hundred bytes for a byte.
STEP_BYTES = 1 << 19
#: Nodes of a list whose pairs are counted one by one.
PAIRED = 8
#: Sets in one block of a group, up to so many blocks; then blocks grow, up to so many shingles.
BLOCK_SETS, BLOCKS, BLOCK_MOST = 80, 24, 1 << 18
#: Entries of short lists that are merged by a heap, and long lists probed in one step.
HEAP_MOST, PROBES = 1 << 12, 32
#: Sets that a task remembers so as to send them once; it starts anew beyond.
REMEMBERED = 1 << 16
_NULL = -(2**63)


def fingerprint(s: np.ndarray) -> int:
    """64 bits of a sorted set of hashes."""
    if not len(s):
        return 0
    total = s.sum(keepdims=True, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(len(s))
    return int(mix(np.bitwise_xor.reduce(mix(s), keepdims=True) + total).view(np.int64)[0])


def _signatures(k: int):
    def run(it):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "fp", "chunk", "counts"]
        for rb in shared.batches(it, ["doc_id", "text"], STEP_BYTES):
            sets = shingles(rb.column(1), k)
            h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            nulls = rb.num_rows
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.nulls(nulls, pa.int32()), pa.nulls(nulls, pa.binary())], names)
        for i in range(0, len(counts), SKETCH_CHUNK):
            part = counts[i : i + SKETCH_CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i // SKETCH_CHUNK], pa.int32()), pa.array([zlib.compress(part.astype(np.uint32).tobytes(), 1)], pa.binary())], names)

    return run


def _add_counts(key, table):
    total = np.zeros(SKETCH_CHUNK, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def sketch_levels(parts: DataFrame) -> np.ndarray:
    """For each counter its level: 0 up to four times the mean, then one more for each doubling."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in parts.groupBy("chunk").applyInArrow(_add_counts, "chunk int, counts binary").collect():
        counts[r.chunk * SKETCH_CHUNK : (r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    base = max(8.0, 4 * counts.mean())
    return np.ceil(np.log2(np.maximum(counts / base, 1))).astype(np.uint8)


def occurrences(n, percent: int):
    """Short lists that two sets must share when each gives n - T + occurrences(n) of them; for
    the smaller of both. The more, the fewer sets with a common passage are candidates."""
    return 1 + n // 6


def least_overlap(n, percent: int):
    """T, the least overlap of a set of size n with any partner, and the least size of a partner."""
    return -(-percent * n // 100)


def short_lists(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a sorted set, all but the T - occurrences most frequent."""
    n = len(s)
    order = np.argsort(levels[(s >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return s[order[: n - least_overlap(n, percent) + occurrences(n, percent)]]


def _sets_once(it, k: int):
    """Sets, with fingerprints; those that this task has had lately only once."""
    had: set[tuple[int, int]] = set()
    for rb in shared.batches(it, ["doc_id", "text"], STEP_BYTES):
        if len(had) > REMEMBERED:
            had.clear()
        for s in shingles(rb.column(1), k):
            key = (fingerprint(s), len(s))
            if len(s) and key not in had:
                had.add(key)
                yield s, key[0]


def _entries(levels, k: int, percent: int):
    def out(keys, fps):
        lens = [len(x) for x in keys]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(fps, np.int64), lens))], ["key", "fp"])

    def run(it):
        keys, fps, size = [], [], 0
        for s, fp in _sets_once(it, k):
            keys.append(short_lists(s, levels.value, percent))
            fps.append(fp)
            size += len(keys[-1])
            if size > 1 << 17:
                yield out(keys, fps)
                keys, fps, size = [], [], 0
        if keys:
            yield out(keys, fps)

    return run


def _sets(found, k: int):
    def out(rows):
        fp, s = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(s, pa.binary())], ["fp", "shingles"])

    def run(it):
        wanted, rows, size = bitmaps.opened(found), [], 0
        for s, fp in _sets_once(it, k):
            if wanted.has(np.array([fp], np.int64).view(np.uint64))[0]:
                rows.append((fp, s.tobytes()))
                size += len(s)
            if size > 1 << 18:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    return run


def needed(a, b, percent: int):
    """Overlap T that sets of sizes a and b need: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class InvertedLists:
    """Inverted lists over sets (sorted arrays), which stand in order of size: for each shingle the
    ascending places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.n, self.sizes = len(sets), np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")  # equal shingles keep the order of the sets
        self.names, first, length = np.unique(every[order], return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(self.names)), length)
        self.postings = np.repeat(np.arange(self.n), self.sizes)[order]
        self.entries = at * self.n + self.postings  # ascending, so a list can be cut or probed by binary search

    def search(self, query: np.ndarray, percent: int, after: int = -1, mu: float = 0.0085) -> np.ndarray:
        """Places after ``after`` of the sets whose overlap with the query reaches T. DivideSkip: the
        lists of the query's shingles, cut to partners of possible size, are divided in long and short
        ones; short lists are merged, and what they leave in reach of T is looked up in the long lists
        by binary search."""
        n = len(query)
        lo = max(after + 1, int(np.searchsorted(self.sizes, -(-percent * n // 100))))
        hi = int(np.searchsorted(self.sizes, 100 * n // percent, side="right"))
        none = np.zeros(0, np.int64)
        if lo >= hi:
            return none
        at = np.minimum(np.searchsorted(self.names, query), len(self.names) - 1)
        at = at[self.names[at] == query]
        start, end = np.searchsorted(self.entries, at * self.n + lo), np.searchsorted(self.entries, at * self.n + hi)
        length = end - start
        some = np.flatnonzero(length)
        least = int(needed(n, self.sizes[lo], percent))
        if len(some) < least:
            return none
        some = some[np.argsort(length[some], kind="stable")]
        n_long = min(least - 1, int(least / (mu * np.log(max(2, int(length[some[-1]]))) + 1)))
        short, long = some[: len(some) - n_long], some[len(some) - n_long :]
        found, count = merged([self.postings[start[i] : end[i]] for i in short])
        need = needed(n, self.sizes[found], percent)
        reach = count + n_long >= need
        found, count, need = found[reach], count[reach], need[reach]
        for i in range(0, len(long), PROBES):  # the longest last; who falls out of reach is not looked up again
            if not len(found):
                break
            keys = at[long[i : i + PROBES], None] * self.n + found
            spot = np.minimum(np.searchsorted(self.entries, keys), len(self.entries) - 1)
            count = count + (self.entries[spot] == keys).sum(0)
            reach = count + max(0, len(long) - i - PROBES) >= need
            found, count, need = found[reach], count[reach], need[reach]
        return found


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending members of ascending lists, and in how many lists each stands: by a heap, or where
    they hold much by a sort that merges the lists as runs."""
    total = sum(map(len, lists))
    if total <= HEAP_MOST:
        each = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64, total)
    else:
        each = np.sort(np.concatenate(lists), kind="stable")
    if not total:
        return each, each
    first = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
    return each[first], np.diff(np.append(first, total))


def linked_sets(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set of ``left`` (and then of ``right``), and the least place of its component:
    all pairs of ``left``, or all of a left and a right set."""
    sets = [*left, *(right or [])]
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    places = np.arange(len(sets)) if right is None else np.arange(len(left), len(sets))
    if not len(left) or not len(places):
        return links, root
    places = places[np.argsort([len(sets[i]) for i in places], kind="stable")]
    lists = InvertedLists([sets[i] for i in places])
    for turn, i in enumerate(places.tolist() if right is None else range(len(left))):
        found = places[lists.search(sets[i], percent, turn if right is None else -1)]
        links[i] += len(found)
        links[found] += 1
        for j in found.tolist():
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return links, np.array([top(i) for i in range(len(sets))], np.int64)


def _link(percent: int):
    def run(key, table):
        b1, b2 = (k.as_py() for k in key[1:])
        # in order of the fingerprint, so that a component's least place is its least node
        table = table.sort_by("fp")
        block, fp = table.column("block").to_numpy(), table.column("fp").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        if b1 == b2:
            order, split = np.arange(len(fp)), None
        else:
            order = np.argsort(block != b1, kind="stable")
            split = int((block == b1).sum())
        fp, sets = fp[order], [sets[i] for i in order]
        links, root = linked_sets(sets[:split], None if split is None else sets[split:], percent)
        some = links > 0
        return pa.table({"fp": fp[some], "links": links[some], "root": fp[root[some]], "blocks": table.column("blocks").to_numpy()[order][some]})

    return run


def candidate_groups(lists: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of the nodes (but the roots themselves) that hang together by candidate pairs.
    ``lists``: key, fp, n, the shared short lists. Candidates share s of them, so the shortest that
    they share is not among the s - 1 longest of either: without these, a list of more than ``PAIRED`` nodes
    holds its nodes together as it is, and no pairs of it are made. All pairs of the other lists
    are made, and count if their common lists and those of the longer kind can be s. So nodes that
    share a passage or a few shingles by chance don't join groups."""
    heads = shared.stored(lists.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "list-heads")
    node = Window.partitionBy("fp")
    least = occurrences_of(least_overlap_of(F.col("n"), percent), percent)
    held = lists.join(heads.hint("merge"), "key").select("key", "fp", "n", "c", F.count("*").over(node).alias("all"), F.count_if(F.col("c") > PAIRED).over(node).alias("long"), F.row_number().over(node.orderBy(F.desc("c"), "key")).alias("place"))
    held = shared.stored(held.where(F.col("all") >= least), "held-lists")
    few = held.where(F.col("c") <= PAIRED).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("fp", "n", "long"))).alias("l"))
    pairs = few.select("l", F.posexplode("l").alias("i", "a")).select("a", F.explode(F.slice("l", F.col("i") + 2, PAIRED)).alias("b"))
    pairs = pairs.where(F.lit(100) * F.least("a.n", "b.n") >= F.lit(percent) * F.greatest("a.n", "b.n"))
    pairs = pairs.groupBy(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).agg(F.count("*").alias("common"), F.min(F.least("a.n", "b.n")).alias("n"), F.min(F.least("a.long", "b.long")).alias("long"))
    pairs = pairs.where(F.col("common") + F.col("long") >= occurrences_of(F.col("n"), percent)).select("u", "v")
    many = held.where((F.col("c") > PAIRED) & (F.col("place") >= least)).select("key", "fp")
    low = shared.stored(many.groupBy("key").agg(F.min("fp").alias("low")), "low-nodes")  # so that Spark can split the join at a long list
    stars = many.join(low.hint("merge"), "key").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    out = components(pairs.union(stars))
    shared.discard(heads, held, low)
    return out


def least_overlap_of(n, percent: int):
    return F.floor((n * percent + 99) / 100)


def occurrences_of(n, percent: int):
    return 1 + F.floor(n / 6)


def link_roots(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures (doc_id, n, fp) of all rows; and fp, root and n_links of the nodes with links."""
    spark = docs.sparkSession
    shared.prepare(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text")
    raw = shared.stored(docs.mapInArrow(_signatures(k), "doc_id long, n long, fp long, chunk int, counts binary"), "signatures")
    levels = spark.sparkContext.broadcast(sketch_levels(raw.where("chunk IS NOT NULL").select("chunk", "counts")))  # 2**20 bytes
    signatures = raw.where("chunk IS NULL").select(F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "n", "fp")
    nodes = signatures.where("n > 0").select("fp", "n").distinct()
    entries = docs.mapInArrow(_entries(levels, k, percent), "key long, fp long").repartition(F.col("key"))
    held = entries.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("key")
    every = shared.stored(entries.join(held.hint("shuffle_hash"), "key").distinct(), "lists")
    shared.release(spark)
    # nodes with enough shared lists, whatever the partner
    enough = every.groupBy("fp").agg(F.count("*").alias("c")).join(nodes.hint("merge"), "fp")
    enough = enough.where(F.col("c") >= occurrences_of(least_overlap_of(F.col("n"), percent), percent)).select("fp", "n")
    enough = shared.stored(enough, "open-nodes")
    lists = shared.stored(every.join(enough.hint("merge"), "fp"), "lists")
    shared.discard(every)
    groups = candidate_groups(lists, percent)
    groups = groups.union(groups.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "fp")
    groups = shared.stored(groups.join(enough.hint("merge"), "fp"), "groups")
    # a large group is cut in blocks, with a task for two blocks each
    blocks = F.greatest(F.least(F.ceil(F.count("*") / BLOCK_SETS), F.lit(BLOCKS)), F.ceil(F.sum("n") / BLOCK_MOST))
    blocks = shared.stored(groups.groupBy("root").agg(blocks.alias("blocks")), "group-blocks")
    places = groups.join(blocks.hint("merge"), "root").select("fp", "root", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block"))
    places = shared.stored(places, "places")
    shared.discard(lists, groups, blocks, enough)
    shared.release(spark)
    found = bitmaps.filter_of(places.select("fp"))
    sets = docs.mapInArrow(_sets(found, k), "fp long, shingles binary").groupBy("fp").agg(F.max("shingles").alias("shingles"))
    rows = sets.join(places.hint("merge"), "fp").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "o").alias("b1"), F.greatest("block", "o").alias("b2"), "block", "blocks", "fp", "shingles")
    links = rows.groupBy("root", "b1", "b2").applyInArrow(_link(percent), "fp long, links long, root long, blocks long")
    links = shared.stored(links, "links")
    shared.release(spark)
    counts = links.groupBy("fp").agg(F.sum("links").alias("n_links"))
    # what hangs together was found in one task, or else by several
    parts = components(links.where("blocks > 1").select(F.col("fp").alias("u"), F.col("root").alias("v")))
    roots = links.where("blocks = 1").select("fp", "root").union(parts.select(F.col("node").alias("fp"), "root"))
    out = counts.join(roots.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n_links")
    out = shared.stored(out, "linked-nodes")
    shared.discard(links, places)
    return signatures, out


def _members(signatures: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n, fp, comp and n_links of the rows with a set that isn't empty; written."""
    node = signatures.where("n > 0").join(roots.hint("merge"), "fp", "left")
    return shared.stored(node.select("doc_id", "n", "fp", F.coalesce("root", "fp").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "members")


def linked_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and n_links (other sets
    linked to the document's)."""
    signatures, roots = link_roots(docs, k, percent)
    node = _members(signatures, roots)
    least = shared.stored(node.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = node.join(least.hint("merge"), "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = signatures.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns: of each component one row, of its least doc_id (null only
    if it has no other), and every row with an empty set."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        parts = shared.stored(linked_components(docs, k, percent), "groups")
        return bitmaps.without(docs, parts.where("doc_id <> component_id").select("doc_id"))
    # repeated or null doc_ids: decide by the row's set
    node = _members(*link_roots(docs, k, percent))
    least = node.groupBy("comp").agg(F.min("doc_id").alias("least"))
    stay = node.join(least.hint("merge"), "comp").where(F.col("doc_id").eqNullSafe(F.col("least"))).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("comp").alias("__comp")).distinct()
    stay = shared.stored(stay, "staying")
    own = docs.withColumn("__own", F.pandas_udf(lambda texts: texts.map(lambda t: fingerprint(shingles(pa.array([t], pa.string()), k)[0])).astype("int64"), "long")(F.coalesce("text", F.lit(""))))
    kept = own.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp"))).dropDuplicates(["__comp"])
    return kept.select(*docs.columns).union(own.where("__own = 0").select(*docs.columns))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(shared.documents(spark, sf_dir))
