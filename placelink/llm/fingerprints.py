"""I-Match document fingerprints in DataFrame functions only (operator 10).

Terms are the distinct lower-cased words, as one of 2**20 hash codes. The lexicon holds the codes
whose document frequency, counted over all documents, lies in a band; it is a bitmap of fixed
size (128 KB) that the plan carries as a literal, so neither terms nor lexicon are ever joined or
shuffled with the documents. A document keeps its terms in the band (all terms, if fewer than
``MIN_TERMS`` are), sorted, and hashes their part in each of ``SEEDS`` x ``LEVELS`` randomised
subsets of the lexicon: for each seed a nested row of subsets that hold 1/2, 1/4, 1/8, ... of it, down to rates at which a text
with all codes has one term or none. A fingerprint ends at the last subset that isn't empty.

``signatures`` are the keys to join on: the 64-bit hashes of the terms in each seed's first subset, a half of the
lexicon, as I-Match has them. Documents with one in common are equal in all terms of that half.
The 15-bit hashes of all subsets in a fingerprint serve the estimate of likeness only.

The likeness of two fingerprints compares the subsets whose rate suits the number of terms, at any
number, so that one or two terms fall in the largest of them: subsets with equal hashes over subsets that are not empty in both.

Defined cases: null text is empty; texts without terms have a fingerprint of their own kind and
likeness 1 to each other; every row is returned and counts in the lexicon, also where a doc_id
repeats or is null: the next document of each of these rows is the next smaller doc_id's, of
whose rows the one with the largest text stands for it; null doc_ids count as one and sort below
all others; a single document is its own next; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

CODE_BITS, SEEDS, MIN_TERMS = 20, 12, 6
#: Rates compared for a number of terms; levels, so that a text with all codes has them too.
COMPARED = 4
LEVELS = CODE_BITS + COMPARED - 1
#: Band of the document frequency as a share of all documents; two documents at least.
BAND = (0.0003, 0.02)
_NONE = -(2**63)


def term_codes(text: Column) -> Column:
    """Codes of the words, with repeats."""
    words = F.split(F.lower(text), r"[\s\p{Punct}]+")
    return F.transform(words, lambda w: F.when(w != "", F.xxhash64(w).bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("int")))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """Bitmap, as longs, of the codes in the band."""
    n = docs.count()
    low, high = max(2, band[0] * n), max(2, band[1] * n)
    codes = docs.select(F.explode(F.array_distinct(term_codes(F.coalesce("text", F.lit(""))))).alias("code"))
    counts = codes.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    longs = counts.groupBy(F.expr("code div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, code % 64)")).alias("bits"))
    out = [0] * (1 << (CODE_BITS - 6))
    for r in longs.collect():
        out[r["at"]] = r.bits
    return out


def part_hash(terms: str) -> Column:
    return F.hash(terms).bitwiseAND(F.lit(0x7FFF)).cast("smallint")


def with_fingerprints(df: DataFrame, texts: dict[str, str], bitmap: list[int], signatures: str = "") -> DataFrame:
    """``df`` with, for each column name in ``texts``, the 15-bit hashes of the subsets (level
    by level, null for an empty subset) and their number of terms under ``<name>_terms``; for the
    name ``signatures`` its join keys too. Each step is a projection of its own, so nothing is computed twice."""
    bits = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")
    in_band = lambda c: F.getbit(F.get(bits, F.shiftright(c, 6)), c.bitwiseAND(F.lit(63))) == 1
    seeded = lambda j: lambda c: F.xxhash64(c, F.lit(j))
    clear = lambda k: lambda h: h.bitwiseAND(F.lit(1 << k)) == 0
    extra = list(df.columns)
    df = df.withColumns({f"__{n}": term_codes(F.col(t)) for n, t in texts.items()})
    df = df.withColumns({f"__{n}": F.array_distinct(F.filter(f"__{n}", lambda c: c.isNotNull())) for n in texts})
    df = df.withColumns({f"__{n}_band": F.filter(f"__{n}", in_band) for n in texts})
    df = df.withColumns({f"__{n}": F.array_sort(F.when(F.size(f"__{n}_band") < MIN_TERMS, F.col(f"__{n}")).otherwise(F.col(f"__{n}_band"))) for n in texts})
    level = {(n, j): F.transform(f"__{n}", seeded(j)) for n in texts for j in range(SEEDS)}
    df = df.select(*extra, *[F.size(f"__{n}").alias(f"{n}_terms") for n in texts], *[e.alias(f"__{n}_{j}_0") for (n, j), e in level.items()])
    hashes = {n: [] for n in texts}
    for k in range(1, LEVELS + 1):
        keep = [c for c in df.columns if not c.endswith(f"_{k - 1}") or not c.startswith("__")]
        subsets = [F.filter(f"__{n}_{j}_{k - 1}", clear(k)).alias(f"__{n}_{j}_{k}") for n in texts for j in range(SEEDS)]
        done = [F.when(F.size(f"__{n}_{j}_{k - 1}") > 0, part_hash(f"__{n}_{j}_{k - 1}")).alias(f"__h_{n}_{j}at{k - 1}") for n in texts for j in range(SEEDS)] if k > 1 else []
        keys = [F.when(F.size(f"__{signatures}_{j}_1") > 0, F.xxhash64(f"__{signatures}_{j}_1")).alias(f"__sig_{j}at") for j in range(SEEDS)] if k == 2 and signatures else []
        df = df.select(*keep, *subsets, *done, *keys)
        for n in texts:
            hashes[n] += [f"__h_{n}_{j}at{k - 1}" for j in range(SEEDS)] if k > 1 else []
    if signatures:
        df = df.withColumn("signatures", F.array(*[f"__sig_{j}at" for j in range(SEEDS)]))
        extra = [*extra, "signatures"]
    last = {f"__h_{n}_{j}at{LEVELS}": F.when(F.size(f"__{n}_{j}_{LEVELS}") > 0, part_hash(f"__{n}_{j}_{LEVELS}")) for n in texts for j in range(SEEDS)}
    for n in texts:
        hashes[n] += [f"__h_{n}_{j}at{LEVELS}" for j in range(SEEDS)]
    df = df.withColumns(last)
    df = df.select(*extra, *[f"{n}_terms" for n in texts], *[F.array(*hashes[n]).alias(n) for n in texts])
    return df.select(*extra, *[f"{n}_terms" for n in texts], *[F.slice(n, F.lit(1), F.coalesce(F.array_max(F.transform(n, lambda h, i: F.when(h.isNotNull(), i + 1))), F.lit(0))).alias(n) for n in texts])


def likeness(a: str, b: str) -> Column:
    """0 to 1 for the fingerprints in columns a and b, with ``<name>_terms`` beside them."""
    terms = (F.col(f"{a}_terms") + F.col(f"{b}_terms")) / 2
    level = F.greatest(F.lit(1), F.floor(F.log2(F.greatest(terms, F.lit(1))))).cast("int")
    part = lambda c: F.slice(c, (level - 1) * SEEDS + 1, F.lit(COMPARED * SEEDS))
    both = F.zip_with(part(a), part(b), lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce(x == y, F.lit(False)).cast("int")))
    said = F.filter(both, lambda x: x.isNotNull())
    equal = F.aggregate(said, F.lit(0), lambda s, x: s + x)
    same = F.col(a).eqNullSafe(F.col(b)) & (F.col(f"{a}_terms") == F.col(f"{b}_terms"))
    return F.when(same, 1.0).when(F.size(said) == 0, 0.0).otherwise(equal / F.size(said))


def fingerprint_string(name: str) -> Column:
    parts = F.transform(F.col(name), lambda h: F.coalesce(F.lpad(F.lower(F.hex(h.cast("bigint"))), 4, "0"), F.lit("-")))
    return F.concat(F.col(f"{name}_terms").cast("string"), F.lit(":"), F.array_join(parts, ""))


def ordered_neighbours(ids: DataFrame) -> DataFrame:
    """For each key (distinct): next_key by descending key, the first after the last, and wanted,
    the n of the document before it. ids: key, n. Sorted by ranges; only one row a range meets
    in one task."""
    spark = ids.sparkSession
    parts = shared.partitions(spark)
    spot = F.monotonically_increasing_id()
    runs = ids.repartitionByRange(parts, F.col("key").desc()).sortWithinPartitions(F.col("key").desc())
    runs = shared.stored(runs.select("key", "n", F.shiftright(spot, 33).cast("int").alias("run"), spot.alias("spot")), "id-order")
    ends = runs.groupBy("run").agg(F.max(F.struct("key", "n")).alias("top"), F.min(F.struct("key", "n")).alias("low"))
    over = Window.orderBy("run")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("run", F.coalesce(F.lead("top.key").over(over), F.first("top.key").over(whole)).alias("after"), F.coalesce(F.lag("low.n").over(over), F.last("low.n").over(whole)).alias("before"))
    within = Window.partitionBy("run").orderBy("spot")
    out = runs.join(ends, "run").select("key", F.coalesce(F.lead("key").over(within), F.col("after")).alias("next_key"), F.coalesce(F.lag("n").over(within), F.col("before")).alias("wanted"))
    return shared.stored(out, "neighbours")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Per row: doc_id, text hashes and terms, the same for the edited text (its last third
    replaced by the start of the next document), and the likenesses."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    one = docs.select("key", "text", F.length("text").alias("n"))  # what stands for each key
    rows = docs.withColumn("top", F.lit(True))
    repeated = not docs.groupBy("key").count().where("count > 1").isEmpty()
    if repeated:
        one = shared.stored(docs.groupBy("key").agg(F.max("text").alias("text"), F.max(F.length("text")).alias("n")), "one-text")
        tops = one.select("key", F.xxhash64("text").alias("top_hash"))
        rows = docs.join(tops.hint("merge"), "key").select("key", "text", (F.xxhash64("text") == F.col("top_hash")).alias("top"))
    bitmap = lexicon(docs, band)
    near = ordered_neighbours(one.select("key", "n"))
    starts = one.select("key", "text").join(near.hint("merge"), "key").select(F.col("next_key"), F.col("key"), F.col("wanted"), F.col("text"))
    back = near.select(F.col("next_key").alias("key"), F.col("key").alias("before_key"))
    starts = starts.join(back.hint("merge"), "key").select(F.col("before_key").alias("key"), F.col("key").alias("next_key"), F.expr("left(text, int(wanted div 3))").alias("start"))
    both = rows.join(starts.hint("merge"), "key").select("key", "next_key", "top", "text", F.length("text").alias("n_chars"), F.expr("concat(left(text, length(text) - int(length(text) div 3)), left(start, int(length(text) div 3)))").alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    out = with_fingerprints(both, {"own": "text", "changed": "edited"}, bitmap, "own").drop("text", "edited")
    out = shared.stored(out, "fingerprints")
    other = out.where("top").dropDuplicates(["key"]) if repeated else out
    other = other.select(F.col("key").alias("next_key"), F.col("own").alias("following"), F.col("own_terms").alias("following_terms"))
    out = out.join(other.hint("merge"), "next_key")
    return out.select(
        F.when(F.col("key") != _NONE, F.col("key")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint_string("own").alias("fingerprint"),
        fingerprint_string("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
        "signatures",
    )


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(shared.documents(spark, sf_dir))
