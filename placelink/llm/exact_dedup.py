"""Exact dedup with a persistent digest index (operator 4).

The index is a table in the warehouse, bucketed and sorted by SHA-256 digest. New data is
reduced to one row per digest and anti-joined with the index by sort-merge (the index side is
read in place, without a shuffle); what is new is appended, and for known digests their further
count. Texts never shuffle; a digest that a third of all rows share is pre-aggregated before
its shuffle, and the join that gives every row its group can be split by Spark at the hot digest.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing
A-Z; of equal texts the row with the largest doc_id stays, a null doc_id being smallest, and
of rows with the same doc_id and text exactly one; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, shared


def text_digest(text="text"):
    return F.unhex(F.sha2(shared.ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """Append-only index of text digests. Its table has a row with ``keep_id`` and ``first`` true for
    each digest, and one for each later batch that had the digest again; ``n`` counts rows."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or shared.partitions(spark)
        if not spark.catalog.tableExists(table):
            self.append(spark.createDataFrame([], "digest binary, keep_id long, n long, first boolean"))

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """digest, keep_id, group_size: one row for each digest, without a shuffle."""
        return self.entries().groupBy("digest").agg(F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"), F.sum("n").alias("group_size"))

    def append(self, entries: DataFrame) -> None:
        out = entries.select("digest", "keep_id", "n", "first").repartition(self.buckets, "digest").write.format("parquet")
        out.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicate ``docs`` (doc_id, text) within itself and against the index, append what
        is new, and return one row per row of ``docs``: doc_id, kept, digest; written. A text already
        indexed keeps the index's row. ``groups`` gives such rows their keep_id and group_size."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), F.monotonically_increasing_id().alias("row"))
        rows = shared.stored(rows, "digests")
        batch = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("n"))
        batch = shared.stored(batch, "digest-groups")
        known = self.entries().where("first").select("digest")
        new = shared.stored(batch.hint("merge").join(known, "digest", "left_anti"), "new-digests")
        again = batch.hint("merge").join(known, "digest", "left_semi")
        entries = new.select("digest", F.col("last.doc_id").alias("keep_id"), "n", F.lit(True).alias("first"))
        again = shared.stored(again.select("digest", F.lit(None).cast("long").alias("keep_id"), "n", F.lit(False).alias("first")), "known-digests")
        self.append(entries.union(again))
        kept = new.select("digest", F.col("last.row").alias("row"), F.lit(True).alias("kept"))
        out = rows.join(kept.hint("merge"), ["digest", "row"], "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"), "digest")
        out = shared.stored(out, "rows")
        shared.discard(rows, batch, new, again)
        return out

    def groups(self, rows: DataFrame) -> DataFrame:
        """``rows`` of ``add`` with keep_id and group_size as the index has them now."""
        return rows.join(self.read().hint("merge"), "digest").select("doc_id", "keep_id", "group_size", "kept", "digest")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of each row of ``docs``, deduplicated in two batches,
    the larger doc_ids first, through an index of its own; written."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5, 100)).first()[0]
    late = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    parts = [index.add(docs.where(late)), index.add(docs.where(~late))]
    out = shared.stored(index.groups(parts[0].union(parts[1])), "copies")
    shared.discard(*parts)
    index.drop()
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Decided by ids; where a doc_id and its
    text stand in several rows, one of them stays."""
    groups = exact_groups(docs)
    kept = groups.where("kept")
    again = groups.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if again.isEmpty():
        return bitmaps.without(docs, groups.where(~F.col("kept")).select("doc_id"))
    # repeated or null doc_ids: decide by digest, one row each
    own = docs.withColumn("__digest", text_digest())
    keys = kept.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d")).distinct()
    own = own.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__d")), "left_semi")
    return own.dropDuplicates(["doc_id", "__digest"]).select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(shared.documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
