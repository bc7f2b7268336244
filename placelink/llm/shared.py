"""Helpers shared by the document operators.

Scratch tables go to the shared folder named in ``spark.checkpoint.dir`` (or, where that is
unset and the master is local, as in tests, to a folder of this process); elsewhere its absence is
an error. ``discard`` deletes what a later table has taken up.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: a batch of long documents must fit a Python worker.
ARROW_ROWS = 512
TASK_ROWS = 100_000
_own_dir: list[str] = []

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for scratch tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="placelink-"))
        found = f"file://{_own_dir[0]}"
    return found.rstrip("/")


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here, and
    lost executors cost no recomputation. ``rows``, if known, sets the number of tasks and files:
    one for each ``TASK_ROWS`` narrow rows, up to the number of shuffle partitions."""
    if rows is not None:
        df = df.coalesce(max(1, min(partitions(df.sparkSession), -(-rows // TASK_ROWS))))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of ``stored`` that nothing will read again, whatever store they are in."""
    for t in tables:
        jvm, jsc = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now rather than at the driver's next
    garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def batches(it, _cols, max_bytes: int = 4 << 20, at: int = 1):
    """Slices of the Arrow batches with at most ``max_bytes`` of text in column ``at``, or one row."""
    for rb in it:
        text = rb.column(at)
        lens = pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lens):
            if i > start and size + n > max_bytes:
                yield rb.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < len(lens):
            yield rb.slice(start)
