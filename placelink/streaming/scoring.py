"""The scorer on streams: stateless, so the batch operators run as they are, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placelink.lexicons import DEFAULT, Config
from placelink.operators.pairs import score_candidates, with_tier


def read_queries(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(queries: DataFrame, candidates: str = "candidates", config: Config = DEFAULT) -> DataFrame:
    """Scored candidates of each incoming row."""
    return with_tier(score_candidates(queries, "query", candidates, config), "final_score", config).withColumn("scored_at", F.current_timestamp())


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
