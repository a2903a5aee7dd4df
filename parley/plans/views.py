"""Input views of the registered queries, as DataFrames and as DuckDB SQL of the same rows.

Times are whole milliseconds or seconds, so sums are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation turn."""
    start = F.col("turn") * 5000
    size = F.coalesce(F.length("text"), F.lit(0))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("rec"), F.col("turn").alias("seg_idx"), F.format_string("seg_%04d", F.col("turn") + 1).alias("id"), start.alias("start_ms"),
        (start + 1000 + (size + 7 * F.col("turn")) % 17 * 250).alias("end_ms"), F.col("role").alias("speaker"), "text",
    )


SEGMENTS = """seg AS (SELECT conv_id AS rec, turn AS seg_idx, printf('seg_%04d', turn + 1) AS id, turn * 5000 AS start_ms,
 turn * 5000 + 1000 + (coalesce(length(text), 0) + 7 * turn) % 17 * 250 AS end_ms, role AS speaker, text FROM conversations)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an analysis window with its embedding, of 50 windows a recording and four voices."""
    truth = F.col("label") % 4
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == truth, 2.0).otherwise(0.0))
    idx = F.col("vec_id") % 50
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("rec"), idx.alias("idx"), F.format_string("w%06d", "vec_id").alias("key"), (idx * 750).alias("start_ms"), (idx * 750 + 1500).alias("end_ms"), truth.alias("truth"), vector.alias("v"), "vec_id",
    )


POINTS = """pts AS (SELECT vec_id // 50 AS rec, vec_id % 50 AS idx, printf('w%06d', vec_id) AS key, (vec_id % 50) * 750 AS start_ms,
 (vec_id % 50) * 750 + 1500 AS end_ms, label % 4 AS truth, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i - 1 = label % 4 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) AS v, vec_id FROM embeddings)"""
#: Length and unit vector in DuckDB.
NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))))"
TEXT = "array_to_string(list_transform({v}, lambda x: printf('%.4f', round(x, 4) + 0.0)), ' ')"


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A reference and a hypothesis of who is active when, in seconds."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    ref = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("rec"), start.alias("start"), (start + 3600 * (1 + F.col("event_id") % 6)).alias("end"), F.col("event_type").alias("speaker"))
    shift = (F.col("event_id") % 3 - 1) * 600
    name = F.concat(F.lit("cluster_"), F.length("speaker").cast("string"), F.substring("speaker", 1, 1))
    hyp = ref.filter("event_id % 7 <> 0").select("event_id", "rec", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), name.alias("speaker"))
    return ref, hyp


TURNS = """ref AS (SELECT event_id, user_id AS rec, cast(floor(epoch(ts)) AS BIGINT) AS start, cast(floor(epoch(ts)) AS BIGINT) + 3600 * (1 + event_id % 6) AS "end", event_type AS speaker FROM events),
hyp AS (SELECT event_id, rec, start + (event_id % 3 - 1) * 600 AS start, "end" + (event_id % 3 - 1) * 600 AS "end", 'cluster_' || length(speaker) || substr(speaker, 1, 1) AS speaker FROM ref WHERE event_id % 7 <> 0)"""
