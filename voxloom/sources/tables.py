"""Parquet tables, and the transcript tables derived from them.

recordings are documents, segments are the turns of conversations laid end to end at
`CHARS_PER_SECOND`, tags are unpivoted labels. Each derivation has a twin in DuckDB SQL, used
by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHARS_PER_SECOND = 15

#: Twins of the functions below, to be put after WITH.
RECORDINGS_SQL = "rec AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, text, lang AS language, source AS folder FROM documents)"
SEGMENTS_SQL = """seg0 AS (SELECT conv_id AS recording_id, turn AS seq, role, text, length(text) AS len,
    sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cum FROM conversations),
seg AS (SELECT recording_id, seq, role, text, CAST(cum - len AS DOUBLE) / 15 AS start_s, CAST(cum AS DOUBLE) / 15 AS end_s,
    CAST((seq // 2) % 2 AS INTEGER) AS speaker FROM seg0)"""
TURNS_SQL = """turns AS (SELECT recording_id, seq AS turn_seq, start_s + 1.5 AS turn_start, end_s + 0.5 AS turn_end, CAST(seq % 3 AS INTEGER) AS turn_speaker
    FROM seg WHERE seq % 4 <> 3)"""
TAGS_SQL = "tags AS (SELECT doc_id AS recording_id, 'good' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: UTF-8 bytes of texts in a part whose words become rows.
PART_BYTES = 8_000_000


def spread(rows: DataFrame, text: str | None = None) -> DataFrame:
    """`rows` dealt to all cores if they come in fewer parts (a small file is one), before costly work on each row; more parts stay where they are.

    With the name of a column `text` all are dealt, to as many parts as hold about `PART_BYTES` of it each, for work that makes many rows of each text.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if text:
        return rows.repartition(text_parts(rows, text))
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def text_parts(rows: DataFrame, text: str, size: int = PART_BYTES) -> int:
    """Parts of about `size` bytes of a column of texts, one for each core at least."""
    n = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // size))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, text, language, folder."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), "text", F.col("lang").alias("language"), F.col("source").alias("folder"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seq, role, text, start_s, end_s, speaker."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").withColumn("cum", F.sum(F.length("text")).over(order))
    return rows.select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("seq"), "role", "text",
        ((F.col("cum") - F.length("text")).cast("double") / CHARS_PER_SECOND).alias("start_s"), (F.col("cum").cast("double") / CHARS_PER_SECOND).alias("end_s"),
        F.expr("cast((turn div 2) % 2 as int)").alias("speaker"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, turn_seq, turn_start, turn_end, turn_speaker: shifted segments, a quarter left out."""
    return segments(spark, sf_dir).where("seq % 4 <> 3").select("recording_id", F.col("seq").alias("turn_seq"), (F.col("start_s") + 1.5).alias("turn_start"), (F.col("end_s") + 0.5).alias("turn_end"), F.expr("cast(seq % 3 as int)").alias("turn_speaker"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, tag: one row for each label that holds."""
    labels = table(spark, sf_dir, "labels")
    return labels.where("quality = 1").select(F.col("doc_id").alias("recording_id"), F.lit("good").alias("tag")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("recording_id"), F.lit("toxic").alias("tag")))
