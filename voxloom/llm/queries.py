"""The registered queries of this subpackage and their SQL, where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import op01_simhash, op02_token_planes, op03_packing, op04_tiling, op05_repeats, op06_warc, op07_pii, op08_quality, op09_bit_sliced, op10_bilinear, op11_filter_audit, op12_ball_tree, op13_jaccard
from voxloom.llm.shared import work_folder
from voxloom.llm.tokens import default_tokenizer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "op2")
    totals = op02_token_planes.write_token_files(table(spark, sf_dir, "documents"), default_tokenizer(), folder)
    return op02_token_planes.read_token_files(spark, folder, totals)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_repeats.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of the repeats that op5 removes from later documents, as groups."""
    return op05_repeats.maximal_repeats(table(spark, sf_dir, "documents"), bodies=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_warc.store_and_read(table(spark, sf_dir, "pages"), work_folder(spark, "op6"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_pii.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op08_quality.score(docs, op08_quality.train(docs, table(spark, sf_dir, "labels")))


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_bit_sliced.top_k(table(spark, sf_dir, "embeddings"))


def op10_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bilinear.score_documents(table(spark, sf_dir, "documents"))


def op11_filter_audit_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ball_tree_(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op12_ball_tree.hard_negatives(vectors.withColumn("label", moved))


def op13_jaccard_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_planes": op2_token_planes,
    "op3_packing": op3_packing,
    "op4_tiling": op4_tiling,
    "op5_repeats": op5_repeats,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_bit_sliced": op9_bit_sliced,
    "op10_bilinear_lm": op10_bilinear_lm,
    "op11_filter_audit": op11_filter_audit_,
    "op12_ball_tree": op12_ball_tree_,
    "op13_jaccard": op13_jaccard_,
    "maximal_repeats": maximal_repeats,
}
ORACLES: dict[str, str] = {
    "op11_filter_audit": op11_filter_audit.SQL,
    "op12_ball_tree": op12_ball_tree.SQL,
    "op13_jaccard": op13_jaccard.SQL,
    "op9_bit_sliced": """
        WITH v AS (
            SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF NOT coalesce(isfinite(x), false)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
