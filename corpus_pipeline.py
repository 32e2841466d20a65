"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, packing.

Every stage but the last returns the columns that it got, of whatever names, and every row that it keeps, unchanged but for the
text of personal data. In all of them an empty table gives an empty table, rows without a doc_id are kept if their
text is, and a null text counts as an empty one (and stays null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import op01_simhash, op03_packing, op04_tiling, op07_pii, op08_quality
from voxloom.llm.shared import drop_written, quoted, written
from voxloom.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, fitted on labelled ones, does not reject.

    Null and empty texts have the mean's score, which is kept or not like any other; rows that repeat a doc_id are each
    scored; without labels of both kinds all rows stay.
    """
    model = op08_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op08_quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id: five-word shingles, 0.8 of them shared.

    Null and empty texts are one group; rows with one doc_id and unlike texts both stay, the same row twice stays once; rows
    without a doc_id all stay.
    """
    return op01_simhash.keep_first(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item is leaked.

    Null and empty texts are clean; rows that repeat a doc_id are each judged by their text; an empty benchmark leaves all rows.
    """
    return op04_tiling.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars, if there is such a column, follows the text.

    A null text stays null, and its n_chars becomes null; rows that repeat a doc_id are each searched.
    """
    found = op07_pii.redact(docs)
    return found.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. A null or empty text is its end token; rows that repeat a doc_id are packed each."""
    return op03_packing.pack_documents(docs, default_tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("packing", packing)]
#: Learned scores, SimHash groups, tiling and tokens cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages one after the other to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
