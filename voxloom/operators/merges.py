"""Maps of merged ids, worked out for all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.sources.files import drop_folder, work_folder


def merged(ids: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key, id, to: for each of `ids` (key, id) the least id of those that `pairs` (key, a, b) join with it, by way of others, too.

    Pairs with unknown ids change nothing. Each round takes the least label among neighbours, hands it to the id that stands for the group, and takes
    that label's own label, so groups at least double; a round is a table, and the last is the one that changes nothing.
    """
    spark = ids.sparkSession
    known = ids.select(key, "id").distinct()
    ends = pairs.select(key, "a", "b").where("a <> b").unionByName(pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    for end in ("a", "b"):
        ends = ends.join(known.withColumnRenamed("id", end), [key, end], "left_semi")
    folders = [work_folder(spark, "merges") for _ in range(2)]
    ends.distinct().write.parquet(folders[0])
    edges = spark.read.parquet(folders[0])
    known.withColumn("to", F.col("id")).withColumn("moved", F.lit(True)).write.parquet(folders[1])
    labels = spark.read.parquet(folders[1])
    while labels.where("moved").head(1):
        near = edges.join(labels.select(key, F.col("id").alias("b"), "to"), [key, "b"]).groupBy(key, F.col("a").alias("id")).agg(F.min("to").alias("near"))
        rows = labels.select(key, "id", F.col("to").alias("was")).join(near, [key, "id"], "left")
        group = rows.groupBy(key, F.col("was").alias("id")).agg(F.min("near").alias("group"))
        now = rows.join(group, [key, "id"], "left").select(key, "id", "was", F.least("was", F.coalesce("near", "was"), F.coalesce("group", "was")).alias("to"))
        jump = now.select(key, F.col("id").alias("to"), F.col("to").alias("far"))
        folders.append(work_folder(spark, "merges"))
        now.join(jump, [key, "to"]).select(key, "id", F.col("far").alias("to"), (F.col("far") < F.col("was")).alias("moved")).write.parquet(folders[-1])
        labels = spark.read.parquet(folders[-1])
        drop_folder(spark, folders.pop(1))
    drop_folder(spark, folders[0])
    return labels.select(key, "id", "to")
