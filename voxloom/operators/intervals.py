"""Intervals in time: who speaks when, by overlap or nearness, always inside one recording.

Overlaps are found through buckets of time: an interval is put into every bucket that it touches, rows meet by
equality of recording and bucket, and a pair counts in the first bucket that both touch. So the
rows that meet grow with the overlaps, not with the square of a recording's rows. What is nearest to a moment
is found by one ordered pass over moments and intervals, in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket. Most segments and turns touch one or two.
BUCKET_S = 30.0


def overlap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0)))


def gap(at: Column, b0: str, b1: str) -> Column:
    """Distance of a moment from an interval; 0 inside."""
    return F.greatest(F.col(b0) - at, at - F.col(b1), F.lit(0.0))


def _bucketed(rows: DataFrame, start: str, end: str, bucket_s: float) -> DataFrame:
    number = lambda c: F.floor(F.col(c) / bucket_s)
    return rows.withColumn("_first", number(start)).withColumn("_bucket", F.explode(F.sequence("_first", F.greatest(number(end), F.col("_first")))))


def meeting(rows: DataFrame, turns: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Pairs of `rows` (recording_id, start_s, end_s, ...) and `turns` (recording_id, turn_start, turn_end, ...) that overlap."""
    a = _bucketed(rows, "start_s", "end_s", bucket_s).withColumnRenamed("_first", "_a")
    b = _bucketed(turns, "turn_start", "turn_end", bucket_s).withColumnRenamed("_first", "_b")
    pairs = a.join(b, ["recording_id", "_bucket"]).where(F.col("_bucket") == F.greatest("_a", "_b"))
    return pairs.where((F.col("turn_end") > F.col("start_s")) & (F.col("turn_start") < F.col("end_s"))).drop("_a", "_b", "_bucket")


def speaker_by_overlap(rows: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """`rows` (recording_id, start_s, end_s) with the speaker of the turn they overlap longest; the first turn of equals; null without overlap."""
    hits = meeting(rows.select("recording_id", *key, "start_s", "end_s"), turns).withColumn("_o", overlap("start_s", "end_s", "turn_start", "turn_end"))
    best = hits.groupBy("recording_id", *key).agg(F.max_by("turn_speaker", F.struct(F.col("_o"), -F.col("turn_seq"))).alias("assigned"))
    return rows.join(best, ["recording_id", *key], "left")


def nearest(points: DataFrame, key: list[str], marks: DataFrame, order: list[str]) -> DataFrame:
    """recording_id, key, value: of `marks` (recording_id, lo, hi, order, value) that nearest to each point (recording_id, key, at), of equals the first by `order`.

    The marks that end last before a point and start first after it are carried along as running maximum and
    minimum, in the order of time and in the reverse one. No mark may hold a point inside.
    """
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in key]
    down = [(-F.col(c)).alias(c) for c in order]
    before = marks.select("recording_id", *none, F.col("hi").alias("at"), F.lit(0).alias("_kind"), F.struct("hi", *down, "value").alias("_before"), F.lit(None).alias("_after"))
    after = marks.select("recording_id", *none, F.col("lo").alias("at"), F.lit(2).alias("_kind"), F.lit(None).alias("_before"), F.struct("lo", *order, "value").alias("_after"))
    asked = points.select("recording_id", *key, "at", F.lit(1).alias("_kind"), F.lit(None).alias("_before"), F.lit(None).alias("_after"))
    rows = before.unionByName(after).unionByName(asked)
    w = Window.partitionBy("recording_id")
    so_far = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.max("_before").over(w.orderBy("at", "_kind").rowsBetween(*so_far)))
    rows = rows.withColumn("_after", F.min("_after").over(w.orderBy(F.desc("at"), F.desc("_kind")).rowsBetween(*so_far))).where("_kind = 1")
    candidates = F.array(
        F.when(F.col("_before").isNotNull(), F.struct((F.col("at") - F.col("_before.hi")).alias("gap"), *[(-F.col(f"_before.{c}")).alias(c) for c in order], F.col("_before.value").alias("value"))),
        F.when(F.col("_after").isNotNull(), F.struct((F.col("_after.lo") - F.col("at")).alias("gap"), *[F.col(f"_after.{c}").alias(c) for c in order], F.col("_after.value").alias("value"))),
    )
    return rows.select("recording_id", *key, F.array_min(candidates)["value"].alias("value")).where("value is not null")


def speaker_by_overlap_or_nearest(rows: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """As :func:`speaker_by_overlap`; rows without overlap take the turn nearest to their middle, the first of equals."""
    found = speaker_by_overlap(rows, turns, key)
    late = found.where("assigned is null").select("recording_id", *key, ((F.col("start_s") + F.col("end_s")) / 2).alias("at"))
    marks = turns.select("recording_id", F.col("turn_start").alias("lo"), F.col("turn_end").alias("hi"), "turn_seq", F.col("turn_speaker").alias("value"))
    near = nearest(late, key, marks, ["turn_seq"]).withColumnRenamed("value", "_near")
    return found.join(near, ["recording_id", *key], "left").withColumn("assigned", F.coalesce("assigned", "_near")).drop("_near")


def consolidate(rows: DataFrame, floor_s: float = 6.0, share: float = 0.08) -> DataFrame:
    """Column `consolidated`: speakers with little talk take the nearest real speaker.

    Only where a recording has more than two speakers. Real: talk of at least the larger of
    `floor_s` and `share` of the most talkative one's. If none or all are real nothing changes.
    """
    talk = rows.where("speaker is not null").groupBy("recording_id", "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_t"))
    w = Window.partitionBy("recording_id")
    talk = talk.withColumn("_real", F.col("_t") >= F.greatest(F.lit(floor_s), share * F.max("_t").over(w))).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.count_if("_real").over(w))
    minor = talk.where("_n > 2 and _k > 0 and _k < _n")
    middle = (F.col("start_s") + F.col("end_s")) / 2
    kind = rows.join(minor.select("recording_id", "speaker", "_real"), ["recording_id", "speaker"])
    marks = kind.where("_real").select("recording_id", middle.alias("lo"), middle.alias("hi"), "start_s", "seq", F.col("speaker").alias("value"))
    near = nearest(kind.where("not _real").select("recording_id", F.col("seq").alias("_k"), middle.alias("at")), ["_k"], marks, ["start_s", "seq"])
    near = near.select("recording_id", F.col("_k").alias("seq"), F.col("value").alias("_s"))
    return rows.join(near, ["recording_id", "seq"], "left").withColumn("consolidated", F.coalesce("_s", "speaker")).drop("_s")


def near_boundary(rows: DataFrame, boundaries: DataFrame, within_s: float = 2.0) -> DataFrame:
    """Rows that start within `within_s` of a boundary (recording_id, boundary_s)."""
    at = F.floor(F.col("start_s") / within_s)
    b = boundaries.select(F.col("recording_id").alias("_r"), "boundary_s", F.explode(F.sequence(F.floor(F.col("boundary_s") / within_s) - 1, F.floor(F.col("boundary_s") / within_s) + 1)).alias("_b"))
    close = F.abs(F.col("start_s") - F.col("boundary_s")) <= within_s
    return rows.withColumn("_a", at).join(b, (F.col("recording_id") == F.col("_r")) & (F.col("_a") == F.col("_b")) & close, "left_semi").drop("_a")


def hints(chunks: DataFrame, turns: DataFrame, cap: int = 12) -> DataFrame:
    """Turns that overlap a chunk, in the chunk's time and joined where the speaker goes on; the first `cap`."""
    hit = meeting(chunks.withColumn("start_s", F.col("chunk_start")).withColumn("end_s", F.col("chunk_end")), turns)
    rows = hit.select("recording_id", "chunk", "turn_seq", F.col("turn_speaker").alias("speaker"), (F.greatest("turn_start", "chunk_start") - F.col("chunk_start")).alias("from_s"), (F.least("turn_end", "chunk_end") - F.col("chunk_start")).alias("to_s"))
    w = Window.partitionBy("recording_id", "chunk").orderBy("from_s", "turn_seq")
    rows = rows.withColumn("_new", (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | F.lag("turn_seq").over(w).isNull()).cast("int")).withColumn("_run", F.sum("_new").over(w))
    joined = rows.groupBy("recording_id", "chunk", "_run").agg(F.min("speaker").alias("speaker"), F.min("from_s").alias("from_s"), F.max("to_s").alias("to_s"))
    nr = F.row_number().over(Window.partitionBy("recording_id", "chunk").orderBy("_run"))
    return joined.withColumn("nr", nr).where(F.col("nr") <= cap).drop("_run")


def global_ids(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """Column global_id for (recording_id, window, local_id): from `mapped`, else a number after all mapped ones in order of appearance."""
    key = ["recording_id", "window", "local_id"]
    top = mapped.groupBy("recording_id").agg(F.max("global_id").alias("_top"))
    first = rows.groupBy(*key).agg(F.min("start_s").alias("_first"))
    late = first.join(mapped.select(*key), key, "left_anti").join(top, "recording_id", "left")
    w = Window.partitionBy("recording_id").orderBy("_first", "window", "local_id")
    late = late.select(*key, (F.coalesce("_top", F.lit(-1)) + F.row_number().over(w)).cast("int").alias("_late"))
    return rows.join(mapped, key, "left").join(late, key, "left").withColumn("global_id", F.coalesce("global_id", "_late", F.lit(0))).drop("_late")


def engine_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Texts of two engines by chunk: recording_id, chunk, text_a, text_b, only (the text if just one engine has any)."""
    rows = a.select("recording_id", "chunk", F.col("text").alias("text_a")).join(b.select("recording_id", "chunk", F.col("text").alias("text_b")), ["recording_id", "chunk"], "full")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return rows.withColumn("only", F.when(blank("text_a"), F.col("text_b")).when(blank("text_b"), F.col("text_a")))


def longest_per_speaker(rows: DataFrame, key: list[str]) -> DataFrame:
    """The longest row of each key, the first of equals."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.col("end_s") - F.col("start_s")), "start_s", "seq")
    return rows.withColumn("_nr", F.row_number().over(w)).where("_nr = 1").drop("_nr")
