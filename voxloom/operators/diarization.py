"""Speakers of long recordings from windows that were diarized one by one, and choices between engines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as ft
from voxloom.functions import words as fw
from voxloom.operators import intervals, sequences

RECAP_S, SAME_VOICE = 45.0, 0.7
#: Agreement at which two readings count as one, and below which a third opinion is asked.
AGREED, DISPUTED = 0.999, 0.85


def drop_recap(rows: DataFrame, recap_s: float = RECAP_S) -> DataFrame:
    """Rows that end after the part of their window that the window before has too; the first window has none."""
    return rows if recap_s <= 0 else rows.where((F.col("window") == 0) | (F.col("end_s") - F.col("window_start") > recap_s))


def threshold(languages: Column) -> Column:
    """How alike two voices must be: lower where only English is spoken."""
    return F.when(F.transform(languages, F.lower) == F.array(F.lit("en")), 0.5).otherwise(0.7)


def cluster_windows(rows: DataFrame, speakers: int = 0, same_voice: float = SAME_VOICE) -> DataFrame:
    """recording_id, window, local_id, global_id of rows with an embedding, one row for each window's speaker."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window", "local_id"])
        return pdf[["recording_id", "window", "local_id"]].assign(global_id=fw.cluster(np.stack(pdf.embedding), speakers, 1 - same_voice))

    return rows.where("embedding is not null").select("recording_id", "window", "local_id", "embedding").groupBy("recording_id").applyInPandas(label, "recording_id long, window int, local_id int, global_id int")


def whole_recording(rows: DataFrame, embeddings: DataFrame, speakers: int = 0) -> DataFrame:
    """One numbering of speakers for all windows of a recording.

    `rows`: recording_id, seq, window, window_start, local_id, start_s, end_s. The longest row of each
    window's speaker stands for the voice; `embeddings` (recording_id, seq, embedding) has its vector.
    Voices are clustered, those without a vector get numbers of their own, seldom speakers are merged and the rest
    are numbered by first appearance.
    """
    kept = drop_recap(rows)
    voices = intervals.longest_per_speaker(kept, ["recording_id", "window", "local_id"]).join(embeddings, ["recording_id", "seq"])
    named = intervals.global_ids(kept, cluster_windows(voices, speakers)).withColumn("speaker", F.col("global_id"))
    merged = intervals.consolidate(named).drop("speaker")
    return sequences.renumber(merged, "consolidated").select("recording_id", "seq", "start_s", "end_s", F.col("renumbered").alias("speaker"))


def chunk_samples(frames: DataFrame, cuts: DataFrame, overlap_s: float = 0.0, bucket_s: float = 30.0) -> DataFrame:
    """Frames (recording_id, at_s, ...) by chunk (recording_id, nr, from_s, to_s); a chunk after a hard cut begins `overlap_s` early.

    A frame meets the chunks of its bucket of time only.
    """
    bucket = lambda at: F.floor(at / bucket_s)
    begins = F.when(F.col("at_silence"), F.col("from_s")).otherwise(F.greatest(F.col("from_s") - overlap_s, F.lit(0.0)))
    chunks = cuts.select("recording_id", "nr", begins.alias("_from"), F.col("to_s").alias("_to")).where("_to > _from")
    chunks = chunks.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    found = frames.withColumn("_bucket", bucket(F.col("at_s"))).join(chunks, ["recording_id", "_bucket"]).where("at_s >= _from and at_s < _to")
    return found.select(*frames.columns, "nr")


def decide(pairs: DataFrame, merged: Column, prior_a: float = 1.0, prior_b: float = 1.0) -> DataFrame:
    """Columns text and ask for two readings (text_a, text_b, seconds): the only one, the sane one, the preferred if they agree, else the merged one, and whether to ask for an arbiter."""
    a, b = F.trim(F.coalesce("text_a", F.lit(""))), F.trim(F.coalesce("text_b", F.lit("")))
    agreement = ft.dice(ft.word_tokens(F.lower(a)), ft.word_tokens(F.lower(b)))
    preferred = a if prior_a >= prior_b else b
    both = (a != "") & (b != "")
    sane = ft.pick_sane(a, b, F.col("seconds"))
    text = F.when(~both, F.concat(a, b)).when(sane.isNotNull(), sane).when(F.col("agreement") >= AGREED, preferred).otherwise(F.coalesce(F.nullif(merged, F.lit("")), preferred))
    return pairs.withColumn("agreement", agreement).withColumn("text", text).withColumn("ask", both & sane.isNull() & (F.col("agreement") < DISPUTED))


def arbitrated(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows (key, words_a, words_b, text) with the text that an arbiter's choices (key, choices) make; without choices it stays."""
    apply = fw.arrow(lambda a, b, c: fw.settle([(w, 1.0) for w in a], [(w, 1.0) for w in b], list(c)), "string")
    return rows.join(replies, "key", "left").withColumn("text", F.coalesce(apply("words_a", "words_b", "choices"), "text")).drop("choices")


def engine(language: Column) -> Column:
    """The engine that runs if none is chosen."""
    return F.when(F.lower(language) == "ar", "omnilingual").otherwise("parakeet")


def ready_pairs(pairs: DataFrame) -> DataFrame:
    """Engine pairs of which both are installed; all if there is none."""
    any_ready = pairs.agg(F.coalesce(F.max((F.col("ready_a") & F.col("ready_b")).cast("int")), F.lit(0)).alias("_any"))
    # one row, so the broadcast has a fixed size
    return pairs.join(F.broadcast(any_ready)).where((F.col("_any") == 0) | (F.col("ready_a") & F.col("ready_b"))).drop("_any")


def first_available(options: DataFrame, key: str) -> DataFrame:
    """The available option with the smallest priority, for each key."""
    return options.where("available").groupBy(key).agg(F.min_by("option", F.struct("priority", "option")).alias("option"))


def pick_model(models: DataFrame, key: str, size: str, name: str, languages: list[str]) -> DataFrame:
    """Of the models of each key (columns pinned and languages: null for a general one) the pinned one, else one for a language of the run, else a general one, else any; the largest of equals, then that of the least name."""
    wanted = F.arrays_overlap("languages", F.array(*map(F.lit, languages)))
    rank = F.when(F.col("pinned"), 0).when(wanted, 1).when(F.col("languages").isNull(), 2).otherwise(3)
    best = F.min_by(F.struct(*models.columns), F.struct(rank, -F.col(size), F.col(name))).alias("m")
    return models.groupBy(key).agg(best).select("m.*")


def promote(vocabulary: DataFrame, learned: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (term) with the chosen learned terms (key, spelling) whose key it lacks, and the learned terms left."""
    have = vocabulary.select(ft.key(F.col("term")).alias("key"))
    added = learned.join(chosen.select("key"), "key", "left_semi").join(have, "key", "left_anti").select(F.col("spelling").alias("term"))
    return vocabulary.select("term").unionByName(added), learned.join(chosen.select("key"), "key", "left_anti")
