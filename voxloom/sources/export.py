"""Transcripts as TXT, SRT and JSON texts, one row for each recording, and sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as ft


def _lines(rows: DataFrame, line, between: str = "") -> DataFrame:
    return rows.withColumn("_l", line).groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "seq", "_l"))), lambda x: x["_l"]), between).alias("body"))


def to_txt(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """recording_id, body: a head, then texts, a speaker's name where it changes; a row without speaker changes nothing."""
    shown = ft.display_speaker(F.col("speaker_name"), F.col("speaker"))
    w = Window.partitionBy("recording_id").orderBy("start_s", "seq")
    rows = segments.withColumn("_s", shown).withColumn("_p", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_s").isNotNull() & (F.col("_p").isNull() | (F.col("_s") != F.col("_p")))
    body = _lines(rows, F.concat(F.when(new, F.concat(F.lit("\n["), "_s", F.lit("]\n"))).otherwise(""), F.trim("text"), F.lit("\n")))
    head = F.concat(F.lit("# "), "title", F.lit("\n"), F.coalesce(F.concat(F.lit("Language: "), "language", F.lit("\n")), F.lit("")), F.lit("Duration: "), ft.duration(F.col("duration_s")), F.lit("\n\n"))
    return recordings.join(body, "recording_id", "left").select("recording_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("body"))


def to_srt(segments: DataFrame) -> DataFrame:
    """recording_id, body: numbered subtitles."""
    shown = ft.display_speaker(F.col("speaker_name"), F.col("speaker"))
    nr = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_s", "seq"))
    line = F.concat(nr.cast("string"), F.lit("\n"), ft.srt_time(F.col("start_s")), F.lit(" --> "), ft.srt_time(F.col("end_s")), F.lit("\n"), F.coalesce(F.concat(shown, F.lit(": ")), F.lit("")), F.trim("text"), F.lit("\n\n"))
    return _lines(segments, line)


#: Fields of an exported transcript and of its segments, in their order; null fields are written.
DOCUMENT = {"audioPath": "audio_path", "title": "title", "language": "language", "translated": "translated", "durationSeconds": "duration_s", "backend": "backend", "model": "model"}
SEGMENT = {"start": "start_s", "end": "end_s", "speaker": "speaker", "speakerName": "speaker_name", "language": "language", "text": "text"}
INDENT = 4


def _fields(rows: DataFrame, fields: dict[str, str], depth: int) -> list:
    """A line for each field; a column that `rows` lacks is null."""
    pad = " " * (INDENT * depth)

    def value(name: str):
        if name not in rows.columns:
            return F.lit("null")
        text = F.to_json(F.struct(F.col(name).alias("x")), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(6), F.length(text) - 6)  # what is between {"x": and }

    return [F.concat(F.lit(f'{pad}"{key}": '), value(name)) for key, name in fields.items()]


def to_json(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """recording_id, body: pretty-printed JSON with null fields kept."""
    outer, inner = " " * INDENT, " " * (2 * INDENT)
    one = F.concat(F.lit(inner + "{\n"), F.concat_ws(",\n", *_fields(segments, SEGMENT, 3)), F.lit("\n" + inner + "}"))
    packed = _lines(segments, one, ",\n").withColumnRenamed("body", "_segments")
    rows = recordings.join(packed, "recording_id", "left")
    listed = F.coalesce(F.concat(F.lit(f'{outer}"segments": [\n'), "_segments", F.lit(f"\n{outer}]")), F.lit(f'{outer}"segments": []'))
    return rows.select("recording_id", F.concat(F.lit("{\n"), F.concat_ws(",\n", *_fields(recordings, DOCUMENT, 1), listed), F.lit("\n}")).alias("body"))


def speakers_sidecar(segments: DataFrame) -> DataFrame:
    """recording_id, names: JSON of speaker to the last name given; recordings without names have no row."""
    last = segments.where("speaker is not null and trim(speaker_name) <> ''").groupBy("recording_id", "speaker").agg(F.max_by("speaker_name", F.struct("start_s", "seq")).alias("n"))
    return last.groupBy("recording_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "n"))))).alias("names"))
