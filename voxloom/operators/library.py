"""Library queries: search, counts, look-ups and metrics over recordings, folders, tags and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(text: Column) -> Column:
    """Lower-case A-Z only, as LIKE and NOCASE of the original store compare."""
    return F.translate(text, _UPPER, _LOWER)


def fold(text: str) -> str:
    """The same for a parameter."""
    return text.translate(str.maketrans(_UPPER, _LOWER))


def search(recordings: DataFrame, segments: DataFrame, tags: DataFrame, folder: str | None = None, tag: str | None = None, text: str | None = None) -> DataFrame:
    """Recordings in `folder`, with `tag`, whose title or a segment holds `text`; unset or blank parameters don't filter.

    Only the joins that a parameter needs are made, and as semi joins, so that tags and segments
    don't multiply rows.
    """
    found = recordings
    if folder is not None:
        found = found.where(F.col("folder") == folder)
    if tag is not None:
        found = found.join(tags.where(F.col("tag") == tag).select(F.col("recording_id").alias("id")), "id", "left_semi")
    wanted = (text or "").strip()
    if wanted:
        folded = fold(wanted)
        hits = segments.where(F.contains(ascii_fold(F.col("text")), F.lit(folded))).select(F.col("recording_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
        found = found.join(hits, "id", "left").where(F.contains(ascii_fold(F.col("title")), F.lit(folded)) | F.col("_hit")).drop("_hit")
    return found


def count_children(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str = "n") -> DataFrame:
    """Parents with their number of children; those without any have 0."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def next_sort_order(rows: DataFrame, column: str) -> DataFrame:
    """One more than the largest order in use; 0 for none."""
    return rows.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_order"))


def metrics(recordings: DataFrame, seconds: str) -> DataFrame:
    """Recordings, whole seconds and different languages."""
    return recordings.agg(F.count("*").alias("n_recordings"), F.floor(F.coalesce(F.sum(seconds), F.lit(0.0))).cast("long").alias("seconds"), F.count_distinct("language").alias("n_languages"))


def joined_text(rows: DataFrame, key: str, order: str, text: str, between: str = "\n") -> DataFrame:
    """One row for each key: its texts in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), between).alias("joined"))


def first_seen_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones that seen first. Blank and 'auto' don't count."""
    clean = rows.withColumn("_v", F.lower(F.trim(value))).where("_v is not null and _v not in ('', 'auto')")
    counts = clean.groupBy(key, "_v").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(F.max_by("_v", F.struct(F.col("_n"), -F.col("_first"))).alias("value"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order`."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_nr", F.row_number().over(w)).where("_nr = 1").drop("_nr")


def named_speakers(segments: DataFrame, sidecar: DataFrame, prior: DataFrame) -> DataFrame:
    """Each segment's speaker name: its own if not blank, else the sidecar's, else the last one given before."""
    last = prior.where("trim(name) <> ''").groupBy("recording_id", "speaker").agg(F.max_by("name", "seq").alias("_prior"))
    side = sidecar.select("recording_id", "speaker", F.col("name").alias("_side"))
    rows = segments.join(side, ["recording_id", "speaker"], "left").join(last, ["recording_id", "speaker"], "left")
    return rows.withColumn("speaker_name", F.coalesce(F.expr("nullif(trim(own_name), '')"), "_side", "_prior")).drop("_side", "_prior")


def queue_head(tasks: DataFrame, recordings: DataFrame, charging: bool) -> DataFrame:
    """The task that runs next: oldest first, not parked for a charger, its recording still there."""
    ready = tasks if charging else tasks.where("not wait_for_charger")
    return ready.join(recordings.select(F.col("id").alias("recording_id")), "recording_id", "left_semi").orderBy("queued_at", "recording_id").limit(1)


def with_defaults(defaults: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """Defaults, saved values over them."""
    return defaults.join(saved.select(key, F.col(value).alias("_saved")), key, "left").withColumn(value, F.coalesce("_saved", value)).drop("_saved")


def combined(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """`rows` with the columns of the others by `key`; numbers that a row lacks are 0."""
    for other in others:
        names = [c for c in other.columns if c != key]
        rows = rows.join(other, key, "left").fillna(0, names)
    return rows


def json_store(text: Column) -> Column:
    """A map of a stored JSON object; what is missing or cannot be read is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def without_pack(stored: Column, pack: Column) -> Column:
    """The terms of a stored vocabulary (by lines and commas), each once and in order, that are not in `pack`."""
    terms = F.filter(F.transform(F.split(stored, "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_except(terms, pack)


def prompt_transcript(segments: DataFrame, speaker: str) -> DataFrame:
    """recording_id, prompt: a line `[mm:ss] speaker: text` for each segment in order; minutes go on past an hour."""
    s = F.floor("start_s")
    who = F.when(F.trim(F.coalesce(speaker, F.lit(""))) != "", F.concat(speaker, F.lit(": "))).otherwise("")
    line = F.concat(F.format_string("[%02d:%02d] ", (s / 60).cast("long"), s % 60), who, F.trim("text"))
    return joined_text(segments.withColumn("_line", line), "recording_id", "seq", "_line").withColumnRenamed("joined", "prompt")


#: Fixed value: speakers above which their number is asked for.
MANY_SPEAKERS = 6


def speaker_hint(segments: DataFrame, auto: Column, many: int = MANY_SPEAKERS) -> DataFrame:
    """recording_id, n, hint: different speakers (null is none), and whether there are too many though `auto` (of the recording) holds."""
    counts = segments.groupBy("recording_id").agg(F.count_distinct("speaker").alias("n"))
    return counts.withColumn("hint", (F.col("n") > many) & auto)
