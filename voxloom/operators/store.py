"""Changes to tables as functions from old rows to new rows.

A table is never changed in place: each function returns the table that a writer then
puts where the old one was, so a lost task is simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` with other keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old`, and rows of `new` with keys that it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def update(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`old` with `columns` from `new` where a key matches."""
    change = new.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = old.join(change, key, "left")
    return rows.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def delete(rows: DataFrame, where: Column) -> DataFrame:
    """Rows for which `where` is not true."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def cascade(children: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """Children whose parent is not among those gone."""
    return children.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti")


def nullify(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows that point at `value` point at nothing."""
    return rows.withColumn(column, F.when(F.col(column) == value, None).otherwise(F.col(column)))


def replace_set(old: DataFrame, new: DataFrame, key: list[str], keys: DataFrame | None = None) -> DataFrame:
    """All old rows of `keys` (else of the keys in `new`) give way to the new ones; a key without new rows is left empty."""
    gone = (new if keys is None else keys).select(*key).distinct()
    return old.join(gone, key, "left_anti").unionByName(new)


def prune_orphans(parents: DataFrame, key: str, links: DataFrame, link_key: str) -> DataFrame:
    """Parents that a link still names."""
    return parents.join(links.select(F.col(link_key).alias(key)), key, "left_semi")


def edit_set(current: DataFrame, wanted: DataFrame, key: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """What to remove from and to add to `current` so that it holds `wanted`, names compared in lower case."""
    fold = lambda d: d.withColumn("_name", F.lower(F.trim(name)))
    a, b = fold(current), fold(wanted)
    by = [*key, "_name"]
    return a.join(b.select(*by), by, "left_anti").drop("_name"), b.dropDuplicates(by).join(a.select(*by), by, "left_anti").drop("_name")


def snapshots(segments: DataFrame, versions: DataFrame) -> DataFrame:
    """New versions (recording_id, segments_json, n): of recordings that have segments and differ from their latest version."""
    row = F.struct("start_s", "end_s", "text", "speaker")
    now = segments.groupBy("recording_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("r")))), lambda x: x["r"])).alias("segments_json"), F.count("*").alias("n"))
    w = Window.partitionBy("recording_id").orderBy(F.desc("created_at"), F.desc("version_id"))
    last = versions.withColumn("_nr", F.row_number().over(w)).where("_nr = 1").select("recording_id", F.col("segments_json").alias("_last"))
    return now.join(last, "recording_id", "left").where("_last is null or _last <> segments_json").drop("_last")


SNAPSHOT = "array<struct<start_s:double,end_s:double,text:string,speaker:int>>"


def restored(version: DataFrame) -> DataFrame:
    """Segments of versions (recording_id, segments_json, n); a version that reads as empty though n > 0 restores nothing."""
    rows = version.withColumn("_s", F.coalesce(F.from_json("segments_json", SNAPSHOT, {"mode": "PERMISSIVE"}), F.array().cast(SNAPSHOT)))
    return rows.where("not (size(_s) = 0 and n > 0)").select("recording_id", F.posexplode("_s").alias("seq", "s")).select("recording_id", F.col("seq").cast("long"), "s.*")


def restore(live: DataFrame, versions: DataFrame, chosen: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Segments and versions after each recording in `chosen` (recording_id, segments_json, n) went back to that version.

    A version that reads as empty though it had segments is refused: its recording stays as it is. Of the others, what was live
    becomes a version named `label` first, unless it is empty or equal to the latest version.
    """
    back = restored(chosen)
    empty = chosen.where("n = 0").select("recording_id")
    done = back.select("recording_id").distinct().unionByName(empty)
    kept = snapshots(live.join(done, "recording_id", "left_semi"), versions).withColumn("label", F.lit(label))
    return replace_set(live.select(*back.columns), back, ["recording_id"], done), versions.unionByName(kept, allowMissingColumns=True)


def backup_plan(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Column outcome: skipped if a file with the name and size is there, else copied; transcripts are always written."""
    here = present.select("name", "bytes").distinct().withColumn("_here", F.lit(True))
    rows = wanted.join(here, ["name", "bytes"], "left")
    return rows.withColumn("outcome", backup_outcome(F.col("kind"), F.col("_here"))).drop("_here")


def backup_outcome(kind: Column, here: Column) -> Column:
    return F.when(kind == "transcript", "written").when(here, "skipped").otherwise("copied")


def backup_outcomes(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Number of files by outcome."""
    return backup_plan(wanted, present).groupBy("outcome").agg(F.count("*").alias("n"))
