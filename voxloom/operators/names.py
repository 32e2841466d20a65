"""Names harvested from transcripts: candidates per text, then counts and rejections as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import mentions
from voxloom.functions import text as ft
from voxloom.functions import words as fw
from voxloom.sources.files import written


def candidates(texts: DataFrame) -> DataFrame:
    """recording_id, pos, cand, initial, key: name candidates that are not ordinary in themselves."""
    rows = texts.select("recording_id", F.posexplode(mentions.name_candidates(F.col("text"))).alias("pos", "c")).select("recording_id", "pos", "c.cand", "c.initial")
    return rows.where(mentions.is_name(F.col("cand"))).withColumn("key", ft.key(F.col("cand")))


def lowercase_counts(texts: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """key, low: how often a word stands with a small first letter; with `keys` (key) only of those."""
    # words are counted as they stand, so that patterns are tried on different words only
    words = texts.select(F.explode(ft.word_tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = words.where(F.col("w").rlike(r"^\p{Ll}")).select(ft.key(F.col("w")).alias("key"), "n")
    if keys is not None:
        words = words.join(keys, "key", "left_semi")
    return words.groupBy("key").agg(F.sum("n").alias("low"))


def agreement(rows: DataFrame, key: str, a: Column, b: Column, parts: int | None = None) -> DataFrame:
    """key, dice: twice the words in common over all words of two texts, counting repeats; 0 if either has none. Words are counted as rows, so texts may be long.

    Pairs are dealt by key to `parts` tasks before words become rows, so a task counts only the words of its own pairs, and words are never shuffled.
    """
    words = lambda text, side: F.transform(ft.word_tokens(F.lower(text)), lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    dealt = rows.select(key, a.alias("a"), b.alias("b"))
    dealt = dealt.repartition(parts, key) if parts else dealt.repartition(key)
    said = dealt.select(key, F.explode_outer(F.concat(words(F.col("a"), 1), words(F.col("b"), -1))).alias("said")).select(key, "said.w", "said.side")
    counts = said.groupBy(key, "w").agg(F.count_if(F.expr("side = 1")).alias("x"), F.count_if(F.expr("side = -1")).alias("y"))
    known = F.col("w").isNotNull()
    total = counts.groupBy(key).agg(F.sum(F.when(known, F.col("x")).otherwise(0)).alias("x"), F.sum(F.when(known, F.col("y")).otherwise(0)).alias("y"), F.sum(F.when(known, F.least("x", "y")).otherwise(0)).alias("c"))
    return total.select(key, F.when((F.col("x") == 0) | (F.col("y") == 0), 0.0).otherwise(2.0 * F.col("c") / (F.col("x") + F.col("y"))).alias("dice"))


def harvest(texts: DataFrame, known: DataFrame, min_recordings: int = 2, limit: int = 200) -> DataFrame:
    """key, spelling, recordings, occurrences of the names that several recordings share.

    Left out: known keys, terms mostly at the start of sentences, those as often written small, and
    runs of which every word is common. The most frequent spelling stands for a key; of
    equally frequent ones the smaller. Texts are read twice: for the candidates, which are counted and written once,
    and for the small words among the keys and parts of those that are left.
    """
    found = candidates(texts).join(known.select(ft.key(F.col("term")).alias("key")).distinct(), "key", "left_anti")
    spelled = written(found.groupBy("key", "cand", "recording_id").agg(F.count("*").alias("n"), F.count_if(~F.col("initial")).alias("mid")), "names")
    terms = spelled.groupBy("key").agg(F.count_distinct("recording_id").alias("recordings"), F.sum("n").alias("occurrences"), F.sum("mid").alias("mid"))
    terms = terms.where((F.col("recordings") >= min_recordings) & (F.col("mid") >= F.greatest(F.lit(1), F.expr("occurrences div 5"))))
    best = spelled.groupBy("key", "cand").agg(F.sum("n").alias("n")).groupBy("key").agg(F.min(F.struct(-F.col("n"), "cand"))["cand"].alias("spelling"))
    terms = written(terms.join(best, "key"), "terms")
    parts = terms.select("key", F.explode(F.split("spelling", " ")).alias("p")).select("key", ft.key(F.col("p")).alias("part"))
    low = written(lowercase_counts(texts, terms.select("key").unionAll(parts.select("part")).distinct()), "low")
    terms = terms.join(low, "key", "left").where(F.coalesce("low", F.lit(0)) < F.col("occurrences")).drop("low", "mid")
    common = parts.join(low.select(F.col("key").alias("part"), "low"), "part", "left").groupBy("key").agg(F.count("*").alias("n"), F.min(F.coalesce("low", F.lit(0))).alias("least"))
    ordinary = common.where("n > 1 and least > 3").select("key")
    return terms.join(ordinary, "key", "left_anti").select("key", "spelling", "recordings", "occurrences").orderBy(F.desc("recordings"), F.desc("occurrences"), F.desc("spelling")).limit(limit)


def suggest(texts: DataFrame, known: DataFrame, dismissed: DataFrame, limit: int = 6) -> DataFrame:
    """For each recording the names it mentions inside sentences most often, at most `limit`, in order of first mention if equal."""
    gone = known.select(ft.key(F.col("term")).alias("key")).union(dismissed.select("key")).distinct()
    found = written(candidates(texts).where("not initial").join(gone, "key", "left_anti"), "mentions")
    counts = found.groupBy("recording_id", "key").agg(F.count("*").alias("occurrences"), F.min("pos").alias("first"))
    spell = found.groupBy("recording_id", "key", "cand").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    best = spell.groupBy("recording_id", "key").agg(F.max_by("cand", F.struct(F.col("n"), -F.col("p"))).alias("spelling"))
    words = texts.select("recording_id", F.explode(ft.word_tokens(F.col("text"))).alias("w")).where(F.col("w").rlike(r"^\p{Ll}")).select("recording_id", ft.key(F.col("w")).alias("key"))
    low = words.join(counts.select("recording_id", "key"), ["recording_id", "key"], "left_semi").groupBy("recording_id", "key").agg(F.count("*").alias("low"))
    rows = counts.join(low, ["recording_id", "key"], "left").where(F.coalesce("low", F.lit(0)) < F.col("occurrences"))
    nr = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("occurrences"), "first"))
    return rows.withColumn("nr", nr).where(F.col("nr") <= limit).join(best, ["recording_id", "key"]).select("recording_id", "nr", "key", "spelling", "occurrences")


def speaker_names(rows: DataFrame) -> DataFrame:
    """Column inferred for (recording_id, seq, start_s, speaker, text, speaker_name): the name given, else the first self-introduction, else in a talk of two how the other greets."""
    said = rows.withColumn("_intro", mentions.introduced_name(F.col("text"))).withColumn("_greet", mentions.addressed_name(F.col("text")))
    own = said.where("_intro is not null").groupBy("recording_id", "speaker").agg(F.min_by("_intro", F.struct("start_s", "seq")).alias("_own"))
    two = rows.groupBy("recording_id").agg(F.count_distinct("speaker").alias("n"), F.min("speaker").alias("a"), F.max("speaker").alias("b")).where("n = 2")
    other = said.where("_greet is not null").join(two, "recording_id").withColumn("_to", F.when(F.col("speaker") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    other = other.groupBy("recording_id", F.col("_to").alias("speaker")).agg(F.min_by("_greet", F.struct("start_s", "seq")).alias("_other"))
    return rows.join(own, ["recording_id", "speaker"], "left").join(other, ["recording_id", "speaker"], "left").withColumn("inferred", F.coalesce("speaker_name", "_own", "_other")).drop("_own", "_other")


def drop_boundary_repeats(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Rows without the words that the row before, of the same speaker, ends with; only rows in `near` (recording_id, seq) change, and one left empty goes."""
    w = "over (partition by recording_id order by start_s, seq)"
    cut = fw.arrow(lambda before, now: " ".join(now.split()[fw.boundary_overlap(before.split(), now.split()) :]), "string")
    marked = rows.withColumn("_before", F.expr(f"lag(text) {w}")).withColumn("_sp", F.expr(f"lag(speaker) {w}")).join(near.select("recording_id", "seq", F.lit(True).alias("_near")), ["recording_id", "seq"], "left")
    change = F.col("_near") & (F.col("_sp") == F.col("speaker"))
    return marked.withColumn("text", F.when(change, cut("_before", "text")).otherwise(F.col("text"))).where("text <> ''").drop("_before", "_sp", "_near")
