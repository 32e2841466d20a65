"""Ordered rows of a recording: runs, islands, smoothing, numbering, and folds where each step needs the last."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as ft
from voxloom.functions.words import FILLERS

#: Short replies that belong to the turn around them.
BACKCHANNELS = [
    "yeah", "yep", "yup", "yes", "mhm", "mm", "mmm", "hm", "uh-huh", "uhuh", "okay", "ok", "right", "sure", "totally", "exactly", "got it", "true",
    "no", "nope", "nah", "alright", "k", "uh", "huh", "ايوه", "أيوه", "تمام", "اوكي", "أوكي", "صح", "ايه", "إيه", "أيوا",
    "так", "ага", "угу", "добре", "ясно", "зрозуміло", "ja", "oké", "klopt", "juist", "inderdaad",
]
BACKCHANNEL_S = 2.0


def _by(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def runs(rows: DataFrame, speaker: str = "speaker", order: tuple[str, ...] = ("start_s", "seq"), name: str = "run") -> DataFrame:
    """Number of the run of equal speakers (null equals null) that a row is in, from 0."""
    w = _by("recording_id", *order)
    new = (F.row_number().over(w) > 1) & ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w))
    return rows.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def coalesce_turns(rows: DataFrame, gap_s: float = 30.0) -> DataFrame:
    """Turns: rows of a speaker in a row whose silence before is shorter than `gap_s`, as one row with the texts joined."""
    rows = runs(rows)
    inside = Window.partitionBy("recording_id", "run").orderBy("start_s", "seq")
    reach = F.max("end_s").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("start_s") - reach >= gap_s).cast("int"), F.lit(0))).withColumn("_island", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "seq", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("recording_id", "run", "_island").agg(F.min("seq").alias("seq"), F.min("speaker").alias("speaker"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), text.alias("text"), F.count("*").alias("n")).drop("run", "_island")


def smooth_sandwiches(rows: DataFrame, short_s: float = 0.25) -> DataFrame:
    """Column smoothed: in recordings of three runs and more, an inner run shorter than `short_s` between equal speakers takes theirs; neighbours as they were."""
    rows = runs(rows)
    each = rows.groupBy("recording_id", "run").agg(F.min("speaker").alias("_sp"), F.min("start_s").alias("_a"), F.max("end_s").alias("_b"))
    w = _by("recording_id", "run")
    each = each.withColumn("_before", F.lag("_sp").over(w)).withColumn("_after", F.lead("_sp").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("recording_id")))
    inner = (F.col("_n") >= 3) & (F.lag("run").over(w).isNotNull()) & (F.lead("run").over(w).isNotNull()) & F.col("_before").eqNullSafe(F.col("_after")) & (F.col("_b") - F.col("_a") < short_s)
    each = each.withColumn("_to", F.when(inner, F.col("_before")).otherwise(F.col("_sp")))
    return rows.join(each.select("recording_id", "run", F.col("_to").alias("smoothed")), ["recording_id", "run"]).drop("run")


def renumber(rows: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Column renumbered: speakers from 0 in order of their first appearance."""
    first = rows.where(F.col(speaker).isNotNull()).groupBy("recording_id", speaker).agg(F.min(F.struct("start_s", "seq")).alias("_f"))
    first = first.withColumn("renumbered", (F.row_number().over(_by("recording_id", "_f")) - 1).cast("int")).drop("_f")
    return rows.join(first, ["recording_id", speaker], "left")


def remap(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply a map (speaker, to) of speakers, unknown ones staying, then close gaps in the numbering."""
    mapped = rows.join(mapping, "speaker", "left").withColumn("mapped", F.coalesce("to", "speaker")).drop("to")
    return renumber(mapped, "mapped")


def split_by_runs(words: DataFrame) -> DataFrame:
    """Pieces of segments by the words' runs of speakers: outer bounds are the segment's, inner ones the words'.

    `words`: recording_id, seq, word_nr, start_s, end_s, text, assigned, seg_start, seg_end.
    """
    w = Window.partitionBy("recording_id", "seq").orderBy("word_nr")
    new = (F.row_number().over(w) > 1) & ~F.col("assigned").eqNullSafe(F.lag("assigned").over(w))
    rows = words.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = ft.join_surfaces(F.transform(F.array_sort(F.collect_list(F.struct("word_nr", "text"))), lambda x: x["text"]))
    parts = rows.groupBy("recording_id", "seq", "_run").agg(F.min("assigned").alias("speaker"), F.min_by("start_s", "word_nr").alias("_a"), F.max_by("end_s", "word_nr").alias("_b"), F.min("seg_start").alias("_s0"), F.max("seg_end").alias("_s1"), text.alias("text"))
    last = F.max("_run").over(Window.partitionBy("recording_id", "seq"))
    return parts.withColumn("_last", last).select("recording_id", "seq", F.col("_run").cast("int").alias("piece"), "speaker", F.when(F.col("_run") == 0, F.col("_s0")).otherwise(F.col("_a")).alias("start_s"), F.when(F.col("_run") == F.col("_last"), F.col("_s1")).otherwise(F.col("_b")).alias("end_s"), "text")


def drop_fillers(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text has a digit, or a word of letters that is no filler."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")
    return rows.where(F.col(text).rlike(r"\p{Nd}") | F.exists(words, lambda x: ~x.isin(FILLERS)))


def absorb_backchannels(rows: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Column absorbed: a short reply between two rows of one other speaker takes that speaker.

    The row before counts as already changed, so this is a pass over a recording's rows in order.
    """
    clean = F.trim(F.regexp_replace(F.lower(F.trim("text")), r"[.!?,;:·]+$", ""))
    reply = ((F.col("end_s") - F.col("start_s")) < BACKCHANNEL_S) & clean.isin(BACKCHANNELS)
    rows = rows.withColumn("_reply", F.coalesce(reply, F.lit(False)))

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by([("start_s", "ascending"), ("seq", "ascending")])
        said, reply, out, before = group["sp"].to_pylist(), group["_reply"].to_pylist(), [], None
        for k, now in enumerate(said):
            if 0 < k < len(said) - 1 and reply[k] and before is not None and before == said[k + 1]:
                now = before
            out.append(now)
            before = now
        return pa.table({"recording_id": group["recording_id"], "seq": group["seq"], "absorbed": pa.array(out, group.schema.field("sp").type)})

    kind = rows.schema[speaker].dataType.simpleString()
    done = rows.select("recording_id", "seq", "start_s", F.col(speaker).alias("sp"), "_reply").groupBy("recording_id").applyInArrow(fold, f"recording_id long, seq long, absorbed {kind}")
    return rows.drop("_reply").join(done, ["recording_id", "seq"])


def silence_runs(frames: DataFrame, window_s: float = 0.025, least_s: float = 0.25, low: float = 0.005, high: float = 0.02) -> DataFrame:
    """Silences (start_s, end_s) of frames (recording_id, frame, rms): runs below the threshold of at least `least_s`.

    The threshold is twice the level at a fifth of the sorted frames, kept between `low` and `high`.
    """
    rank = F.row_number().over(_by("recording_id", "rms", "frame"))
    n = F.count("*").over(Window.partitionBy("recording_id"))
    level = frames.withColumn("_r", rank).withColumn("_n", n).where("_r = floor(_n / 5) + 1").select("recording_id", F.least(F.greatest(2 * F.col("rms"), F.lit(low)), F.lit(high)).alias("threshold"))
    rows = frames.join(level, "recording_id").withColumn("_quiet", F.col("rms") < F.col("threshold"))
    rows = rows.withColumn("_island", F.sum((~F.col("_quiet")).cast("int")).over(_by("recording_id", "frame").rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.where("_quiet").groupBy("recording_id", "_island").agg((F.min("frame") * window_s).alias("start_s"), ((F.max("frame") + 1) * window_s).alias("end_s"), F.count("*").alias("_n"))
    return found.where(F.col("_n") * window_s >= least_s - 1e-9).select("recording_id", "start_s", "end_s")


def cut_points(silences: DataFrame, durations: DataFrame, target_s: float = 28.0, flex_s: float = 2.0, least_s: float = 1.0) -> DataFrame:
    """recording_id, nr, cut_s, at_silence: from one cut to the next, the silence whose middle is nearest to the target and no more than `flex_s` before it, but more than `least_s` after the last cut; else the target."""
    packed = durations.join(silences.groupBy("recording_id").agg(F.array_sort(F.collect_list((F.col("start_s") + F.col("end_s")) / 2)).alias("mids")), "recording_id", "left")

    kind = dict(durations.dtypes)["recording_id"]

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples():
                mids = [] if r.mids is None else list(r.mids)
                last, nr = 0.0, 0
                while r.duration_s - last > target_s + flex_s:
                    target = last + target_s
                    k = bisect_right(mids, target) - 1
                    cut = mids[k] if k >= 0 and mids[k] >= target - flex_s and mids[k] > last + least_s else None
                    out.append((r.recording_id, nr, target if cut is None else cut, cut is not None))
                    last, nr = out[-1][2], nr + 1
            yield pd.DataFrame(out, columns=["recording_id", "nr", "cut_s", "at_silence"])

    return packed.select("recording_id", "duration_s", "mids").mapInPandas(walk, f"recording_id {kind}, nr int, cut_s double, at_silence boolean")


def context_tail(rows: DataFrame, n: int = 250) -> DataFrame:
    """Column context: the last `n` characters of the row before."""
    return rows.withColumn("context", F.expr(f"right(lag(text) over (partition by recording_id order by start_s, seq), {n})"))


def subword_words(tokens: DataFrame, missing_s: float = 0.08) -> DataFrame:
    """Words of sentence-piece tokens (recording_id, nr, token, at_s, len_s): a marker or space, or the first token, begins a word."""
    w = _by("recording_id", "nr")
    begins = F.col("token").rlike("^[▁ ]") | (F.row_number().over(w) == 1)
    rows = tokens.withColumn("_w", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.regexp_replace("token", "[▁ ]", ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "_t"))), lambda x: x["_t"]), "")
    out = rows.groupBy("recording_id", "_w").agg(text.alias("text"), F.min("at_s").alias("start_s"), F.max(F.col("at_s") + F.coalesce("len_s", F.lit(missing_s))).alias("end_s")).where("text <> ''")
    return out.select("recording_id", F.row_number().over(_by("recording_id", "_w")).alias("word_nr"), "text", "start_s", "end_s")
