"""Queries over time: attribution of speakers, turns, smoothing, silences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import intervals, library, sequences
from voxloom.plans.registry import query
from voxloom.sources import tables as t

_BEST = """hit AS (SELECT {k}, r.recording_id AS rid, turn_speaker, turn_seq, least(r.end_s, turn_end) - greatest(r.start_s, turn_start) AS o FROM {r} r JOIN turns ON r.recording_id = turns.recording_id AND turn_end > r.start_s AND turn_start < r.end_s),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY rid, {p} ORDER BY o DESC, turn_seq) = 1)"""


@query(f"""WITH {t.SEGMENTS_SQL}, {t.TURNS_SQL}, {_BEST.format(k='r.seq', r='seg', p='seq')}
    SELECT seg.recording_id, seg.seq, turn_speaker AS assigned FROM seg LEFT JOIN best ON rid = recording_id AND best.seq = seg.seq""")
def segment_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.speaker_by_overlap(t.segments(spark, sf_dir), t.turns(spark, sf_dir), ["seq"]).select("recording_id", "seq", "assigned")


#: Words, evenly spread over their segments.
_WORDS_SQL = """w0 AS (SELECT recording_id, seq, start_s AS s0, end_s AS s1, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM seg),
words AS (SELECT recording_id, seq, CAST(i AS INTEGER) AS word_nr, s0 AS seg_start, s1 AS seg_end, s0 + (s1 - s0) * i / len(ws) AS start_s, s0 + (s1 - s0) * (i + 1) / len(ws) AS end_s, ws[i + 1] AS text FROM (SELECT *, unnest(range(len(ws))) AS i FROM w0))"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir)
    rows = seg.withColumn("ws", F.filter(F.split(F.translate("text", "\n", " "), " "), lambda x: x != "")).withColumn("n", F.size("ws"))
    rows = rows.select("recording_id", "seq", F.col("start_s").alias("s0"), F.col("end_s").alias("s1"), "n", F.posexplode("ws").alias("i", "text"))
    return rows.selectExpr("recording_id", "seq", "i as word_nr", "s0 as seg_start", "s1 as seg_end", "s0 + (s1 - s0) * i / n as start_s", "s0 + (s1 - s0) * (i + 1) / n as end_s", "text")


_NEAR = f"""{t.SEGMENTS_SQL}, {t.TURNS_SQL}, {_WORDS_SQL}, {_BEST.format(k='r.seq, r.word_nr', r='words', p='seq, word_nr')},
late AS (SELECT w.* FROM words w LEFT JOIN best b ON b.rid = w.recording_id AND b.seq = w.seq AND b.word_nr = w.word_nr WHERE b.rid IS NULL),
near AS (SELECT l.recording_id, seq, word_nr, turn_speaker FROM late l JOIN turns USING (recording_id)
    QUALIFY row_number() OVER (PARTITION BY l.recording_id, seq, word_nr ORDER BY greatest(turn_start - (start_s + end_s) / 2, (start_s + end_s) / 2 - turn_end, 0), turn_seq) = 1),
assigned AS (SELECT w.*, coalesce(b.turn_speaker, n.turn_speaker) AS assigned FROM words w LEFT JOIN best b ON b.rid = w.recording_id AND b.seq = w.seq AND b.word_nr = w.word_nr
    LEFT JOIN near n ON n.recording_id = w.recording_id AND n.seq = w.seq AND n.word_nr = w.word_nr)"""


@query(f"WITH {_NEAR} SELECT recording_id, seq, word_nr, text, assigned FROM assigned")
def word_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.speaker_by_overlap_or_nearest(_words(spark, sf_dir), t.turns(spark, sf_dir), ["seq", "word_nr"])
    return found.select("recording_id", "seq", "word_nr", "text", "assigned")


@query(f"""WITH {_NEAR}, flagged AS (SELECT *, CASE WHEN word_nr > 0 AND assigned IS DISTINCT FROM lag(assigned) OVER w THEN 1 ELSE 0 END AS new FROM assigned WINDOW w AS (PARTITION BY recording_id, seq ORDER BY word_nr)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, seq ORDER BY word_nr ROWS UNBOUNDED PRECEDING) AS piece FROM flagged),
    p AS (SELECT recording_id, seq, piece, min(assigned) AS speaker, arg_min(start_s, word_nr) AS a, arg_max(end_s, word_nr) AS b, min(seg_start) AS s0, max(seg_end) AS s1, regexp_replace(string_agg(text, ' ' ORDER BY word_nr), '(\\p{{L}}) ([''’ʼ‘]\\S)', '\\1\\2', 'g') AS text FROM r GROUP BY ALL)
    SELECT recording_id, seq, CAST(piece AS INTEGER) AS piece, speaker, round(CASE WHEN piece = 0 THEN s0 ELSE a END, 6) AS start_s, round(CASE WHEN piece = max(piece) OVER (PARTITION BY recording_id, seq) THEN s1 ELSE b END, 6) AS end_s, text FROM p""")
def segments_split_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = intervals.speaker_by_overlap_or_nearest(_words(spark, sf_dir), t.turns(spark, sf_dir), ["seq", "word_nr"])
    return sequences.split_by_runs(words).withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))


#: Four speakers, of whom one talks seldom.
_FOUR_SQL = "four AS (SELECT * REPLACE (CAST(CASE WHEN seq % 17 = 5 THEN 3 ELSE seq % 3 END AS INTEGER) AS speaker) FROM seg)"


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(spark, sf_dir).withColumn("speaker", F.expr("cast(case when seq % 17 = 5 then 3 else seq % 3 end as int)"))


@query(f"""WITH {t.SEGMENTS_SQL}, {_FOUR_SQL}, talk AS (SELECT recording_id, speaker, sum(end_s - start_s) AS t FROM four GROUP BY ALL),
    k AS (SELECT *, t >= greatest(6.0, 0.08 * max(t) OVER w) AS r, count(*) OVER w AS n FROM talk WINDOW w AS (PARTITION BY recording_id)),
    m AS (SELECT *, count(*) FILTER (r) OVER (PARTITION BY recording_id) AS nr FROM k),
    m2 AS (SELECT * FROM m WHERE n > 2 AND nr > 0 AND nr < n),
    real AS (SELECT f.* FROM four f JOIN m2 USING (recording_id, speaker) WHERE r), small AS (SELECT f.* FROM four f JOIN m2 USING (recording_id, speaker) WHERE NOT r),
    near AS (SELECT s.recording_id, s.seq, real.speaker AS sp FROM small s JOIN real USING (recording_id) QUALIFY row_number() OVER (PARTITION BY s.recording_id, s.seq ORDER BY abs((real.start_s + real.end_s) / 2 - (s.start_s + s.end_s) / 2), real.start_s, real.seq) = 1)
    SELECT f.recording_id, f.seq, coalesce(near.sp, f.speaker) AS consolidated FROM four f LEFT JOIN near ON near.recording_id = f.recording_id AND near.seq = f.seq""")
def minor_speakers_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.consolidate(_four(spark, sf_dir)).select("recording_id", "seq", "consolidated")


@query(f"""WITH {t.SEGMENTS_SQL}, b AS (SELECT recording_id, start_s + 1.25 AS boundary_s FROM seg WHERE seq % 3 = 1)
    SELECT recording_id, seq FROM seg WHERE EXISTS (SELECT 1 FROM b WHERE b.recording_id = seg.recording_id AND abs(seg.start_s - boundary_s) <= 2.0)""")
def segments_near_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir)
    return intervals.near_boundary(seg, seg.where("seq % 3 = 1").select("recording_id", (F.col("start_s") + 1.25).alias("boundary_s"))).select("recording_id", "seq")


@query(f"""WITH {t.SEGMENTS_SQL}, {t.TURNS_SQL}, c AS (SELECT DISTINCT recording_id, CAST(floor(start_s / 28) AS BIGINT) AS chunk FROM seg), h AS (
    SELECT c.recording_id, chunk, turn_seq, turn_speaker AS speaker, greatest(turn_start, chunk * 28.0) - chunk * 28.0 AS a, least(turn_end, chunk * 28.0 + 28) - chunk * 28.0 AS b
    FROM c JOIN turns ON c.recording_id = turns.recording_id AND turn_end > chunk * 28.0 AND turn_start < chunk * 28.0 + 28),
    f AS (SELECT *, CASE WHEN lag(turn_seq) OVER w IS NULL OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY a, turn_seq)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, chunk ORDER BY a, turn_seq ROWS UNBOUNDED PRECEDING) AS run FROM f),
    g AS (SELECT recording_id, chunk, run, min(speaker) AS speaker, round(min(a), 6) AS from_s, round(max(b), 6) AS to_s FROM r GROUP BY ALL)
    SELECT recording_id, chunk, speaker, from_s, to_s, CAST(run AS INTEGER) AS nr FROM g WHERE run <= 12""")
def diarization_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = t.segments(spark, sf_dir).select("recording_id", F.floor(F.col("start_s") / 28).alias("chunk")).distinct().selectExpr("recording_id", "chunk", "chunk * 28.0D as chunk_start", "chunk * 28.0D + 28 as chunk_end")
    return intervals.hints(chunks, t.turns(spark, sf_dir)).selectExpr("recording_id", "chunk", "speaker", "round(from_s, 6) as from_s", "round(to_s, 6) as to_s", "nr")


@query(f"""WITH {t.SEGMENTS_SQL}, r AS (SELECT recording_id, seq, start_s, CAST(floor(start_s / 300) AS INTEGER) AS win, speaker AS local_id FROM seg), m AS (SELECT DISTINCT recording_id, win, local_id, local_id AS g FROM r WHERE win = 0 AND local_id = 0),
    f AS (SELECT recording_id, win, local_id, min(start_s) AS s FROM r GROUP BY ALL), top AS (SELECT recording_id, max(g) AS t FROM m GROUP BY ALL),
    l AS (SELECT f.recording_id, f.win, f.local_id, coalesce(t, -1) + row_number() OVER (PARTITION BY f.recording_id ORDER BY s, f.win, f.local_id) AS g FROM f LEFT JOIN top USING (recording_id) WHERE (f.recording_id, f.win, f.local_id) NOT IN (SELECT (recording_id, win, local_id) FROM m))
    SELECT r.recording_id, r.seq, CAST(coalesce(m.g, l.g, 0) AS INTEGER) AS global_id FROM r LEFT JOIN m USING (recording_id, win, local_id) LEFT JOIN l USING (recording_id, win, local_id)""")
def global_speaker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.segments(spark, sf_dir).selectExpr("recording_id", "seq", "start_s", "cast(floor(start_s / 300) as int) as window", "speaker as local_id")
    mapped = rows.where("window = 0 and local_id = 0").selectExpr("recording_id", "window", "local_id", "local_id as global_id").distinct()
    return intervals.global_ids(rows, mapped).select("recording_id", "seq", "global_id")


@query("""WITH a AS (SELECT conv_id AS recording_id, turn AS chunk, CASE WHEN turn % 5 = 0 THEN ' ' ELSE text END AS text FROM conversations WHERE turn % 7 <> 1), b AS (SELECT conv_id AS recording_id, turn AS chunk, upper(role) AS text FROM conversations WHERE turn % 4 <> 2)
    SELECT recording_id, chunk, CASE WHEN coalesce(trim(a.text), '') = '' THEN b.text WHEN coalesce(trim(b.text), '') = '' THEN a.text END AS only_text FROM a FULL JOIN b USING (recording_id, chunk)""")
def engine_chunk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations").selectExpr("conv_id as recording_id", "turn as chunk", "role", "text")
    a = rows.where("chunk % 7 <> 1").withColumn("text", F.expr("case when chunk % 5 = 0 then ' ' else text end"))
    b = rows.where("chunk % 4 <> 2").withColumn("text", F.upper("role"))
    return intervals.engine_pairs(a, b).select("recording_id", "chunk", F.col("only").alias("only_text"))


@query(f"""WITH {t.SEGMENTS_SQL} SELECT recording_id, CAST(floor(start_s / 300) AS BIGINT) AS win, speaker, seq FROM seg
    QUALIFY row_number() OVER (PARTITION BY recording_id, floor(start_s / 300), speaker ORDER BY end_s - start_s DESC, start_s, seq) = 1""")
def longest_segment_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.segments(spark, sf_dir).withColumn("win", F.floor(F.col("start_s") / 300))
    return intervals.longest_per_speaker(rows, ["recording_id", "win", "speaker"]).select("recording_id", "win", "speaker", "seq")


@query(f"WITH {t.SEGMENTS_SQL} SELECT recording_id, speaker, round(sum(end_s - start_s), 6) AS talk_s, round(avg(1.0 / (1 + seq)), 6) AS confidence FROM seg GROUP BY ALL")
def talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(spark, sf_dir).groupBy("recording_id", "speaker").agg(F.round(F.sum(F.col("end_s") - F.col("start_s")), 6).alias("talk_s"), F.round(F.avg(1.0 / (1 + F.col("seq"))), 6).alias("confidence"))


@query("SELECT recording_id, n, n > 6 AND recording_id % 2 = 0 AS hint FROM (SELECT conv_id AS recording_id, count(DISTINCT CASE WHEN turn <> 3 THEN turn % 8 END) AS n FROM conversations GROUP BY ALL)")
def speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different speakers, and whether to ask for their number: many were found, and it was left to the engine."""
    rows = t.segments(spark, sf_dir).withColumn("speaker", F.expr("case when seq <> 3 then seq % 8 end"))
    return library.speaker_hint(rows, F.col("recording_id") % 2 == 0)


_RUNS_SQL = """rs AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_s, seq ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN row_number() OVER w > 1 AND speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM seg WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, seq)))"""


@query(f"WITH {t.SEGMENTS_SQL}, {_RUNS_SQL} SELECT recording_id, seq, CAST(run AS INTEGER) AS run FROM rs")
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(t.segments(spark, sf_dir)).select("recording_id", "seq", "run")


@query(f"""WITH {t.SEGMENTS_SQL}, {_RUNS_SQL}, i AS (SELECT *, coalesce(start_s - max(end_s) OVER (PARTITION BY recording_id, run ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 0.5, false) AS cut FROM (SELECT * REPLACE (end_s - (seq % 2) AS end_s) FROM rs)),
    j AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY recording_id, run ORDER BY start_s, seq ROWS UNBOUNDED PRECEDING) AS island FROM i)
    SELECT recording_id, min(seq) AS seq, min(speaker) AS speaker, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, string_agg(text, ' ' ORDER BY start_s, seq) AS text, count(*) AS n FROM j GROUP BY recording_id, run, island""")
def turns_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.segments(spark, sf_dir).withColumn("end_s", F.col("end_s") - F.col("seq") % 2)
    found = sequences.coalesce_turns(rows, 0.5)
    return found.withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))


@query(f"""WITH {t.SEGMENTS_SQL}, {_RUNS_SQL}, e AS (SELECT recording_id, run, min(speaker) AS sp, min(start_s) AS a, max(end_s) AS b FROM rs GROUP BY ALL),
    s AS (SELECT *, lag(sp) OVER w AS p, lead(sp) OVER w AS q, lag(run) OVER w AS pr, lead(run) OVER w AS qr, count(*) OVER (PARTITION BY recording_id) AS n FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY run))
    SELECT rs.recording_id, rs.seq, CASE WHEN n >= 3 AND pr IS NOT NULL AND qr IS NOT NULL AND p IS NOT DISTINCT FROM q AND b - a < 40 THEN p ELSE sp END AS smoothed FROM rs JOIN s USING (recording_id, run)""")
def sandwiches_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.smooth_sandwiches(t.segments(spark, sf_dir), 40.0).select("recording_id", "seq", "smoothed")


@query(f"""WITH {t.SEGMENTS_SQL}, f AS (SELECT recording_id, role, min(start_s) AS s FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s) - 1 AS k FROM f)
    SELECT seg.recording_id, seq, CAST(k AS INTEGER) AS renumbered FROM seg JOIN r USING (recording_id, role)""")
def speakers_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.renumber(t.segments(spark, sf_dir), "role").select("recording_id", "seq", "renumbered")


@query(f"""WITH {t.SEGMENTS_SQL}, {_FOUR_SQL}, m AS (SELECT *, CASE speaker WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE speaker END AS k FROM four), f AS (SELECT recording_id, k, min(start_s) AS s FROM m GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s) - 1 AS n FROM f) SELECT m.recording_id, seq, CAST(n AS INTEGER) AS renumbered FROM m JOIN r USING (recording_id, k)""")
def speakers_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(2, 0), (3, 1)], "speaker int, to int")
    return sequences.remap(_four(spark, sf_dir), mapping).select("recording_id", "seq", "renumbered")


@query(f"WITH {t.SEGMENTS_SQL}, x AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'Um, uh.' WHEN 1 THEN 'hmm 7' WHEN 2 THEN '...' ELSE text END AS said FROM seg) SELECT recording_id, seq FROM x WHERE seq % 4 IN (1, 3)")
def fillers_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.segments(spark, sf_dir).withColumn("said", F.expr("case seq % 4 when 0 then 'Um, uh.' when 1 then 'hmm 7' when 2 then '...' else text end"))
    return sequences.drop_fillers(rows, "said").select("recording_id", "seq")


@query(f"""WITH RECURSIVE {t.SEGMENTS_SQL}, x AS (SELECT recording_id, seq, CAST(seq % 2 AS INTEGER) AS sp, seq % 2 = 1 AS reply, row_number() OVER w AS k, lead(CAST(seq % 2 AS INTEGER)) OVER w AS next FROM seg WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, seq)),
    f AS (SELECT recording_id, seq, k, sp, sp AS absorbed FROM x WHERE k = 1
        UNION ALL SELECT x.recording_id, x.seq, x.k, x.sp, CASE WHEN x.reply AND x.next IS NOT NULL AND f.absorbed = x.next THEN f.absorbed ELSE x.sp END FROM f JOIN x ON x.recording_id = f.recording_id AND x.k = f.k + 1)
    SELECT recording_id, seq, sp AS speaker, absorbed FROM f""")
def backchannels_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.segments(spark, sf_dir).withColumn("speaker", F.expr("cast(seq % 2 as int)")).withColumn("text", F.expr("case when seq % 2 = 1 then 'Yeah.' else text end")).withColumn("end_s", F.expr("case when seq % 2 = 1 then start_s + 1 else end_s end"))
    return sequences.absorb_backchannels(rows).select("recording_id", "seq", "speaker", "absorbed")


@query(f"WITH {t.SEGMENTS_SQL} SELECT recording_id, seq FROM seg WHERE end_s > 45.0")
def recap_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(spark, sf_dir).where("end_s > 45.0").select("recording_id", "seq")


@query(f"WITH {t.SEGMENTS_SQL} SELECT recording_id, seq, right(lag(text) OVER (PARTITION BY recording_id ORDER BY seq), 200) AS context FROM seg")
def previous_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.context_tail(t.segments(spark, sf_dir), 200).select("recording_id", "seq", "context")


#: Events as frames of sound: a level for each event of a user.
_FRAMES_SQL = "frames AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, abs(value) % 1.0 / 40 AS rms FROM events)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").selectExpr("user_id as recording_id", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as long) as frame", "abs(value) % 1.0D / 40 as rms")


@query(f"""WITH {_FRAMES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY rms, frame) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM frames),
    l AS (SELECT recording_id, least(greatest(2 * rms, 0.005), 0.02) AS th FROM r WHERE k = n // 5 + 1), q AS (SELECT f.*, rms < th AS quiet FROM frames f JOIN l USING (recording_id)),
    i AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM q)
    SELECT recording_id, round(min(frame) * CAST(0.025 AS DOUBLE), 6) AS start_s, round((max(frame) + 1) * CAST(0.025 AS DOUBLE), 6) AS end_s FROM i WHERE quiet GROUP BY recording_id, island HAVING count(*) * 0.025 >= 0.05 - 1e-9""")
def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.silence_runs(_frames(spark, sf_dir), least_s=0.05).selectExpr("recording_id", "round(start_s, 6) as start_s", "round(end_s, 6) as end_s")


@query(f"""WITH RECURSIVE {t.SEGMENTS_SQL}, r AS (SELECT recording_id, max(end_s) AS d, list((end_s - 0.2 + (end_s + 0.2)) / 2) AS mids FROM (SELECT recording_id, CAST(end_s AS DOUBLE) AS end_s FROM seg) GROUP BY ALL),
    c AS (SELECT recording_id, CAST(-1 AS INTEGER) AS nr, CAST(0 AS DOUBLE) AS cut_s, false AS at_silence FROM r
        UNION ALL SELECT recording_id, nr + 1, coalesce(m, cut_s + 28), m IS NOT NULL
        FROM (SELECT c.*, r.d, list_max(list_filter(mids, lambda m: m >= cut_s + 28 - 2 AND m <= cut_s + 28 AND m > cut_s + 1)) AS m FROM c JOIN r USING (recording_id)) WHERE d - cut_s > 30)
    SELECT recording_id, nr, round(cut_s, 6) AS cut_s, at_silence FROM c WHERE nr >= 0""")
def audio_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir)
    quiet = seg.selectExpr("recording_id", "end_s - 0.2 as start_s", "end_s + 0.2 as end_s")
    return sequences.cut_points(quiet, seg.groupBy("recording_id").agg(F.max("end_s").alias("duration_s"))).withColumn("cut_s", F.round("cut_s", 6))


@query(f"WITH {_FRAMES_SQL} SELECT recording_id, frame // 10 AS win, round(sqrt(avg(rms * rms)), 9) AS level FROM frames GROUP BY ALL HAVING sqrt(avg(rms * rms)) >= 0.002")
def loud_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).groupBy("recording_id", F.expr("frame div 10").alias("win")).agg(F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("l")).where("l >= 0.002").select("recording_id", "win", F.round("l", 9).alias("level"))


@query("""WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value AS p20 FROM v WHERE k = n // 5 + 1""")
def fifth_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").selectExpr("user_id", "value", "row_number() over (partition by user_id order by value, event_id) as k", "count(*) over (partition by user_id) as n").where("k = n div 5 + 1").selectExpr("user_id", "value as p20")


@query(f"""WITH {_FRAMES_SQL}, fine AS (SELECT recording_id, frame // 4 AS k, max(abs(rms)) AS peak FROM frames GROUP BY ALL), n AS (SELECT recording_id, count(*) AS n FROM fine GROUP BY ALL)
    SELECT recording_id, CAST(b AS INTEGER) AS bucket, round(coalesce((SELECT avg(peak) FROM fine f WHERE f.recording_id = n.recording_id AND k >= floor(b * n / 8.0) AND k < floor((b + 1) * n / 8.0)),
        (SELECT peak FROM fine f WHERE f.recording_id = n.recording_id AND k = floor(b * n / 8.0)), 0), 9) AS level FROM n, unnest(range(8)) u(b)""")
def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = _frames(spark, sf_dir).groupBy("recording_id", F.expr("frame div 4").alias("k")).agg(F.max(F.abs("rms")).alias("peak"))
    packed = fine.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "peak"))), lambda x: x["peak"]).alias("p"))
    part = packed.select("recording_id", "p", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bucket")).selectExpr("recording_id", "bucket", "p", "cast(floor(bucket * size(p) / 8.0D) as int) as lo", "cast(floor((bucket + 1) * size(p) / 8.0D) as int) as hi")
    return part.selectExpr("recording_id", "bucket", "round(case when hi > lo then aggregate(slice(p, lo + 1, hi - lo), 0D, (a, x) -> a + x) / (hi - lo) when lo < size(p) then p[lo] else 0D end, 9) as level")


@query("""WITH w AS (SELECT user_id, ts, event_id, event_type FROM events), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM w),
    y AS (SELECT *, sum(CASE WHEN nr = 1 OR event_type < 'm' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY nr ROWS UNBOUNDED PRECEDING) AS g FROM x)
    SELECT user_id AS recording_id, CAST(g AS INTEGER) AS word_nr, string_agg(event_type, '' ORDER BY nr) AS text FROM y GROUP BY user_id, g""")
def words_of_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = t.table(spark, sf_dir, "events").selectExpr("user_id as recording_id", "row_number() over (partition by user_id order by ts, event_id) as nr", "concat(case when event_type < 'm' then '▁' else '' end, event_type) as token", "1.0D as at_s", "cast(null as double) as len_s")
    return sequences.subword_words(tokens).select("recording_id", "word_nr", "text")


@query(f"""WITH {t.SEGMENTS_SQL}, p AS (SELECT recording_id, seq, list_transform(range(1, 6), lambda i: least(greatest((seq * i % 11) / 10.0, 1e-6), 1)) AS ps FROM seg)
    SELECT recording_id, seq, round(exp(list_sum([ln(x) FOR x IN ps]) / 5), 9) AS confidence FROM p""")
def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.segments(spark, sf_dir).selectExpr("recording_id", "seq", "explode(sequence(1, 5)) as i").selectExpr("recording_id", "seq", "least(greatest(cast(seq * i % 11 as double) / 10, 1e-6), 1) as p")
    return rows.groupBy("recording_id", "seq").agg(F.round(F.exp(F.avg(F.ln("p"))), 9).alias("confidence"))


@query("SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("window_start"), "n", "total")
