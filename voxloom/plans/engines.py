"""Queries on windows, engines, vocabularies and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as ft
from voxloom.functions import words as fw
from voxloom.operators import diarization
from voxloom.plans.registry import query
from voxloom.sources import tables as t


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in windows of 300 s that begin 45 s before the last one's end."""
    return t.segments(spark, sf_dir).selectExpr("recording_id", "seq", "cast(floor(start_s / 255) as int) as window", "floor(start_s / 255) * 255.0D as window_start", "cast(seq % 3 as int) as local_id", "start_s", "end_s")


@query(f"WITH {t.SEGMENTS_SQL} SELECT recording_id, seq FROM seg WHERE floor(start_s / 255) = 0 OR end_s - floor(start_s / 255) * 255 > 45")
def window_recap_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.drop_recap(_windows(spark, sf_dir)).select("recording_id", "seq")


@query()
def diarized_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _windows(spark, sf_dir)
    vectors = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    size = vectors.agg(F.max("v") + 1).first()[0] or 1
    keys = rows.select("recording_id", "seq", F.expr(f"(recording_id * 7 + local_id * 11) % {size}").alias("v"))
    return diarization.whole_recording(rows, keys.join(vectors, "v").select("recording_id", "seq", "embedding"))


@query(f"""WITH {t.SEGMENTS_SQL}, c AS (SELECT recording_id, CAST(k AS INTEGER) AS nr, CASE WHEN k % 2 = 0 THEN k * 28.0 ELSE greatest(k * 28.0 - 3, 0) END AS a, (k + 1) * 28.0 AS b FROM (SELECT recording_id, unnest(range(CAST(ceil(d / 28) AS BIGINT))) AS k FROM (SELECT recording_id, max(end_s) AS d FROM seg GROUP BY ALL)))
    SELECT s.recording_id, s.seq, nr FROM seg s JOIN c ON s.recording_id = c.recording_id AND s.start_s >= a AND s.start_s < b""")
def samples_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir)
    cuts = seg.groupBy("recording_id").agg(F.max("end_s").alias("d")).selectExpr("recording_id", "explode(sequence(0, cast(ceil(d / 28) as int) - 1)) as nr").selectExpr("recording_id", "nr", "nr * 28.0D as from_s", "(nr + 1) * 28.0D as to_s", "nr % 2 = 0 as at_silence")
    return diarization.chunk_samples(seg.withColumn("at_s", F.col("start_s")), cuts, 3.0).select("recording_id", "seq", "nr")


@query()
def ensemble_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as heard by two engines; the second one heard the same, nothing, other words, or got stuck."""
    d = t.spread(t.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("text_a")))
    b = F.when(F.col("turn") % 4 == 0, F.col("text_a")).when(F.col("turn") % 4 == 1, "").when(F.col("turn") % 4 == 2, F.regexp_replace("text_a", r"\b(the|de|la|der)\b", "a")).otherwise(F.repeat(F.lit("la la "), F.lit(20)))
    merged = fw.arrow(lambda x, y: fw.vote([(w, 0.8) for w in x.split()], [(w, 0.9) for w in y.split()]), "string")("text_a", "text_b")
    pairs = d.withColumn("text_b", b).withColumn("seconds", F.lit(20.0)).withColumn("_m", merged)
    return diarization.decide(pairs, F.col("_m")).select("conv_id", "turn", "text", "ask", F.round("agreement", 6).alias("agreement"))


@query(r"""WITH w AS (SELECT conv_id, turn, text, string_split(text, ' ') AS a FROM conversations), b AS (SELECT *, [CASE WHEN length(x) > 6 THEN 'x' || reverse(x) ELSE x END FOR x IN a] AS b FROM w),
    k AS (SELECT *, [i FOR i IN range(1, len(a) + 1) IF regexp_replace(lower(a[i]), '[^\p{L}\p{Nd}]', '', 'g') <> regexp_replace(lower(b[i]), '[^\p{L}\p{Nd}]', '', 'g')] AS d FROM b)
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN array_to_string([regexp_replace(CASE WHEN i IN (d[1], d[3]) THEN b[i] ELSE a[i] END, '\s+', ' ', 'g') FOR i IN range(1, len(a) + 1)], ' ') ELSE text END AS text FROM k""")
def arbitrated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.split("text", " ").alias("words_a"))
    rows = d.withColumn("words_b", F.transform("words_a", lambda w: F.when(F.length(w) > 6, F.concat(F.lit("x"), F.reverse(w))).otherwise(w))).withColumn("text", F.array_join("words_a", " "))
    replies = d.where("key.turn % 2 = 0").select("key", F.array(F.lit(1), F.lit(0), F.lit(1)).alias("choices"))
    return diarization.arbitrated(rows, replies).select("key.conv_id", "key.turn", "text")


@query("SELECT doc_id, CASE WHEN lower(lang) = 'ar' THEN 'omnilingual' ELSE 'parakeet' END AS engine, CASE WHEN lang = 'en' THEN 0.5 ELSE 0.7 END::DOUBLE AS threshold FROM documents")
def engine_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", diarization.engine(F.col("lang")).alias("engine"), diarization.threshold(F.array("lang")).alias("threshold"))


@query("SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey % 2 = 0")
def engine_pairs_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = t.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), (F.col("n_nationkey") % 2 == 0).alias("ready_a"), (F.col("n_regionkey") % 2 == 0).alias("ready_b"))
    return diarization.ready_pairs(pairs).select("a", "b")


@query("SELECT p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS option FROM part WHERE p_retailprice > 910 GROUP BY p_brand")
def first_available_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = t.table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("option"), F.col("p_size").alias("priority"), (F.col("p_retailprice") > 910).alias("available"))
    return diarization.first_available(options, "p_brand")


@query("""SELECT p_brand, p_partkey, p_size FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 97 = 5 THEN 0 WHEN p_type = 'LARGE' THEN 1 WHEN p_type <> 'SMALL' THEN 2 ELSE 3 END, p_size DESC, p_partkey) = 1""")
def largest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that a run in Ukrainian or Dutch uses: the pinned one, one made for the language, the largest general one, any."""
    rows = t.table(spark, sf_dir, "part")
    languages = F.expr("case p_type when 'LARGE' then array('uk', 'pl') when 'SMALL' then array('ar') end")
    models = rows.withColumn("languages", languages).withColumn("pinned", F.col("p_partkey") % 97 == 5)
    return diarization.pick_model(models, "p_brand", "p_size", "p_partkey", ["uk", "nl"]).select("p_brand", "p_partkey", "p_size")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY source")
def catalogue_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").where("text is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("""SELECT n_name AS term FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_name || '!' FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 3 = 0""")
def terms_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = t.table(spark, sf_dir, "nation")
    learned = nation.select(ft.key(F.col("n_name")).alias("key"), F.concat("n_name", F.lit("!")).alias("spelling"), "n_nationkey")
    return diarization.promote(nation.where("n_nationkey < 10").select(F.col("n_name").alias("term")), learned, learned.where("n_nationkey % 3 = 0"))[0]


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 <> 1")
def terms_not_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", ft.key(F.col("n_name")).alias("key"))
    return nation.join(nation.where("n_nationkey % 4 = 1").select("key"), "key", "left_anti").select("n_nationkey", "n_name")


@query("SELECT conv_id, turn, 'Speak ' || role || ': ' || text || ' {snippet:none} ' || role AS prompt FROM conversations")
def prompts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ft.fill_template(F.lit("Speak {language_hint}: {transcript} {snippet:none} {snippet:who}"), {"language_hint": F.col("role"), "transcript": F.col("text"), "snippet:who": F.col("role")})
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("prompt"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['en', 'nl'] ELSE ['uk'] END AS languages, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'en,nl' ELSE 'uk' END AS csv FROM documents")
def language_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case doc_id % 3 when 0 then '' when 1 then ' EN,nl,,en' else 'uk' end")
    parts = F.array_distinct(F.filter(F.transform(ft.csv_list(raw), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return t.table(spark, sf_dir, "documents").select("doc_id", parts.alias("languages"), F.array_join(parts, ",").alias("csv"))


@query("SELECT event_id, greatest(value - 10, 0) AS elapsed, ts < TIMESTAMP '2024-01-10' AS stale FROM events")
def elapsed_and_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").select("event_id", F.greatest(F.col("value") - 10, F.lit(0.0)).alias("elapsed"), (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))).alias("stale"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def latest_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
