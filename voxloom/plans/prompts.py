"""Queries on prompts, names of languages and models, and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import prompts as fp
from voxloom.functions import words as fw
from voxloom.operators import library
from voxloom.plans.registry import query
from voxloom.sources import tables as t


def _said(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, names: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_said(k)} THEN {_said(v)}" for k, v in names.items()) + f" ELSE {other} END"


_CODES = "CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['AR'] WHEN 2 THEN ['en', 'NL', 'EN'] WHEN 3 THEN ['xx'] ELSE [lang] END"


def _codes() -> F.Column:
    return F.expr("case doc_id % 5 when 0 then cast(array() as array<string>) when 1 then array('AR') when 2 then array('en', 'NL', 'EN') when 3 then array('xx') else array(lang) end")


_SYSTEM_NAME = _case("c", fp.SYSTEM_NAMES, "'the language with ISO code ''' || c || ''''")
_AUDIO_HINT = f"""CASE WHEN len(codes) = 0 THEN {_said(fp.ANY_LANGUAGE)} WHEN len(codes) = 1 THEN 'The audio is in ' || {_case('codes[1]', fp.HINT_NAMES, "'the language identified by ISO code ''' || codes[1] || ''''")} || '.'
    ELSE {_said(fp.ONE_OF[0])} || array_to_string([{_SYSTEM_NAME} FOR c IN codes], ', ') || {_said(fp.ONE_OF[1])} END"""
_DISTINCT = f"d AS (SELECT *, CASE WHEN doc_id % 5 = 2 THEN ['en', 'nl'] ELSE list_transform({_CODES}, lambda x: lower(x)) END AS codes FROM documents)"


@query(f"""WITH {_DISTINCT} SELECT doc_id, {_AUDIO_HINT} AS audio, CASE WHEN lang IS NULL OR lower(lang) IN ('', 'auto') THEN 'The transcript may be in any language.' ELSE 'The transcript is in ' || {_case('lower(lang)', fp.HINT_NAMES, "'language code ''' || lang || ''''")} || '.' END AS transcript FROM d""")
def language_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", fp.audio_hint(_codes()).alias("audio"), fp.transcript_hint(F.col("lang")).alias("transcript"))


_FILES = [*fp.EMBEDDING_MODELS, "other.onnx"]
_IDS = [*fp.CATEGORIES, "x"]


@query(f"""WITH p AS (SELECT p_partkey, [{', '.join(map(_said, _FILES))}][p_partkey % 4 + 1] AS file, [{', '.join(map(_said, _IDS))}][p_partkey % 5 + 1] AS id FROM part)
    SELECT p_partkey, {_case('file', fp.EMBEDDING_MODELS, 'NULL')} AS model, {_case('id', fp.CATEGORIES, 'NULL')} AS category FROM p""")
def names_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.array(*map(F.lit, names))[(F.col("p_partkey") % n).cast("int")]
    return t.table(spark, sf_dir, "part").select("p_partkey", fp.looked_up(pick(_FILES, 4), fp.EMBEDDING_MODELS).alias("model"), fp.looked_up(pick(_IDS, 5), fp.CATEGORIES).alias("category"))


@query(f"""WITH {_DISTINCT}, v AS (SELECT *, list_transform(range(CAST(doc_id % 7 * 50 AS BIGINT)), lambda k: 'Term' || k) AS terms FROM d),
    e AS (SELECT *, [x FOR x IN [CASE WHEN len(terms) > 0 THEN {_said(fp.VOCABULARY[0])} || array_to_string(terms[1:{fp.SYSTEM_TERMS}], ', ') || {_said(fp.VOCABULARY[1])} END,
        CASE WHEN doc_id % 2 = 0 THEN {_said(fp.NO_FILLERS)} END, CASE WHEN doc_id % 3 = 0 THEN {_said(fp.VERBATIM)} END, CASE WHEN doc_id % 11 = 0 THEN 'Tone: formal.' END] IF x IS NOT NULL] AS parts FROM v)
    SELECT doc_id, 'Transcribe. ' || {_AUDIO_HINT} || CASE WHEN len(parts) = 0 THEN '' ELSE {_said(fp.EXTRAS)} || array_to_string(parts, chr(10) || '- ') END AS system, array_to_string(terms[1:{fp.DECODER_TERMS}], ', ') AS decoder FROM e""")
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.expr("transform(slice(sequence(0, 400), 1, cast(doc_id % 7 * 50 as int)), k -> concat('Term', k))")
    system = fp.system_prompt(F.lit("Transcribe. {language_hint}"), _codes(), terms, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 11 == 0, "Tone: formal."))
    return t.table(spark, sf_dir, "documents").select("doc_id", system.alias("system"), fp.decoder_prompt(terms).alias("decoder"))


_MESSAGE_NAME = _case("c", fp.MESSAGE_NAMES, "'the language with ISO code ''' || c || ''''")


@query(f"""WITH d AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN [] WHEN 1 THEN ['ar'] WHEN 2 THEN ['en', 'uk'] ELSE ['xx'] END AS codes, CASE WHEN conv_id % 3 = 0 THEN 'nl' END AS target, turn % 2 = 0 AS verbatim,
        lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context, turn AS recap_s, conv_id % 2 = 0 AS diarize, CASE WHEN turn = 5 THEN true ELSE false END AS hinted FROM conversations),
    n AS (SELECT *, array_to_string([{_MESSAGE_NAME} FOR c IN codes], ' or ') AS names FROM d)
    SELECT conv_id, turn, CASE WHEN target IS NOT NULL THEN 'Translate the following speech segment in ' || CASE len(codes) WHEN 0 THEN 'the source language' WHEN 1 THEN names ELSE 'one of ' || names END || ' into natural Dutch text. '
        WHEN len(codes) = 0 THEN 'Transcribe the following speech segment into text in its spoken language. ' WHEN len(codes) = 1 THEN 'Transcribe the following speech segment in ' || names || ' into ' || names || ' text. '
        ELSE 'Transcribe the following speech segment into text. The speech is in ' || names || '; detect which and transcribe in that language exactly as heard. ' END
        || CASE WHEN verbatim THEN '' ELSE {_said(fp.PUNCTUATION)} END || {_said(fp.OUTPUT)} || CASE WHEN context IS NULL OR trim(context) = '' THEN '' ELSE {_said(fp.CONTINUITY[0])} || right(context, {fp.CONTEXT_CHARS}) || {_said(fp.CONTINUITY[1])} END
        || CASE WHEN recap_s >= 2 THEN {_said(fp.RECAP[0])} || recap_s || '.0' || {_said(fp.RECAP[1])} ELSE '' END
        || CASE WHEN hinted THEN {_said(fp.HINTS[0])} || '- 0.0–4.5s: Speaker 1' || chr(10) || '- 4.5–12.0s: Speaker 3' || chr(10) || {_said(fp.HINTS[1])} WHEN diarize THEN {_said(fp.SPEAKERS)} ELSE '' END AS message FROM n""")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.expr("case turn % 4 when 0 then cast(array() as array<string>) when 1 then array('ar') when 2 then array('en', 'uk') else array('xx') end")
    hints = F.expr("case when turn = 5 then array(struct(0.0D as from_s, 4.5D as to_s, 0 as speaker), struct(4.5D as from_s, 12.0D as to_s, 2 as speaker)) end")
    message = fp.user_message(codes, F.when(F.col("conv_id") % 3 == 0, "nl"), F.col("turn") % 2 == 0, F.expr("lag(text) over (partition by conv_id order by turn)"), F.col("turn").cast("double"), hints, F.col("conv_id") % 2 == 0)
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", message.alias("message"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN ['b'] WHEN 1 THEN ['c', 'b'] ELSE ['x'] END AS kept FROM nation""")
def vocabulary_pack_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary, kept as text, without the terms of a pack."""
    stored = F.expr("case n_nationkey % 3 when 0 then 'a, b\\n\\nb' when 1 then 'c\\na,b, c ' else ' x ,a' end")
    return t.table(spark, sf_dir, "nation").select("n_nationkey", library.without_pack(stored, F.array(F.lit("a"), F.lit("d"))).alias("kept"))


@query()
def prompt_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript that a prompt holds: times, speakers and texts without stutters."""
    seg = t.segments(spark, sf_dir).withColumn("text", F.expr("case when seq % 2 = 0 then concat('um, so I I mean, ', text) else text end"))
    return library.prompt_transcript(seg.withColumn("text", fw.destuttered(F.trim("text"))), "role")
