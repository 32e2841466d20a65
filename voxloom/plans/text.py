"""Queries on words: harvest, agreement of readings, differences, stutters, exports, parsers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions import mentions
from voxloom.functions import text as ft
from voxloom.functions import words as fw
from voxloom.operators import merges, names
from voxloom.plans.registry import query
from voxloom.sources import export
from voxloom.sources import tables as t
from voxloom.streaming import live

_KEY = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"


@query(f"SELECT doc_id, {_KEY.format('text')} AS key, len(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS n_words, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_tokens FROM documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents")
    return d.select("doc_id", ft.key(F.col("text")).alias("key"), F.size(ft.word_tokens(F.col("text"))).cast("long").alias("n_words"), F.size(ft.whitespace_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT conv_id, turn, role || ':' || regexp_replace(trim(text), '\\s{2,}', ' ', 'g') AS line, left(text, 5) AS head, right(text, 5) AS tail FROM conversations")
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat_ws(":", "role", ft.clean_spaces(F.col("text"))).alias("line"), F.left("text", F.lit(5)).alias("head"), F.right("text", F.lit(5)).alias("tail"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration,
    lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(CAST(floor(x * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS srt
    FROM (SELECT o_orderkey, o_totalprice / 16 AS x, CAST(floor(o_totalprice / 16) AS BIGINT) AS s FROM orders)""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").withColumn("x", F.col("o_totalprice") / 16)
    return rows.select("o_orderkey", ft.duration(F.col("x")).alias("duration"), ft.srt_time(F.col("x")).alias("srt"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%H:%M') AS clock, upper(strftime(o_orderdate, '%-d %b')) AS day, CAST(o_orderdate AS DATE) = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS is_today FROM orders")
def clock_and_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    orders = t.table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate").cast("timestamp").alias("now")).first().now
    return orders.select("o_orderkey", F.date_format(ts, "HH:mm").alias("clock"), F.upper(F.date_format(ts, "d MMM")).alias("day"), ft.is_same_day(ts, F.lit(now)).alias("is_today"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""")
def cosine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")).join(b, "a").select("a", "b", F.round(ft.cosine_distance(F.col("ea"), F.col("eb")), 6).alias("distance"))


_PAIR = "p AS (SELECT a.doc_id, list_filter(string_split_regex(lower(a.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS wa, list_filter(string_split_regex(lower(b.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS wb FROM documents a JOIN documents b ON a.doc_id + 1 = b.doc_id)"


@query(f"""WITH {_PAIR}, ca AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(wa) AS w FROM p) GROUP BY ALL), cb AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(wb) AS w FROM p) GROUP BY ALL),
    c AS (SELECT ca.doc_id, sum(least(ca.n, cb.n)) AS c FROM ca JOIN cb USING (doc_id, w) GROUP BY ALL)
    SELECT p.doc_id, round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE 2.0 * coalesce(c, 0) / (len(wa) + len(wb)) END, 6) AS dice FROM p LEFT JOIN c USING (doc_id)""")
def reading_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = d.select("doc_id", F.col("text").alias("a")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")
    return names.agreement(pairs, "doc_id", F.col("a"), F.col("b"), 2 * t.text_parts(d, "text")).withColumn("dice", F.round("dice", 6))


#: Text that a failed chunk ends with, by document.
_FAILED = ["go to the go to the go to the go to the end", "I cannot transcribe this.", ""]
_SUFFIX = "CASE doc_id % 5 WHEN 0 THEN ' " + _FAILED[0] + "' WHEN 1 THEN ' " + _FAILED[1] + "' ELSE '' END"


@query(f"""WITH x AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text || {_SUFFIX}, '^\\s+', ''), '\\s+$', '') AS body FROM documents UNION ALL SELECT -1 - conv_id * 100 - turn, role FROM conversations),
    l AS (SELECT *, length(body) AS n, string_split(regexp_replace(body, '\\s+', ' ', 'g'), ' ') AS ws FROM x),
    w AS (SELECT id, k, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM l, (SELECT unnest(range(2, 6)) AS k)),
    e AS (SELECT id, k, i, coalesce(w = lead(w, k) OVER (PARTITION BY id, k ORDER BY i), false) AS same FROM w),
    g AS (SELECT id, k, same, sum(CAST(NOT same AS INTEGER)) OVER (PARTITION BY id, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM e),
    loops AS (SELECT DISTINCT id FROM (SELECT id, k, island FROM g WHERE same GROUP BY ALL HAVING count(*) >= 3 * k))
    SELECT id, round(least(CASE WHEN n < 12 THEN 0.6 WHEN n < 60 THEN 0.3 ELSE 0.0 END + CASE WHEN id IN (SELECT id FROM loops) THEN 0.7 ELSE 0.0 END
        + CASE WHEN regexp_matches(lower(body), '{"|".join(x.replace("'", "''") for x in ft.REFUSALS)}') THEN 0.8 ELSE 0.0 END + CASE WHEN n > 30 AND regexp_matches(body, '\\p{{L}}$') THEN 0.15 ELSE 0.0 END, 1.0)::DOUBLE, 6) AS score FROM l""")
def chunk_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, some with the end of a failed chunk, and texts that are far too short for their sound."""
    end = F.when(F.col("doc_id") % 5 == 0, " " + _FAILED[0]).when(F.col("doc_id") % 5 == 1, " " + _FAILED[1]).otherwise("")
    long = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("text", end).alias("text"))
    short = t.table(spark, sf_dir, "conversations").select((-1 - F.col("conv_id") * 100 - F.col("turn")).alias("id"), F.col("role").alias("text"))
    return long.unionByName(short).select("id", F.round(ft.suspicion(F.col("text"), F.lit(20.0)), 6).alias("score"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each turn, whole: as it is, and with words changed, left out and put in."""
    heard = F.transform(F.split("text", " "), lambda w, i: F.when(i % 7 == 3, F.lit(None)).when(i % 5 == 2, F.reverse(w)).when(i % 11 == 4, F.concat(w, F.lit(" uh"))).otherwise(w))
    return t.spread(t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.col("text").alias("a"), F.array_join(heard, " ").alias("b"))


#: The alignment of both readings of each turn: rows of a cost table, then the way back from its end; ps holds (place in a, place in b), 0 for none, from the end.
_ALIGNED_SQL = rf"""t0 AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations),
    t1 AS (SELECT *, [CASE WHEN (i - 1) % 5 = 2 THEN reverse(ws[i]) WHEN (i - 1) % 11 = 4 THEN ws[i] || ' uh' ELSE ws[i] END FOR i IN range(1, len(ws) + 1) IF (i - 1) % 7 <> 3] AS hs FROM t0),
    t2 AS (SELECT conv_id, turn, [x FOR x IN string_split_regex(array_to_string(ws, ' '), '\s+') IF x <> ''] AS a, [x FOR x IN string_split_regex(array_to_string(hs, ' '), '\s+') IF x <> ''] AS b FROM t1),
    t3 AS (SELECT *, [{_KEY.format("x")} FOR x IN a] AS ka, [{_KEY.format("x")} FOR x IN b] AS kb FROM t2),
    co AS (SELECT conv_id, turn, 0 AS i, ka, kb, range(len(kb) + 1) AS row_ FROM t3
        UNION ALL SELECT conv_id, turn, i, ka, kb, [list_min(base[1:j]) + j - 1 FOR j IN range(1, len(base) + 1)] AS row_
            FROM (SELECT conv_id, turn, i + 1 AS i, ka, kb, [CASE WHEN j = 1 THEN i + 1 ELSE least(row_[j] + 1, row_[j - 1] + CASE WHEN ka[i + 1] = kb[j - 1] THEN 0 ELSE 1 END) - (j - 1) END FOR j IN range(1, len(kb) + 2)] AS base FROM co WHERE i < len(ka))),
    fin AS MATERIALIZED (SELECT conv_id, turn, any_value(ka) AS ka, any_value(kb) AS kb, list(row_ ORDER BY i) AS tab FROM co GROUP BY conv_id, turn),
    tr AS (SELECT conv_id, turn, len(ka) AS i, len(kb) AS j, CAST([] AS STRUCT(i BIGINT, j BIGINT)[]) AS ps FROM fin
        UNION ALL SELECT conv_id, turn, CASE WHEN pair OR alone THEN i - 1 ELSE i END, CASE WHEN alone THEN j ELSE j - 1 END, ps || [{{i: CASE WHEN pair OR alone THEN i ELSE 0 END, j: CASE WHEN alone THEN 0 ELSE j END}}]
        FROM (SELECT conv_id, turn, i, j, ps, pair, NOT pair AND i > 0 AND here = up + 1 AS alone FROM (SELECT conv_id, turn, i, j, ps, tab[i + 1][j + 1] AS here, tab[i][j + 1] AS up, i > 0 AND j > 0 AND tab[i + 1][j + 1] = tab[i][j] + CASE WHEN ka[i] = kb[j] THEN 0 ELSE 1 END AS pair
            FROM tr JOIN fin USING (conv_id, turn) WHERE i > 0 OR j > 0))),
    al AS (SELECT conv_id, turn, a, b, t3.ka, t3.kb, list_reverse(ps) AS ps FROM tr JOIN t3 USING (conv_id, turn) WHERE i = 0 AND j = 0)"""


@query(rf"""WITH RECURSIVE {_ALIGNED_SQL}, p AS (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM al), q AS (SELECT conv_id, turn, k, a[ps[k].i] AS x, b[ps[k].j] AS y, ps[k].i AS i, ps[k].j AS j, ka[ps[k].i] = kb[ps[k].j] AS same,
        0.5 + ((ps[k].i - 1) * 7 % 5) / 10 AS cx, CASE WHEN (ps[k].j - 1) % 3 = 0 THEN 0.7 ELSE 0.5 + ((ps[k].j - 1) * 7 % 5) / 10 END AS cy FROM p),
    w AS (SELECT conv_id, turn, k, CASE WHEN i > 0 AND j > 0 THEN CASE WHEN same OR cx >= cy THEN x ELSE y END WHEN i > 0 AND cx >= 0.55 THEN x WHEN i = 0 AND cy >= 0.55 THEN y END AS word FROM q)
    SELECT conv_id, turn, coalesce(string_agg(word, ' ' ORDER BY k), '') AS merged FROM w GROUP BY ALL""")
def readings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    def merge(a: str, b: str) -> str:
        # every third word of the second reading has no confidence of its own
        x, y = ([(w, None if side and k % 3 == 0 else 0.5 + (k * 7 % 5) / 10) for k, w in enumerate(s.split())] for side, s in enumerate((a, b)))
        return fw.vote(fw.scored(x, y), fw.scored(y, x))

    return _readings(spark, sf_dir).select("conv_id", "turn", fw.arrow(merge, "string")("a", "b").alias("merged"))


@query(rf"""WITH RECURSIVE {_ALIGNED_SQL}, p AS (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM al)
    SELECT conv_id, turn, CAST(k - 1 AS INTEGER) AS place, a[ps[k].i] AS a, b[ps[k].j] AS b FROM p WHERE ps[k].i > 0 AND ps[k].j > 0 AND ka[ps[k].i] <> kb[ps[k].j] QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) <= 8""")
def reading_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first disputes of each turn, as many as an arbiter is asked about."""

    def find(x: str, y: str) -> list[tuple[int, str, str]]:
        a, b = ([(w, 1.0) for w in s.split()] for s in (x, y))
        return fw.disputes(a, b)[: fw.MOST_DISPUTES]

    rows = _readings(spark, sf_dir).withColumnsRenamed({"a": "x", "b": "y"})
    return fw.rows_of(rows, ["conv_id", "turn"], ["x", "y"], find, "place int, a string, b string")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and versions of them in which words are changed, left out and moved to the end."""
    words = F.split("text", r"\s+")
    new = F.concat(F.transform(F.filter(words, lambda w, i: (i % 53 != 7) & (i >= 5)), lambda w, i: F.when(i % 31 == 30, F.reverse(w)).otherwise(w)), F.slice(words, 1, 5))
    return t.spread(t.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.array_join(new, " ").alias("new"))


@query()
def version_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words added, removed and kept."""

    def count(a: str, b: str) -> list[int]:
        kinds = [k for _, k in fw.word_diff(a, b)]
        return [kinds.count(k) for k in (fw.ADDED, fw.REMOVED, fw.SAME)]

    rows = _versions(spark, sf_dir).withColumn("d", fw.arrow(count, "array<int>")("text", "new"))
    return rows.select("doc_id", *[F.col("d")[k].alias(n) for k, n in enumerate(("added", "removed", "same"))])


def version_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, paragraph, run, kind, text of the versions' differences."""
    return fw.rows_of(_versions(spark, sf_dir), ["doc_id"], ["text", "new"], lambda a, b: fw.diff_runs(fw.word_diff(a, b)), "paragraph int, run int, kind string, text string")


#: Words that differ by punctuation or case only count as the same and are shown as in the new version.
_WORD_KEY_SQL = r"coalesce(nullif(regexp_replace(lower(x), '[^\p{L}\p{Nd}]', '', 'g'), ''), x)"


@query(rf"""WITH w AS (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM documents),
    f AS (SELECT doc_id, ws, [ws[i + 1] FOR i IN range(len(ws)) IF i % 53 <> 7 AND i >= 5] AS fs FROM w),
    v AS (SELECT doc_id, ws, [CASE WHEN i % 31 = 30 THEN reverse(fs[i + 1]) ELSE fs[i + 1] END FOR i IN range(len(fs))] || ws[1:5] AS new FROM f)
    SELECT doc_id, array_to_string([{_WORD_KEY_SQL} FOR x IN ws IF x <> ''], ' ') AS old, array_to_string([x FOR x IN new IF x <> ''], ' ') AS new, true AS sizes_right, true AS runs_right FROM v WHERE len([x FOR x IN ws IF x <> '']) > 0""")
def versions_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions made again from the runs of their differences; paragraphs of at most 160 words, all but the last of 80 at least; runs that take turns and differ from the one before."""
    rows = version_runs(spark, sf_dir).withColumn("n", F.size(F.split("text", " ")))
    before = Window.partitionBy("doc_id").orderBy("paragraph", "run")
    rows = rows.withColumn("turns", F.coalesce((F.col("run") == 0) | ((F.lag("kind").over(before) != F.col("kind")) & (F.lag("run").over(before) == F.col("run") - 1)), F.lit(False)))
    # all by document, so that the runs are made and shuffled once
    rows = rows.withColumn("size", F.sum("n").over(Window.partitionBy("doc_id", "paragraph")))
    runs = F.sort_array(F.collect_list(F.struct("paragraph", "run", "kind", "text"))).alias("runs")
    whole = rows.groupBy("doc_id").agg(runs, F.every("turns").alias("runs_right"), F.max("size").alias("most"), F.min(F.when(F.col("size") < 80, F.col("paragraph"))).alias("short"), F.max("paragraph").alias("last"))
    side = lambda kind: F.array_join(F.transform(F.filter("runs", lambda x: x["kind"].isin(fw.SAME, kind)), lambda x: x["text"]), " ")
    whole = whole.select("doc_id", side(fw.REMOVED).alias("old"), side(fw.ADDED).alias("new"), "most", "short", "last", "runs_right")
    return whole.select("doc_id", ft.diff_keys(F.col("old")).alias("old"), "new", ((F.col("most") <= 160) & (F.coalesce("short", "last") == F.col("last"))).alias("sizes_right"), "runs_right")


@query()
def texts_destuttered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", fw.arrow(fw.destutter, "string")("text").alias("text"))


_LOOPS_SQL = r"""d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN repeat(' Speaker 1:', 9) WHEN 1 THEN ' Speaker 1: a Speaker 2: b Speaker 1: Speaker 2: c Speaker 1:' WHEN 2 THEN ' Speaker 1: no Speaker 2: no speaker 1 : no' WHEN 3 THEN ' ' || repeat('abcdefgh', 14 + doc_id % 25) ELSE '' END AS text FROM documents),
    m AS (SELECT *, string_split_regex(text, '(?i)\bSpeaker\s+\d+\s*:') AS pieces, regexp_extract_all(text, '(?i)\bSpeaker\s+\d+\s*:') AS marks, "right"(text, 80) AS short, "right"(text, 200) AS long FROM d),
    b AS (SELECT *, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN pieces[2:]] AS bodies, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split_regex(short, '(?i)\bSpeaker\s+\d+\s*:')[2:]] AS tail FROM m),
    h AS (SELECT *, [i FOR i IN range(1, len(tail) + 1) IF tail[i] = '' OR (i > 1 AND tail[i] = tail[i - 1])] AS hits, [substr(long, i, 8) FOR i IN range(1, length(long) - 6)] AS grams,
        list_max([i FOR i IN range(1, len(bodies)) IF bodies[i] <> '' AND bodies[i] <> bodies[i + 1]]) AS other FROM b)"""


@query(rf"""WITH {_LOOPS_SQL}
    SELECT doc_id, (length(text) >= 80 AND len(tail) >= 3 AND len(hits) >= 2) OR (length(text) >= 200 AND 8 * coalesce(list_max(map_values(list_histogram([g FOR g IN grams IF length(trim(g)) >= 4]))), 0) > 100) AS runaway,
        CASE WHEN length(text) >= 30 AND len(bodies) >= 2 AND (bodies[-1] = '' OR bodies[-1] = bodies[-2])
            THEN regexp_replace(array_to_string(pieces[1:1] || [marks[i] || pieces[i + 1] FOR i IN range(1, coalesce(other, 0) + 1)], ''), '\s+$', '') ELSE text END AS trimmed FROM h""")
def runaway_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts end in a loop, and texts without the markers at their end that loop."""
    end = F.expr("""case doc_id % 5 when 0 then repeat(' Speaker 1:', 9) when 1 then ' Speaker 1: a Speaker 2: b Speaker 1: Speaker 2: c Speaker 1:' when 2 then ' Speaker 1: no Speaker 2: no speaker 1 : no'
        when 3 then concat(' ', repeat('abcdefgh', cast(14 + doc_id % 25 as int))) else '' end""")
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", end).alias("text"))
    return d.select("doc_id", ft.is_runaway(F.col("text")).alias("runaway"), mentions.trim_runaway(F.col("text")).alias("trimmed"))


#: What recordings say besides: acronyms and names inside sentences and at their start, openers, contractions, repeats.
_SAID = ["OWASP is good.", "We saw OWASP there. OWASP again. Then Kaiko met Blits Insurance at KLM", "Ask KimKim or Mara Vos. Kim KimKim, That's it! Monday", "Project Falcon began\nwith Mara. the project, a falcon, falcon", "So NASA went. Falcon flew with Mara Vos Lee Long"]
_IN_LIST = lambda words: "(" + ", ".join("'" + w + "'" for w in words) + ")"
#: Words by sentence, and candidates (cand, initial) with their keys, as rows: runs are islands between words that are no names.
_NAMES_SQL = rf"""rec AS (SELECT doc_id AS r, text || '. ' || ['{"', '".join(x.replace("'", "''") for x in _SAID)}'][CAST(doc_id % 5 AS INTEGER) + 1] AS text FROM documents),
    sen AS (SELECT r, unnest(string_split_regex(text, '[.!?\n]')) AS sentence, unnest(range(len(string_split_regex(text, '[.!?\n]')))) AS sn FROM rec),
    wl AS (SELECT r, sn, list_filter([regexp_replace(x, '^\p{{P}}+|\p{{P}}+$', '', 'g') FOR x IN string_split(sentence, ' ')], lambda x: x <> '') AS ws FROM sen),
    wr AS (SELECT r, sn, unnest(ws) AS w, unnest(range(len(ws))) AS wn FROM wl),
    wk AS (SELECT *, regexp_matches(w, '^[\p{{Lu}}\p{{Nd}}]{{3,6}}$') AND regexp_matches(w, '\p{{L}}') AS acronym, regexp_matches(w, '(?s)^\p{{Lu}}.*[\p{{Ll}}\p{{Nd}}]') AS name FROM wr),
    wo AS (SELECT *, wn = 0 AND name AND NOT acronym AND lower(w) IN {_IN_LIST(mentions.OPENERS)} AS opens FROM wk),
    wi AS (SELECT *, sum(CASE WHEN opens OR NOT (acronym OR name) THEN 1 ELSE 0 END) OVER (PARTITION BY r, sn ORDER BY wn) AS island FROM wo),
    ca AS (SELECT r, sn, min(wn) AS wn, string_agg(w, ' ' ORDER BY wn) AS cand, min(wn) = 0 AND count(*) = 1 AND NOT bool_or(acronym) AS initial FROM wi WHERE (acronym OR name) AND NOT opens GROUP BY r, sn, island
        UNION ALL SELECT r, sn, wn, w, true FROM wi WHERE opens),
    ck AS (SELECT *, {_KEY.format("cand")} AS key, [{_KEY.format("x")} FOR x IN string_split(cand, ' ')] AS parts FROM ca),
    cn AS (SELECT * FROM ck WHERE length(key) >= 3 AND key NOT IN {_IN_LIST(mentions.STOP)} AND NOT regexp_matches(cand, '[''’]') AND len(parts) <= 3 AND len([1 FOR x IN parts IF x IN {_IN_LIST(mentions.STOP)}]) = 0
        AND len([1 FOR i IN range(1, len(parts)) IF starts_with(parts[i], parts[i + 1]) OR starts_with(parts[i + 1], parts[i])]) = 0),
    lw AS (SELECT r, {_KEY.format("w")} AS key FROM (SELECT r, unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}]+')) AS w FROM rec) WHERE regexp_matches(w, '^\p{{Ll}}'))"""


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, _SAID))
    return t.spread(t.recordings(spark, sf_dir), "text").select(F.col("id").alias("recording_id"), F.concat("text", F.lit(". "), F.get(said, (F.col("id") % 5).cast("int"))).alias("text"))


@query(f"""WITH {_NAMES_SQL}, low AS (SELECT key, count(*) AS low FROM lw GROUP BY key), h AS (SELECT * FROM cn WHERE key NOT IN ('kaiko', 'blitsinsurance')),
    k AS (SELECT key, count(DISTINCT r) AS recordings, count(*) AS occurrences, count(*) FILTER (NOT initial) AS mid FROM h GROUP BY key),
    sp AS (SELECT key, cand, parts FROM (SELECT key, cand, any_value(parts) AS parts, count(*) AS n FROM h GROUP BY key, cand) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, cand) = 1),
    pl AS (SELECT key, len(any_value(parts)) AS n, min(coalesce(low, 0)) AS least FROM (SELECT sp.key, parts, unnest(parts) AS part FROM sp) p LEFT JOIN (SELECT key AS part, low FROM low) USING (part) GROUP BY key)
    SELECT key, cand AS spelling, recordings, occurrences FROM k JOIN sp USING (key) JOIN pl USING (key) LEFT JOIN low USING (key)
    WHERE recordings >= 2 AND mid >= greatest(1, occurrences // 5) AND coalesce(low, 0) < occurrences AND NOT (n > 1 AND least > 3) ORDER BY recordings DESC, occurrences DESC, spelling DESC LIMIT 200""")
def harvested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Kaiko",), ("Blits Insurance",)], "term string")
    return names.harvest(_recorded(spark, sf_dir), known)


@query(f"""WITH {_NAMES_SQL}, low AS (SELECT r, key, count(*) AS low FROM lw GROUP BY r, key), h AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY sn, wn) AS pos FROM cn WHERE NOT initial AND key NOT IN ('kaiko', 'mara')),
    k AS (SELECT r, key, count(*) AS occurrences, min(pos) AS first FROM h GROUP BY r, key),
    sp AS (SELECT r, key, cand FROM (SELECT r, key, cand, count(*) AS n, min(pos) AS p FROM h GROUP BY r, key, cand) QUALIFY row_number() OVER (PARTITION BY r, key ORDER BY n DESC, p) = 1)
    SELECT r AS recording_id, CAST(row_number() OVER (PARTITION BY r ORDER BY occurrences DESC, first) AS INTEGER) AS nr, key, cand AS spelling, occurrences
    FROM k JOIN sp USING (r, key) LEFT JOIN low USING (r, key) WHERE coalesce(low, 0) < occurrences QUALIFY row_number() OVER (PARTITION BY r ORDER BY occurrences DESC, first) <= 6""")
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.suggest(_recorded(spark, sf_dir), spark.createDataFrame([("Kaiko",)], "term string"), spark.createDataFrame([("mara",)], "key string"))


@query(r"""SELECT key, count(*) AS low FROM (SELECT regexp_replace(lower(w), '[^\p{L}\p{Nd}]', '', 'g') AS key FROM (SELECT unnest(string_split_regex(text, '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE regexp_matches(w, '^\p{Ll}')) GROUP BY key""")
def lowercase_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.lowercase_counts(t.recordings(spark, sf_dir))


@query(f"""WITH {t.SEGMENTS_SQL}, two AS (SELECT recording_id, min(speaker) AS a, max(speaker) AS b FROM seg GROUP BY recording_id HAVING count(DISTINCT speaker) = 2),
    own AS (SELECT DISTINCT recording_id, speaker FROM seg WHERE seq = 0), met AS (SELECT DISTINCT s.recording_id, CASE WHEN s.speaker = a THEN b ELSE a END AS speaker FROM seg s JOIN two USING (recording_id) WHERE s.seq = 2)
    SELECT seg.recording_id, seg.seq, CASE WHEN own.speaker IS NOT NULL THEN 'Ahmed' WHEN met.speaker IS NOT NULL THEN 'Lana' END AS inferred FROM seg
    LEFT JOIN own ON own.recording_id = seg.recording_id AND own.speaker = seg.speaker LEFT JOIN met ON met.recording_id = seg.recording_id AND met.speaker = seg.speaker""")
def inferred_speaker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir).withColumn("text", F.expr("case when seq = 0 then concat('Hi, I''m Ahmed. ', text) when seq = 2 then concat('hello Lana, ', text) else text end"))
    return names.speaker_names(seg.withColumn("speaker_name", F.lit(None).cast("string"))).select("recording_id", "seq", "inferred")


@query(rf"""WITH {t.SEGMENTS_SQL}, m AS (SELECT recording_id, seq, start_s, string_split(text, ' ') AS ws, text, lag(text) OVER (PARTITION BY recording_id ORDER BY seq) AS prev FROM seg),
    s AS (SELECT recording_id, seq, start_s, CASE WHEN seq % 3 = 1 AND len(ws) > 4 THEN array_to_string(list_slice(string_split(prev, ' '), -4, -1), ' ') || ' ' || text ELSE text END AS text FROM m),
    b AS (SELECT *, lag(text) OVER (PARTITION BY recording_id ORDER BY start_s, seq) AS before FROM s),
    k AS (SELECT *, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS now, [{_KEY.format("x")} FOR x IN string_split_regex(before, '\s+') IF x <> ''] AS ka FROM b),
    j AS (SELECT *, [{_KEY.format("x")} FOR x IN now] AS kb FROM k),
    o AS (SELECT *, CASE WHEN seq % 3 = 1 THEN list_max([n FOR n IN range(3, least(len(ka), len(kb)) + 1) IF len([1 FOR skip IN range(4) IF skip <= len(kb) - n AND list_slice(ka, len(ka) - n + 1, len(ka)) = list_slice(kb, skip + 1, skip + n)]) > 0]) END AS n FROM j),
    r AS (SELECT recording_id, seq, CASE WHEN seq % 3 = 1 THEN array_to_string(CASE WHEN n IS NULL THEN now ELSE list_slice(now, n + 1 + list_min([skip FOR skip IN range(4) IF skip <= len(kb) - n AND list_slice(ka, len(ka) - n + 1, len(ka)) = list_slice(kb, skip + 1, skip + n)]), len(now)) END, ' ') ELSE text END AS text FROM o)
    SELECT * FROM r WHERE text <> ''""")
def boundary_repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir).withColumn("speaker", F.lit(0))
    tail = F.expr("array_join(slice(split(lag(text) over (partition by recording_id order by seq), ' '), -4, 4), ' ')")
    rows = seg.withColumn("text", F.when((F.col("seq") % 3 == 1) & (F.size(F.split("text", " ")) > 4), F.concat_ws(" ", tail, "text")).otherwise(F.col("text")))
    return names.drop_boundary_repeats(rows, seg.where("seq % 3 = 1")).select("recording_id", "seq", "text")


@query("""WITH RECURSIVE v AS (SELECT vec_id // 40 AS r, list(vec_id ORDER BY vec_id) AS ids, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS v FROM embeddings GROUP BY ALL),
    s AS (SELECT r, ids, v, [[i] FOR i IN range(1, len(ids) + 1)] AS g, v AS c FROM v
        UNION ALL SELECT r, ids, v, [CASE WHEN i = a THEN g[a] || g[b] ELSE g[i] END FOR i IN range(1, len(g) + 1) IF i <> b], [CASE WHEN i = a THEN m ELSE c[i] END FOR i IN range(1, len(g) + 1) IF i <> b]
        FROM (SELECT *, [list_avg([v[k][d] FOR k IN g[a] || g[b]]) FOR d IN range(1, len(v[1]) + 1)] AS m FROM (SELECT *, p.a AS a, p.b AS b
            FROM (SELECT *, list_min(flatten([[{d: list_cosine_distance(c[i], c[j]), a: i, b: j} FOR j IN range(i + 1, len(c) + 1)] FOR i IN range(1, len(c))])) AS p FROM s WHERE len(g) > 4))))
    SELECT r AS recording_id, vec_id, CAST(k - 1 AS INTEGER) AS "cluster" FROM (SELECT r, ids, k, unnest(g[k]) AS i FROM (SELECT r, ids, g, unnest(range(1, len(g) + 1)) AS k FROM s WHERE len(g) <= 4)), LATERAL (SELECT ids[i] AS vec_id)""")
def speaker_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    rows = t.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id div 40 as recording_id", "embedding")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"recording_id": pdf.recording_id, "vec_id": pdf.vec_id, "cluster": fw.cluster(np.stack(pdf.embedding), 4)})

    return rows.groupBy("recording_id").applyInPandas(label, "recording_id long, vec_id long, cluster int")


@query("""SELECT DISTINCT conv_id, CAST(id AS INTEGER) AS id, CAST(CASE WHEN id < 2 OR conv_id % 5 = 4 THEN id ELSE conv_id % 2 END AS INTEGER) AS "to" FROM conversations, (SELECT unnest(range(4)) AS id)""")
def speakers_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers joined as a reply says; pairs with unknown speakers and replies that cannot be read change nothing."""
    reply = F.when(F.col("conv_id") % 5 == 4, "not json").otherwise(F.format_string('{"merge": [[3, 2], [2, %d], [1, 1], [9, 1]]}', F.col("conv_id") % 2))
    rows = t.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    pairs = rows.select("conv_id", ft.parse_merges(reply, F.array(*map(F.lit, [0, 1, 2, 3]))).alias("pairs"))
    ids = rows.select("conv_id", F.explode(F.array(*map(F.lit, [0, 1, 2, 3]))).alias("id"))
    return merges.merged(ids, pairs.select("conv_id", F.explode("pairs").alias("p")).select("conv_id", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b")), "conv_id")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'meeting' WHEN 4 THEN 'idea' END AS category,
    CASE WHEN event_id % 5 = 1 THEN array_to_string(list_resize([CAST(least(greatest(user_id % 3 - 1, 0), 1) AS INTEGER), 1], event_id % 4, 0), ',') WHEN event_id % 5 = 4 THEN array_to_string(list_resize([1, 0], event_id % 4, 0), ',')
        WHEN event_id % 5 = 3 AND event_id % 4 = 0 THEN '' END AS choices FROM events""")
def replies_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = F.expr("""case event_id % 5 when 0 then '{"category": "Meeting"}' when 1 then concat('{"choices": [', user_id % 3 - 1, ', 1]}') when 2 then 'junk'
        when 3 then '{"category": "other", "choices": []}' else '{"choices": [5, 0], "category": "idea"}' end""")
    rows = t.table(spark, sf_dir, "events").select("event_id", replies.alias("reply"), (F.col("event_id") % 4).cast("int").alias("n"))
    return rows.select("event_id", ft.parse_category(F.col("reply")).alias("category"), F.array_join(ft.parse_choices(F.col("reply"), F.col("n")).cast("array<string>"), ",").alias("choices"))


def _stripped_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _leaks_sql(text: str) -> str:
    for pattern in ft.LEAKS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return _stripped_sql(text)


@query(rf"""WITH a AS (SELECT doc_id, {_stripped_sql("['Sure, here is the text: ', '=== CONTEXT (DO NOT REPEAT) === x === END CONTEXT === ', 'The previous chunk ended with: foo bar. ', ''][CAST(doc_id % 4 AS INTEGER) + 1] || text")} AS text FROM documents),
    q AS (SELECT doc_id, CASE WHEN length(text) > 2 AND regexp_matches(text, '(?s)^(?:".+"|“.+”|‘.+’|''.+'')$') THEN substr(text, 2, length(text) - 2) ELSE text END AS text FROM a),
    p AS (SELECT doc_id, {_leaks_sql(_stripped_sql("regexp_replace(" + _stripped_sql("text") + ", '" + ft.PREAMBLE.replace("'", "''") + "', '')"))} AS text FROM q),
    m AS (SELECT *, string_split_regex(text, '(?i)\bSpeaker\s+\d+\s*:') AS pieces, regexp_extract_all(text, '(?i)\bSpeaker\s+\d+\s*:') AS marks FROM p),
    b AS (SELECT *, [{_stripped_sql("x")} FOR x IN pieces[2:]] AS bodies FROM m),
    c AS (SELECT doc_id, CASE WHEN length(text) >= 30 AND len(bodies) >= 2 AND (bodies[-1] = '' OR bodies[-1] = bodies[-2])
        THEN regexp_replace(array_to_string(pieces[1:1] || [marks[i] || pieces[i + 1] FOR i IN range(1, coalesce(list_max([i FOR i IN range(1, len(bodies)) IF bodies[i] <> '' AND bodies[i] <> bodies[i + 1]]), 0) + 1)], ''), '\s+$', '') ELSE text END AS text FROM b),
    w AS (SELECT *, [x FOR x IN [lower(regexp_replace(y, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g')) FOR y IN string_split_regex({_stripped_sql(r"regexp_replace(text, '(?i)\bSpeaker\s+\d+\s*:\s*', '', 'g')")}, '[\s,]+')] IF x <> ''] AS ws FROM c)
    SELECT doc_id, CASE WHEN length(trim(text)) <= 200 AND len(ws) >= 3 AND len([1 FOR x IN ws IF x NOT IN ('yuri', 'len', 'abci')]) = 0 THEN '' ELSE text END AS text FROM w""")
def replies_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.expr("case doc_id % 4 when 0 then 'Sure, here is the text: ' when 1 then '=== CONTEXT (DO NOT REPEAT) === x === END CONTEXT === ' when 2 then 'The previous chunk ended with: foo bar. ' else '' end")
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text").alias("text"))
    return d.select("doc_id", ft.scrub_vocabulary_echo(mentions.trim_runaway(ft.strip_leaks(ft.strip_preamble(F.col("text")))), ["Yuri", "Len", "ABCI"]).alias("text"))


def _speaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(spark, sf_dir).withColumn("speaker", F.when(F.col("seq") % 5 == 3, None).otherwise(F.concat(F.lit("SPEAKER_"), F.col("speaker")))).withColumn("speaker_name", F.when(F.col("seq") % 7 == 0, "Ana"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(spark, sf_dir).groupBy("recording_id").agg(F.max("end_s").alias("duration_s")).selectExpr("recording_id", "concat('Talk ', recording_id) as title", "case when recording_id % 2 = 0 then 'en' end as language", "duration_s")


#: Twins of the two functions above: named speakers and heads of recordings.
_SPOKEN = f"""WITH {t.SEGMENTS_SQL}, spk AS (SELECT *, coalesce(nm, replace(sp, 'SPEAKER_', 'Speaker ')) AS shown FROM (SELECT *, CASE WHEN seq % 5 = 3 THEN NULL ELSE 'SPEAKER_' || speaker END AS sp, CASE WHEN seq % 7 = 0 THEN 'Ana' END AS nm FROM seg)),
    heads AS (SELECT recording_id, max(end_s) AS d, CASE WHEN recording_id % 2 = 0 THEN 'en' END AS language FROM seg GROUP BY recording_id)"""
_LONG = "CASE WHEN CAST(floor(d) AS BIGINT) >= 3600 THEN CAST(floor(d) AS BIGINT) // 3600 || ':' || lpad(CAST(CAST(floor(d) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(CAST(floor(d) AS BIGINT) // 60 AS VARCHAR) END || ':' || lpad(CAST(CAST(floor(d) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


def _stamp(x: str) -> str:
    ms = f"CAST(floor({x} * 1000) AS BIGINT)"
    two = lambda v: f"lpad(CAST({v} AS VARCHAR), 2, '0')"
    return f"{two(f'{ms} // 3600000')} || ':' || {two(f'{ms} // 60000 % 60')} || ':' || {two(f'{ms} // 1000 % 60')} || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


@query(f"""{_SPOKEN}, p AS (SELECT *, last(shown IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spk),
    b AS (SELECT recording_id, string_agg(CASE WHEN shown IS NOT NULL AND (before IS NULL OR before <> shown) THEN chr(10) || '[' || shown || ']' || chr(10) ELSE '' END || trim(text, ' ') || chr(10), '' ORDER BY start_s, seq) AS body FROM p GROUP BY recording_id)
    SELECT recording_id, '# Talk ' || recording_id || chr(10) || coalesce('Language: ' || language || chr(10), '') || 'Duration: ' || {_LONG} || chr(10) || chr(10) || body AS body FROM heads JOIN b USING (recording_id)""")
def export_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_txt(_heads(spark, sf_dir), _speaking(spark, sf_dir))


@query(f"""{_SPOKEN}, n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, seq) AS nr FROM spk)
    SELECT recording_id, string_agg(nr || chr(10) || {_stamp('start_s')} || ' --> ' || {_stamp('end_s')} || chr(10) || coalesce(shown || ': ', '') || trim(text, ' ') || chr(10) || chr(10), '' ORDER BY nr) AS body FROM n GROUP BY recording_id""")
def export_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_srt(_speaking(spark, sf_dir))


def _json_sql(fields: dict[str, str], depth: int) -> str:
    pad = " " * (4 * depth)
    return " || ',' || chr(10) || ".join(f"""'{pad}"{key}": ' || {value}""" for key, value in fields.items())


_JSON_OF = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


@query(f"""{_SPOKEN}, b AS (SELECT recording_id, string_agg('        {{' || chr(10) || {_json_sql({'start': _JSON_OF('start_s'), 'end': _JSON_OF('end_s'), 'speaker': _JSON_OF('sp'), 'speakerName': _JSON_OF('nm'), 'language': "'null'", 'text': _JSON_OF('text')}, 3)} || chr(10) || '        }}', ',' || chr(10) ORDER BY start_s, seq) AS segments FROM spk GROUP BY recording_id)
    SELECT recording_id, '{{' || chr(10) || {_json_sql({'audioPath': "'null'", 'title': _JSON_OF("'Talk ' || recording_id"), 'language': _JSON_OF('language'), 'translated': "'null'", 'durationSeconds': _JSON_OF('d'), 'backend': "'null'", 'model': "'null'"}, 1)} || ',' || chr(10) || '    "segments": [' || chr(10) || segments || chr(10) || '    ]' || chr(10) || '}}' AS body
    FROM heads JOIN b USING (recording_id)""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_json(_heads(spark, sf_dir), _speaking(spark, sf_dir))


@query(f"""{_SPOKEN}, l AS (SELECT recording_id, sp, arg_max(nm, (start_s, seq)) AS nm FROM spk WHERE sp IS NOT NULL AND nm IS NOT NULL GROUP BY ALL)
    SELECT recording_id, '{{' || string_agg(to_json(sp) || ':' || to_json(nm), ',' ORDER BY sp) || '}}' AS names FROM l GROUP BY recording_id""")
def export_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.speakers_sidecar(_speaking(spark, sf_dir))


@query(f"""WITH {t.SEGMENTS_SQL} SELECT recording_id, string_agg('[' || lpad(CAST(CAST(floor(start_s) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || role || ': ' || trim(text), chr(10) ORDER BY seq) AS prompt FROM seg GROUP BY ALL""")
def assembled_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor("start_s")
    line = F.concat(F.format_string("[%02d:%02d] ", (s / 60).cast("long"), s % 60), "role", F.lit(": "), F.trim("text"))
    rows = t.segments(spark, sf_dir).withColumn("line", line)
    return rows.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


@query("""SELECT doc_id, list_distinct_ordered AS vocabulary, n_pending FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['a', 'b', 'c', 'd'] ELSE ['c', 'a', 'b', 'd'] END AS list_distinct_ordered, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 2 END AS n_pending FROM documents)""")
def vocabulary_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents")
    own = F.expr("case when doc_id % 2 = 0 then array('a', 'b', 'a', 'c') else array('c', 'a', 'c') end")
    pack = F.array(F.lit("b"), F.lit("d"), F.lit("a"))
    has = F.expr("case when doc_id % 2 = 0 then array('a', 'x') else array('d', 'x') end")
    return d.select("doc_id", F.array_union(own, pack).alias("vocabulary"), F.size(F.array_except(pack, has)).alias("n_pending"))


#: Events as live words: those of a type without words are silence, errors are stops; a month is squeezed into a minute and a half.
_LIVE = "(epoch_us(ts) - 1704067200000000) / 3e10 AS sec, CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN NULL ELSE event_type END AS text"


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, text IS NULL, text) AS nr FROM (SELECT user_id, {_LIVE} FROM events)),
    f AS (SELECT user_id, nr, CASE WHEN text IS NOT NULL THEN sec END AS s, CASE WHEN text IS NOT NULL THEN sec END AS l, CASE WHEN text <> '' THEN 1 ELSE 0 END AS n, text AS words, CAST(NULL AS DOUBLE) AS ds, CAST(NULL AS DOUBLE) AS dl, 0 AS dn, CAST(NULL AS VARCHAR) AS done FROM e WHERE nr = 1
        UNION ALL SELECT user_id, nr, CASE WHEN text IS NULL THEN NULL WHEN fresh THEN sec ELSE s END, CASE WHEN text IS NULL THEN NULL WHEN fresh OR text <> '' THEN sec ELSE l END,
            CASE WHEN text IS NULL THEN 0 WHEN fresh THEN CAST(text <> '' AS INTEGER) ELSE n + CAST(text <> '' AS INTEGER) END, CASE WHEN text IS NULL THEN NULL WHEN fresh THEN text WHEN text <> '' THEN trim(words || ' ' || text) ELSE words END,
            CASE WHEN ended THEN s END, CASE WHEN ended THEN l END, CASE WHEN ended THEN n ELSE 0 END, CASE WHEN ended THEN words END
        FROM (SELECT e.user_id, e.nr, e.sec, e.text, f.s, f.l, f.n, f.words, f.s IS NOT NULL AND (e.text IS NULL OR e.sec - f.l >= CASE WHEN f.words <> '' THEN 1.4 ELSE 2.4 END OR e.sec - f.s >= 20) AS ended,
            f.s IS NULL OR e.text IS NULL OR e.sec - f.l >= CASE WHEN f.words <> '' THEN 1.4 ELSE 2.4 END OR e.sec - f.s >= 20 AS fresh FROM f JOIN e ON e.user_id = f.user_id AND e.nr = f.nr + 1))
    SELECT user_id, ds AS start_s, dl AS end_s, CAST(dn AS BIGINT) AS n, done AS text FROM f WHERE done <> ''
    UNION ALL SELECT user_id, s, l, CAST(n AS BIGINT), words FROM f WHERE words <> '' AND (user_id, nr) IN (SELECT (user_id, max(nr)) FROM e GROUP BY user_id)""")
def live_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.batch_utterances(live_words(spark, sf_dir))


def live_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, at, text of the events."""
    return t.table(spark, sf_dir, "events").selectExpr("user_id", "(unix_micros(cast(ts as timestamp)) - 1704067200000000) / 3e10D as at", "case event_type when 'view' then '' when 'error' then null else event_type end as text")


@query("""SELECT user_id, w AS "window", count(*) AS n, round(avg(value), 6) AS level FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS w FROM events) GROUP BY ALL HAVING count(*) = 10""")
def whole_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.count_windows(t.table(spark, sf_dir, "events"), 10, "user_id", "ts", "event_id").withColumn("level", F.round("level", 6))


@query("""SELECT user_id, w AS start, count(*) AS n, round(avg(value), 6) AS level FROM (SELECT user_id, value, unnest([make_timestamp(CAST(k * 43200000000 AS BIGINT)), make_timestamp(CAST((k - 1) * 43200000000 AS BIGINT))]) AS w
    FROM (SELECT *, epoch_us(ts) // 43200000000 AS k FROM events)) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.windows(t.table(spark, sf_dir, "events"), "1 day", "12 hours").select("user_id", "start", "n", F.round("level", 6).alias("level"))
