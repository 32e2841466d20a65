"""Queries over the library: look-ups, search, counts, changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as ft
from voxloom.operators import library, store
from voxloom.plans.registry import query
from voxloom.sources import files, stored
from voxloom.sources import tables as t

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH {t.RECORDINGS_SQL}, {t.SEGMENTS_SQL}, {t.TAGS_SQL}
    SELECT id, title, language, folder FROM rec WHERE folder IN ('src0') AND id IN (SELECT recording_id FROM tags WHERE tag = 'good')
    AND (contains({_FOLD.format('title')}, 'ti') OR id IN (SELECT recording_id FROM seg WHERE contains({_FOLD.format('text')}, 'ti')))""")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library.search(t.recordings(spark, sf_dir), t.segments(spark, sf_dir), t.tags(spark, sf_dir), folder="src0", tag="good", text="  TI ")
    return found.select("id", "title", "language", "folder").orderBy(F.desc("id"))


@query(f"WITH {t.RECORDINGS_SQL} SELECT id, title, language, folder FROM rec WHERE folder = 'src3'")
def library_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library.search(t.recordings(spark, sf_dir), t.segments(spark, sf_dir), t.tags(spark, sf_dir), folder="src3", text="   ")
    return found.select("id", "title", "language", "folder").orderBy(F.desc("id"))


@query(f"WITH {t.RECORDINGS_SQL} SELECT id, title, language, folder FROM rec WHERE id = 42")
def recording_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.recordings(spark, sf_dir).where("id = 42").select("id", "title", "language", "folder")


@query("SELECT doc_id AS id, lang AS language, source AS folder, n_chars FROM documents")
def all_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("folder"), "n_chars")


@query(f"WITH {t.SEGMENTS_SQL} SELECT seq, role, text, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM seg WHERE recording_id = 7")
def segments_of_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(spark, sf_dir).where("recording_id = 7").select("seq", "role", "text", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s")).orderBy("start_s", "seq")


@query(f"WITH {t.SEGMENTS_SQL} SELECT recording_id, seq, round(start_s, 6) AS start_s FROM seg")
def segments_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(spark, sf_dir).select("recording_id", "seq", F.round("start_s", 6).alias("start_s")).orderBy("recording_id", "start_s", "seq")


@query(f"WITH {t.RECORDINGS_SQL}, {t.TAGS_SQL} SELECT rec.id, tag FROM rec JOIN tags ON rec.id = tags.recording_id")
def tags_of_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.recordings(spark, sf_dir).select("id").join(t.tags(spark, sf_dir).withColumnRenamed("recording_id", "id"), "id")


@query("SELECT c_custkey, c_name, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = t.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return library.count_children(parents, "c_custkey", t.table(spark, sf_dir, "orders"), "o_custkey")


@query(f"WITH {t.TAGS_SQL} SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tags(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


@query("SELECT count(*) AS n FROM labels WHERE toxic = 1")
def tag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tags(spark, sf_dir).where("tag = 'toxic'").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, r_name AS folder FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = t.table(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("folder"))
    return t.table(spark, sf_dir, "nation").join(folders, "n_regionkey", "left").select("n_nationkey", "n_name", "folder")


@query("SELECT CAST(coalesce(max(n_nationkey), -1) + 1 AS INTEGER) AS next_order FROM nation")
def next_folder_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.next_sort_order(t.table(spark, sf_dir, "nation"), "n_nationkey")


@query("SELECT count(*) AS n_recordings, CAST(floor(sum(n_chars / 16.0)) AS BIGINT) AS seconds, count(DISTINCT lang) AS n_languages FROM documents")
def library_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), (F.col("n_chars") / 16.0).alias("s"))
    return library.metrics(rows, "s")


@query(f"WITH {t.SEGMENTS_SQL} SELECT recording_id, string_agg(text, chr(10) ORDER BY seq) AS joined FROM seg GROUP BY recording_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.joined_text(t.segments(spark, sf_dir), "recording_id", "seq", "text")


@query("""WITH c AS (SELECT source AS folder, lower(trim(lang)) AS v, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang <> 'auto' GROUP BY ALL)
    SELECT folder, v AS value FROM c QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, f) = 1""")
def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.recordings(spark, sf_dir)
    return library.first_seen_mode(rows, "folder", "language", "id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.latest(t.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'nation_7' ORDER BY n_nationkey LIMIT 1")
def folder_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "nation").where(library.ascii_fold(F.col("n_name")) == library.fold("Nation_7")).select("n_nationkey", "n_name").orderBy("n_nationkey").limit(1)


@query(f"""WITH {t.SEGMENTS_SQL}, own AS (SELECT *, CASE WHEN seq % 5 = 0 THEN ' Ana ' WHEN seq % 5 = 1 THEN ' ' END AS own_name FROM seg),
    side AS (SELECT DISTINCT recording_id, speaker, 'Side' AS n FROM seg WHERE recording_id % 2 = 0 AND speaker = 0),
    prior AS (SELECT recording_id, speaker, arg_max('P' || seq, seq) AS n FROM seg WHERE seq % 3 = 0 GROUP BY ALL)
    SELECT o.recording_id, o.seq, coalesce(nullif(trim(o.own_name), ''), side.n, prior.n) AS speaker_name FROM own o LEFT JOIN side USING (recording_id, speaker) LEFT JOIN prior USING (recording_id, speaker)""")
def speaker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir)
    own = seg.withColumn("own_name", F.expr("case when seq % 5 = 0 then ' Ana ' when seq % 5 = 1 then ' ' end"))
    side = seg.where("recording_id % 2 = 0 and speaker = 0").select("recording_id", "speaker", F.lit("Side").alias("name")).distinct()
    prior = seg.where("seq % 3 = 0").select("recording_id", "speaker", "seq", F.concat(F.lit("P"), F.col("seq")).alias("name"))
    return library.named_speakers(own, side, prior).select("recording_id", "seq", "speaker_name")


@query("""SELECT o_orderkey AS recording_id, o_orderdate AS queued_at FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    ORDER BY queued_at, recording_id LIMIT 1""")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders")
    tasks = orders.select(F.col("o_orderkey").alias("recording_id"), F.col("o_orderdate").alias("queued_at"), (F.col("o_orderpriority") == "1-URGENT").alias("wait_for_charger"))
    there = orders.join(t.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"))
    return library.queue_head(tasks, there, charging=False).select("recording_id", "queued_at")


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'saved ' || n_name END, n_name) AS n_name FROM nation")
def presets_over_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    saved = defaults.where("n_nationkey % 3 = 0").withColumn("n_name", F.concat(F.lit("saved "), "n_name"))
    return library.with_defaults(defaults, saved, "n_nationkey", "n_name")


_OLD = "old AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS folder FROM customer)"
_NEW = "new AS (SELECT c_custkey + 100 AS id, 'new ' || c_name AS name, c_nationkey AS folder FROM customer WHERE c_custkey % 7 = 0)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("folder"))
    return rows, rows.where("id % 7 = 0").select((F.col("id") + 100).alias("id"), F.concat(F.lit("new "), "name").alias("name"), "folder")


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_old_new(spark, sf_dir), ["id"])


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_ignore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.insert_ignore(*_old_new(spark, sf_dir), ["id"])


@query(f"WITH {_OLD}, {_NEW} SELECT old.id, CASE WHEN new.id IS NULL THEN old.name ELSE new.name END AS name, old.folder FROM old LEFT JOIN new USING (id)")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.update(*_old_new(spark, sf_dir), ["id"], ["name"])


@query(f"WITH {_OLD} SELECT * FROM old WHERE folder <> 3")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(_old_new(spark, sf_dir)[0], F.col("folder") == 3)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = t.table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return store.cascade(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query(f"WITH {_OLD} SELECT id, name, nullif(folder, 5) AS folder FROM old")
def unfile_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.nullify(_old_new(spark, sf_dir)[0], "folder", 5)


@query("""WITH new AS (SELECT conv_id, turn, upper(role) AS role FROM conversations WHERE conv_id % 4 = 0 AND turn % 2 = 0)
    SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM new) UNION ALL SELECT * FROM new""")
def replace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return store.replace_set(old, old.where("conv_id % 4 = 0 and turn % 2 = 0").withColumn("role", F.upper("role")), ["conv_id"])


@query("""WITH new AS (SELECT conv_id, role, 'again' AS text FROM conversations WHERE turn = 0)
    SELECT conv_id, role, text FROM conversations WHERE (conv_id, role) NOT IN (SELECT (conv_id, role) FROM new) UNION ALL SELECT * FROM new""")
def replace_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return store.replace_set(old.drop("turn"), old.where("turn = 0").select("conv_id", "role", F.lit("again").alias("text")), ["conv_id", "role"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def prune_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.prune_orphans(t.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", t.table(spark, sf_dir, "lineitem").where("l_quantity > 49"), "l_partkey")


@query("""WITH c1 AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS folder FROM customer), n AS (SELECT id + 100 AS id, 'new ' || name AS name, folder FROM c1 WHERE id % 7 = 0),
    c2 AS (SELECT * FROM c1 WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n), c3 AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'named ' || id ELSE name END AS name, nullif(folder, 5) AS folder FROM c2),
    gone AS (SELECT id FROM c3 WHERE id % 5 = 0), o1 AS (SELECT o_orderkey AS id, o_custkey AS parent, o_orderstatus AS name FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone)),
    o2 AS (SELECT * FROM o1 WHERE parent % 6 <> 1 UNION ALL SELECT -parent, parent, 'again' FROM (SELECT DISTINCT o_custkey AS parent FROM orders) WHERE parent % 12 = 1)
    SELECT 'folder' AS kind, id, CAST(folder AS BIGINT) AS parent, name FROM c3 WHERE id % 5 <> 0 UNION ALL SELECT 'item', id, parent, name FROM o2""")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are written, changed by five commits and read back: upsert, update, unfile, delete with children, replace sets."""
    folder = files.work_folder(spark, "tables")
    orders = t.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey as parent", "o_orderstatus as name")
    old, new = _old_new(spark, sf_dir)
    tables = stored.Tables(spark, folder, 8)
    tables.create(folders=(old, ["id"]), items=(orders, ["parent"]))
    tables.upsert("folders", new, ["id"])
    tables.update("folders", tables.read("folders").where("id % 11 = 0").select("id", F.concat_ws(" ", F.lit("named"), "id").alias("name")), ["id"], ["name"])
    tables.change(folders=(None, lambda rows: store.nullify(rows, "folder", 5)))
    tables.delete_with("folders", tables.read("folders").where("id % 5 = 0"), "id", items="parent")
    keys = orders.where("parent % 6 = 1").select("parent").distinct()
    tables.replace("items", keys.where("parent % 12 = 1").selectExpr("-parent as id", "parent", "'again' as name"), ["parent"], keys)
    tables.drop_unused()
    rows = tables.read("folders").select(F.lit("folder").alias("kind"), "id", F.col("folder").cast("long").alias("parent"), "name")
    return rows.unionByName(tables.read("items").select(F.lit("item").alias("kind"), "id", "parent", "name"))


_TAGS = """cur AS (SELECT doc_id, 'Good' AS tag FROM labels WHERE quality = 1), want AS (SELECT doc_id, 'good ' AS tag FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'Toxic' FROM labels WHERE toxic = 1)"""


@query(f"""WITH {_TAGS} SELECT 'remove' AS act, doc_id, tag FROM cur WHERE (doc_id, lower(trim(tag))) NOT IN (SELECT (doc_id, lower(trim(tag))) FROM want)
    UNION ALL SELECT 'add', doc_id, tag FROM want WHERE (doc_id, lower(trim(tag))) NOT IN (SELECT (doc_id, lower(trim(tag))) FROM cur)""")
def tag_set_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = t.table(spark, sf_dir, "labels")
    current = labels.where("quality = 1").select("doc_id", F.lit("Good").alias("tag"))
    wanted = labels.where("doc_id % 2 = 0").select("doc_id", F.lit("good ").alias("tag")).unionByName(labels.where("toxic = 1").select("doc_id", F.lit("Toxic").alias("tag")))
    remove, add = store.edit_set(current, wanted, ["doc_id"], "tag")
    return remove.select(F.lit("remove").alias("act"), "doc_id", "tag").unionByName(add.select(F.lit("add").alias("act"), "doc_id", "tag"))


@query(f"""WITH {t.SEGMENTS_SQL} SELECT recording_id, '[' || string_agg(CAST(to_json({{start_s: start_s, end_s: end_s, text: text, speaker: speaker}}) AS VARCHAR), ',' ORDER BY seq) || ']' AS segments_json, count(*) AS n
    FROM seg WHERE recording_id % 3 <> 0 GROUP BY recording_id""")
def version_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = t.segments(spark, sf_dir)
    none = spark.createDataFrame([], "recording_id long, segments_json string, created_at long, version_id long")
    first = store.snapshots(seg.where("recording_id % 3 = 0"), none)
    kept = first.select("recording_id", "segments_json", F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("version_id"))
    return store.snapshots(seg, kept).select("recording_id", "segments_json", "n")


@query(f"WITH {t.SEGMENTS_SQL} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS seq, text, speaker FROM seg WHERE recording_id % 10 <> 0")
def version_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "recording_id long, segments_json string, created_at long, version_id long")
    saved = store.snapshots(t.segments(spark, sf_dir), none)
    broken = saved.withColumn("segments_json", F.when(F.col("recording_id") % 10 == 0, "not valid json").otherwise(F.col("segments_json")))
    return store.restored(broken).select("recording_id", "seq", "text", "speaker")


@query(f"""WITH {t.SEGMENTS_SQL}, live AS (SELECT recording_id, seq, upper(text) AS text FROM seg WHERE seq > 0), n AS (SELECT recording_id, count(*) AS n FROM live GROUP BY ALL)
    SELECT 'segment' AS kind, recording_id, seq, text FROM (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS seq, text FROM seg) WHERE recording_id % 10 <> 0
    UNION ALL SELECT 'segment', recording_id, seq, text FROM live WHERE recording_id % 10 = 0
    UNION ALL SELECT 'version', recording_id, 1, 'engine ' || n FROM n WHERE recording_id % 10 <> 0""")
def versions_restored_over_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording goes back to its first version; an unreadable one is refused, what was live becomes a version."""
    none = spark.createDataFrame([], "recording_id long, segments_json string, created_at long, version_id long")
    seg = t.segments(spark, sf_dir)
    saved = store.snapshots(seg, none).select("recording_id", F.when(F.col("recording_id") % 10 == 0, "{broken").otherwise(F.col("segments_json")).alias("segments_json"), "n")
    live = seg.where("seq > 0").withColumn("text", ft.upper(F.col("text"))).select("recording_id", "seq", "start_s", "end_s", "text", "speaker")
    segments, versions = store.restore(live, none, saved, "engine")
    rows = segments.select(F.lit("segment").alias("kind"), "recording_id", "seq", "text")
    return rows.unionByName(versions.select(F.lit("version").alias("kind"), "recording_id", F.lit(1).cast("long").alias("seq"), F.concat_ws(" ", "label", "n").alias("text")))


@query("""SELECT conv_id, turn, role FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id, turn, upper(role) FROM conversations WHERE conv_id % 8 = 0""")
def live_rows_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a live session give way to those of a batch run, also where the run found none."""
    live = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    done = live.where("conv_id % 4 = 0").select("conv_id").distinct()
    batch = live.where("conv_id % 8 = 0").withColumn("role", F.upper("role"))
    return store.replace_set(live, batch, ["conv_id"], done)


@query(f"""WITH {t.TAGS_SQL}, s AS (SELECT conv_id AS id, count(*) AS n_segments, count(DISTINCT role) AS n_speakers FROM conversations GROUP BY ALL), g AS (SELECT recording_id AS id, count(*) AS n_tags FROM tags GROUP BY ALL)
    SELECT doc_id AS id, lang AS language, coalesce(n_segments, 0) AS n_segments, coalesce(n_speakers, 0) AS n_speakers, coalesce(n_tags, 0) AS n_tags FROM documents LEFT JOIN s ON s.id = doc_id LEFT JOIN g ON g.id = doc_id""")
def recording_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of several sources as one row for each recording."""
    segments = t.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n_segments"), F.count_distinct("role").alias("n_speakers"))
    tags = t.tags(spark, sf_dir).groupBy(F.col("recording_id").alias("id")).agg(F.count("*").alias("n_tags"))
    return library.combined(t.recordings(spark, sf_dir).select("id", "language"), "id", segments, tags)


@query(r"SELECT p_partkey, replace(replace(replace(p_name || '\' || p_size || '%_', '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM part")
def like_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("\\"), F.col("p_size").cast("string"), F.lit("%_"))
    return t.table(spark, sf_dir, "part").select("p_partkey", ft.escape_like(raw).alias("pattern"))


@query("""WITH d AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'saved ' || n_name WHEN n_nationkey % 3 = 1 THEN n_name END AS saved, n_name FROM nation)
    SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN saved END, n_name) AS preset FROM d""")
def presets_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets kept as JSON objects over the defaults; an object that cannot be read is an empty one."""
    rows = t.table(spark, sf_dir, "nation")
    saved = rows.select("n_nationkey", F.expr("case when n_nationkey % 5 = 0 then '{\"preset\": ' when n_nationkey % 3 = 0 then to_json(map('preset', concat('saved ', n_name))) when n_nationkey % 3 = 1 then to_json(map('preset', n_name, 'x', 'y')) end").alias("stored"))
    return rows.join(saved, "n_nationkey").select("n_nationkey", F.coalesce(F.try_element_at(library.json_store(F.col("stored")), F.lit("preset")), "n_name").alias("preset"))


@query("""WITH w AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'transcript' ELSE 'audio' END AS kind FROM documents)
    SELECT CASE WHEN kind = 'transcript' THEN 'written' WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'skipped' ELSE 'copied' END AS outcome, count(*) AS n FROM w GROUP BY 1""")
def backup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("bytes"), F.expr("case when doc_id % 2 = 0 then 'transcript' else 'audio' end").alias("kind"))
    present = files.where("cast(name as long) % 3 = 0").select("name", F.expr("case when cast(name as long) % 5 = 0 then bytes + 1 else bytes end").alias("bytes"))
    return store.backup_outcomes(files, present)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT p_partkey, lower(p_name) AS name FROM part ORDER BY name, p_partkey")
def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name")).orderBy("name", "p_partkey")


@query("SELECT DISTINCT lang AS language, source AS folder FROM documents")
def distinct_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.recordings(spark, sf_dir).select("language", "folder").distinct()


@query("SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, -1, 'flushed' FROM conversations WHERE turn = 0")
def lines_with_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rows.unionByName(rows.where("turn = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("flushed").alias("text")))
