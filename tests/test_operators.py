"""Operators on hand-made rows: ties, nulls, folds, exports, sound files and streams."""

import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voxloom.functions import mentions
from voxloom.functions import text as ft
from voxloom.functions import words as fw
from voxloom.operators import intervals, library, merges, names, sequences, store
from voxloom.sources import audio, export, files
from voxloom.streaming import live

SEG = "recording_id long, seq long, start_s double, end_s double, speaker int, text string"
TURN = "recording_id long, turn_seq long, turn_start double, turn_end double, turn_speaker int"


def test_overlap_ties_go_to_the_first_turn_and_gaps_to_the_nearest(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 4.0, 0, "a"), (1, 1, 10.0, 11.0, 0, "b"), (2, 0, 0.0, 1.0, 0, "c")], SEG)
    turns = spark.createDataFrame([(1, 0, 0.0, 2.0, 7), (1, 1, 2.0, 4.0, 8), (1, 2, 20.0, 22.0, 9)], TURN)
    got = {(r.recording_id, r.seq): r.assigned for r in intervals.speaker_by_overlap(seg, turns, ["seq"]).collect()}
    assert got == {(1, 0): 7, (1, 1): None, (2, 0): None}
    got = {(r.recording_id, r.seq): r.assigned for r in intervals.speaker_by_overlap_or_nearest(seg, turns, ["seq"]).collect()}
    assert got == {(1, 0): 7, (1, 1): 8, (2, 0): None}


def test_backchannels_are_absorbed_in_sequence(spark):
    rows = [(1, k, float(k), k + 0.5, k % 2, "Yeah." if k % 2 else "yes") for k in range(5)]
    got = [r.absorbed for r in sequences.absorb_backchannels(spark.createDataFrame(rows, SEG)).orderBy("seq").collect()]
    assert got == [0, 0, 0, 0, 0]


def test_turns_with_long_silence_stay_apart(spark):
    rows = [(1, 0, 0.0, 5.0, 1, "a"), (1, 1, 6.0, 10.0, 1, "b"), (1, 2, 45.0, 46.0, 1, "c"), (1, 3, 46.0, 47.0, None, "d"), (1, 4, 47.0, 48.0, None, "e")]
    got = sorted((r.seq, r.speaker, r.text, r.end_s) for r in sequences.coalesce_turns(spark.createDataFrame(rows, SEG)).collect())
    assert [x[2] for x in got] == ["a b", "c", "d e"]


def test_cut_points_snap_before_the_target(spark):
    silences = spark.createDataFrame([(1, 26.8, 27.2), (1, 28.5, 28.9)], "recording_id long, start_s double, end_s double")
    got = sequences.cut_points(silences, spark.createDataFrame([(1, 90.0), (2, 20.0)], "recording_id long, duration_s double")).orderBy("nr").collect()
    assert [(r.recording_id, round(r.cut_s, 3), r.at_silence) for r in got] == [(1, 27.0, True), (1, 55.0, False), (1, 83.0, False)]


def test_silence_at_the_end_counts(spark):
    frames = spark.createDataFrame([(1, k, 0.0 if k >= 20 else 0.5) for k in range(40)], "recording_id long, frame long, rms double")
    got = sequences.silence_runs(frames).collect()
    assert [(round(r.start_s, 3), round(r.end_s, 3)) for r in got] == [(0.5, 1.0)]


def test_subwords(spark):
    tokens = spark.createDataFrame([(1, k, t, k * 0.1, None) for k, t in enumerate(["▁Hel", "lo", " wor", "ld", "▁", "x"])], "recording_id long, nr int, token string, at_s double, len_s double")
    assert [r.text for r in sequences.subword_words(tokens).orderBy("word_nr").collect()] == ["Hello", "world", "x"]


def test_search_folds_ascii_only(spark):
    rec = spark.createDataFrame([(1, "Über ABC", "f"), (2, "über 100%", "f"), (3, "x", "g")], "id long, title string, folder string")
    seg = spark.createDataFrame([(3, "say AbC now")], "recording_id long, text string")
    tag = spark.createDataFrame([(1, "t"), (1, "t")], "recording_id long, tag string")
    ids = lambda **k: sorted(r.id for r in library.search(rec, seg, tag, **k).collect())
    assert ids(text="abc") == [1, 3]
    assert ids(text="Ü") == [1] and ids(text="100%") == [2] and ids(text="  ") == [1, 2, 3]
    assert ids(tag="t", folder="f") == [1]


def test_store_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id long, folder int")
    assert store.delete(rows, F.col("folder") == 5).count() == 1
    assert [r.folder for r in store.nullify(rows, "folder", 5).collect()] == [None, None]


def test_scalars(spark):
    row = spark.range(1).select(
        ft.escape_like(F.lit(r"50\%_")).alias("like"), ft.srt_time(F.lit(3661.0019)).alias("srt"), ft.srt_time(F.lit(-1.0)).alias("neg"), ft.duration(F.lit(59.9)).alias("d"), ft.duration(F.lit(3600.0)).alias("h"),
        ft.strip_preamble(F.lit('"Sure, here is the text: hello"')).alias("pre"), ft.strip_leaks(F.lit("=== CONTEXT (x) === a\n=== END CONTEXT === hi")).alias("leak"),
        ft.scrub_vocabulary_echo(F.lit("Speaker 1: Yuri, Len, ABCI."), ["Yuri", "len", "abci"]).alias("echo"), ft.suspicion(F.lit("Um."), F.lit(20.0)).alias("low"),
        ft.suspicion(F.lit("go to the go to the go to the go to the end."), F.lit(1.0)).alias("loop"), ft.dice(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"))).alias("dice"),
        ft.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), ft.trim_punctuation(F.lit("«(x-y)!")).alias("trim"), ft.join_surfaces(F.array(F.lit("Пам"), F.lit("'ятаєш"), F.lit(" a  b "))).alias("join"),
        ft.top_gram_share(F.lit("abcdefgh" * 40)).alias("gram"),
    ).first()
    assert row.like == r"50\\\%\_" and row.srt == "01:01:01,001" and row.neg == "00:00:00,000" and row.d == "0:59" and row.h == "1:00:00"
    assert row.pre == "here is the text: hello" or row.pre == "hello"
    assert row.leak == "hi" and row.echo == "" and row.low == 0.6 and row.loop == 0.7 and abs(row.dice - 2 / 3) < 1e-9 and row.zero == 1.0
    assert row.trim == "x-y" and row.join == "Пам'ятаєш a b" and row.gram > 20


def test_replies(spark):
    replies = [('{"category": "Meeting"}', 2), ('{"category": "other", "choices": [1]}', 3), ("junk", 2), ('{"choices": [5, -1, 1, 0]}', 3), ('{"choices": []}', 1), ("{choices: [1, 0]}", 2)]
    rows = spark.createDataFrame(replies, "reply string, n int")
    got = [tuple(r) for r in rows.select(ft.parse_category(F.col("reply")), ft.parse_choices(F.col("reply"), F.col("n"))).collect()]
    assert got == [("meeting", None), (None, [1, 0, 0]), (None, None), (None, [1, 0, 1]), (None, None), (None, [1, 0])]
    assert spark.range(1).select(ft.parse_merges(F.lit("{merge: [[1,0]]}"), F.array(*map(F.lit, range(4))))).first()[0] == [[1, 0]]
    pairs = spark.range(1).select(ft.parse_merges(F.lit('{"merge": [[3, 2], [1, 1], [9, 1]]}'), F.array(*map(F.lit, range(4))))).first()[0]
    assert pairs == [[3, 2]]


def _said(spark, f, texts):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").orderBy("k").select(f(F.col("t"))).collect()]


def test_runaway_texts(spark):
    plain = " ".join(f"word{k}" for k in range(60))
    empty_twice = plain + " Speaker 1: a Speaker 2: b Speaker 1: Speaker 2: c Speaker 1:"  # five markers, two of them empty
    texts = [plain, plain + " Speaker 1:" * 9, plain + " Speaker 1: a Speaker 2: b Speaker 1: c", "abcdefgh" * 40, "short", plain + " Speaker 1: no Speaker 2: no Speaker 1: no", "", empty_twice]
    assert _said(spark, ft.is_runaway, texts) == [False, True, False, True, False, True, False, True]
    loop, fine = "Hello there everyone, good to see you.", "Speaker 1: Good day. Speaker 2: Yeah, good day. Speaker 1: Thanks Paul. Bye. And now to something else altogether."
    texts = [loop + " " + "Speaker 1: " * 9, fine, loop + " Speaker 1: a Speaker 2: b Speaker 1: b", loop + " Speaker 1: Speaker 2: a Speaker 1:", "Speaker 1: Speaker 2:", "Speaker 1: " * 5, "", None, loop + " Speaker 1:"]
    assert _said(spark, mentions.trim_runaway, texts) == [loop, fine, loop + " Speaker 1: a", loop + " Speaker 1: Speaker 2: a", texts[4], "", "", None, texts[8]]
    assert [[tuple(x) for x in r] for r in _said(spark, mentions.diarized, [fine, "no marker", "speaker 12 : x Speaker 3:"])] == [[(1, "Good day."), (2, "Yeah, good day."), (1, "Thanks Paul. Bye. And now to something else altogether.")], [], [(12, "x")]]


def test_names_in_sentences(spark):
    found = [[tuple(x) for x in r] for r in _said(spark, mentions.name_candidates, ["Then Kaiko met Blits Insurance at KLM. Anna said so", "OWASP is good. OWASP Zap! Ask OWASP\nNASA, ok", "", "(Kaiko) 'Mara Vos', 42 A4 x", "Then  Then Kaiko"])]
    assert found == [[("Then", True), ("Kaiko", False), ("Blits Insurance", False), ("KLM", False), ("Anna", True)], [("OWASP", False), ("OWASP Zap", False), ("Ask", True), ("OWASP", False), ("NASA", False)], [], [("Kaiko Mara Vos", False), ("A4", False)], [("Then", True), ("Then Kaiko", False)]]
    assert _said(spark, mentions.is_name, ["Monday", "That's", "Kim KimKim", "Kaiko", "Blits Insurance", "A B C D", "It Works", "Jo"]) == [False, False, False, True, True, False, False, False]
    texts = spark.createDataFrame([(1, "OWASP is good."), (2, "OWASP was there. OWASP again.")], "recording_id long, text string")
    assert [(r.spelling, r.recordings, r.occurrences) for r in names.harvest(texts, spark.createDataFrame([], "term string")).collect()] == [("OWASP", 2, 3)]
    assert sorted((r.recording_id, r.spelling) for r in names.suggest(texts, spark.createDataFrame([], "term string"), spark.createDataFrame([], "key string")).collect()) == [(1, "OWASP"), (2, "OWASP")]


def test_introduced_and_addressed_names(spark):
    said = ["Hi, I'm Ahmed, nice to meet you", "This is Yuri speaking", "I'm just looking around", "Мене звати Олена, дуже приємно", "Ik ben Anke", "اسمي أحمد", "أنا متأكد", "I'm Sorry. my name is Bo-Anne", None]
    assert _said(spark, mentions.introduced_name, said) == ["Ahmed", "Yuri", None, "Олена", "Anke", "أحمد", None, "Bo-Anne", None]
    greeted = ["hello, my name is Sara", "Hey guys, welcome back", "hi Lana, how are you?", "Hi, I'm Ahmed", "Hi, I’ll start. Hello Lana", "hey Imre!"]
    assert _said(spark, mentions.addressed_name, greeted) == [None, None, "Lana", None, "Lana", "Imre"]


def test_merges(spark):
    """A path of a thousand ids in any order, a small map, unknown ids, a key without pairs."""
    rnd = random.Random(2)
    path = rnd.sample(range(1000), 1000)
    pairs = [(1, a, b) for a, b in zip(path, path[1:], strict=False)] + [(2, 3, 2), (2, 2, 1), (2, 9, 1), (2, 9, 0), (3, 1, 1)]
    ids = [(1, k) for k in range(1000)] + [(k, i) for k in (2, 3, 4) for i in range(4)]
    got = merges.merged(spark.createDataFrame(ids, "key long, id int"), spark.createDataFrame(pairs, "key long, a int, b int"), "key").collect()
    assert sorted(map(tuple, got)) == [(1, k, 0) for k in range(1000)] + [(2, 0, 0), (2, 1, 1), (2, 2, 1), (2, 3, 1)] + [(k, i, i) for k in (3, 4) for i in range(4)]


def test_nearest_marks(spark):
    """Against looking at every mark; marks that end or start together, and recordings without any."""
    rnd = random.Random(3)
    points = [(rnd.randint(1, 4), k, rnd.randint(0, 60) / 2) for k in range(200)]
    marks = [(rnd.randint(1, 3), n, a, a + rnd.randint(0, 3), f"v{n}") for n in range(40) for a in [float(rnd.randint(0, 30))]]
    clear = [(r, k, at) for r, k, at in points if not any(m[0] == r and m[2] < at < m[3] for m in marks)]
    got = intervals.nearest(spark.createDataFrame(clear, "recording_id int, k int, at double"), ["k"], spark.createDataFrame(marks, "recording_id int, seq int, lo double, hi double, value string"), ["seq"])
    want = {}
    for r, k, at in clear:
        near = [(max(lo - at, at - hi, 0), n, v) for q, n, lo, hi, v in marks if q == r]
        if near:
            want[r, k] = min(near)[2]
    assert {(x.recording_id, x.k): x.value for x in got.collect()} == want and len(want) > 50


def test_overlaps_meet_once_for_any_bucket(spark):
    rnd = random.Random(4)
    span = lambda: (a := rnd.uniform(0, 100), a + rnd.choice((0, 1, 7, 45)))
    rows = [(rnd.randint(1, 2), k, *span()) for k in range(60)]
    turns = [(rnd.randint(1, 2), k, *span(), k % 3) for k in range(60)]
    want = sorted((k, n) for r, k, a, b in rows for q, n, c, d, _ in turns if r == q and d > a and c < b)
    for size in (1.0, 30.0, 1000.0):
        got = intervals.meeting(spark.createDataFrame(rows, "recording_id int, seq int, start_s double, end_s double"), spark.createDataFrame(turns, "recording_id int, turn_seq int, turn_start double, turn_end double, turn_speaker int"), size)
        assert sorted((r.seq, r.turn_seq) for r in got.collect()) == want


def test_agreement_counts_repeats(spark):
    rnd = random.Random(5)
    texts = [(k, *(" ".join(rnd.choice("ab cd ef G g".split()) for _ in range(rnd.randint(0, 9))) for _ in range(2))) for k in range(80)]
    rows = spark.createDataFrame(texts, "k int, a string, b string")
    whole = {r.k: r.dice for r in names.agreement(rows, "k", F.col("a"), F.col("b")).collect()}
    short = {r.k: r.d for r in rows.select("k", ft.dice(ft.word_tokens(F.lower("a")), ft.word_tokens(F.lower("b"))).alias("d")).collect()}
    for k, a, b in texts:
        x, y = Counter(a.lower().split()), Counter(b.lower().split())
        want = 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0
        assert abs(whole[k] - want) < 1e-9 and abs(short[k] - want) < 1e-9


def test_harvest_against_a_plain_count(spark):
    rnd = random.Random(6)
    vocabulary = "Kaiko Mara Falcon falcon went told We Then Blits Insurance the project NASA meeting Meeting".split()
    texts = [(k, " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", "."]) for _ in range(60))) for k in range(12)]
    got = [tuple(r) for r in names.harvest(spark.createDataFrame(texts, "recording_id int, text string"), spark.createDataFrame([("mara",)], "term string")).collect()]
    low = Counter(fw.word_key(w) for _, t in texts for w in re.findall(r"[^\W_]+", t) if w[0].islower())
    found: dict[str, list] = {}
    df = spark.createDataFrame(texts, "recording_id int, text string")
    candidates = {r.recording_id: [tuple(x) for x in r.c] for r in df.select("recording_id", F.filter(mentions.name_candidates(F.col("text")), lambda x: mentions.is_name(x["cand"])).alias("c")).collect()}
    for k, t in texts:
        for cand, first in candidates[k]:
            if fw.word_key(cand) != "mara":
                found.setdefault(fw.word_key(cand), []).append((k, cand, first))
    want = []
    for key, hits in found.items():
        where, n, mid = {k for k, _, _ in hits}, len(hits), sum(not f for _, _, f in hits)
        counts = Counter(c for _, c, _ in hits)
        spelling = min(counts, key=lambda c: (-counts[c], c))
        parts = [fw.word_key(p) for p in spelling.split()]
        if len(where) >= 2 and mid >= max(1, n // 5) and low[key] < n and not (len(parts) > 1 and min(low[p] for p in parts) > 3):
            want.append((key, spelling, len(where), n))
    assert sorted(got) == sorted(want) and len(want) > 3


def test_restore_refuses_what_it_cannot_read(spark):
    live = spark.createDataFrame([(1, 0, 0.0, 1.0, "now", 0), (2, 0, 0.0, 1.0, "now", 0), (3, 0, 0.0, 1.0, "now", 0)], "recording_id long, seq long, start_s double, end_s double, text string, speaker int")
    none = spark.createDataFrame([], "recording_id long, segments_json string, created_at long, version_id long")
    old = '[{"start_s":0.0,"end_s":2.0,"text":"then","speaker":1}]'
    chosen = spark.createDataFrame([(1, old, 1), (2, "{broken", 1), (3, "[]", 0)], "recording_id long, segments_json string, n long")
    segments, versions = store.restore(live, none, chosen, "engine")
    assert sorted((r.recording_id, r.text) for r in segments.collect()) == [(1, "then"), (2, "now")]
    assert sorted((r.recording_id, r.label, r.n) for r in versions.collect()) == [(1, "engine", 1), (3, "engine", 1)]


def test_backup_skips_unchanged_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "transcript", "x"), ("b", "audio", "yy"), ("c", "audio", "zz")], "name string, kind string, body string")
    folder = "file://" + str(tmp_path / "out")
    assert {tuple(r) for r in files.backup(spark, rows, folder).collect()} == {("written", 1), ("copied", 2)}
    assert {tuple(r) for r in files.backup(spark, rows.withColumn("body", F.when(F.col("name") == "c", "longer").otherwise(F.col("body"))), folder).collect()} == {("written", 1), ("skipped", 1), ("copied", 1)}
    assert (tmp_path / "out" / "c").read_text() == "longer"


def test_backup_asks_for_its_own_files_only(spark, tmp_path):
    """A folder of many files is not listed, and files count whatever their names."""
    rows = spark.createDataFrame([("_a", "audio", "x"), (".b", "audio", "yy"), ("c d%20é?", "audio", "zz"), ("e", "transcript", "t"), ("f", "audio", "new"), ("g", "audio", "longer")], "name string, kind string, body string")
    out = tmp_path / "out"
    out.mkdir()
    for k in range(400):
        (out / f"other-{k}").write_text("x")
    for name, body in (("_a", "1"), (".b", "22"), ("c d%20é?", "33"), ("e", "t"), ("g", "short")):
        (out / name).write_text(body)
    spark.sparkContext.setJobGroup("backup", "backup")
    try:
        found = {tuple(r) for r in files.backup(spark, rows, "file://" + str(out).replace(" ", "%20")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {("skipped", 3), ("written", 1), ("copied", 2)}
    assert [(out / x).read_text() for x in ("_a", ".b", "c d%20é?", "e", "f", "g")] == ["1", "22", "33", "t", "new", "longer"]
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("backup") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4


def test_utterances_end_by_silence_length_and_stops():
    end = lambda events: live.fold_utterances(events, None)[0]
    assert end([(0, "a"), (1.3, "b"), (2.8, "c")]) == [(0, 1.3, 2, "a b")]
    assert end([(0, ""), (2.0, "a"), (2.5, ""), (3.5, "b")]) == [(0, 2.0, 1, "a")]  # silence after words is short
    assert end([(0, ""), (2.4, "a"), (2.5, None)]) == [(2.4, 2.4, 1, "a")]  # without words it is longer, and gives nothing
    assert end([(k, "x") for k in range(25)])[0][:3] == (0, 19, 20)
    assert end([(0, "a"), (0.5, None), (0.6, "b"), (0.7, None), (0.8, None)]) == [(0, 0, 1, "a"), (0.6, 0.6, 1, "b")]


def test_queue_takes_parked_tasks_up_again(spark, tmp_path):
    """Runs go on where the one before was; a parked task runs once the charger is there, with new tasks or alone, and none runs twice."""
    task = lambda k, wait: (k, float(k), wait)
    schema, place = "recording_id int, queued_at double, wait_for_charger boolean", str(tmp_path / "in")
    run = lambda charging: live.drained(spark.readStream.schema(schema).parquet(place), charging, str(tmp_path / "state"), str(tmp_path / "out"))
    add = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(place)
    told = lambda done: sorted((r.step, r.place, r.recording_id) for r in done.collect())
    add(task(3, False), task(1, False), task(2, True), task(9, True))
    done, parked = run(False)
    assert told(done) == [(0, 1, 1), (0, 2, 3)] and sorted(r.recording_id for r in parked.collect()) == [2, 9]
    add(task(0, False), task(8, True))
    done, parked = run(False)
    assert told(done) == [(0, 1, 1), (0, 2, 3), (1, 1, 0)] and sorted(r.recording_id for r in parked.collect()) == [2, 8, 9]
    done, parked = run(True)  # nothing new
    assert told(done)[3:] == [(2, 1, 2), (2, 2, 8), (2, 3, 9)] and parked.count() == 0
    assert told(run(True)[0]) == told(done)
    add(task(20, True))
    run(False)
    add(*[task(30 + k, False) for k in range(40)])
    done, parked = run(True)
    assert told(done)[6:] == [(4, k + 1, x) for k, x in enumerate([20, *range(30, 70)])] and parked.count() == 0


def test_queue_step_that_failed_is_done_again(spark, tmp_path):
    """A step without its mark counts as not done: the backlog of the step before is taken again."""
    schema, place, out = "recording_id int, queued_at double, wait_for_charger boolean", str(tmp_path / "in"), tmp_path / "out"
    run = lambda charging: live.drained(spark.readStream.schema(schema).parquet(place), charging, str(tmp_path / "state"), str(out))
    spark.createDataFrame([(1, 1.0, True), (2, 2.0, False)], schema).write.parquet(place)
    run(False)
    run(True)
    (out / "step=1" / "_SUCCESS").unlink()
    done, parked = run(True)
    assert sorted((r.step, r.recording_id) for r in done.collect()) == [(0, 2), (1, 1)] and parked.count() == 0


def test_harvest(spark):
    texts = spark.createDataFrame([(1, "We met Kaiko today. Meeting went well."), (2, "I told Kaiko about the meeting."), (3, "then Project Falcon began")], "recording_id long, text string")
    none = spark.createDataFrame([], "term string")
    assert [(r.spelling, r.recordings, r.occurrences) for r in names.harvest(texts, none).collect()] == [("Kaiko", 2, 2)]
    assert names.harvest(texts, spark.createDataFrame([("kaiko",)], "term string")).count() == 0


def test_inferred_names(spark):
    schema = "recording_id long, seq long, start_s double, speaker string, text string, speaker_name string"
    rows = spark.createDataFrame([(1, 0, 0.0, "A", "hi Lana, how are you?", None), (1, 1, 2.0, "B", "I'm good", None), (2, 0, 0.0, "A", "Hi, Lana", None), (2, 1, 1.0, "B", "Actually, I'm Sara, not Lana", None), (3, 0, 0.0, "A", "Hi, I'm Ahmed", "Boss")], schema)
    got = {(r.recording_id, r.seq): r.inferred for r in names.speaker_names(rows).collect()}
    assert got == {(1, 0): None, (1, 1): "Lana", (2, 0): None, (2, 1): "Sara", (3, 0): "Boss"}


def test_exports(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "SPEAKER_0", " a ", None), (1, 1, 1.0, 2.0, None, "b", None), (1, 2, 2.0, 3.5, "SPEAKER_0", "c", None), (1, 3, 4.0, 5.0, "SPEAKER_1", "d", "Ana")], "recording_id long, seq long, start_s double, end_s double, speaker string, text string, speaker_name string")
    rec = spark.createDataFrame([(1, "T", None, 61.0), (2, "Empty", "en", 0.0)], "recording_id long, title string, language string, duration_s double")
    txt = {r.recording_id: r.body for r in export.to_txt(rec, seg).collect()}
    assert txt[1] == "# T\nDuration: 1:01\n\n\n[Speaker 0]\na\nb\nc\n\n[Ana]\nd\n"
    assert txt[2] == "# Empty\nLanguage: en\nDuration: 0:00\n\n"
    assert export.to_srt(seg).first().body.startswith("1\n00:00:00,000 --> 00:00:01,000\nSpeaker 0: a\n\n2\n")
    body = {r.recording_id: r.body for r in export.to_json(rec, seg).collect()}
    told = json.loads(body[1])
    assert list(told) == ["audioPath", "title", "language", "translated", "durationSeconds", "backend", "model", "segments"] and told["language"] is None and told["durationSeconds"] == 61.0
    assert told["segments"][3] == {"start": 4.0, "end": 5.0, "speaker": "SPEAKER_1", "speakerName": "Ana", "language": None, "text": "d"}
    assert body[1] == json.dumps(told, indent=4) and body[2] == json.dumps(json.loads(body[2]), indent=4)
    assert export.speakers_sidecar(seg).first().names == '{"SPEAKER_1":"Ana"}'


def test_sound_files(spark, tmp_path):
    samples = np.sin(np.arange(audio.RATE * 5) / 10).astype(np.float32) / 2
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(samples))
    (tmp_path / "b.wav").write_bytes(b"junk")
    got, rate = audio.parse_wav((tmp_path / "a.wav").read_bytes())
    assert rate == audio.RATE and np.abs(got - samples).max() < 1e-3
    d = {r.path[-5:]: r.duration_s for r in audio.durations(spark, str(tmp_path)).collect()}
    assert d == {"a.wav": 5.0, "b.wav": 0.0}
    assert [(r.chunk, r.start_s, r.n) for r in audio.read_chunks(spark, str(tmp_path / "a.wav"), 2.0, 0.5).orderBy("chunk").collect()] == [(0, 0.0, 32000), (1, 1.5, 32000), (2, 3.0, 32000)]


def test_chunks_of_other_rates_are_those_of_the_whole_file(spark, tmp_path):
    """Each chunk reads its own part of the file; resampled they equal cuts of the resampled whole."""
    from voxloom.functions.words import resample

    rnd = np.random.default_rng(1)
    for rate in (8000, 16000, 22050, 44100):
        samples = rnd.normal(0, 0.2, rate * 3 + 17).astype(np.float32)
        path = tmp_path / f"{rate}.wav"
        path.write_bytes(audio.wav_bytes(np.repeat(samples, 2), rate, 2))
        whole, own = audio.parse_wav(path.read_bytes())
        whole = resample(whole, own, audio.RATE) if own != audio.RATE else whole
        got = audio.read_chunks(spark, str(path), 1.0, 0.25).orderBy("chunk").collect()
        cuts = [whole[a : a + 16000] for a in range(0, len(whole) - 4000, 12000)]
        assert [r.n for r in got] == [len(c) for c in cuts]
        assert np.allclose([r.rms for r in got], [np.sqrt(np.mean(c.astype(float) ** 2)) for c in cuts], atol=1e-6)


def test_stream_gives_the_batch_utterances_that_have_ended(spark, tmp_path):
    """Three runs from one checkpoint: timers end what is silent, context goes on over batches and runs, what may go on stays open."""
    times = [0, 1, 2, 5, 5.5, *range(100, 130), 500]
    rows = [(u, float(x) + u, None if k == 2 else "" if k == 7 else f"w{k}" + "x" * 90) for u in (1, 2) for k, x in enumerate(times)]
    df = spark.createDataFrame(rows, "user_id long, at double, text string")
    run = lambda: live.streamed_utterances(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "out"), "1 second").collect()
    got = []
    for part in ("at < 4.5", "at between 4.5 and 110", "at > 110"):
        df.where(part).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        got.append({(r.user_id, r.start_s, r.end_s, r.n, r.text): r.context for r in run()})
    want = {}
    for u in (1, 2):
        done, _ = live.fold_utterances(live._ordered(df.where(f"user_id = {u}").toPandas()), None)
        for k, x in enumerate(done):
            want[(u, *x)] = done[k - 1][3][-200:] if k else None
    assert got[2] == want and set(got[0]) < set(got[1]) < set(got[2]) and len(got[2]) > 6
    assert {(*x[1:],) for x in got[1] if x[0] == 1} >= {x for x in live.fold_utterances([(6.0, "w3" + "x" * 90), (6.5, "w4" + "x" * 90), (99, "")], None)[0]}  # ended by its timer
    batch = {(r.user_id, r.start_s, r.end_s, r.n, r.text) for r in live.batch_utterances(df).collect()}
    assert set(want) < batch and len(batch) == len(want) + 2


def test_windows_stream(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = live.replay(spark, live.windows(stream, "1 day"), "win", "complete", str(tmp_path / "cp"))
    assert sorted(map(str, got.collect())) == sorted(map(str, live.windows(df, "1 day").collect()))


def test_capitals_keep_the_length_of_a_text(spark):
    rows = spark.createDataFrame([("Straße, groß.",), ("plain é",), ("ﬁn ŉ ᾳ ǆ",), (None,), ("",), ("ßß",)], "t string")
    assert [r[0] for r in rows.select(ft.upper(F.col("t"))).collect()] == ["STRAẞE, GROẞ.", "PLAIN É", "ﬁN ŉ ᾼ Ǆ", None, "", "ẞẞ"]


def test_words_of_bytes_leave_python_in_small_batches(spark, small):
    """Tokens of a batch of turns are never held together: they are no column."""
    from voxloom import plans

    assert "ArrowEvalPython" not in plans.QUERIES["words_of_bytes"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_stream_keeps_what_is_before_its_clock_begins(spark, tmp_path):
    """Negative seconds are no earlier than the first watermark; in the query they are in the first third."""
    from voxloom.plans import QUERIES

    df = spark.createDataFrame([(1, -50.0, "a"), (1, -49.5, "b"), (1, -40.0, "c"), (2, -1.0, "d"), (2, 0.5, "e"), (1, 1e5, None), (2, 1e5, None)], "user_id long, at double, text string").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    found = live.streamed_utterances(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "out"), "1 second")
    assert {tuple(r)[:5] for r in found.collect()} == {(1, -50.0, -49.5, 2, "a b"), (1, -40.0, -40.0, 1, "c"), (2, -1.0, -1.0, 1, "d"), (2, 0.5, 0.5, 1, "e")}
    events = spark.createDataFrame([(k, f"{day} 00:00:00", 1, kind) for k, (day, kind) in enumerate((("2023-12-01", "click"), ("2023-12-20", "click"), ("2024-01-05", "click")))], "event_id long, ts string, user_id long, event_type string")
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "0.5D as value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["streamed_utterances"](spark, str(tmp_path)).count() == QUERIES["live_utterances"](spark, str(tmp_path)).count() == 3


def test_rows_that_crash_are_found_with_few_tries(spark, tmp_path):
    calls = tmp_path / "calls"

    def work(batch):
        with calls.open("a") as f:
            f.write("x")
        if (batch.k % 1024 == 1023).any():
            raise ValueError("poison")
        return batch[["k"]] * 2

    rows = spark.range(1024).selectExpr("id as k").coalesce(1)
    found = live.isolated(rows, work, "k long").collect()
    assert sorted(r.k for r in found if r.aside is None) == [2 * k for k in range(1023)]
    assert [(r.aside, r.error) for r in found if r.aside] == [('{"k":1023}', "ValueError: poison")]
    assert len(calls.read_text()) <= 12  # a try of the whole, ten first halves, the row alone


def test_texts_are_dealt_by_their_bytes(spark):
    """Work that makes rows of words gets parts of bounded size, however few parts the texts come in; a pair's words stay in its part."""
    from voxloom.operators import names
    from voxloom.sources import tables

    rows = spark.range(40).select("id", F.repeat(F.lit("é b c d "), 111_111).alias("text")).coalesce(1)
    assert tables.text_parts(rows, "text") == 5 and tables.text_parts(rows, "text", 1_000_000) == 40  # 9 bytes a time
    assert tables.spread(rows, "text").rdd.getNumPartitions() == 5
    pairs = spark.createDataFrame([(1, "a b b c", "B b d"), (2, "", "x"), (3, None, "x"), (4, "q r", "R q")], "k long, a string, b string")
    found = names.agreement(pairs, "k", F.col("a"), F.col("b"), 7)
    assert found.rdd.getNumPartitions() == 7
    assert {(r.k, round(r.dice, 6)) for r in found.collect()} == {(1, round(4 / 7, 6)), (2, 0.0), (3, 0.0), (4, 1.0)}
