"""Tables that change by commits."""

import pytest
from pyspark.sql import functions as F

from voxloom.sources import stored


@pytest.fixture
def tables(spark, tmp_path):
    found = stored.Tables(spark, f"file://{tmp_path}/tables", 12)
    people = spark.createDataFrame([(k, f"p{k}") for k in range(50)], "id long, name string")
    notes = spark.createDataFrame([(k, k % 50, "x") for k in range(200)], "id long, person long, text string")
    found.create(people=(people, ["id"]), notes=(notes, ["person"]))
    return found


def told(df):
    return sorted(map(tuple, df.collect()))


def test_changes_are_read_back(spark, tables):
    new = spark.createDataFrame([(3, "three"), (70, "seventy")], "id long, name string")
    before = tables.state()[1]["people"]["at"]
    tables.upsert("people", new, ["id"])
    after = tables.state()[1]["people"]["at"]
    assert told(tables.read("people")) == sorted([(k, f"p{k}") for k in range(50) if k != 3] + [(3, "three"), (70, "seventy")])
    assert sum(after.get(k) == v for k, v in before.items()) >= len(before) - 2  # other parts are the same files
    tables.insert_ignore("people", spark.createDataFrame([(3, "no"), (71, "yes")], "id long, name string"), ["id"])
    assert {(3, "three"), (71, "yes")} <= set(told(tables.read("people")))
    tables.delete_with("people", tables.read("people").where("id % 2 = 0"), "id", notes="person")
    assert {r.id % 2 for r in tables.read("people").collect()} == {1} == {r.person % 2 for r in tables.read("notes").collect()} and tables.read("notes").count() == 100
    tables.replace("notes", spark.createDataFrame([(900, 1, "new")], "id long, person long, text string"), ["person"], spark.createDataFrame([(1,), (3,)], "person long"))
    assert [r for r in told(tables.read("notes")) if r[1] in (1, 3)] == [(900, 1, "new")]
    tables.delete("notes", F.col("person") > 0)
    assert tables.read("notes").count() == 0
    people = told(tables.read("people"))
    tables.drop_unused()
    assert told(tables.read("people")) == people
    tables.upsert("people", spark.createDataFrame([], "id long, name string"), ["id"])
    assert told(tables.read("people")) == people


def test_a_change_that_fails_half_way_leaves_the_old_tables(spark, tables, monkeypatch):
    people, notes = told(tables.read("people")), told(tables.read("notes"))
    gone = tables.read("people").where("id < 20")
    write, written = stored.Tables._write, []

    def fails(self, name, *rest):
        if written:
            raise OSError("disk full")
        written.append(name)
        return write(self, name, *rest)

    monkeypatch.setattr(stored.Tables, "_write", fails)
    with pytest.raises(OSError, match="disk full"):
        tables.delete_with("people", gone, "id", notes="person")
    monkeypatch.undo()
    assert written == ["people"] and (told(tables.read("people")), told(tables.read("notes"))) == (people, notes)
    tables.delete_with("people", gone, "id", notes="person")
    tables.drop_unused()
    assert min(r.id for r in tables.read("people").collect()) == 20 == min(r.person for r in tables.read("notes").collect())


def test_of_two_changes_at_once_the_later_is_refused(spark, tables, monkeypatch):
    other = stored.Tables(spark, tables.folder)
    row = lambda k: spark.createDataFrame([(k, "new")], "id long, name string")
    mark = stored.Tables._mark

    def late(self, number, state):
        monkeypatch.undo()
        other.upsert("people", row(1), ["id"])
        mark(self, number, state)

    monkeypatch.setattr(stored.Tables, "_mark", late)
    with pytest.raises(stored.Conflict):
        tables.upsert("people", row(2), ["id"])
    assert {(1, "new"), (2, "p2")} <= set(told(tables.read("people")))


def test_a_sound_is_written_in_parts_and_the_header_counts_them_all(spark, tmp_path):
    """Samples or arrays of them give the file that the whole recording would, over several parts, and no task gets a whole recording."""
    import numpy as np
    from pyspark.sql import functions as F

    from voxloom.sources import audio, files

    x = np.sin(np.arange(3 * audio.PART + 7) / 5) * 1.2
    rows = spark.createDataFrame([(k % 2, k // 2, float(v)) for k, v in enumerate(np.repeat(x, 2))], "recording_id long, frame long, x double")
    parts = audio.sounds(rows.repartition(3), F.concat(F.col("recording_id").cast("string"), F.lit(".wav")))
    assert parts.count() == 8 and parts.agg(F.max(F.length("body"))).first()[0] <= 2 * audio.PART + 44
    assert files.write_parts(parts, (tmp_path / "a").as_uri()) == 2
    blocks = rows.groupBy("recording_id", F.expr("frame div 32 * 32").alias("frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda s: s["x"]).alias("x"))
    assert files.write_parts(audio.sounds(blocks, F.concat(F.col("recording_id").cast("string"), F.lit(".wav"))), (tmp_path / "b").as_uri()) == 2
    want = audio.wav_bytes(x.astype(np.float32))
    assert all((tmp_path / d / f"{k}.wav").read_bytes() == want for d in "ab" for k in range(2))
    stereo = audio.sounds(rows.where("recording_id = 0").withColumn("y", -F.col("x")), F.lit("s.wav"), 2)
    files.write_parts(stereo, (tmp_path / "c").as_uri())
    assert (tmp_path / "c" / "s.wav").read_bytes() == audio.wav_bytes(np.stack([x, -x], 1).ravel().astype(np.float32), audio.RATE, 2)
