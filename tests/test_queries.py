"""Every query against DuckDB, or at least that it gives rows."""

import compare
import pytest

from voxloom import plans

@pytest.fixture(scope="module")
def con(small):
    return compare.oracle(small)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, small, con, name):
    assert compare.difference(spark, small, plans.QUERIES[name], plans.ORACLES[name], con) == ""
    assert con.execute(plans.ORACLES[name]).fetchone() is not None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).collect()


def test_search_reads_pushed_down_columns(spark, small):
    plan = plans.QUERIES["recording_by_id"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,42)]" in plan
    assert "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    found = e.entry(spark)
    assert found.columns == ["id", "title", "language", "folder"] and found.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["segment_speakers", "word_speakers", "minor_speakers_merged", "segments_near_boundaries", "diarization_hints", "samples_by_chunk", "library_search", "speaker_names"])
def test_joins_have_equality_keys(spark, small, name):
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["versions_rebuilt", "reading_disputes"])
def test_texts_are_compared_once_and_after_they_are_dealt(spark, small, name):
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    python = [line for line in plan.splitlines() if "ArrowEvalPython" in line or "MapInArrow" in line]
    assert len(python) == 1 and "Join" not in plan
    assert "Exchange RoundRobin" in plan[plan.index(python[0]) :]


@pytest.mark.parametrize("name", ["sound_chunks", "sound_samples", "sound_resampled", "sound_durations"])
def test_sound_files_that_were_written_are_not_listed(spark, small, name):
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "binaryFile" not in plan
