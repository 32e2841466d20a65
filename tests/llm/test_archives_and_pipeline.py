"""WARC archives, and the pipeline's stages on a small corpus."""

import base64
import hashlib
import json
import random

import pytest
from samples import prose
from pyspark.sql import functions as F

from voxloom.llm import op06_warc
from voxloom.llm.shared import work_folder


def test_archives(spark):
    rows = [(k, f"http://x/{k}", f"<p>{k % 7}</p>") for k in range(40)]
    rows += [(100, None, None), (101, "u\r\nv", ""), (None, "w", ""), (102, "x", "a\r\n\r\nWARC/1.1\r\n"), (103, "y", "é" * 50_000), (39, "again", "<p>4</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z")).withColumn("response_id", F.lit(1))
    folder = work_folder(spark, "warc")
    assert op06_warc.write_archives(pages, folder, file_bytes=500) == len(rows)
    records = op06_warc.read_archives(spark, folder, with_payload=True)
    got = op06_warc.resolve_revisits(records.drop("payload")).collect()
    last = {}
    for d, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if d is None else d)
    want = []
    for d, _, h in rows:
        b = (h or "").encode()
        mine = last[h or ""] == (-1 if d is None else d)
        want.append((d, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if mine else "revisit", None if mine else last[h or ""]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    stored = records.where("record_type = 'response'").collect()
    assert all(sha == op06_warc.sha1_base32(bytes(p)) for sha, p in ((r.payload_digest, r.payload) for r in stored))
    assert records.where("record_type = 'revisit' and length(payload) > 0").count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in op06_warc.store_and_read(pages, work_folder(spark, "w"), min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert op06_warc.store_and_read(pages.where("false"), work_folder(spark, "w")).count() == 0


def test_cut_archive_is_refused():
    data = op06_warc.record([("WARC-Type", "response")], b"abc")
    assert list(op06_warc.read_records(data + data))[1][1] == b"abc"
    with pytest.raises(ValueError):
        list(op06_warc.read_records(data[:-4]))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = [a + b + c for a in "ba de ki lo mu na pe ro".split() for b in "ra sti nta ly sho ve".split() for c in "n m t s".split()]
    good = lambda n=80: ". ".join(prose(rnd, 10, words).capitalize() for _ in range(n // 10)) + "."
    docs, labels = [], []
    for k in range(300):
        bad = k % 5 == 0
        docs.append((k, good().upper().replace(" ", "!! ") if bad else good()))
        labels.append((k, int(not bad), 0))
    bench = [(k, good(30)) for k in range(5)]
    docs += [(1000, docs[1][1]), (1001, docs[2][1].replace(docs[2][1].split()[30], "changed")), (1002, good() + " " + bench[0][1] + " " + good()), (1003, good() + " mail me at foo@bar.com now. " + good()), (1004, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(d, t, "en", "src", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(docs)


def test_pipeline(spark, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            kept[name] = {r.doc_id: r.text for r in out.collect()}
            docs = out
    good = {d for d in range(300) if d % 5}
    assert good <= kept["quality"].keys() and not kept["quality"].keys() & {d for d in range(300) if not d % 5}
    assert {1002, 1003} <= kept["quality"].keys()
    assert good <= kept["near_duplicates"].keys() and not {1000, 1001} & kept["near_duplicates"].keys()
    assert kept["near_duplicates"].keys() - kept["decontaminate"].keys() == {1002}
    assert kept["personal_data"].keys() == kept["decontaminate"].keys()
    assert "[EMAIL]" in kept["personal_data"][1003] and "foo@bar.com" not in json.dumps(kept["personal_data"])
    pieces = pipeline.run(spark, path)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept["personal_data"].keys()


def test_stages_keep_odd_rows(spark, corpus, tmp_path):
    """Nulls, empty and repeated rows, rows without a doc_id, empty tables and columns with the names that operators use inside."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from samples import EXTRA

    path = corpus[0]
    rnd = random.Random(13)
    texts = [prose(rnd, 60, [f"w{k}" for k in range(400)]) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (3, None), (4, ""), (None, texts[3]), (None, None), (5, "x" * 300_000 + " mail a@b.co")]
    plain = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        none = stage(spark, docs.where("false"), path)
        assert none.count() == 0
        if name == "packing":
            assert out.groupBy("doc_id").count().count() == 6
            continue
        assert out.columns == docs.columns == none.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if name == "near_duplicates":  # null and empty texts are one group, the same row twice one document
            assert got == sorted([rows[0], rows[1], rows[2], rows[4], *rows[6:]], key=str)
        elif name == "decontaminate":
            assert got == sorted(rows, key=str)
        elif name == "personal_data":
            assert len(got) == len(rows) and (5, "x" * 300_000 + " mail [EMAIL]") in got and sum(t is None for _, t in got) == 2
        else:
            assert set(got) <= set(rows)
