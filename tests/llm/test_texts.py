"""Token files, packing, tiling, repeats, personal data, quality and language models."""

import hashlib
import math
import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from samples import docs_frame, prose
from pyspark.sql import functions as F

from voxloom.llm import blocks, op02_token_planes, op03_packing, op04_tiling, op05_repeats, op07_pii, op08_quality, op10_bilinear
from voxloom.llm.shared import work_folder
from voxloom.llm.tokens import END, WordEncoder, chunks, default_tokenizer


def direct_ids(texts):
    tokenizer = WordEncoder(default_tokenizer()).tokenizer
    return [np.array([*x.ids, 1], "<u4") for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    rnd = random.Random(5)
    signs = " \t\n\x0b\x1c  aAbzZéÉßÿÀ×÷µªºσΣİ0159'.,!_-`|<>{}~`^́한😀ǅ"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["x<|endoftext|>y <|STARTOFTEXT|>", "a" * 500 + " é" * 50 + " can't we'll"]
    enc = WordEncoder(default_tokenizer())
    assert enc.encode(texts) == [x.tobytes() for x in direct_ids(texts)]
    assert enc.encode([None, ""]) == [END, END]


def test_encoder_keeps_no_words():
    """A Python worker holds the tokenizer, and not the words of the texts before."""
    rnd = random.Random(8)
    enc = WordEncoder(default_tokenizer())
    enc.encode(["warm up, été x1"])
    tracemalloc.start()
    for _ in range(3):
        words = ["".join(rnd.choices("abcdefgé", k=9)) for _ in range(30_000)]
        texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
        assert sum(len(x) for x in enc.encode(texts)) > 4 * len(words)
    del words, texts
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 3_000_000


def test_chunks_hold_all_rows_in_order():
    texts = pa.array(["a" * 5, None, "", "b" * 30, "é" * 5, "c", None])
    assert list(chunks(texts, 10)) == [(0, 3), (3, 1), (4, 1), (5, 2)]
    assert list(chunks(texts.slice(3, 3), 10)) == [(0, 1), (1, 1), (2, 1)]
    assert list(chunks(texts.slice(0, 0))) == []


def test_words_are_numbered_by_bytes():
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b" \t\n\x0b\x0c\r\x1c\x00aAzZ\xc3\xa9\xed\xa0\x80\xff") for _ in range(rnd.randint(0, 20))) for _ in range(500)] + [b"", b" "]
    words, places, sizes = blocks.lower_words(texts)
    want = [x.lower().split() for x in texts]
    assert [words[k] for k in places] == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
    assert words == list(dict.fromkeys(w for x in want for w in x))


def test_arrow_keeps_no_freed_memory():
    """Making a block leaves no large pool behind in the Python worker (Linux: resident memory)."""
    code = """
import re, random
from pathlib import Path
from voxloom.llm import blocks, jaccard
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024
rnd = random.Random(1)
texts = [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(500)).encode() for _ in range(2000)]
pack = jaccard._packer(5)
pack([1], [b"a"]); blocks.release_arrow()
before = held()
pack(list(range(2000)), texts)
most = held() - before
blocks.release_arrow()
print(most, held() - before)
"""
    most, left = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split())
    assert left < 0.7 * most


@pytest.mark.parametrize("size", [1.0, 30.0, 500.0])
def test_sums_of_exponentials(size):
    """In place, single precision, as plain formulas in double precision give them; large scores do not overflow."""
    x = (np.random.default_rng(2).normal(size=(50, 40)) * size).astype(np.float32)
    wide = x.astype(np.float64)
    assert np.allclose(op10_bilinear._log_sums(x.copy()), np.logaddexp.reduce(wide, 1), rtol=1e-5, atol=1e-5)
    weight = np.arange(50, dtype=np.float32)[:, None]
    assert np.allclose(op10_bilinear._shares(weight, x.copy()), weight / (1 + np.exp(np.clip(wide, -700, 700))), rtol=1e-4, atol=1e-30)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rnd = np.random.default_rng(1)
    for top in (1, 2, 300, 70_000, 2**32 - 1):
        for n in (0, 1, 7, 100_001):
            ids = rnd.integers(0, top, n).astype("<u4")
            data = op02_token_planes.pack_shard([5], [n], ids, kind=kind, block=1000)
            index = op02_token_planes.read_index(data)
            assert (op02_token_planes.read_ids(data, index) == ids).all()
            assert op02_token_planes.read_documents(data, index).tolist() == [[5, n]]
            if n > 5000:
                assert (op02_token_planes.read_ids(data, index, 1999, 2002) == ids[1999:4001]).all()


@pytest.mark.parametrize("extra", [False, True])
def test_token_files(spark, odd_rows, extra):
    folder = work_folder(spark, "tokens")
    totals = op02_token_planes.write_token_files(docs_frame(spark, odd_rows, extra), default_tokenizer(), folder, kind="bit" if extra else "byte", shard_ids=5000, partitions=3)
    got = sorted(op02_token_planes.read_token_files(spark, folder, totals).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted((-1 if d is None else d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(odd_rows, direct_ids([t for _, t in odd_rows]), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_no_documents(spark):
    none = docs_frame(spark, [])
    folder = work_folder(spark, "none")
    totals = op02_token_planes.write_token_files(none, default_tokenizer(), folder)
    assert op02_token_planes.read_token_files(spark, folder, totals).count() == 0
    assert op03_packing.pack_documents(none, default_tokenizer()).count() == 0
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert op04_tiling.leaks(none, bench).count() == 0
    assert op05_repeats.drop_repeats(none).count() == 0
    assert op07_pii.digest(none).count() == 0
    assert op10_bilinear.score_documents(none).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, odd_rows, extra):
    rows = [(d, t) for d, t in odd_rows if d is not None and d != 11]
    got = op03_packing.pack_documents(docs_frame(spark, rows, extra), default_tokenizer(), with_ids=True, shard_tokens=9000).collect()
    ids = dict(zip([d for d, _ in rows], direct_ids([t for _, t in rows]), strict=True))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert np.concatenate([r.ids for r in parts]).tolist() == ids[d].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids[d]) for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        n = sum(r.length for r in parts)
        assert n == 2048 or (n < 2048 and n & (n - 1) == 0)


def test_packing_fetches_the_closest_document():
    docs = [np.array(x * 20, "<u4") for x in ([5, 6, 7], [8, 9, 10], [5, 6, 11], [12, 13, 14])]
    index = op03_packing.ShardIndex(docs, np.ones(20), 60.0)
    assert np.argsort(-index.scores(0), kind="stable").tolist()[:2] == [0, 2]
    assert [k for k, _, _ in op03_packing.pack(docs, index, 120)[0]] == [0, 2]


def test_packing_against_plain_bm25():
    """Scores by the formula, and windows filled greedily from the best unused neighbour of the seed."""
    rnd = np.random.default_rng(6)
    for _ in range(20):
        docs = [rnd.integers(2, 30, rnd.integers(1, 90)).astype("<u4") for _ in range(25)]
        df = np.zeros(30)
        for d in docs:
            df[np.unique(d)] += 1
        idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        mean = float(np.mean([len(d) for d in docs]))
        index = op03_packing.ShardIndex(docs, idf, mean)

        def bm25(seed, k, docs=docs, idf=idf, mean=mean):
            total = 0.0
            for t in set(docs[seed].tolist()):
                f = docs[k].tolist().count(t)
                total += idf[t] * f * (op03_packing.K1 + 1) / (f + op03_packing.K1 * (1 - op03_packing.B + op03_packing.B * len(docs[k]) / mean))
            return total

        scores = np.array([[bm25(s, k) for k in range(len(docs))] for s in range(len(docs))])
        assert all(np.allclose(index.scores(s), scores[s], rtol=1e-4, atol=1e-4) for s in range(len(docs)))
        unused, rest, want, at = set(range(len(docs))), None, [], 0
        while rest or unused:
            if rest is None:
                rest = (min(unused), 0)
                unused.discard(rest[0])
            seed, start = rest
            size = min(128, len(docs[seed]) - start)
            pieces, room = [(seed, start, size)], 128 - size
            rest = (seed, start + size) if start + size < len(docs[seed]) else None
            for k in sorted(unused, key=lambda k: (-float(index.scores(seed)[k]), k)) if room else ():
                if not room:
                    break
                size = min(room, len(docs[k]))
                pieces.append((k, 0, size))
                unused.discard(k)
                room -= size
                rest = (k, size) if size < len(docs[k]) else rest
            want.append(pieces)
        got = op03_packing.pack(docs, index, 128)
        full = [p for p in got if sum(n for *_, n in p) == 128]
        assert full[: len(want) - 1] == want[: len(full)][: len(want) - 1]


def brute_tiles(item, doc, shortest):
    free_i, free_d, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < shortest:
            return total
        total += n
        for k in range(n):
            free_i[i + k] = free_d[d + k] = False


def test_tiles_are_the_greedy_ones():
    rnd = random.Random(6)
    for _ in range(150):
        item = [rnd.randrange(3) for _ in range(rnd.randint(3, 14))]
        doc = [rnd.randrange(3) for _ in range(rnd.randint(0, 30))]
        tiles = op04_tiling.greedy_tiles(item, doc, 3)
        assert sorted((n for n, _, _ in tiles), reverse=True) == [n for n, _, _ in tiles]
        assert all(item[i : i + n] == doc[d : d + n] for n, i, d in tiles)
        places = [(p, k) for n, i, d in tiles for p, at in (("i", i), ("d", d)) for k in range(at, at + n)]
        assert len(places) == len(set(places))
        if tiles:  # the longest match is the first tile
            assert tiles[0][0] == max(n for n in range(1, 15) if any(item[i : i + n] == doc[d : d + n] and i + n <= len(item) and d + n <= len(doc) for i in range(len(item)) for d in range(len(doc))))
        assert bool(tiles) == (brute_tiles(item, doc, 3) > 0)


def test_leaks(spark, odd_rows):
    rnd = random.Random(8)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(12)] + [(50, "too short"), (51, None), (None, items_text := "a b c d e f g"), (3, "w3x0 w3x1 w3x2 w3x3 w3x4 other words here"), (60, "a a a a a a a a a b c d e")]
    text = dict(items[:12])
    half = lambda k: " ".join(text[k].split()[15:] + ["stop"] + text[k].split()[:15])
    docs = odd_rows + [(500, prose(rnd, 50) + " " + text[0].upper() + "! " + prose(rnd, 10)), (501, half(1)), (502, " ".join(text[2].split()[:20])), (503, text[4] + " " + text[5]), (503, text[4]), (504, " ".join(text[6].split()[:24])), (505, "a a a a a a a a a a a"), (None, text[7]), (506, items_text)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = Counter([(500, 0), (501, 1), (503, 4), (503, 5), (503, 4), (504, 6), (None, 7)])
    for extra in (False, True):
        df = docs_frame(spark, docs, extra)
        got = Counter((r.doc_id, r.item_id) for r in op04_tiling.leaks(df, bench).collect())
        assert got == want
        kept = op04_tiling.drop_leaks(df, bench)
        assert kept.columns == df.columns and kept.count() == len(docs) - 6
    empty = spark.createDataFrame([], "item_id long, text string")
    assert op04_tiling.leaks(df, empty).count() == 0 and op04_tiling.drop_leaks(df, empty).count() == len(docs)


def test_leaks_are_those_that_tiles_of_whole_texts_cover(spark, monkeypatch):
    """Against tiling every document with every item, with phrases that most items have, cut, reordered and overlapping passages."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    common = prose(rnd, 7, words)
    items = [(k, " ".join([common, prose(rnd, rnd.randint(0, 25), words)][:: rnd.choice((1, -1))])) for k in range(25)]
    docs = []
    for d in range(120):
        parts = [common if rnd.random() < 0.5 else prose(rnd, 4, words)]
        for _ in range(rnd.randint(0, 4)):
            w = rnd.choice(items)[1].split()
            a, b = sorted((rnd.randint(0, len(w)), rnd.randint(0, len(w))))
            cut = w if rnd.random() < 0.4 else w[b:] + w[:a] + w[a:b]
            parts += [" ".join(cut), prose(rnd, rnd.randint(0, 2), words)]
        docs.append((d, " ".join(parts)))
    want = {(d, i): brute_tiles(t.split(), x.split(), 5) / len(t.split()) for d, x in docs for i, t in items if len(t.split()) >= 5}
    want = {k: round(v, 9) for k, v in want.items() if v >= 0.8}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (30, 16):
        monkeypatch.setattr(op04_tiling, "FILTER_BITS", bits)
        got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in op04_tiling.leaks(docs_frame(spark, docs), bench).collect()}
        assert got == want and len(want) > 50
    kept = {r.doc_id for r in op04_tiling.drop_leaks(docs_frame(spark, docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def brute_repeats(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], -1 if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (-1 if d is None else d):
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if b else 0
        out.append((-1 if d is None else d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_templated_benchmark_joins_nothing(spark, monkeypatch):
    """Items that share a prompt of 40 words with each other and with the documents: only leaks are compared, in whatever order their passages stand."""
    rnd = random.Random(31)
    prompt = prose(rnd, 40, [f"p{k}" for k in range(30)])
    own = [prose(rnd, 20, [f"i{k}x{j}" for j in range(60)]) for k in range(60)]
    bench = spark.createDataFrame([(k, f"{prompt} {x}") for k, x in enumerate(own)], "item_id long, text string")
    docs = [(k, f"{prose(rnd, 30)} {prompt} {prose(rnd, 30, [f'd{k}x{j}' for j in range(50)])}") for k in range(80)]
    docs += [(100, f"{own[3]} and then {prompt}"), (101, f"{prompt} {' '.join(own[4].split()[:12])}"), (102, f"{prompt} {' '.join(own[5].split()[:5])}"), (103, own[6]), (104, f"{prose(rnd, 9)} {' '.join(own[7].split()[10:])} x {' '.join(own[7].split()[:10])} {prompt}")]
    pairs, number = [], {}
    monkeypatch.setattr(op04_tiling, "_candidates", lambda *a, f=op04_tiling._candidates: pairs.append(f(*a).count()) or f(*a))
    got = {(r.doc_id, r.item_id) for r in op04_tiling.leaks(docs_frame(spark, docs), bench).collect()}
    want = {(d, k) for d, text in docs for k, x in enumerate(own) if sum(n for n, _, _ in op04_tiling.greedy_tiles(*[[number.setdefault(w, len(number)) for w in t.split()] for t in (f"{prompt} {x}", text)])) >= 48}
    assert got == want == {(100, 3), (101, 4), (104, 7)} and pairs[0] <= 5


@pytest.mark.parametrize("block, hot", [(8_000_000, 64), (1500, 64), (1500, 1)])
def test_repeats(spark, odd_rows, block, hot):
    rnd = random.Random(3)
    line = prose(rnd, 14)[:80]
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000] + [(300 + k, prose(rnd, 10) + "\n" + line + "\n" + prose(rnd, 12)) for k in range(25)] + [(400, line[:50]), (401, line[1:51]), (402, line[:49]), (403, "ab" * 200), (404, "ab" * 60), (405, line + line)]
    got = op05_repeats.drop_repeats(docs_frame(spark, rows, True), block, hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
    spans = op05_repeats.repeat_spans(docs_frame(spark, rows), block, hot).collect()
    assert sum(r.end - r.start for r in spans) == sum(r.n_removed for r in got) and len(spans) == sum(r.n_spans for r in got)


def test_suffix_array_and_intervals():
    rnd = random.Random(2)
    texts = list({"".join(rnd.choice("ab") for _ in range(rnd.randint(4, 30))).encode() for _ in range(60)})
    array = op05_repeats.SuffixArray(texts, 4)
    tails = [texts[t][o:] for t, o in zip(array.text[array.order], array.offset[array.order], strict=True)]
    for a, b, n in zip(tails, tails[1:], array.common[1:].tolist(), strict=False):
        real = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert n == real and a[:n] == b[:n] and a[n : n + 1] <= b[n : n + 1]
    common = array.common.tolist()
    found = list(op05_repeats.intervals(common, 5))
    for n, a, b, _ in found:
        assert min(common[a + 1 : b + 1]) == n
        assert (a == 0 or common[a] < n) and (b + 1 == len(common) or common[b + 1] < n)
    outer = [(a, b) for _, a, b, o in found if o]
    assert sum(b - a + 1 for a, b in outer) == sum(c >= 5 or (k + 1 < len(common) and common[k + 1] >= 5) for k, c in enumerate(common))


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(text):
    out = []
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for nr, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) < 256 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), nr, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choice("0123456789.-+ ()@ab_%é\n") for _ in range(rnd.randint(0, 120)))) for k in range(800)]
    rows += [(900, None), (901, ""), (902, "a@b.c_d@e.f 4111 1111 1111 1111, +1 (988) 555-2485 10.0.0.256 10.0.0.25"), (902, "dup@x.yz"), (903, "x" * 20_000 + "1 " * 500 + "a@b.co " * 300), (904, "iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765433 ssn 123-45-6789 " + "q " * 40 + "123-45-6777"), (None, "n@o.pe")]
    got = op07_pii.digest(docs_frame(spark, rows, True)).collect()
    want = Counter()
    for d, t in rows:
        spans = brute_pii(t)
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want[d, *(sum(s[3] == k for s in spans) for k in op07_pii.BASE), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert next(r.spans for r in got if r.doc_id == 904) == "iban:5:32,national_id:61:72"
    plan = op07_pii.digest(docs_frame(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    masked = {r.doc_id: r.text for r in op07_pii.redact(docs_frame(spark, rows, True)).collect()}
    assert masked[900] is None and masked[901] == "" and masked[904].startswith("iban [IBAN], GB82")
    assert op07_pii.redact(docs_frame(spark, rows, True)).columns == docs_frame(spark, rows, True).columns


def test_further_kinds_of_personal_data(spark):
    """IBANs by mod 97, and numbers like 123-45-6789 near a word that says what they are, against plain Python."""
    rnd = random.Random(14)
    rows = []
    for k in range(400):
        bban = "".join(rnd.choice("0123456789ABCXYZ") for _ in range(rnd.randint(11, 30)))
        country = rnd.choice(["DE", "GB", "ZZ"])
        check = 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97
        iban = f"{country}{check if rnd.random() < 0.6 else rnd.randint(2, 98):02d}{bban}"
        ssn = f"{rnd.choice(['000', '666', '123', '900'])}-{rnd.choice(['00', '45'])}-{rnd.choice(['0000', '6789'])}"
        rows.append((k, f"{'.' * rnd.randint(0, 3)} {iban} {rnd.choice(['ssn', 'no', 'National ID:', 'assn', 'SSN' + ' .' * 30])} {ssn}"))
    got = {r.doc_id: {tuple(x.split(":")) for x in r.spans.split(",") if x.split(":")[0] in ("iban", "national_id")} for r in op07_pii.digest(docs_frame(spark, rows)).collect()}
    total = Counter()
    for d, t in rows:
        want = set()
        for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", t):
            if int("".join(str(int(c, 36)) for c in m[0][4:] + m[0][:4])) % 97 == 1:
                want.add(("iban", str(m.start()), str(m.end())))
        for m in re.finditer(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t):
            near = (t[max(0, m.start() - 40) : m.start()] + " " + t[m.end() : m.end() + 40]).lower()
            if m[0][:3] not in ("000", "666") and m[0][4:6] != "00" and m[0][7:] != "0000" and re.search(r"(?<![a-z])(ssn|social security|national id)(?![a-z])", near):
                want.add(("national_id", str(m.start()), str(m.end())))
        assert got[d] == want, t
        total.update(k for k, *_ in want)
    assert min(total["iban"], total["national_id"]) >= 20


def test_personal_data_of_a_long_text(spark):
    """Work grows with the text: five megabytes with fifty thousand addresses take seconds, not hours."""
    text = " ".join(f"some words here and there then w{k} user{k}@mail.example.org and more words, call 10.1.2.{k % 256} now done" for k in range(50_000))
    began = time.time()
    row = op07_pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    masked = op07_pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert len(text) > 5_000_000 and (row.n_email, row.n_ip) == (50_000, 50_000) and time.time() - began < 60
    assert masked == re.sub(r"10\.1\.2\.\d+", "[IP]", re.sub(r"user\d+@mail\.example\.org", "[EMAIL]", text))


def test_masks_follow_the_spans(spark):
    """Against masks put in one by one, with spans inside and across one another and around block edges."""
    rnd = random.Random(8)
    parts = ["a@b.co", "x@10.0.0.1", "10.0.0.7", "4111 1111 1111 1111", "+1 (988) 555-2485", "+4111111111111111", "ssn 123-45-6789", "DE89 3704 0044 0532 0130 00", "é", "😀", " ", "w" * 40, ", "]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for k in range(300)]
    docs = docs_frame(spark, rows)
    spans = {r.doc_id: r.spans for r in op07_pii.digest(docs).collect()}
    masked = {r.doc_id: r.text for r in op07_pii.redact(docs).collect()}
    for d, t in rows:
        out, at = "", 0
        for kind, a, b in (x.split(":") for x in spans[d].split(",") if x):
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert masked[d] == out + t[at:]


def test_quality(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, prose(rnd, 60).upper().replace(" ", "!! ") if bad else prose(rnd, 60).capitalize() + "."))
        labels.append((k, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "x"), (1, rows[1][1])]
    labels += [(5, None, 0), (99_999, 1, 0), (None, 1, 1), (8, 0, 0)]
    docs = docs_frame(spark, rows, True)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op08_quality.train(docs, marks)
    got = op08_quality.score(docs, model).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    kept = op08_quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert op08_quality.train(docs, marks.where("quality = 1")) is None
    assert {r.score for r in op08_quality.score(docs, None).collect()} == {0.5}
    assert op08_quality.score(docs_frame(spark, []), model).count() == 0 and op08_quality.keep_good(docs, None).count() == len(rows)


def test_ranker_finds_the_minimum_of_the_pair_loss():
    """Against plain gradient descent on the same pairs: the loss of preferences, logistic in feature differences, with its penalty."""
    rnd = np.random.default_rng(3)
    x = np.column_stack([rnd.normal(0, 1, (60, 3)), np.full(60, 200.0)])
    better = x[:, 0] + 0.8 * rnd.normal(0, 1, 60) > 0
    model = op08_quality.fit(x, better)
    z = op08_quality.expand(x, model.mean, model.scale)
    draw, n = np.random.default_rng(7), op08_quality.PAIRS_PER_ROW * len(x)
    diff = z[draw.choice(np.flatnonzero(better), n)] - z[draw.choice(np.flatnonzero(~better), n)]
    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        w -= 0.3 * (diff.T @ (1 / (1 + np.exp(-diff @ w)) - 1) / n + op08_quality.L2 * w)
    assert np.allclose(model.weights, w, atol=1e-3)
    assert np.isclose(model.cut, np.quantile(z @ w, 1 - better.mean()), atol=1e-3)


def test_ranks_on_held_out_documents():
    """Where labels follow a hidden quality, better documents get higher scores: area under the curve against counting pairs."""
    rnd = random.Random(4)
    texts, good = [], []
    for k in range(500):
        share = (k % 10) / 10
        words = prose(rnd, 80).split()
        texts.append(" ".join(w.upper() + "!!" if rnd.random() < share else w for w in words))
        good.append(rnd.random() > share)
    x = np.array([op08_quality.features(t) for t in texts])
    y = np.array(good)
    model = op08_quality.fit(x[:300], y[:300])
    s = model.score(x[300:])
    wins = [a > b for a in s[y[300:]] for b in s[~y[300:]]]
    assert np.mean(wins) > 0.8


def test_labels_do_not_reach_scores_but_through_the_fit(spark):
    rnd = random.Random(2)
    docs = docs_frame(spark, [(k, prose(rnd, 20)) for k in range(50)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in op08_quality.score(docs, op08_quality.train(docs, m)).collect()) for m in (labels, flipped))
    assert a == b


def test_language_model(spark, odd_rows):
    rnd = random.Random(7)
    rows = odd_rows + [(1000 + k, " ".join(f"{'abc'[j % 3]}{rnd.randrange(4)}" for j in range(200))) for k in range(60)]
    got = op10_bilinear.score_documents(docs_frame(spark, rows, True)).collect()
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in rows]
    learned = [d is None or zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    counts = Counter(w for t, ok in zip(tokens, learned, strict=True) if ok for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, not ok, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5)) for (d, _), ok, t in zip(rows, learned, tokens, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    fresh = [r for r in got if r.held_out and (r.doc_id or 0) >= 1000]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh) + 20 * len(fresh)


def test_word_probabilities_sum_to_one():
    """Over all words and the end, whatever the parameters: classes, groups, places, and the rare words of a place with one unseen word each."""
    rnd = np.random.default_rng(4)
    words = [b"w%d" % k for k in range(4000)]
    counts = np.sort(rnd.integers(5, 90, len(words)))[::-1].copy()
    groups = op10_bilinear.TAIL * op10_bilinear.GROUPS
    rare_words, rare_tokens = rnd.integers(0, 3, groups), rnd.integers(3, 9, groups)
    corpus = op10_bilinear.Corpus(50, 10_000, 5000, words, counts, rare_words, rare_tokens)
    theta = op10_bilinear.Bilinear.start(corpus.class_counts())
    draw = lambda n: rnd.normal(0, 0.5, (n, op10_bilinear.DIM + 1)).astype(np.float32)
    model = op10_bilinear.Model(theta + rnd.normal(0, 0.3, len(theta)).astype(np.float32), theta, draw(groups), draw(len(corpus.group)))
    codes = np.arange(op10_bilinear.END + 1 + len(corpus.group))
    # every outcome after the same two words: as the third token of a document each
    whole = np.column_stack([np.full(len(codes), 7), np.full(len(codes), 300), codes]).ravel()
    said = op10_bilinear.token_scores(corpus, model, op10_bilinear.choices_of(corpus, (model.groups, model.places)), whole, np.arange(0, len(whole) + 1, 3))[2::3]
    assert abs((10**said).sum() - 1) < 1e-4


def test_choices_learn_what_follows():
    """Against probabilities that are known: outcomes of a choice depend on the context's sign."""
    rnd = np.random.default_rng(5)
    n = 6000
    side = rnd.integers(0, 2, n) * 2 - 1
    h = np.zeros((n, op10_bilinear.DIM + 1), np.float32)
    h[:, 0], h[:, -1] = side, 1
    outcome = np.where(rnd.random(n) < 0.9, (side > 0).astype(int), rnd.integers(0, 2, n))
    order = np.argsort(outcome, kind="stable")
    h, outcome = h[order], outcome[order]
    choices = op10_bilinear.Choices(np.array([0, 2, 3]), np.array([*np.bincount(outcome, minlength=2), 10.0]))
    before = choices.log_probability(h, outcome).sum()
    for _ in range(20):
        sums, tokens = np.zeros_like(choices.theta), np.zeros(2)
        choices.learn(h, outcome, np.ones(n, np.float32), sums, tokens)
        assert tokens.tolist() == [n, 0]
        choices.theta = np.concatenate([sums[:2] / n, sums[2:]])
    after = choices.log_probability(h, outcome).sum()
    # the best possible: 0.95 and 0.05
    best = n * (0.95 * np.log10(0.95) + 0.05 * np.log10(0.05))
    assert before < after < 0 and abs(after - best) < 0.1 * abs(best)


def test_language_model_without_training_documents(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = op10_bilinear.score_documents(docs_frame(spark, [(held, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def brute_maximal(texts, least=50):
    """text to places of every substring that occurs twice and can be extended neither way: by sorted suffixes and their common-prefix intervals."""
    suffixes = sorted((b[p:], d, p) for d, b in texts.items() for p in range(len(b) - least + 1))
    common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for (a, *_), (b, *_) in zip(suffixes, suffixes[1:], strict=False)]
    found = {}
    for length, a, b, _ in op05_repeats.intervals(common, least):
        places = {(d, p) for _, d, p in suffixes[a : b + 1]}
        if len({texts[d][p - 1] if p else (d, p) for d, p in places}) > 1 and len({d for d, _ in places}) > 1:
            found[suffixes[a][0][:length]] = places
    return found


@pytest.mark.parametrize("block, hot", [(8_000_000, 16_384), (900, 16_384), (900, 1)])
def test_maximal_repeats(spark, block, hot):
    """Passages of several hundred bytes that documents share whole or in part, next to others, in copies and within a document."""
    rnd = random.Random(21)
    words = [a + b + c for a in "ba de ki lo mu na pe ro".split() for b in "ra sti nta ly sho ve".split() for c in "n m t s".split()]
    passages = [prose(rnd, n, words) for n in (60, 45, 30, 14, 12)]
    docs = {}
    for k in range(14):
        parts = [prose(rnd, 4, words)]
        for _ in range(rnd.randint(1, 3)):
            p = rnd.choice(passages).split()
            a, b = (0, len(p)) if rnd.random() < 0.6 else sorted((rnd.randint(0, len(p) - 12), len(p)))
            parts += [" ".join(p[a:b]), prose(rnd, rnd.choice((0, 3)), words)]
        docs[k] = " ".join(parts)
    docs[20], docs[21] = docs[3], docs[3] + " and more"
    want = brute_maximal({d: t.encode() for d, t in docs.items()})
    got = {}
    for r in op05_repeats.maximal_repeats(docs_frame(spark, list(docs.items())), block, hot).collect():
        assert r.length == len(r.text)
        got.setdefault(bytes(r.text), []).append((r.doc_id, r.start))
    assert all(len(x) == len(set(x)) for x in got.values())
    assert {t: set(x) for t, x in got.items()} == want
    assert max(map(len, want)) > 400 and len(want) > 15


def _maximal(spark, docs, block, hot=16_384):
    got = {}
    for r in op05_repeats.maximal_repeats(docs_frame(spark, list(docs.items())), block, hot).collect():
        got.setdefault(bytes(r.text), []).append((r.doc_id, r.start))
    assert all(len(x) == len(set(x)) for x in got.values())
    return {t: set(x) for t, x in got.items()}


def test_a_repeat_all_of_whose_parts_occur_elsewhere(spark):
    rnd = random.Random(1)
    whole = "".join(rnd.choice("abcdefgh ") for _ in range(200))
    docs = {1: "x" + whole + "!", 2: "y" + whole + "?", 3: whole[:140], 4: "z" + whole[60:]}
    got = _maximal(spark, docs, 8_000_000)
    assert got == brute_maximal({d: t.encode() for d, t in docs.items()})
    assert {d for d, _ in got[whole.encode()]} == {1, 2}


@pytest.mark.parametrize("seed, hot", [(1, 16_384), (2, 1), (3, 16_384)])
def test_nested_repeats(spark, seed, hot):
    """Pieces of pieces of a few texts, in any order, with the bytes about them shared or not: every repeat with all its places."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(400)) for _ in range(3)]
    docs = {}
    for k in range(40):
        text = ""
        for _ in range(rnd.randint(1, 4)):
            source = rnd.choice(pool)
            a = rnd.choice((0, 0, rnd.randint(0, 300)))
            text += source[a : a + rnd.choice((400, rnd.randint(20, 200)))] + rnd.choice(("", "", f"<{k}>"))
        docs[k] = text
        if rnd.random() < 0.3:
            pool.append(text[:600])
    assert _maximal(spark, docs, 3000, hot) == brute_maximal({d: t.encode() for d, t in docs.items()})


def test_maximal_repeats_list_all_occurrences(spark, odd_rows):
    rnd = random.Random(3)
    line = prose(rnd, 14)[:70]
    rows = [(d, t) for d, t in odd_rows if d is not None and d != 11 and len(t or "") < 5000] + [(300 + k, prose(rnd, 10) + "\n" + line + "\n" + prose(rnd, 12)) for k in range(12)]
    texts = {d: (t or "").encode() for d, t in rows}
    groups = {}
    for r in op05_repeats.maximal_repeats(docs_frame(spark, rows), 1500).collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == bytes(r.text)
        groups.setdefault(bytes(r.text), set()).add((r.doc_id, r.start))
    assert any(line.encode() in g for g in groups)
    for text, found in groups.items():
        want = {(d, m.start()) for d, b in texts.items() for m in re.finditer(b"(?=" + re.escape(text) + b")", b)}
        assert found == want and len(found) > 1 and len(text) >= 50


def test_maximal_repeats_keep_no_text_for_each_window(spark):
    """A long copy in which every line begins a window: what is stored grows with its length, not with its square."""
    from voxloom.llm.shared import shared_root

    rnd = random.Random(8)
    lines = ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(70)) for _ in range(150)]
    whole = "\n".join(lines)
    docs = {1: whole + "x", 2: whole + "y" * 9, **{10 + k: f"{k} {line}" for k, line in enumerate(lines)}}
    folder = Path(shared_root(spark).removeprefix("file:")) / "voxloom"
    before = set(folder.glob("*")) if folder.exists() else set()
    assert _maximal(spark, docs, 8_000_000) == brute_maximal({d: t.encode() for d, t in docs.items()})
    stored = 0
    for table in set(folder.glob("*")) - before:
        rows = spark.read.parquet(f"file://{table}") if list(table.glob("*.parquet")) else None
        for c, kind in rows.dtypes if rows else ():
            stored += rows.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0] if kind == "binary" else 0
    assert stored < 15 * sum(map(len, docs.values()))


@pytest.mark.parametrize("rows_of_batch", [1, 3, 10_000])
def test_windows_of_repeats_stream_by(spark, monkeypatch, rows_of_batch):
    """Many windows with a few texts each: no call of Python for each window, and a window's texts may come in several batches."""
    rnd = random.Random(5)
    lines = [f"{k} " + "".join(rnd.choice("abcdefghijklmnop ") for _ in range(75)) for k in range(40)]
    docs = {}
    for k, line in enumerate(lines):
        for copy in range(4):
            docs[10 * k + copy] = f"{copy}{line[: 60 + 5 * copy]}|{'' if copy < 2 else rnd.choice(lines)}"
    plans = {}
    kept = op05_repeats.written

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(op05_repeats, "written", written)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_batch)
    try:
        assert _maximal(spark, docs, 8_000_000) == brute_maximal({d: t.encode() for d, t in docs.items()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name in ("ranked", "maximal"):
        assert "FlatMapGroups" not in plans[name]
