"""SimHash, bit-sliced search and connected components against brute force."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from samples import docs_frame, prose

from voxloom.llm import components, jaccard, op01_simhash, op09_bit_sliced, op13_jaccard


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, near):
    ids = sorted(values)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near(values[a], values[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, odd_rows):
    for extra in (False, True):
        got = op01_simhash.near_duplicates(docs_frame(spark, odd_rows, extra)).collect()
        assert len(got) == len(odd_rows)
    values = {d: brute_fingerprint(t) for d, t in odd_rows if d is not None}
    want = brute_components(values, lambda a, b: bin(a ^ b).count("1") <= 2)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (values[r.doc_id], want[r.doc_id])
    assert {r.component_id for r in got if r.doc_id is None} == {3, 20}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def within_two(values):
    """Least member of each value's component, by looking up all values within two bits."""
    label = {}
    for v in sorted(values, key=signed):
        if v in label:
            continue
        todo = [v]
        label[v] = v
        while todo:
            x = todo.pop()
            for y in (x ^ (1 << i) ^ (1 << j if j < i else 0) for i in range(64) for j in range(i + 1)):
                if y in values and y not in label:
                    label[y] = v
                    todo.append(y)
    return {signed(k): signed(v) for k, v in label.items()}


@pytest.mark.parametrize("templates, members, flips", [(4, 120, 4), (1, 5000, 5), (1, 3000, 2)])
def test_links_of_large_groups(spark, templates, members, flips):
    rnd = random.Random(1)
    values = set()
    for _ in range(templates):
        base = rnd.getrandbits(64)
        for _ in range(members):
            x = base
            for _ in range(rnd.randint(0, flips)):
                x ^= 1 << rnd.randrange(64)
            values.add(x)
    df = spark.createDataFrame([(signed(v),) for v in sorted(values)], "fp long")
    got = {r.node: r.label for r in components.components(op01_simhash.links(df)).collect()}
    want = within_two(values)
    assert {k: got.get(k, k) for k in want} == want


def test_forest_connects_those_within_two_bits():
    rnd = random.Random(2)
    for n, bits in ((3, 5), (60, 22), (300, 22), (2000, 12)):
        base = rnd.getrandbits(64)
        values = {base ^ (rnd.getrandbits(bits) << 40) & (2**64 - 1) for _ in range(n)}
        want = within_two(values)
        a, b = op01_simhash.forest(np.array([signed(v) for v in values], np.int64))
        parent = dict(zip(a.tolist(), b.tolist(), strict=True))
        groups = {}
        for v in want:
            groups.setdefault(want[v], set()).add(parent.get(v, v))
        assert all(len(roots) == 1 for roots in groups.values()) and len({r for g in groups.values() for r in g}) == len(groups)


def test_empty_table(spark):
    none = docs_frame(spark, [])
    assert op01_simhash.near_duplicates(none).count() == 0
    assert op01_simhash.keep_first(none).count() == 0


def test_large_groups_get_narrow_keys_only_where_their_wildcard_matters(spark):
    rng, low = random.Random(5), 0x89ABCDEF
    template = {low | rng.getrandbits(32) << 32 for _ in range(50)}
    cloud = {low ^ 1 << rng.randrange(4) | (0x1234 << 48 ^ 1 << rng.randrange(32, 64)) for _ in range(60)}
    frame = lambda fps: spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    for fps in (template, cloud, template | cloud):
        want = within_two(fps)
        got = {r.node: r.label for r in components.components(op01_simhash.links(frame(fps))).collect()}
        assert len({(got.get(v, v), x) for v, x in want.items()}) == len(set(want.values())) == len({got.get(v, v) for v in want})
    # members that all agree in a segment have six keys each
    assert op01_simhash._narrow(op01_simhash._variants(frame(template)).where("key < 137438953472")).count() == 6 * len(template)


def test_keep_first_drops_near_copies_and_keeps_others(spark):
    rnd = random.Random(9)
    words = [a + b + c for a in "ba de ki lo mu na pe ro".split() for b in "ra sti nta ly sho ve".split() for c in "n m t s".split()]
    base = [prose(rnd, 150, words) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(30):  # near copies of document 7: two words changed
        w = base[7].split()
        w[rnd.randrange(150)] = w[rnd.randrange(150)] = f"new{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, base[3]), (201, None), (202, ""), (None, "z")]
    kept = op01_simhash.keep_first(docs_frame(spark, rows, True))
    assert kept.columns == docs_frame(spark, rows, True).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [*range(20), 201]
    assert kept.where("doc_id is null").count() == 1


def test_keep_first_takes_simhash_links_besides_exact_ones(spark):
    """Texts of one shingle said over and over have one fingerprint, though they share less than 0.8 of their shingles."""
    said = "one two three four five " * 40
    rows = [(1, said + "and then some more words here"), (2, said + "but now quite other ones follow it"), (3, "nothing of the kind is said in this text")]
    assert op01_simhash.fingerprint(rows[0][1], 5) != 0
    far = (op01_simhash.fingerprint(rows[0][1], 5) ^ op01_simhash.fingerprint(rows[1][1], 5)) & (2**64 - 1)
    assert far.bit_count() <= 2
    assert sorted(r.doc_id for r in op01_simhash.keep_first(docs_frame(spark, rows, True)).collect()) == [1, 3]


def test_keep_first_goes_by_rows(spark):
    """Unlike texts with one doc_id both stay; the same row twice stays once."""
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    a, b = prose(rnd, 50, words), prose(rnd, 60, words)
    rows = [(1, a), (1, b), (2, a), (3, b + " x"), (4, None), (4, ""), (4, None), (5, " "), (None, a)]
    kept = op01_simhash.keep_first(docs_frame(spark, rows, True))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len(got) == 4 and {(1, a), (1, b), (None, a)} <= set(got)
    assert [d for d, t in got if not (t or "").strip()] == [4]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("blocks", [(32_768, 128), (16, 3)])
def test_top_k(spark, blocks):
    rnd = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rnd.normal(0, 0.2, 12)]) for k in range(160)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (250, rows[5][1]), (300, None), (301, [None] * 12), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (350, []), (None, rows[1][1])]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (50, rows[9][1]), (400, [2e6] + [0.5] * 11), (401, [-1e9] * 12), (402, [1e300] * 12), (450, [1e300] * 12), (403, [1e308] * 3), (500, [1e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op09_bit_sliced.top_k(df, block_rows=blocks[0], block_queries=blocks[1]).orderBy("query_id", "rank").collect()
    whole = lambda x: math.floor(Fraction(x) * 256)
    ok = [(k, [whole(x) for x in v]) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({k for k, _ in ok if k % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for k, v in ok if k == q for c, w in ok if c != q)[:5]
        want += [(q, n + 1, c, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, c) in enumerate(best)]
    assert [tuple(r) for r in got] == want


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert op09_bit_sliced.top_k(spark.createDataFrame([], schema)).count() == 0
    assert op09_bit_sliced.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in op09_bit_sliced.top_k(spark.createDataFrame([(0, [1.0]), (1, [-2.0])], schema)).collect()] == [(0, 1, 1, 256 * -512)]


def test_sliced_scores_sum_up():
    rnd = np.random.default_rng(3)
    values = rnd.integers(-300, 300, (500, 6))
    block = op09_bit_sliced.SlicedBlock(np.arange(500), values)
    query = rnd.integers(-40, 40, 6)
    slices = block.scores(query)
    total = sum(np.unpackbits(s.view(np.uint8), count=500, bitorder="little").astype(np.int64) << p for p, s in enumerate(slices))
    assert len({*(total - values @ query).tolist()}) == 1


def shares(a, b):
    """Part of the different five-word shingles of two texts that both have."""
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_of_shuffled_passages(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    same = [prose(rnd, 11, words) for _ in range(24)]
    texts = {k: " ".join(rnd.sample(same, 24)) for k in range(24)}
    changed = texts[17].split()
    changed[100] = "changed"
    texts[50] = " ".join(changed)
    got = {r.doc_id: r.component_id for r in op01_simhash.similar_documents(docs_frame(spark, list(texts.items()))).collect()}
    assert got == brute_components(texts, lambda a, b: shares(a, b) >= 0.8)
    assert got[50] == 17 and len(set(got.values())) == 24


def test_pages_of_one_template_meet_nobody(spark, monkeypatch):
    """Pages that share 0.77 of their shingles: what is compared grows with the pages, not with their pairs."""
    rnd = random.Random(12)
    template = prose(rnd, 1000, [f"w{k}" for k in range(5000)])
    texts = {k: f"{template} {prose(rnd, 150, [f'own{k}x{j}' for j in range(150)])}" for k in range(120)}
    tiles = []
    monkeypatch.setattr(jaccard, "_members", lambda *a, f=jaccard._members: tiles.append(f(*a)) or tiles[-1])
    monkeypatch.setattr(jaccard, "drop_written", lambda df: None)
    got = op01_simhash.similar_documents(docs_frame(spark, list(texts.items()))).collect()
    assert {r.component_id for r in got} == set(texts) and tiles[0].count() == 0


def brute_sets(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def test_jaccard_components(spark, odd_rows):
    """Whole result against brute force: odd rows, extensions about the threshold, passages in many texts, near copies."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    rows = list(odd_rows)
    common = prose(rnd, 40, words)
    for k in range(60):
        base = prose(rnd, rnd.randint(3, 150), words) + (f" {common}" if k % 2 else "")
        rows.append((1000 + 10 * k, base))
        rows += [(1001 + 10 * k + j, f"{base} {prose(rnd, max(1, round(len(base.split()) * part)), words)}") for j, part in enumerate((0.02, 0.05, 0.1, 0.111, 0.12, 0.2))]
    copy = prose(rnd, 100, words).split()
    for k in range(150):
        other = list(copy)
        for _ in range(k % 4):
            other[rnd.randrange(100)] = f"x{rnd.randrange(40)}"
        rows.append((3000 + k, " ".join(other)))
    rows += [(4000, "A b"), (4001, "a B"), (4002, "a"), (4003, "a b c"), (4004, "x y z " * 9), (4005, "x y z x y z"), (None, None)]
    rnd.shuffle(rows)
    for extra in (False, True):
        got = op13_jaccard.jaccard_components(docs_frame(spark, rows, extra)).collect()
        assert len(got) == len(rows)
    sets = {(d, t): brute_sets(t) for d, t in rows}
    texts = sorted(sets, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    number = {x: k for k, x in enumerate(texts)}
    near = lambda a, b: sets[texts[a]] and sets[texts[b]] and 100 * len(sets[texts[a]] & sets[texts[b]]) >= 90 * len(sets[texts[a]] | sets[texts[b]])
    label = brute_components({number[x]: number[x] for x in texts}, near)
    want = sorted(str((d, len(sets[d, t]), texts[label[number[d, t]]][0])) for d, t in rows)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert op13_jaccard.jaccard_components(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_prefixes_of_linked_sets_meet(percent):
    """Whatever the order of shingles, the smaller set's index prefix and the larger one's probing prefix share one."""
    rnd = random.Random(percent)
    for _ in range(3000):
        small, both = rnd.randint(1, 40), 0
        large = rnd.randint(small, small * 100 // percent)
        both = -(-percent * (small + large) // (100 + percent))
        if both > small:
            continue
        order = rnd.sample(range(small + large - both), small + large - both)
        a, b = sorted(order[:small]), sorted(order[small - both :])
        i, p = jaccard.prefix_sizes(len(a), percent)[0], jaccard.prefix_sizes(len(b), percent)[1]
        assert set(a[:i]) & set(b[:p])


def test_links_are_decided_by_whole_sets_of_shingles(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    texts = {}
    for k in range(40):
        texts[10 * k] = prose(rnd, 120 + k, words)
        for j, part in enumerate((0.42, 0.34, 0.27, 0.22, 0.2, 0.1)):
            texts[10 * k + 1 + j] = texts[10 * k] + " " + prose(rnd, int((120 + k) * part), words)
    got = {r.doc_id: r.component_id for r in op01_simhash.similar_documents(docs_frame(spark, list(texts.items()))).collect()}
    assert got == brute_components(texts, lambda a, b: a[:20] == b[:20] and shares(a, b) >= 0.8)


def test_large_group_of_near_copies(spark):
    """Two thousand copies of one text with up to a fifth of it changed, and others of a page frame that share less: every link, by brute force."""
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    template, frame = prose(rnd, 160, words).split(), prose(rnd, 60, words)
    texts = {}
    for k in range(2000):
        copy = list(template)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 5, 6))):
            copy[rnd.randrange(160)] = f"x{rnd.randrange(300)}"
        texts[k] = " ".join(copy)
    texts |= {5000 + k: f"{frame} {prose(rnd, rnd.randint(40, 60), words)}" for k in range(150)}
    texts |= {6000 + k: texts[5000 + k] + " end" for k in range(0, 150, 5)}
    sets = {d: frozenset(brute_sets(t, 5)) for d, t in texts.items()}
    number = {h: k for k, h in enumerate(sorted(set().union(*sets.values())))}
    ids, flags = sorted(texts), np.zeros((len(texts), len(number)), np.float32)
    for row, d in enumerate(ids):
        flags[row, [number[h] for h in sets[d]]] = 1
    both, size = flags @ flags.T, flags.sum(1)
    near = both / (size[:, None] + size[None, :] - both) >= 0.8
    label = np.arange(len(ids))
    while True:
        least = np.array([label[near[k]].min() for k in range(len(ids))])
        if (least == label).all():
            break
        label = least
    want = {d: ids[label[k]] for k, d in enumerate(ids)}
    got = {r.doc_id: r.component_id for r in op01_simhash.similar_documents(docs_frame(spark, list(texts.items()))).collect()}
    assert got == want and 100 < len(set(want.values())) < 2000
