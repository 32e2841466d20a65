"""The filter audit and hard-negative mining against brute force."""

import math
import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from samples import EXTRA, prose

from voxloom.llm import op11_filter_audit, op12_ball_tree

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = {}
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t]]
        parts.setdefault(s or "", []).append((d, {"ABCDE"[k] for k, x in enumerate(fails) if x}))
    rows = []
    for part, found in parts.items():
        removed_in_all = dict.fromkeys("ABCDE", 0)
        made = []
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                own, before = order[step - 1], set(order[: step - 1])
                removed = [d for d, f in found if own in f and not f & before]
                removed_in_all[own] += len(removed)
                made.append((order, step, sum(not f & {own, *before} for _, f in found), removed, sum(own in f and bool(f & before) for _, f in found), sum(f == {own} for _, f in found)))
        rows += [(part, o, s, kept, len(r), redundant, unique, sum(d in good for d in r), sum(d in toxic for d in r), removed_in_all[o[s - 1]]) for o, s, kept, r, redundant, unique in made]
    return sorted(rows)


def test_audit(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    texts = [None, "", " \n", "a", "A B c", "50% off", "É" * 300 + " É", *[prose(rnd, n, words) for n in (199, 200, 300, 5000, 60_000)], "x y " * 150, ("Loud words " * 30 + prose(rnd, 200, words))]
    long = texts[-3]
    texts += [long[:-1] + "!", long[: len(long) // 2] + "~" + long[len(long) // 2 + 1 :], "b" + long[1:]]  # one length, unlike in one block each
    docs = [(k, rnd.choice(texts), rnd.choice(["s1", "s2", None, ""])) for k in rnd.sample(range(1000), 150)]
    docs += [(2000 + k, texts[8], "hot") for k in range(1100)] + [(2000, texts[8], "s1"), (None, texts[8], "s1"), (None, None, None), (-5, texts[4], "s2"), docs[0], docs[0]]
    labels = [(d, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for d, _, _ in docs[:90]] + [(None, 1, 1), (docs[0][0], 1, 0)]
    rnd.shuffle(docs)
    want = brute_audit(docs, labels)
    for extra in (False, True):
        df = spark.createDataFrame(docs, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in (EXTRA | {"class": 1, "part": "q", "mask": 3, "salt": 4, "words": "x", "length": 1, "blocks": 2}).items()})
        assert sorted(map(tuple, op11_filter_audit.audit(df, spark.createDataFrame(labels, LABELS)).collect())) == want


def test_audit_of_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, None, None)], DOCS)
    assert op11_filter_audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    assert sorted(map(tuple, op11_filter_audit.audit(one, spark.createDataFrame([], LABELS)).collect())) == brute_audit([(1, None, None)], [])


def test_classes_of_equal_hashes_are_told_apart(spark, monkeypatch):
    """Whole texts decide, even if all hashes of blocks were the same."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(op11_filter_audit, "block_hashes", lambda text: F.array(F.length(text).cast("long") * 0))
    docs = [(k, t, "s") for k, t in enumerate(["ab", "cd", "ab", "ef", "cd", "xyz", "ab"])]
    found = op11_filter_audit.duplicates(spark.createDataFrame(docs, DOCS))
    assert sorted(r.doc_id for r in found.collect()) == [2, 4, 6]


def brute_negatives(rows):
    whole = lambda x: math.floor(Fraction(x) * 256)
    ok = [(i, [whole(x) for x in v], label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    clamp = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    out = []
    for q, v, label in ok:
        if q % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c, other) for c, w, other in ok if c != q)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            found = [(c, -t) for t, c, other in scored if other != label and -80 * s <= -100 * t <= -100 * s][:5]
            out += [(q, p, n + 1, c, clamp(-s), clamp(t)) for n, (c, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(32_768, 128, 256), (40, 3, 4)])
def test_hard_negatives(spark, sizes):
    rnd = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rnd.normal(0.05, 0.2, 8)], int(rnd.integers(0, 3)) if k % 3 else 7) for k in range(0, 330)]
    rows += [(400 + k, rows[100][1], k % 4) for k in range(60)]  # one vector many times, a tie that ids decide
    rows += [(500, [1e200] * 8, 1), (501, [1e200] * 8, 1), (502, [9e199] * 8, 2), (600, [1e5] + [0.0] * 7, 2), (601, [9e4] * 8, 1), (602, [3e6] * 8, 2), (603, [-1e308] * 8, 2)]
    rows += [(700, None, 1), (701, [None] * 8, 1), (702, [float("nan")] * 8, 1), (703, [float("inf")] + [0.0] * 7, 1), (704, rows[1][1], None), (None, rows[1][1], 1), (800, [], 1), (900, [0.5] * 3, 7), (901, [0.5] * 3, 7), (902, [0.45] * 3, 8)]
    rows += [(5, rows[6][1], 1), (5, rows[6][1], 1), (17, rows[8][1], 2), (2**62 // 100 * 100, rows[4][1], -1), (-100, rows[9][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as nr", "2 as anchor", "3 as block", "'x' as score", "4 as split", "5 as large")
    got = op12_ball_tree.hard_negatives(df, block_rows=sizes[0], batch=sizes[1], leaf=sizes[2]).collect()
    want = brute_negatives(rows)
    assert len(want) > 60 and sorted(map(tuple, got)) == want


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        assert op12_ball_tree.hard_negatives(spark.createDataFrame(rows, schema)).count() == 0
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.7], 2), (4, [1.1], 2)]
    assert [tuple(r) for r in op12_ball_tree.hard_negatives(spark.createDataFrame(rows, schema)).collect()] == [(0, 1, 1, 2, 65536, 58880)]


def test_bounds_prune_and_lose_nothing():
    """Clustered rows: few leaves are opened, and the best rows are those of a full comparison."""
    rnd = np.random.default_rng(8)
    middles = rnd.normal(0, 200, (40, 16))
    values = np.floor(np.repeat(middles, 100, axis=0) + rnd.normal(0, 2, (4000, 16)))
    ids = rnd.permutation(4000)
    tree = op12_ball_tree.Tree(ids.copy(), values.copy(), leaf=50)
    opened = []
    search = op12_ball_tree.Search(np.full(20, -1), values[::200].copy(), 5, np.arange(20))
    leaf = search._leaf
    search._leaf = lambda t, a, b, who: (opened.append(len(who)), leaf(t, a, b, who))
    search.descend(tree)
    scores = values[::200] @ values.T
    assert [[i for _, i in x] for x in search.best] == [[i for _, i in sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:5]] for s in scores]
    assert sum(opened) < 0.5 * 20 * 4000 / 50


def test_sort_keys():
    numbers = sorted([0, 1, -1, 127, 128, -128, -129, 255, 256, 2**63, -(2**63), 10**40, -(10**40), 10**300])
    assert sorted(numbers, key=op12_ball_tree.sort_key) == numbers


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_ball_tree", "op13_jaccard"])
def test_same_rows_as_sql(spark, small, name):
    import compare

    from voxloom.llm import queries

    assert compare.difference(spark, small, queries.QUERIES[name], queries.ORACLES[name], compare.oracle(small)) == ""
