"""Hard negatives by branch and bound in ball trees.

Vectors are quantised to integers and dealt to blocks of rows. A block holds a ball tree for each label: a node is a run of rows with a
centre and a radius, so the inner product of an anchor q with any of its rows lies within q . centre +- |q| radius.
Anchors go through a block in batches, all of a batch down the tree at once; at each node those go on for which the bounds leave something to find:

1. Positives: the best rows in the tree of the anchor's own label. A node is pruned if its upper bound is below the current k-th score.
2. Negatives: for each positive a window of scores. A node is pruned if it lies outside the window, or strictly beneath the k-th
   score of those found in it. Trees of the anchor's own label are left out.

A block's best rows are merged with those of the other blocks after each pass. Bounds are taken a little wider than floating point makes
them, and scores are integers: exact in doubles where all partial sums are below 2 ** 53. Rows and anchors of very large components are
compared without bounds in Python's integers; a score beyond a long is returned as the nearest long.

Anchors lie in a file of the shared folder, which tasks stream in small batches, so a task holds a block and a batch.

Defined cases: a row without an id or label, or whose vector is null or holds a null or non-finite component, takes no part; vectors of
different lengths are compared as if filled up with zeros (an empty vector scores zero); an anchor's own row is every row with its
id; rows that repeat an id are candidates each, and anchors each; ties go to the smaller id; an anchor without positives or
negatives gives no rows, nor does an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.shared import drop_folder, drop_written, work_folder, written

#: Quantisation: floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these parts of the positive's, in per cent.
LOW, HIGH = 80, 100
#: Rows of a block and of a leaf, and anchors that a task holds at once.
BLOCK_ROWS, LEAF, BATCH = 32_768, 256, 128
_LONG = 2**63


def quantised(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond a double (such an x is whole)."""
    return math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale


def matrix(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Quantised rows, filled up to `width`: doubles if all are small enough for exact products, else Python's integers."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.zeros((len(sizes), width))
    inside = np.arange(width)[None, :] < sizes[:, None]
    with np.errstate(over="ignore"):
        values[inside] = np.floor(scale * flat)
    if is_small(values):
        return values
    out = np.zeros(values.shape, object)
    out[inside] = [quantised(x, scale) for x in flat.tolist()]
    return out


def is_small(values: np.ndarray) -> bool:
    """Products of two such rows and all their partial sums are whole numbers below 2 ** 53."""
    return not values.size or bool(np.abs(values).max() ** 2 * values.shape[1] < 2**53)


class Tree:
    """A ball tree over rows; `ids` and `values` are in its order, a node's rows being a run, which in a leaf is sorted by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        self.ids, self.values, self.exact = ids, values, values.dtype == object
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left and right child (or -1)
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._build(0, len(ids), len(ids) if self.exact else leaf)

    def _build(self, a: int, b: int, leaf: int) -> int:
        """The node of rows a to b, split at the median along the line between two far rows."""
        node, order = len(self.nodes), None
        self.nodes.append((a, b, -1, -1))
        rows = np.zeros((1, self.values.shape[1])) if self.exact else self.values[a:b]
        self.centres.append(rows.mean(0))
        away = np.sqrt(((rows - self.centres[node]) ** 2).sum(1))
        self.radii.append(np.inf if self.exact else float(away.max()))
        if b - a <= leaf:
            order = np.argsort(self.ids[a:b], kind="stable")
        else:
            far = rows - rows[away.argmax()]
            order = np.argsort(far @ far[(far**2).sum(1).argmax()], kind="stable")
        self.ids[a:b], self.values[a:b] = self.ids[a:b][order], self.values[a:b][order]
        if b - a > leaf:
            middle = (a + b) // 2
            left = self._build(a, middle, leaf)
            self.nodes[node] = (a, b, left, self._build(middle, b, leaf))
        return node


def _float(x: float) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


class Search:
    """A batch of searches, each of an anchor (`owner` numbers the rows ids, values) in a window of scores, with the k best rows found."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int, owner: np.ndarray, windows: list[tuple[int, int]] | None = None):
        self.ids, self.values, self.k, self.owner, self.exact = ids, values, k, owner, values.dtype == object
        self.near = np.zeros(values.shape) if self.exact else values
        self.norms = np.full(len(ids), np.inf) if self.exact else np.sqrt((values**2).sum(1))
        self.windows = windows
        if windows is not None:
            self.low, self.high = (np.array([_float(w[side]) for w in windows]) for side in (0, 1))
        self.best: list[list[tuple[int, int]]] = [[] for _ in owner]  # (-score, id), ascending
        self.kth = np.full(len(owner), -np.inf)

    def descend(self, tree: Tree) -> None:
        """Look for better rows in a tree, first in the child that promises more to most."""
        todo = [(0, np.arange(len(self.owner)))]
        while todo:
            node, who = todo.pop()
            who = who[self._bounded(tree, node, who)]
            if not len(who):
                continue
            a, b, left, right = tree.nodes[node]
            if left < 0:
                self._leaf(tree, a, b, who)
            else:
                q = self.near[self.owner[who]]
                first = (q @ (tree.centres[left] - tree.centres[right]) > 0).mean() >= 0.5
                todo += [(right, who), (left, who)] if first else [(left, who), (right, who)]

    def _bounded(self, tree: Tree, node: int, who: np.ndarray) -> np.ndarray:
        """Which searches may find something in the node; a bound that is no number leaves nothing out."""
        q, centre = self.owner[who], tree.centres[node]
        with np.errstate(invalid="ignore"):
            middle, reach = self.near[q] @ centre, self.norms[q] * tree.radii[node]
            slack = 1e-9 * (reach + self.norms[q] * np.sqrt((centre**2).sum())) + 1e-3
            low, high = middle - reach - slack, middle + reach + slack
        out = high < self.kth[who]
        if self.windows is not None:
            out |= (high < self.low[who]) | (low > self.high[who])
        return ~out

    def _scores(self, tree: Tree, a: int, b: int, who: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of each search with rows a to b, and the least score that counts, the window's low and high end."""
        owners, place = np.unique(self.owner[who], return_inverse=True)
        if not (tree.exact or self.exact):
            return (self.values[owners] @ tree.values[a:b].T)[place], [self.kth[who], *([] if self.windows is None else [self.low[who], self.high[who]])]
        rows = [[int(x) for x in v] for v in tree.values[a:b]]
        scores = np.empty((len(owners), b - a), object)
        for i, o in enumerate(owners):
            q = [int(x) for x in self.values[o]]
            scores[i] = [sum(x * y for x, y in zip(q, v, strict=True)) for v in rows]
        ends = [np.array([-self.best[w][-1][0] if len(self.best[w]) == self.k else -math.inf for w in who], object)]
        return scores[place], ends + ([] if self.windows is None else [np.array([self.windows[w][side] for w in who], object) for side in (0, 1)])

    def _leaf(self, tree: Tree, a: int, b: int, who: np.ndarray) -> None:
        scores, ends = self._scores(tree, a, b, who)
        ok = (tree.ids[None, a:b] != self.ids[self.owner[who]][:, None]) & (scores >= ends[0][:, None]).astype(bool)
        if self.windows is not None:
            ok &= (scores >= ends[1][:, None]).astype(bool) & (scores <= ends[2][:, None]).astype(bool)
        for j in np.flatnonzero(ok.any(1)).tolist():
            w, at = who[j], np.flatnonzero(ok[j])
            mine = scores[j, at]
            if len(at) > self.k:  # rows are in the order of their ids, which decides ties
                chosen = np.argsort(-mine, kind="stable")[: self.k]
                at, mine = at[chosen], mine[chosen]
            self.best[w] = sorted([*self.best[w], *zip((-int(x) for x in mine), tree.ids[a + at].tolist(), strict=True)])[: self.k]
            if len(self.best[w]) == self.k:
                self.kth[w] = _float(-self.best[w][-1][0])


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest integers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _forest(found: pa.Table, width: int, scale: int, leaf: int) -> list[tuple[int, Tree]]:
    """A block's trees with their labels: for each label one of rows with small components and one of the others."""
    out = []
    labels, ids, large = (found[x].to_numpy() for x in ("label", "vec_id", "large"))
    for label in np.unique(labels).tolist():
        for kind in (0, 1):
            at = np.flatnonzero((labels == label) & (large == kind))
            if len(at):
                out.append((label, Tree(ids[at], matrix(found["embedding"].take(pa.array(at)).combine_chunks(), width, scale), leaf)))
    return out


def sort_key(score: int) -> bytes:
    """Bytes that sort as integers of any size do."""
    size = (abs(score).bit_length() + 8) // 8
    return (2**15 + (size if score >= 0 else -size)).to_bytes(2, "big") + (score % (1 << 8 * size)).to_bytes(size, "big")


_FOUND = {"anchor": pa.int64(), "nr": pa.int32(), "id": pa.int64(), "score": pa.int64(), "exact": pa.string(), "key": pa.binary()}


def _best_of_blocks(index: DataFrame, anchors: str, width: int, scale: int, batch: int, leaf: int, k: int, limits: tuple[int, int] | None) -> DataFrame:
    """anchor, nr, id, score, exact (as text), key (that sorts as scores do): the k best rows of each block for each anchor of the folder `anchors`.

    Without `limits` these are rows of the anchor's label; else rows of other labels in the window of each of its positives (`nr`, in the column positives).
    """

    def find(key: tuple, found: pa.Table) -> pa.Table:
        import pyarrow.dataset as ds
        from pyarrow import fs

        trees = _forest(found, width, scale, leaf)
        store, path = fs.FileSystem.from_uri(anchors)
        asked = ds.dataset(path, filesystem=store, format="parquet").to_batches(filter=ds.field("split") == key[1].as_py(), batch_size=batch, batch_readahead=1, fragment_readahead=1)
        out: list[tuple] = []
        for part in asked:
            labels, large = part["label"].to_numpy(), part["large"].to_numpy()
            for label, kind in sorted(set(zip(labels.tolist(), large.tolist(), strict=True))):
                mine = part.take(pa.array(np.flatnonzero((labels == label) & (large == kind))))
                ids, values, names = mine["vec_id"].to_numpy(), matrix(mine["embedding"], width, scale), mine["anchor"].to_pylist()
                if limits is None:
                    search, names = Search(ids, values, k, np.arange(len(ids))), [(x, 0) for x in names]
                else:
                    asked_ = [(row, x["nr"], window(int(x["exact"]), *limits)) for row, xs in enumerate(mine["positives"].to_pylist()) for x in xs]
                    asked_ = [x for x in asked_ if x[2][0] <= x[2][1]]
                    search = Search(ids, values, k, np.array([x[0] for x in asked_], np.int64), [x[2] for x in asked_])
                    names = [(names[row], nr) for row, nr, _ in asked_]
                for other, tree in trees:
                    if (other == label) == (limits is None):
                        search.descend(tree)
                out += [(*name, i, min(max(-s, -_LONG), _LONG - 1), str(-s), sort_key(-s)) for name, best in zip(names, search.best, strict=True) for s, i in best]
        columns = list(zip(*out, strict=True)) or [()] * len(_FOUND)
        return pa.table({n: pa.array(x, t) for (n, t), x in zip(_FOUND.items(), columns, strict=True)})

    return index.groupBy("block", "split").applyInArrow(find, "anchor long, nr int, id long, score long, exact string, key binary")


def hard_negatives(
    vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    block_rows: int = BLOCK_ROWS, batch: int = BATCH, leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row of `vectors` (vec_id, embedding, label) where `is_anchor` holds, its `positives` best rows of the same label; for each of these the
    `negatives` best rows of other labels whose scores are between `low` and `high` per cent of the positive's.
    """
    spark = vectors.sparkSession
    takes_part = "vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    rows = vectors.select("vec_id", "label", "embedding").where(F.coalesce(F.expr(takes_part), F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    width = max(width, 1)
    limit = 0.99 * math.sqrt(2**53 / width) / scale - 1
    rows = rows.withColumn("large", F.exists("embedding", lambda x: F.abs(x) >= F.lit(limit)).cast("int"))
    blocks = max(1, -(-n // block_rows))
    splits = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    index = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "vec_id", "label", "embedding", "large")
    search = lambda folder, k, limits: _best_of_blocks(index, folder, width, scale, batch, leaf, k, limits)

    folder, again = work_folder(spark, "anchors"), work_folder(spark, "windows")
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(splits)).cast("int").alias("split")
    rows.where(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), deal, "vec_id", "label", "embedding", "large").write.parquet(folder)
    best = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("key"), "id"))
    found = search(folder, positives, None).withColumn("nr", best("anchor")).where(F.col("nr") <= positives)
    found = written(found.select("anchor", "nr", "id", "score", "exact"), "positives")
    asked = spark.read.parquet(folder).join(found.groupBy("anchor").agg(F.collect_list(F.struct("nr", "exact")).alias("positives")), "anchor")
    asked.write.parquet(again)
    chosen = search(again, negatives, (low, high)).withColumn("rank", best("anchor", "nr")).where(F.col("rank") <= negatives).select("anchor", "nr", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = written(chosen, "negatives")
    names = spark.read.parquet(folder).select("anchor", F.col("vec_id").alias("anchor_id"))
    pairs = found.join(names, "anchor").select("anchor", "nr", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = written(chosen.join(pairs, ["anchor", "nr"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for done in (folder, again):
        drop_folder(spark, done)
    for done in (found, chosen):
        drop_written(done)
    return out


SQL = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF NOT coalesce(isfinite(x), false)]) = 0
    ), s AS (
        SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), p AS (
        SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), n AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
            s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
    )
    SELECT * FROM n WHERE rank <= 5
"""
