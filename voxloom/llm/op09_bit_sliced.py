"""Exact top-k search by a bit-sliced index.

Vectors are quantised to integers. A block of rows holds, for each dimension, one bitmap per bit
of the quantised values (above the block's least value). For a query, the slices are weighted by the bits
of its components and summed with bitmap full adders into the slices of the score. The top rows are
chosen from the most significant slice downward: rows surely in (G) and rows still
equal (E); rows left equal after the last slice have one score and go by smaller id. The
chosen rows' scores are worked out again from the integers.

A task gathers one block of rows, builds its slices once, and streams the queries past it in small
batches from a file in the shared folder; the k best of each block are merged by a window with a group limit.
Only while there are fewer blocks than cores do several tasks share a block, each with a part of the queries.

Vectors with a component so large that a score might not fit 64 bits are compared in Python's integers, with
the same ranking; a score beyond a long is returned as the nearest long.

Defined cases: a vector that is null, empty or holds null or non-finite components, or
has no id, takes no part; a query's own row is every row with its id; rows that repeat an id are candidates
each, and as queries they share one list of k; vectors of different lengths are compared as if filled up
with zeros; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.shared import work_folder

#: Quantisation: floor(SCALE * x).
SCALE = 256
#: Rows of one block, and queries that a task holds at once.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 128


def to_bitmap(flags: np.ndarray) -> np.ndarray:
    """Flags as 64-bit words, the first flag lowest."""
    raw = np.packbits(flags, bitorder="little")
    out = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    out[: len(raw)] = raw
    return out.view("<u8")


def places(bitmap: np.ndarray, n: int) -> np.ndarray:
    """Rows whose bit is set."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=n, bitorder="little"))


class SlicedBlock:
    """Bit slices of some rows, which must be in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.n = ids, values, len(ids)
        self.least = values.min(0) if self.n else np.zeros(values.shape[1], np.int64)
        above = values - self.least
        self.bits = [int(x).bit_length() for x in above.max(0)] if self.n else []
        self.all = to_bitmap(np.ones(self.n, bool))
        self.slices = [[to_bitmap((above[:, j] >> b) & 1 != 0) for b in range(self.bits[j])] for j in range(values.shape[1] if self.n else 0)]
        # a negative weight counts what is missing from the highest value
        self.missing = [[x ^ self.all for x in s] for s in self.slices]

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of a number that is the inner product but for a constant; lowest first."""
        piles: list[list[np.ndarray]] = [[] for _ in range(64)]
        for j, weight in enumerate(query.tolist()):
            slices, weight, a = self.slices[j] if weight >= 0 else self.missing[j], abs(weight), 0
            while weight:
                if weight & 1:
                    for b, x in enumerate(slices):
                        piles[a + b].append(x)
                weight, a = weight >> 1, a + 1
        out = []
        top = max((p for p, pile in enumerate(piles) if pile), default=-1)
        p = 0
        while p <= top or (p < 64 and piles[p]):
            pile = piles[p]
            up = piles[p + 1] if p < 63 else []
            while len(pile) >= 3:  # a full adder: three bitmaps of one weight are one of it and one of the next
                x, y, z = pile.pop(), pile.pop(), pile.pop()
                half = x ^ y
                carry = half & z
                half ^= z
                carry |= x & y
                up.append(carry)
                pile.append(half)
            if len(pile) == 2:
                x, y = pile
                up.append(x & y)
                out.append(x ^ y)
            else:
                out.append(pile[0] if pile else np.zeros_like(self.all))
            p += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), the query's own id left out."""
        if not self.n:
            return []
        sure = np.zeros_like(self.all)
        equal = self.all.copy()
        for own in range(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")):
            equal[own // 64] &= ~np.uint64(1 << (own % 64))
        if int(np.bitwise_count(equal).sum()) > k:
            for s in reversed(self.scores(query)):
                inside = equal & s
                n = int(np.bitwise_count(sure | inside).sum())
                if n > k:
                    equal = inside
                else:
                    sure |= inside
                    equal &= ~s
                    if n == k:
                        equal[:] = 0
                        break
        rows = places(sure, self.n)
        if len(rows) < k:
            rows = np.concatenate([rows, places(equal, self.n)[: k - len(rows)]])
        return sorted(zip(self.ids[rows].tolist(), (self.values[rows] @ query).tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def quantised(vectors: DataFrame, limit: int, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>), w (array<double>) of the vectors that take part: v, the quantised components, if all are below `limit` in size, else w, the components themselves."""
    takes_part = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))")
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(takes_part, F.lit(False)))
    small = F.expr(f"forall(embedding, x -> abs(cast(x as double)) < {limit / scale}D)")
    v = F.when(small, F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as int))"))
    return rows.select("vec_id", v.alias("v"), F.when(~small, F.col("embedding").cast("array<double>")).alias("w"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up to `width`."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.zeros((len(sizes), width), np.int64)
    values[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return values


def _exact(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond a double (such an x is whole)."""
    return math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale


class _Rows:
    """Rows of a batch: those in 64-bit integers, by id, and the wide ones in Python's."""

    def __init__(self, found: pa.Table | pa.RecordBatch, width: int, scale: int):
        found = pa.Table.from_batches([found]) if isinstance(found, pa.RecordBatch) else found
        small = found.filter(found["v"].is_valid()).sort_by("vec_id").combine_chunks()
        self.ids = small["vec_id"].to_numpy()
        self.values = _matrix(small["v"].combine_chunks() if small.num_rows else pa.array([], pa.list_(pa.int32())), width)
        wide = found.filter(found["w"].is_valid())
        self.wide = [(i, [_exact(x, scale) for x in w]) for i, w in zip(wide["vec_id"].to_pylist(), wide["w"].to_pylist(), strict=True)]


def _best(pairs: Iterator[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(pairs, key=lambda x: (-x[1], x[0]))[:k]


def search(block: SlicedBlock, wide: list[tuple[int, list[int]]], queries: _Rows, k: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best rows of a block for each query."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for query_id, query in zip(queries.ids.tolist(), queries.values, strict=True):
        found = block.top(query_id, query, k)
        if wide:
            found = _best([*found, *((i, dot(w, query.tolist())) for i, w in wide if i != query_id)], k)
        yield from ((query_id, i, s) for i, s in found)
    for query_id, query in queries.wide:
        rows = [*zip(block.ids.tolist(), block.values.tolist(), strict=True), *wide]
        yield from ((query_id, i, s) for i, s in _best([(i, dot(w, query)) for i, w in rows if i != query_id], k))


def top_k(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row of `vectors` where `is_query` holds."""
    spark = vectors.sparkSession
    width = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    rows = quantised(vectors, 1 << (62 - max(width, 1).bit_length()) // 2, scale)
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    splits = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    folder = work_folder(spark, "queries")
    rows.where(is_query).withColumn("split", F.pmod(F.xxhash64("vec_id"), F.lit(splits))).write.parquet(folder)
    deal = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    index = rows.select(deal.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "vec_id", "v", "w")

    def find(key: tuple, found: pa.Table) -> pa.Table:
        import pyarrow.dataset as ds
        from pyarrow import fs

        mine = _Rows(found, width, scale)
        block = SlicedBlock(mine.ids, mine.values)
        store, path = fs.FileSystem.from_uri(folder)
        asked = ds.dataset(path, filesystem=store, format="parquet").to_batches(columns=["vec_id", "v", "w"], filter=ds.field("split") == key[1].as_py(), batch_size=block_queries, batch_readahead=1, fragment_readahead=1)
        out = [x for batch in asked if batch.num_rows for x in search(block, mine.wide, _Rows(batch, width, scale), k)]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([min(max(x[2], -(2**63)), 2**63 - 1) for x in out], pa.int64()), "exact": pa.array([_sortable(x[2]) for x in out], pa.binary())})

    found = index.groupBy("block", "split").applyInArrow(find, "query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_first("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sortable(score: int) -> bytes | None:
    """Bytes that sort as the scores beyond a long do; none for a score that fits."""
    if -(2**63) <= score < 2**63 - 1:
        return None
    size = (score.bit_length() + 7) // 8
    head = size if score > 0 else 2**16 - 1 - size
    return head.to_bytes(2, "big") + (score if score > 0 else (1 << 8 * size) + score).to_bytes(size, "big")
