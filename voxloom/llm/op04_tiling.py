"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased words, each word a 63-bit hash. Seeds are runs of `SHORTEST` words
that a document shares with an item: an equality join of hashed runs, both sides being tables. As most runs of the documents
are in no item, they are first looked up in a bitmap of the items' runs (sixteen bits a run, at most 2 ** `FILTER_BITS`
bits, which bounds what tasks hold; a fuller bitmap lets more needless runs through, never fewer). For each (document, item) with seeds, the parts of
the document that seeds cover are tiled: running Karp-Rabin finds the longest matches of unmarked words, marks them in both
sequences, and goes on with shorter ones down to `SHORTEST`. An item is leaked into the
document if tiles cover at least `COVERAGE` of the item's words; as tiles may lie in any order,
reordered passages count.

Tiles that cover so much leave few of the item's words uncovered, so of more places than that one must be in a tile. Documents are asked only for runs over an
item's rarest places: neither a phrase nor a whole prompt that is in very many items and documents joins them all, unless it is
so much of the items that each document with it is a leak of each of them.

Defined cases: null and empty texts match nothing; an item of fewer than `SHORTEST`
words has no seed and never matches; items that repeat an id each match on their own and
are reported once; items without an id are left out; rows that repeat a doc_id are each
compared; an empty benchmark leaves every document clean; other columns, of whatever names, are ignored or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.shared import free_name, quoted, written

#: Words in the shortest tile, and the share of an item's words that tiles must cover.
SHORTEST, COVERAGE = 5, 0.8
#: Places count as rare if no run over them is in the benchmark more often.
RARE = 4
#: The bitmap of the items' runs has two to this power of bits at most, and words whose hashes a task keeps.
FILTER_BITS, MEMO_WORDS = 30, 100_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PRIME = (1 << 61) - 1
_RADIX = 1_000_003
_STOP = np.array([-1])
#: Documents that are compared with the index at once, and their code points.
_DOCS, _CHARS = 512, 4_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _runs(seq: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every run of `size` free words, rolled along."""
    high, h, n = pow(_RADIX, size - 1, _PRIME), 0, 0
    for k, (word, ok) in enumerate(zip(seq, free, strict=True)):
        if not ok:
            h = n = 0
            continue
        if n == size:
            h = (h - (seq[k - size] + 1) * high) % _PRIME
            n -= 1
        h = (h * _RADIX + word + 1) % _PRIME
        n += 1
        if n == size:
            yield k - size + 1, h


def _longest(item: list[int], doc: list[int], item_free: list[bool], doc_free: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Matches (length, item start, doc start) of at least `size` free words that cannot be made longer."""
    places: dict[int, list[int]] = {}
    for at, h in _runs(item, item_free, size):
        places.setdefault(h, []).append(at)
    out = []
    for d, h in _runs(doc, doc_free, size):
        for i in places.get(h, ()):
            if i and d and item_free[i - 1] and doc_free[d - 1] and item[i - 1] == doc[d - 1]:
                continue  # part of a match that began earlier
            n = 0
            while i + n < len(item) and d + n < len(doc) and item_free[i + n] and doc_free[d + n] and item[i + n] == doc[d + n]:
                n += 1
            if n >= size:
                out.append((n, i, d))
    return out


def greedy_tiles(item: list[int], doc: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Tiles (length, item start, doc start): longest first, not overlapping in either sequence; a negative word in `doc` matches nothing."""
    item_free, doc_free = [x >= 0 for x in item], [x >= 0 for x in doc]
    size, tiles = min(len(item), len(doc)), []
    while size >= shortest:
        found = sorted(_longest(item, doc, item_free, doc_free, size), key=lambda x: (-x[0], x[1], x[2]))
        for n, i, d in found:
            if all(item_free[i : i + n]) and all(doc_free[d : d + n]):
                item_free[i : i + n] = [False] * n
                doc_free[d : d + n] = [False] * n
                tiles.append((n, i, d))
        if found:  # what marks have cut off may still hold a match of this size
            continue
        size = size // 2 if size > 2 * shortest else shortest if size > shortest else 0
    return tiles


class Words:
    """Texts as arrays of word hashes. A task keeps the hashes of the first words that it meets, the frequent ones among them."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, memo = words_of(text), self.memo
        found = list(map(memo.get, words))
        for k, x in enumerate(found) if None in found else ():
            if x is None:
                w = words[k]
                found[k] = x = memo.get(w) or xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
                if len(memo) < MEMO_WORDS:
                    memo[w] = x
        return np.array(found, np.int64)


def run_hashes(seq: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (as signed integers) of the runs of `size` words, and where they start; a negative number is no word."""
    if len(seq) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.concatenate([[0], np.cumsum(seq >= 0)])
    at = np.flatnonzero(word[size:] - word[:-size] == size)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = (h ^ (seq[at + k].astype(np.uint64) + np.uint64(1))) * _BASE
        h ^= h >> np.uint64(29)
    return h.view(np.int64), at


def _items(benchmark: DataFrame, shortest: int) -> DataFrame:
    """A written table of key, item_id, words, runs: every item that has a run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, key = Words(), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0), batch.column(1), strict=True):
                seq = words(text.as_py())
                if len(seq) >= shortest:
                    rows.append((key, item_id.as_py(), seq, run_hashes(seq, shortest)[0]))
                    key += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["key", "item_id", "words", "runs"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    return written(rows.mapInArrow(cut, "key long, item_id long, words array<long>, runs array<long>"), "items")


def _bitmap(items: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of all the items' runs, by the run's highest bits, and how many these are."""
    n = items.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    bits = min(FILTER_BITS, max(16, (16 * n).bit_length()))
    places = items.select(F.explode("runs").alias("r")).select(F.shiftrightunsigned("r", 64 - bits).alias("p")).distinct()

    def chunk(key: tuple, found: pa.Table) -> pa.Table:
        flags = np.zeros(1 << 15, np.uint8)
        flags[found["p"].to_numpy() & 0x7FFF] = 1
        return pa.table({"c": pa.array([key[0].as_py()], pa.int64()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    out = np.zeros(1 << bits - 3, np.uint8)
    for r in places.withColumn("c", F.shiftright("p", 15)).groupBy("c").applyInArrow(chunk, "c long, flags binary").collect():
        out[r.c << 12 : (r.c + 1) << 12] = np.frombuffer(r.flags, np.uint8)
    return out, bits


def _probes(items: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """key, run, times, need: the runs of each item that documents are asked for, the chosen places that they cover, and how many a document must have.

    Tiles leave at most u = n - ceil(coverage * n) of an item's n words uncovered. So of any chosen places all but u are in a tile, and with
    each of them a run that covers it. Chosen are the u + 1 places whose runs are the rarest of the benchmark, and all others
    with rare runs; a place is as common as the commonest run over it.
    """
    runs = items.select("key", F.size("words").alias("n"), F.posexplode("runs").alias("start", "run"))
    common = runs.groupBy("run").agg(F.count("*").alias("common"))
    over = runs.join(common, "run").select("key", "n", "run", "common", F.explode(F.expr(f"sequence(start, start + {shortest - 1})")).alias("place"))
    places = over.groupBy("key", "n", "place").agg(F.max("common").alias("level"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("level", "place"))
    spare = F.col("n") - F.ceil(F.col("n") * coverage - 1e-9)
    chosen = places.withColumn("rank", rank).withColumn("spare", spare).where(f"rank <= spare + 1 or level <= {RARE}")
    need = chosen.groupBy("key").agg((F.count("*") - F.max("spare")).alias("need"))
    return over.join(chosen.select("key", "place"), ["key", "place"], "left_semi").groupBy("key", "run").agg(F.count("*").alias("times")).join(need, "key")


def _candidates(seeded: DataFrame, items: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """row, key: documents and items that are to be tiled."""
    met = seeded.select("row", F.explode("runs").alias("run")).join(_probes(items, shortest, coverage), "run")
    return met.groupBy("row", "key").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need").select("row", "key")


def _seeded(docs: DataFrame, bitmap: np.ndarray, bits: int, shortest: int) -> DataFrame:
    """A written table of row, doc_id, hash, runs, parts: documents with runs in the bitmap, and the words that such runs cover, with -1 between stretches."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, row = Words(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in _batches(batch, 1):
                seqs = []
                for text in texts:
                    seqs += [words(text), _STOP]
                whole = np.concatenate(seqs)
                ends = np.cumsum([len(s) for s in seqs])[1::2]
                h, at = run_hashes(whole, shortest)
                place = h.view(np.uint64) >> np.uint64(64 - bits)
                hit = np.flatnonzero(bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1)
                doc = np.searchsorted(ends, at[hit], side="right")
                edges = np.flatnonzero(np.diff(doc, prepend=-1))
                rows = []
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(hit)][: len(edges)], strict=True):
                    parts: list[int] = []
                    last = -1
                    for x in at[hit[a:b]].tolist():
                        if x > last and parts:
                            parts.append(-1)
                        parts += whole[max(x, last) : x + shortest].tolist()
                        last = x + shortest
                    d = first + int(doc[a])
                    rows.append((row, batch.column(0)[d].as_py(), batch.column(2)[d].as_py(), np.unique(h[hit[a:b]]), parts))
                    row += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["row", "doc_id", "hash", "runs", "parts"])

    rows = docs.select("doc_id", "text", F.xxhash64("text"))
    return written(rows.mapInArrow(search, "row long, doc_id long, hash long, runs array<long>, parts array<long>"), "seeded")


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """Parts of a batch: (first row, texts), of bounded length."""
    at, held, size = 0, [], 0
    for k, x in enumerate(batch.column(column)):
        held.append(x.as_py())
        size += len(held[-1] or "")
        if len(held) >= _DOCS or size >= _CHARS:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def _leaked(docs: DataFrame, benchmark: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """row, doc_id, hash, item_id, coverage, n_tiles: a row for each document's row and item that is leaked into it; items that repeat an id each have their own."""
    names = "row long, doc_id long, hash long, item_id long, coverage double, n_tiles long"
    items = _items(benchmark, shortest)
    if not items.head(1):
        return docs.sparkSession.createDataFrame([], names)
    seeded = _seeded(docs, *_bitmap(items), shortest)
    rows = _candidates(seeded, items, shortest, coverage).join(seeded.select("row", "doc_id", "hash", "parts"), "row").join(items.select("key", "item_id", "words"), "key")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc_id, hash_, item_id, parts, item in zip(*batch.columns, strict=True):
                parts, item = parts.values.to_pylist(), item.values.to_pylist()
                have = set(parts)
                if sum(w in have for w in item) < coverage * len(item):
                    continue  # tiles lie inside the seeded words, which are too few of the item's
                tiles = greedy_tiles(item, parts, shortest)
                share = sum(n for n, _, _ in tiles) / len(item)
                if share >= coverage:
                    out.append((row.as_py(), doc_id.as_py(), hash_.as_py(), item_id.as_py(), share, len(tiles)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=[x.split()[0] for x in names.split(", ")])

    return rows.select("row", "doc_id", "hash", "item_id", "parts", "words").mapInArrow(tile, names)


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles: a row for each document and item that is leaked into it."""
    found = _leaked(docs, benchmark, shortest, coverage)
    best = found.groupBy("row", "doc_id", "item_id").agg(F.max(F.struct("coverage", "n_tiles")).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", "b.n_tiles")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs` into which no item is leaked, with all their columns. Rows are known by their texts' hashes, as copies of a leaked text are leaked too."""
    gone = written(_leaked(docs, benchmark, shortest, coverage).select("hash").distinct(), "leaked")
    tag = free_name(docs, "_leak")
    rows = docs.withColumn(f"{tag}_h", F.xxhash64("text"))
    return rows.join(gone.withColumnRenamed("hash", f"{tag}_h"), f"{tag}_h", "left_anti").select(*[quoted(c) for c in docs.columns])
