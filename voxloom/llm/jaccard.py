"""Exact similarity join of documents by their sets of word shingles.

Two sets are linked if they share `percent` per cent of their union. All links between different sets are respected, and no pair
is left out by chance:

1. Documents are gathered into blocks of coded words. Equal sets are one from here on; its name is a hash of the sorted set.
2. Blocks ask hash buckets how many different sets hold each of their shingles (sorted values of 32 bits in a bucket).
   Shingles are ordered by that number, rarest first, so that the order is the same for all sets.
3. Of two linked sets the smaller has one of its first m - ceil(2 p / (100 + p) m) + 1 shingles in common with the first
   m - ceil(p / 100 m) + 1 of the larger. A set is indexed by the first few and probes by the longer prefix; shingles that no
   other set holds are left out. A text with enough shingles of its own thus meets nobody, whatever template it shares.
4. Tiles: members are dealt by (shingle, size band), a band being a factor of 100 / p, so a set probes its own band and the one below. Pairs
   of small tiles are compared; in a larger one all members are first compared with two hubs, then those in different components
   with a few more, and only members that this leaves in different components are paired.
5. A pair's overlap is bounded from above by the bit counts of hashed bitmaps, then counted exactly in the sorted arrays.

Defined cases: null and empty texts and texts of white space have the empty set, which links with nothing; rows that
repeat a doc_id are documents of their own; a set of a text with fewer words than a shingle holds the whole
sequence; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.blocks import doc_id_array, lower_words, make_blocks, plain, press, with_answers
from voxloom.llm.components import components
from voxloom.llm.shared import drop_written, written

SEED = 42
#: Tiles up to this size are compared in pairs at once; larger ones with two hubs first.
PAIRS_TO = 8
#: Members of a tile of several components that all its other members are compared with.
HUBS = 16
#: Longs of a set's bitmap.
BITMAP_LONGS = 8
#: Members of a tile that are compared with one copy of a hub's set.
_SALT = 512
#: Least number of buckets, and blocks for each bucket beyond.
_BUCKETS, _BLOCKS_OF_BUCKET = 32, 4
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Columns of a block: doc_ids, hashes of the texts, words in each, names and sizes of their sets, the different words' hashes and each word's number.
_COLUMNS = "ids binary, texts binary, sizes binary, names binary, counts binary, words binary, places binary"


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(words) - size + 1
    h = np.full(n, size, _U)
    for k in range(size):
        h = (h ^ (words[k : k + n] + _U(1))) * _BASE
        h ^= h >> _U(29)
    return h


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """The different shingles of a text as ascending hashes; `words` are hashes of its words."""
    if not len(words):
        return np.zeros(0, _U)
    h = np.sort(_run_hashes(words, min(shingle, len(words))))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), _U, len(words))


def _planes(x: np.ndarray) -> bytes:
    """Integers of 32 bits as planes of bytes, which compress better."""
    return press(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(plain(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _packer(shingle: int):
    def pack(ids: list[int], texts: list[bytes]) -> tuple[bytes, ...]:
        words, places, sizes = lower_words(texts)
        different = word_hashes(words)
        sets = [shingle_set(x, shingle) for x in np.split(different[places], np.cumsum(sizes)[:-1])]
        arrays = [np.array(ids, "<i8"), np.array([xxhash.xxh64_intdigest(x, SEED) for x in texts], "<u8"), sizes.astype("<i8"), np.array([_name(x) for x in sets], "<u8"), np.array([len(x) for x in sets], "<i8"), different.astype("<u8")]
        return (*[press(x.tobytes()) for x in arrays], _planes(places))

    return pack


class _Sets:
    """The sets of a block's documents."""

    def __init__(self, sizes: bytes, words: bytes, places: bytes, shingle: int):
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(plain(sizes), "<i8"))])
        self.words, self.shingle = np.frombuffer(plain(words), "<u8")[_from_planes(places)], shingle

    def __getitem__(self, nr: int) -> np.ndarray:
        return shingle_set(self.words[self.ends[nr] : self.ends[nr + 1]], self.shingle)


def _marks(blocks: DataFrame) -> DataFrame:
    """A written table of doc_id, hash (of the text), id, m (name and size of its set), block, nr: a row for each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, *columns in zip(*batch.columns, strict=True):
                ids = np.frombuffer(plain(ids.as_py()), "<i8")
                texts, names, counts = (pa.array(np.frombuffer(plain(x.as_py()), "<i8")) for x in columns)
                yield pa.RecordBatch.from_arrays([doc_id_array(ids), texts, names, counts, pa.array(np.full(len(ids), block.as_py())), pa.array(np.arange(len(ids)))], names=["doc_id", "hash", "id", "m", "block", "nr"])

    return written(blocks.select("block", "ids", "texts", "names", "counts").mapInArrow(each, "doc_id long, hash long, id long, m long, block long, nr long"), "marks")


def _chosen(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """block, sizes, words, places, chosen: the blocks with the numbers of the documents that `rows` (block, nr) name."""
    return blocks.select("block", "sizes", "words", "places").join(rows.groupBy("block").agg(F.sort_array(F.collect_list("nr")).alias("chosen")), "block")


def _shingle_counts(blocks: DataFrame, shingle: int, bucket_bits: int) -> DataFrame:
    """A written table of answers (block, bucket, data): how common each different shingle of a block's chosen sets is, 1 if no other set has it."""
    shift, buckets = _U(32 - bucket_bits), np.arange((1 << bucket_bits) + 1, dtype=_U) << _U(32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, words, places, chosen in zip(*batch.columns, strict=True):
                sets = _Sets(sizes.as_py(), words.as_py(), places.as_py(), shingle)
                keys, times = np.unique(np.concatenate([sets[k] for k in chosen.as_py()]) >> shift, return_counts=True)
                edges = np.searchsorted(keys, buckets)
                rows = [(k, _planes(np.diff(keys[a:b] & _U(0xFFFFFFFF), prepend=_U(0))), press(times[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(rows), pa.int64()), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]], names=["block", "bucket", "steps", "times"])

    def answer(key: tuple, found: pa.Table) -> pa.Table:
        values = [np.cumsum(_from_planes(x.as_py()), dtype=_U).astype("<u4") for x in found["steps"]]
        times = np.concatenate([np.frombuffer(plain(x.as_py()), "<u4") for x in found["times"]])
        _, place = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(place, weights=times)
        # steps of a twelfth of a doubling; 1 only for those that are alone
        level = np.minimum(1 + np.ceil(12 * np.log2(n)), 255).astype(np.uint8)[place]
        parts = np.split(level, np.cumsum([len(x) for x in values])[:-1])
        return pa.table({"block": found["block"], "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()), "data": pa.array([press(x.tobytes()) for x in parts], pa.binary())})

    rows = blocks.mapInArrow(ask, "block long, bucket int, steps binary, times binary")
    return written(rows.groupBy("bucket").applyInArrow(answer, "block long, bucket int, data binary"), "shingle-counts")


def prefix_sizes(m: int, percent: int) -> tuple[int, int]:
    """Shingles by which a set of `m` is indexed, and those by which it probes."""
    return m + 1 + -2 * percent * m // (100 + percent), m + 1 + -percent * m // 100


def _prefixes(blocks: DataFrame, shingle: int, percent: int, bucket_bits: int) -> DataFrame:
    """A written table of id, m, indexed, keys: each set's shingles in its probing prefix that other sets have, too; the first `indexed` of them are in the index."""
    shift = _U(32 - bucket_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, words, places, chosen, answers in zip(*batch.columns, strict=True):
                sets = _Sets(sizes.as_py(), words.as_py(), places.as_py(), shingle)
                mine = [sets[k] for k in chosen.as_py()]
                place = np.unique(np.concatenate(mine) >> shift, return_inverse=True)[1]
                levels = np.concatenate([np.frombuffer(plain(x["said"]), np.uint8) for x in answers.as_py()])[place]
                rows, end = [], 0
                for h in mine:
                    begin, end = end, end + len(h)
                    index, probe = prefix_sizes(len(h), percent)
                    level = levels[begin:end]
                    alone = int((level == 1).sum())
                    if alone >= probe:
                        continue
                    others = np.flatnonzero(level > 1)
                    first = others[np.lexsort((h[others], level[others]))[: probe - alone]]
                    rows.append((_name(h) - (_name(h) >> 63 << 64), len(h), max(0, min(index - alone, len(first))), h[first].view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["id", "m", "indexed", "keys"])

    return written(blocks.mapInArrow(cut, "id long, m long, indexed int, keys array<long>"), "prefixes")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits that say of which places the set has an odd number of hashes. A shingle that one of two sets has turns one bit at most."""
    odd = np.bincount((hashes & _U(64 * BITMAP_LONGS - 1)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _whole_sets(blocks: DataFrame, shingle: int) -> DataFrame:
    """A written table of id, hashes (ascending), bits: the chosen sets."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, words, places, chosen in zip(*batch.columns, strict=True):
                sets = _Sets(sizes.as_py(), words.as_py(), places.as_py(), shingle)
                numbers = chosen.as_py()
                for at in range(0, len(numbers), 256):
                    mine = [sets[k] for k in numbers[at : at + 256]]
                    names = pa.array(np.array([_name(h) for h in mine], "<u8").view("<i8"))
                    yield pa.RecordBatch.from_arrays([names, pa.array([h.view(np.int64) for h in mine], pa.list_(pa.int64())), pa.array([bitmap(h) for h in mine], pa.list_(pa.int64()))], names=["id", "hashes", "bits"])

    return written(blocks.mapInArrow(whole, "id long, hashes array<long>, bits array<long>"), "sets")


def _within(bits_a: str, bits_b: str, sizes: str, percent: int) -> str:
    """SQL: the bit counts allow that two sets share enough. Of d shingles that one of them has alone, each turns a bit at most."""
    turned = " + ".join(f"bit_count({bits_a}[{k}] ^ {bits_b}[{k}])" for k in range(BITMAP_LONGS))
    return f"{100 + percent} * ({turned}) <= {100 - percent} * ({sizes})"


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A written table of the pairs (a, b) of `pairs` (a, b, n) whose sets share `percent` of their union.

    A hub is in as many pairs as its tile has members, n, so copies of its set are dealt to n / 512 tasks.
    """
    pairs = pairs.groupBy("a", "b").agg(F.max("n").alias("n"))
    sized = lambda end: sets.select(F.col("id").alias(end), F.col("bits").alias(f"bits_{end}"), F.size("hashes").cast("long").alias(f"m{end}"))
    near = pairs.join(sized("a"), "a").join(sized("b"), "b").where(_within("bits_a", "bits_b", "ma + mb", percent))
    near = written(near.select("a", "b", "ma", "mb", F.expr(f"pmod(xxhash64(b), n div {_SALT} + 1)").alias("sa"), F.expr(f"pmod(xxhash64(a), n div {_SALT} + 1)").alias("sb")), "candidates")
    side = lambda end: near.select(end, f"s{end}").distinct().join(sets.select(F.col("id").alias(end), F.col("hashes").alias(f"h{end}")), end)
    both = F.size(F.array_intersect("ha", "hb"))
    found = near.join(side("a"), ["a", "sa"]).join(side("b"), ["b", "sb"]).where(100 * both >= percent * (F.col("ma") + F.col("mb") - both))
    out = written(found.select("a", "b"), "linked")
    drop_written(near)
    return out


def _members(prefixes: DataFrame, percent: int) -> DataFrame:
    """A written table of key, band, id, m, indexed, n: the members of all tiles with an indexed member and another one; n is the tile's size."""
    # a little wider than the exact factor, so that rounding never parts a pair by two bands
    band = F.floor(F.log(F.col("m")) / (np.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1.0)).cast("int")
    rows = prefixes.select("id", "m", F.col("indexed").alias("first"), band.alias("own"), F.posexplode("keys").alias("nr", "key"))
    places = F.array(F.struct(F.col("own").alias("band"), (F.col("nr") < F.col("first")).alias("indexed")), F.struct((F.col("own") - 1).alias("band"), F.lit(False).alias("indexed")))
    rows = rows.select("key", "id", "m", F.explode(places).alias("p")).select("key", "p.band", "id", "m", "p.indexed")
    tiles = rows.groupBy("key", "band").agg(F.count("*").alias("n"), F.max("indexed").alias("any")).where("n > 1 and any").select("key", "band", "n")
    return written(rows.join(tiles, ["key", "band"]), "members")


def _probed(a: str, b: str, percent: int) -> str:
    """SQL: of two members of a tile, `a` is the smaller one and indexed, and their sizes are near enough."""
    return f"({a}.indexed and ({a}.m < {b}.m or {a}.m = {b}.m and {a}.id < {b}.id) and 100 * {a}.m >= {percent} * {b}.m)"


def _first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """a, b, n: all pairs of small tiles, and of each member of a larger tile with two hubs: the member that is in the most and largest tiles and the smallest."""
    small = members.where(f"n <= {PAIRS_TO}")
    pairs = small.alias("a").join(small.alias("b"), ["key", "band"]).where(_probed("a", "b", percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n"))
    large = members.where(f"n > {PAIRS_TO}")
    weights = large.groupBy("id").agg(F.sum("n").alias("w"))
    hubs = large.join(weights, "id").groupBy("key", "band").agg(F.max_by(F.struct("id", "m"), F.struct("w", "id")).alias("c"), F.min(F.struct("m", "id")).alias("f"))
    hubs = hubs.select("key", "band", F.explode(F.array(F.col("c"), F.struct("f.id", "f.m"))).alias("h"))
    stars = large.join(hubs, ["key", "band"]).where(f"id <> h.id and 100 * least(m, h.m) >= {percent} * greatest(m, h.m)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").unionAll(stars.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b"), "n"))


def _open(members: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame | None:
    """A written table of the members of larger tiles that hold several components, with labels, bits and the tile's largest component, `main`; none if there are no such tiles."""
    rows = members.where(f"n > {PAIRS_TO}").join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", "m", "indexed", F.coalesce("label", "id").alias("label"))
    parts = rows.groupBy("key", "band", "label").agg(F.count("*").alias("k")).groupBy("key", "band").agg(F.count("*").alias("labels"), F.sum("k").alias("n"), F.expr("max_by(label, struct(k, label))").alias("main"))
    rows = written(rows.join(parts.where("labels > 1"), ["key", "band"]).join(sets.select("id", "bits"), "id"), "open")
    return rows if rows.head(1) else None


def _sampled_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, n: of each open tile all members with `HUBS` others of other components, one for each residue of a hash."""
    hubs = rows.groupBy("key", "band", F.expr(f"pmod(xxhash64(id), {HUBS})").alias("residue")).agg(F.max_by(F.struct("id", "m", "label", "bits"), F.xxhash64("id", F.lit(1))).alias("h"))
    near = f"label <> h.label and 100 * least(m, h.m) >= {percent} * greatest(m, h.m) and {_within('bits', 'h.bits', 'm + h.m', percent)}"
    return rows.join(hubs, ["key", "band"]).where(near).select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b"), "n")


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, n: pairs of members of open tiles in different components, those outside the largest component with all others, unless sizes or bit counts rule them out."""
    either = f"({_probed('a', 'b', percent)} or {_probed('b', 'a', percent)})"
    found = rows.where("label <> main").alias("a").join(rows.alias("b"), ["key", "band"]).where(f"a.label <> b.label and {either} and {_within('a.bits', 'b.bits', 'a.m + b.m', percent)}")
    return found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), F.col("a.n").alias("n"))


def similar_sets(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash, id, m), one for each of `docs`, and different sets (id, m, first, label): sets with one label are linked by chains.

    hash is that of the row's text (null: of the empty one), id and m name and size of its set; first is the least (doc_id, hash) with that set, rows without a doc_id last.
    """
    blocks = make_blocks(docs, pack=_packer(shingle), columns=_COLUMNS)
    bucket_bits = max(_BUCKETS, -(-blocks.count() // _BLOCKS_OF_BUCKET)) - 1
    bucket_bits = bucket_bits.bit_length()
    marks = _marks(blocks)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "block", "nr")).alias("first")
    named = written(marks.groupBy("id", "m").agg(first), "named")

    one_each = _chosen(blocks, named.where("m > 0").select("first.block", "first.nr"))
    counts = _shingle_counts(one_each, shingle, bucket_bits)
    prefixes = _prefixes(with_answers(one_each, counts), shingle, percent, bucket_bits)
    members = _members(prefixes, percent)
    need = members.select("id").distinct().join(named, "id").select("first.block", "first.nr")
    sets = _whole_sets(_chosen(blocks, need), shingle)

    linked = _linked(_first_pairs(members, percent), sets, percent)
    label = written(components(linked), "labels")
    for pairs in (_sampled_pairs, _open_pairs):
        rows = _open(members, label, sets)
        if rows is None:
            break
        linked = linked.unionAll(_linked(pairs(rows, percent), sets, percent))
        label = written(components(linked), "labels")
        drop_written(rows)
    for done in (counts, prefixes, members, sets):
        drop_written(done)
    names = named.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "m", "first", F.coalesce("label", "id").alias("label"))
    return marks.select("doc_id", "hash", "id", "m"), names
