"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at
most two bits, one segment differs in at most one bit, so both fingerprints have a variant in common
in which that bit of that segment is a wildcard. Each different fingerprint is
indexed under its 64 variants (segment, wildcard, the other 31 bits); fingerprints that share
a variant are compared in full.

A variant's group is summed up before the shuffle by its count, least, greatest and the
XOR of its members, which spells out groups of up to three members. The members of
larger groups, found by an equality join, get narrower keys. Either one segment is equal and of the
three thirds of the other one is, too (6 keys of 42 or 43 bits for each member); or both segments differ in one
bit, so with the low one's bit as a wildcard a half of the high one is equal (2 keys of 47 bits in each
of a member's groups whose wildcard stands for both bits). Such a group has 22
free bits at most, so a task that gathers one holds at most 2 ** 22 longs, however hot the template
is; it hands out a spanning forest of its links, never its pairs.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; rows that repeat a doc_id get a row each; a null doc_id keeps its row and never
names a component unless the component has no other id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.components import components
from voxloom.llm.jaccard import similar_sets
from voxloom.llm.shared import drop_written, free_name, input_parts, quoted, written

#: Words in a shingle, and bits in which linked fingerprints may differ.
SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Row v holds the bits of v, least significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8) * 256)[None, :]
#: Shingles that are counted at once.
_PART = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, n, _PART):
        part = min(n, at + _PART)
        if shingle == 3 and len(words) > 3:
            hashes = [digest(b"%b %b %b" % w, SEED) for w in zip(words[at:part], words[at + 1 : part + 1], words[at + 2 : part + 2], strict=True)]
        else:
            hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, part)]
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((raw + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = np.packbits((counts.ravel() * 2 > n), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) for every row; texts are read once and never shuffled."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """key, fp: a row for each of 64 wildcards. The key is the wildcard's place and the segment's other bits."""
    segment = "(case when w < 32 then fp else shiftrightunsigned(fp, 32) end) & 4294967295"
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w")).select(F.expr(f"shiftleft(cast(w as bigint), 32) | (({segment}) & ~shiftleft(1L, w % 32))").alias("key"), "fp")


def _narrow(hot: DataFrame) -> DataFrame:
    """kind, rest, fp: the narrower keys of fingerprints in large groups of variants, `hot` (key, fp).

    Two that have one segment in common get a common one of six keys, whatever groups they are in. Two that differ by one bit in each segment
    meet in the group in which the low segment's one is the wildcard, and have a half of the other segment in common; groups whose members all have the wildcard's bit alike need no such keys.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    low, thirds, halves = (1 << 32) - 1, [(0, 11), (11, 22), (22, 32)], [(0, 16), (16, 32)]
    run = lambda a, b: (1 << b) - (1 << a)
    exact = [m for a, b in thirds for m in (low | run(a, b) << 32, low << 32 | run(a, b))]
    by_mask = lambda masks: F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("nr", "mask")
    one = hot.select("fp").distinct().select("fp", by_mask(exact)).select(F.col("nr").alias("kind"), F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp")
    rows = hot.where(f"key < {32 << 32}").withColumn("w", F.expr("cast(shiftright(key, 32) as int)"))
    mixed = rows.groupBy("key", "w").agg((F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("vary")).where("shiftright(vary, w) & 1 = 1").select("key")
    both = rows.join(mixed, "key", "left_semi").select("fp", "w", by_mask([low | run(a, b) << 32 for a, b in halves]))
    return one.unionAll(both.select(F.expr(f"{len(exact)} + 2 * w + nr").alias("kind"), F.expr("fp & mask & ~shiftleft(1L, w)").alias("rest"), "fp"))


def _sum_up(rows: DataFrame, *key: str) -> DataFrame:
    """The groups of two and more by key: n, lo, hi and mid (the third of three), combined before the shuffle."""
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("x"))
    return sums.where("n > 1").select(*key, "n", "lo", "hi", F.expr("x ^ lo ^ hi").alias("mid"))


def _spelled_out(groups: DataFrame) -> DataFrame:
    """Links (a < b) within groups of two and three."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    found = groups.where("n <= 3").select(F.explode(F.when(F.col("n") == 2, F.array(pair("lo", "hi"))).otherwise(F.array(pair("lo", "mid"), pair("mid", "hi"), pair("lo", "hi")))).alias("e")).select("e.a", "e.b")
    return found.where(f"a != b and bit_count(a ^ b) <= {DISTANCE}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the different `values` but the roots, with its root: trees of those connected by steps of up to two bits.

    Up to 64 values are compared at once; more are grouped, for each two of the bits in which they differ at all, by
    all their other bits, so the work is linear in the values.
    """
    values = np.unique(values)
    n, label = len(values), np.arange(len(values))

    def join(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal label
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (up := label[label])).any():
                label = up

    if n <= 64:
        join(*np.nonzero(np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= DISTANCE))
    else:
        vary = int(np.bitwise_or.reduce(values ^ values[0])) & (2**64 - 1)
        bits = [k for k in range(64) if vary >> k & 1]
        for i, k in enumerate(bits):
            for m in bits[i + 1 :] or [k] * (len(bits) == 1):
                rest = values.view(np.uint64) & np.uint64(~(1 << k | 1 << m) & (2**64 - 1))
                order = np.argsort(rest, kind="stable")
                same = np.flatnonzero(rest[order][1:] == rest[order][:-1])
                join(order[same + 1], order[same])
    other = np.flatnonzero(label != np.arange(n))
    return values[other], values[label[other]]


def links(fps: DataFrame, parts: int = 1) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp, each once) that connect all those within two bits.

    Fingerprints are few bytes but have many variants, so they are dealt to `parts` tasks before these are made.
    """
    fps = fps.repartition(parts, "fp")
    groups = written(_sum_up(_variants(fps), "key"), "groups")
    hot = written(_variants(fps).join(groups.where("n > 3").select("key"), "key", "left_semi"), "hot")
    narrow = written(_narrow(hot), "keys")
    inner = written(_sum_up(narrow, "kind", "rest"), "narrow")

    def trees(found: pa.Table) -> pa.Table:
        a, b = forest(found["fp"].to_numpy())
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    large = narrow.join(inner.where("n > 3").select("kind", "rest"), ["kind", "rest"], "left_semi")
    trees_ = large.groupBy("kind", "rest").applyInArrow(trees, "a long, b long")
    found = written(_spelled_out(groups).unionAll(_spelled_out(inner)).unionAll(trees_).distinct(), "links")
    for done in (groups, hot, narrow, inner):
        drop_written(done)
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(classes.select("fp"), input_parts(docs))
    label = written(components(edges), "labels")
    named = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    names = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(names, "label").select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similarity search: the share of two texts' different shingles, in per cent, that both have, from which on they are linked.
PERCENT = 80


def similar_documents(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, component_id for every row: documents that share `percent` of their different shingles, and chains of such.

    A component is named by its smallest doc_id; null and empty texts have no shingles and are one component.
    """
    rows, named = similar_sets(docs, shingle, percent)
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    return rows.join(named.join(least, "label").select("id", F.col("least.doc_id").alias("component_id")), "id").select("doc_id", "component_id")


def _with_simhash(docs: DataFrame, rows: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """`named` (:func:`similar_sets`) with the labels joined that the rows' SimHash groups connect."""
    ids = F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "hash", "fp"])

    prints = written(docs.select(*ids, "text").mapInArrow(apply, "doc_id long, hash long, fp long"), "fingerprints")
    edges = links(prints.select("fp").distinct(), input_parts(docs))
    groups = written(components(edges), "labels").select(F.col("node").alias("fp"), F.col("label").alias("group"))
    prints = prints.join(groups, "fp", "left").select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), F.coalesce("group", "fp").alias("group"))
    # a row is its doc_id and text: all sets that a group's rows have
    at = rows.join(named.select("id", "label"), "id").select("doc_id", "hash", "label")
    met = written(at.join(prints, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("group", "label").distinct(), "met")
    first = met.groupBy("group").agg(F.min("label").alias("b"))
    joined = written(components(met.join(first, "group").where("label <> b").select(F.col("label").alias("a"), "b")), "labels")
    return named.join(joined.select(F.col("node").alias("label"), F.col("label").alias("wider")), "label", "left").select("id", "m", "first", F.coalesce("wider", "label").alias("label"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of `docs` for each group of similar documents: that with the smallest doc_id, of several that whose text's hash is least.

    Documents are linked by SimHash, and by an exact join that finds those which share `percent` of their shingles but differ by more bits.

    Rows without a doc_id stay. Rows that repeat a doc_id are documents of their own unless their texts are similar.
    Null and empty texts are copies of one another. Columns of any name stay as they are; an empty table stays empty.
    """
    rows, named = similar_sets(docs, shingle, percent)
    named = _with_simhash(docs, rows, named, shingle)
    kept = named.groupBy("label").agg(F.min("first").alias("least")).where("least.doc_id is not null")
    tag = free_name(docs, "_keep")
    kept = kept.select(F.col("least.doc_id").alias(f"{tag}_d"), F.col("least.hash").alias(f"{tag}_h"))
    found = docs.withColumn(f"{tag}_t", F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, (F.col("doc_id") == F.col(f"{tag}_d")) & (F.col(f"{tag}_t") == F.col(f"{tag}_h")), "left_semi")
    # rows that are the same document, to the text
    again = F.row_number().over(Window.partitionBy("doc_id", f"{tag}_t").orderBy(F.lit(0)))
    once = found.withColumn(f"{tag}_nr", again).where(F.col(f"{tag}_nr") == 1)
    return once.unionByName(docs.where("doc_id is null"), allowMissingColumns=True).select(*[quoted(c) for c in docs.columns])
