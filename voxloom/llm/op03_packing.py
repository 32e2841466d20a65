"""Packing by lexical retrieval: neighbours of a seed document fill its window.

Documents become token ids once. Document frequencies of all ids over the whole corpus are a vector
as long as the vocabulary. Documents are dealt into shards by range of (signature,
doc_id), the signature being the least hash of the document's id pairs, so that documents
with common passages tend to meet and a group of copies of any size is spread over
many shards. Each shard has a BM25 inverted index of its documents. A window of
`window` ids begins with a seed (what is left of the last document, or else the next unused
one); the unused documents that score highest against the seed fill it, and the
last one is cut. All windows of a shard are full but for the last, which is cut into
sequences whose lengths are powers of two. So nothing is padded.

Defined cases: a null text is empty and has the end id only; an empty table gives no
rows; rows that repeat a doc_id are packed separately; ties in score go to the
earlier document of the shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.shared import release_arrow, written
from voxloom.llm.tokens import chunks, encoder

WINDOW = 2048
#: A shard is closed at this many ids; a partition holds several shards.
SHARD_TOKENS, PARTITION_TOKENS = 1 << 19, 1 << 22
#: Fixed values of BM25.
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def signature(ids: np.ndarray) -> int:
    """Least hash of the pairs of neighbouring ids."""
    if len(ids) < 2:
        return -(2**63)
    x = ids.astype(np.uint64)
    h = (x[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return int(h.min()) - 2**63


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A written table of doc_id, sig, n, ids (zstandard of uint32); rows without n hold a task's document frequencies (id, count)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, press, counts = encoder(tokenizer), zstandard.ZstdCompressor(level=1), np.zeros(0, np.int64)
        names = ["doc_id", "sig", "n", "ids"]
        for batch in batches:
            for at, rows in chunks(batch.column(1)):
                ids = [np.frombuffer(x, "<u4") for x in enc.encode(batch.column(1).slice(at, rows))]
                each = [np.unique(x) for x in ids]
                seen = np.bincount(np.concatenate(each), minlength=len(counts))
                seen[: len(counts)] += counts
                counts = seen
                # ids that fit two bytes are stored so; a negative n marks wider ones
                packed = [press.compress(x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes()) for x in ids]
                wide = [x.max() >= 65536 for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array([signature(x) for x in ids], pa.int64()), pa.array([-len(x) if w else len(x) for x, w in zip(ids, wide, strict=True)], pa.int64()), pa.array(packed, pa.binary())], names=names)
                release_arrow()
        used = np.flatnonzero(counts)
        if len(used):
            rows = press.compress(np.array([used, counts[used]], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(used)], pa.int64()), pa.array([None], pa.int64()), pa.array([rows], pa.binary())], names=names)

    return written(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, sig long, n long, ids binary"), "tokens")


def document_frequencies(table: DataFrame) -> np.ndarray:
    """Documents that hold each id; as long as the highest id in use, so no longer than the vocabulary."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for x in batch.column(0):
                pair = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["id", "df"])

    found = table.where("n is null").select("ids").mapInArrow(unpack, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(int(max(found["id"].to_pylist(), default=-1)) + 1)
    out[found["id"].to_numpy()] = found["df"].to_numpy()
    return out


class ShardIndex:
    """BM25 inverted index of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = len(docs)
        lengths = np.array([len(x) for x in docs])
        pairs, counts = np.unique(np.repeat(np.arange(n, dtype=np.int64), lengths) << 32 | np.concatenate(docs).astype(np.int64), return_counts=True)
        doc, term = pairs >> 32, pairs & 0xFFFFFFFF
        weight = idf[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[doc] / mean_length))
        self.n, self.term, self.doc_start = n, term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard against the seed's different ids."""
        terms = self.term[self.doc_start[seed] : self.doc_start[seed + 1]]
        begin, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack(docs: list[np.ndarray], index: ShardIndex, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every id of `docs` is in one piece."""
    unused, left = np.ones(len(docs), bool), len(docs)
    sequences, next_doc, rest = [], 0, None
    while rest or left:
        if rest is None:
            while not unused[next_doc]:
                next_doc += 1
            rest, left = (next_doc, 0), left - 1
            unused[next_doc] = False
        seed, start = rest
        size = min(window, len(docs[seed]) - start)
        pieces, room = [(seed, start, size)], window - size
        rest = (seed, start + size) if start + size < len(docs[seed]) else None
        if room and left:
            score = np.where(unused, index.scores(seed), -1.0)
            order = iter(np.argsort(-score, kind="stable").tolist())
            while room and left:
                k = next(order)
                size = min(room, len(docs[k]))
                pieces.append((k, 0, size))
                unused[k] = False
                left, room = left - 1, room - size
                if size < len(docs[k]):
                    rest = (k, size)
        sequences += [pieces] if not room else in_powers(pieces, window - room)
    return sequences


def in_powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Cut pieces of `total` ids into sequences whose lengths are falling powers of two."""
    out, at = [], 0
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        sequence = []
        while room:
            doc, start, size = pieces[at]
            take = min(room, size)
            sequence.append((doc, start, take))
            room -= take
            if take == size:
                at += 1
            else:
                pieces[at] = (doc, start + take, size - take)
        if sequence:
            out.append(sequence)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; `with_ids` adds the piece's ids (array)."""
    table = token_table(docs, tokenizer)
    df = document_frequencies(table)
    rows = table.where("n is not null")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.abs("n")), F.lit(0))).first()
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), total / max(n, 1)
    parts = max(1, -(-total // PARTITION_TOKENS))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        plain, sequence = zstandard.ZstdDecompressor(), TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal sequence
            ids = [x for _, x in held]
            out: list[tuple] = []
            for pieces in pack(ids, ShardIndex(ids, idf, mean), window):
                offset = 0
                for k, start, size in pieces:
                    piece = ids[k][start : start + size].astype("<u4")
                    out.append((held[k][0], start, size, zlib.crc32(piece.tobytes()), len(ids[k]), sequence, offset, *[piece] * with_ids))
                    offset += size
                sequence += 1
            held.clear()
            types = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in names.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, m, ids in zip(*batch.columns, strict=True):
                m = m.as_py()
                held.append((doc_id.as_py(), np.frombuffer(plain.decompress(ids.as_py()), "<u2" if m > 0 else "<u4")))
                size += abs(m)
                if size >= shard_tokens:
                    yield close()
                    size = 0
        if held:
            yield close()

    names = PIECES + ", ids array<long>" * with_ids
    return rows.repartitionByRange(int(parts), "sig", "doc_id").sortWithinPartitions("sig", "doc_id", "ids").select("doc_id", "n", "ids").mapInArrow(fill, names)
