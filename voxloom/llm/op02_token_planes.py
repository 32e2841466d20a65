"""Token-ID output: ids in byte or bit planes, zstandard and a chunk index.

File format (little endian), one file per shard of whole documents:

    b"VXTP" version:u32
    chunks: for each, its planes one after the other, each zstandard-compressed
    documents: zstandard of int64 pairs (doc_id, n_tokens); a null doc_id is NULL_ID
    index: zstandard of JSON {kind, block, chunks: [[offset, n_ids, [plane sizes]]...],
           documents: [offset, size], n_docs, n_tokens, first}
    index offset:u64 index size:u64 b"VXTP"

A chunk holds `block` ids (the last one fewer). Byte planes: plane k holds byte k
of every id. Bit planes: plane k holds bit k of every id, packed. Planes above the
highest byte or bit in use are left out.

Defined cases: a null text is an empty one and has the end id only; an empty table
writes no file and gives no rows; rows that repeat a doc_id are all kept, in order of
their text's hash and then text; null doc_ids come first, the least long as one of them; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.shared import input_parts, put_file, release_arrow
from voxloom.llm.tokens import chunks, encoder

MAGIC = b"VXTP"
NULL_ID = -(2**63)
#: Ids in a block that is transposed at once.
BLOCK = 65_536
#: A shard file is closed at this many ids.
SHARD_IDS = 4_000_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transpose ids (uint32) into planes."""
    top = int(ids.max()) if len(ids) else 0
    if kind == "byte":
        width = max(1, (top.bit_length() + 7) // 8)
        return [np.ascontiguousarray(ids.view("u1").reshape(-1, 4)[:, k]).tobytes() for k in range(width)]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1) != 0, bitorder="little").tobytes() for k in range(max(1, top.bit_length()))]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids that :func:`to_planes` took apart."""
    if kind == "byte":
        out = np.zeros((n, 4), "u1")
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, "u1")
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, "u1"), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return ids


def pack_shard(doc_ids: list[int], lengths: list[int], ids: np.ndarray, first: int = 0, kind: str = "byte", block: int = BLOCK) -> bytes:
    """One file's bytes; `first` ids of the same partition lie in files before it."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    out, at, chunks = [MAGIC + struct.pack("<I", 1)], 8, []
    for start in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[start : start + block], "<u4")
        planes = [press.compress(x) for x in to_planes(part, kind)]
        chunks.append([at, len(part), [len(x) for x in planes]])
        out += planes
        at += sum(map(len, planes))
    documents = press.compress(np.array([doc_ids, lengths], "<i8").T.tobytes())
    out.append(documents)
    index = press.compress(json.dumps({"kind": kind, "block": block, "chunks": chunks, "documents": [at, len(documents)], "n_docs": len(doc_ids), "n_tokens": len(ids), "first": first}).encode())
    out += [index, struct.pack("<QQ", at + len(documents), len(index)), MAGIC]
    return b"".join(out)


def read_index(data: bytes) -> dict:
    """The chunk index of a file."""
    import zstandard

    data = memoryview(data)
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a token plane file")
    at, size = struct.unpack("<QQ", data[-20:-4])
    return json.loads(zstandard.ZstdDecompressor().decompress(data[at : at + size]))


def read_ids(data: bytes, index: dict, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids `first` to `first + count` of a file; only the chunks that hold them are decompressed."""
    import zstandard

    data = memoryview(data)
    count = index["n_tokens"] - first if count is None else count
    if count <= 0:
        return np.zeros(0, "<u4")
    block, plain, parts = index["block"], zstandard.ZstdDecompressor(), []
    for at, n, sizes in index["chunks"][first // block : (first + count - 1) // block + 1]:
        planes = []
        for size in sizes:
            planes.append(plain.decompress(data[at : at + size]))
            at += size
        parts.append(from_planes(planes, n, index["kind"]))
    skip = first % block
    return np.concatenate(parts)[skip : skip + count]


def read_documents(data: bytes, index: dict) -> np.ndarray:
    """Pairs (doc_id, n_tokens) of a file."""
    import zstandard

    data, (at, size) = memoryview(data), index["documents"]
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), "<i8").reshape(-1, 2)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, kind: str = "byte", block: int = BLOCK, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> list[int]:
    """Encode `docs` (doc_id, text) and write shards below `folder` in ascending doc_id order.

    Returns the number of ids in each partition, in order (one number a task).
    The texts are range-partitioned once, on doc_id and, for a doc_id with many
    rows, on the text's hash; ids never cross the network.
    """
    parts = partitions or input_parts(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        doc_ids, lengths, held, n_held, shard, total = [], [], [], 0, 0, 0

        def flush():
            nonlocal doc_ids, lengths, held, n_held, shard, total
            ids = np.frombuffer(b"".join(held), "<u4")
            put_file(folder, f"part-{part:06d}-{shard:05d}.vxtp", pack_shard(doc_ids, lengths, ids, total, kind, block))
            doc_ids, lengths, held, n_held, shard, total = [], [], [], 0, shard + 1, total + n_held

        for batch in batches:
            texts = batch.column(1)
            for at, rows in chunks(texts):
                for doc_id, ids in zip(batch.column(0).slice(at, rows).to_pylist(), enc.encode(texts.slice(at, rows)), strict=True):
                    doc_ids.append(NULL_ID if doc_id is None else doc_id)
                    lengths.append(len(ids) // 4)
                    held.append(ids)
                    n_held += len(ids) // 4
                    if n_held >= shard_ids:
                        flush()
                release_arrow()
        if doc_ids:
            flush()
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [total]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64())]))

    found = {r.part: r.n for r in rows.mapInArrow(write, "part int, n long").collect()}
    return [found.get(k, 0) for k in range(max(found, default=-1) + 1)]


def read_token_files(spark: SparkSession, folder: str, totals: list[int]) -> DataFrame:
    """Documents of the files below `folder`: doc_id, start, n_tokens, ids_crc32.

    `totals` are the ids of each partition; one shard is in memory at a time.
    """
    names = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not totals:
        return spark.createDataFrame([], names)
    begin = [0, *np.cumsum(totals).tolist()]
    schema = pa.schema([(x.split()[0], pa.int64()) for x in names.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_buffer()
                part = int(path.as_py().rpartition("/part-")[2].split("-")[0])
                index = read_index(data)
                pairs, ids = read_documents(data, index), read_ids(data, index)
                ends = np.cumsum(pairs[:, 1])
                starts, raw = ends - pairs[:, 1], memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.array(pairs[:, 0], mask=pairs[:, 0] == NULL_ID)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + (begin[part] + index["first"])), pa.array(pairs[:, 1]), pa.array(crc, pa.int64())], schema=schema)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(read, names)
