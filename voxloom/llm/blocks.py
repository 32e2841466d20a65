"""Documents in compressed blocks, and questions that blocks ask of hash buckets.

Several operators need, for every word or text anchor of every document, something that is known only
after looking at the whole corpus. Rows for each word would be most of the work, so whole documents are
gathered into blocks of about `BLOCK_BYTES` of text. A block asks each hash bucket about its
different keys in one row; a bucket answers with one row for each block that asked; the
answers are joined to the blocks. A key that is in every document reaches its bucket
once a block, so no bucket holds more than its share of different keys for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.shared import input_parts, release_arrow, work_folder

#: UTF-8 bytes at which a block is closed. A longer document is a block of its own.
BLOCK_BYTES = 8_000_000
NULL_ID = -(2**63)


def press(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_texts(ids: list[int], texts: list[bytes]) -> tuple[bytes, ...]:
    """A block's columns heads and data: doc_ids with sizes, and the texts one after the other."""
    return press(np.array([ids, [len(x) for x in texts]], "<i8").tobytes()), press(b"".join(texts))


def lower_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts in order of appearance (A-Z in lower case, cut at ASCII white space), the number of each word of the texts, and how many words each text has."""
    data = pa.array(texts, pa.binary())
    # Arrow's ASCII functions take strings; they look at single bytes, so these need not be UTF-8
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.string(), len(data), data.buffers())))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    sizes = np.diff(before[split.offsets.to_numpy()])
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy(), sizes


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, pack=pack_texts, columns: str = "heads binary, data binary") -> DataFrame:
    """A table block, heads, data: the documents (doc_id, text) in blocks, in the order in which a scan meets them; or with the columns that another `pack` makes.

    It lies in the shared folder, bucketed by block, so that joins of answers to blocks move the answers only. Buckets need
    an entry in the catalogue while the table is written; it is taken out again, the files stay.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, size
            packed = pack(ids, held)
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=["block", *[x.split()[0] for x in columns.split(", ")]])
            block, size = block + 1, 0
            ids.clear(), held.clear()
            release_arrow()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                data = text.encode("utf-8", "surrogatepass") if text else b""
                if held and size + len(data) > block_bytes:
                    yield close()
                ids.append(NULL_ID if doc_id is None else doc_id)
                held.append(data)
                size += len(data)
        if held:
            yield close()

    spark, name = docs.sparkSession, f"voxloom_blocks_{uuid.uuid4().hex}"
    # as many buckets as a join has partitions, else Spark would deal the blocks anew
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_parts(docs))
    rows = docs.select("doc_id", "text").mapInArrow(gather, f"block long, {columns}")
    rows.write.option("path", work_folder(spark, "blocks")).option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return blocks


def open_block(heads: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """doc_ids, where each text begins (and the end of the last), and all texts one after the other."""
    ids, sizes = np.frombuffer(plain(heads), "<i8").reshape(2, -1)
    return ids, np.concatenate([[0], np.cumsum(sizes)]), plain(data)


def doc_id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """`blocks` with a last column answers: array of (bucket, data), in order of bucket. A block has at most one answer a bucket."""
    mine = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", F.col("data").alias("said")))).alias("answers"))
    return blocks.join(mine, "block", "left").select(*blocks.columns, "answers")
