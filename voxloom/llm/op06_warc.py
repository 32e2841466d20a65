"""WARC archives in which equal payloads are stored once.

Headers (file, payload digest, largest id) are shuffled by digest, payloads never; the record with the largest id of
each digest is the response, the others become revisit records that refer to it. Records are
written with fresh headers, each as its own gzip member, into files that roll over at `file_bytes`.
Reading parses the files record by record and resolves revisits by an equality join of
their WARC-Refers-To header with the responses' record ids.

Defined cases: a null html is an empty payload; payloads below `min_bytes` are
all responses; rows that repeat a response's page_id and payload are all
responses; a null page_id is written without an id, compares as smaller than any
other, and refers_to of its revisits is null only if the response has no id; an
empty table writes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.shared import drop_folder, drop_written, put_file, work_folder, written

#: A file is closed at this many compressed bytes.
FILE_BYTES = 16_000_000
_STEP = 16_384
#: Fixed values of the WARC 1.1 format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:%s>"


def sha1_base32(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + press.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzipped archive, one member at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        plain, parts = zlib.decompressobj(31), []
        while not plain.eof:  # in steps, as what is not used of a step is copied
            step = view[at : at + _STEP]
            if not len(step):
                raise ValueError("a gzip member is cut short")
            parts.append(plain.decompress(step))
            at += len(step) - len(plain.unused_data)
        stream = io.BytesIO(b"".join(parts))
        if not stream.readline().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := stream.readline().strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _member(heads: list[tuple[str, str]], url: str | None, digest: bytes, more: list[tuple[str, str]], block: bytes) -> bytes:
    target = [] if url is None else [("WARC-Target-URI", " ".join(url.split()))]
    return record([*heads, *target, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), *more], block)


def _ident(page_id: int | None) -> str:
    return RECORD_ID % ("" if page_id is None else page_id)


_STAGED = "file string, records array<struct<page_id:bigint,url:string,digest:binary,at:bigint,size:int>>, tops array<struct<digest:binary,top:bigint,n:bigint>>"


def _stage(pages: DataFrame, folder: str, min_bytes: int, file_bytes: int, date: str) -> DataFrame:
    """Write each page as a response member into files below `folder`; a row of headers for each file.

    tops: the file's different payload digests with their largest page_id and number of records, so a payload that is
    everywhere is one header a file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nr, held, records, tops, size = TaskContext.get().partitionId(), 0, [], [], {}, 0

        def close() -> pa.RecordBatch:
            nonlocal nr, size
            name = f"part-{part:06d}-{nr:05d}"
            put_file(folder, name, b"".join(held))
            rows = [{"file": name, "records": records, "tops": [{"digest": d, "top": top, "n": n} for d, (top, n) in tops.items()]}]
            out = pa.RecordBatch.from_pylist(rows, schema)
            nr, size = nr + 1, 0
            held.clear(), records.clear(), tops.clear()
            return out

        for batch in batches:
            for page_id, url, html in zip(*batch.columns, strict=True):
                page_id, url, payload = page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha1(payload).digest()
                heads = [("WARC-Type", "response"), ("WARC-Record-ID", _ident(page_id)), ("WARC-Date", date)]
                held.append(_member(heads, url, digest, [("Content-Type", "text/html; charset=utf-8")], payload))
                records.append({"page_id": page_id, "url": url, "digest": digest, "at": size, "size": len(held[-1])})
                if len(payload) >= min_bytes:
                    top, n = tops.get(digest, (None, 0))
                    tops[digest] = (page_id if top is None else top if page_id is None else max(top, page_id), n + 1)
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    schema = pa.schema([("file", pa.string()), ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.binary()), ("at", pa.int64()), ("size", pa.int32())]))), ("tops", pa.list_(pa.struct([("digest", pa.binary()), ("top", pa.int64()), ("n", pa.int64())])))])
    return written(pages.select("page_id", "url", "html").mapInArrow(write, _STAGED), "staged")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> int:
    """Write `pages` (page_id, url, html) as gzipped archives below `folder`; returns the number of records.

    Pages are compressed once, into staged files whose headers alone are shuffled: by digest, to find each payload's
    response, and back by file. Then a task copies a staged file's responses as they are and puts
    revisits in the place of the others. Files are named by the partition, so a task that runs again replaces its own.
    """
    spark = pages.sparkSession
    place = work_folder(spark, "warc")
    staged = _stage(pages, place, min_bytes, file_bytes, date)
    heads = staged.select("file", F.explode("tops").alias("t")).select("file", "t.*")
    first = heads.groupBy("digest").agg(F.max("top").alias("response_id"), F.sum("n").alias("n")).where("n > 1").select("digest", "response_id")
    answers = heads.select("file", "digest").join(first, "digest").groupBy("file").agg(F.collect_list(F.struct("digest", "response_id")).alias("answers"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(place)
        for batch in batches:
            for file, records, said in zip(*batch.columns, strict=True):
                name, records = file.as_py(), records.as_py()
                response = {x["digest"]: x["response_id"] for x in said.as_py() or ()}
                with store.open_input_file(f"{path}/{name}") as f:
                    data = memoryview(f.read())
                ident = uuid.uuid5(uuid.NAMESPACE_URL, name)
                out = [record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
                for x in records:
                    if x["digest"] not in response or response[x["digest"]] == x["page_id"]:
                        out.append(data[x["at"] : x["at"] + x["size"]])
                    else:
                        heads = [("WARC-Type", "revisit"), ("WARC-Record-ID", _ident(x["page_id"])), ("WARC-Date", date)]
                        out.append(_member(heads, x["url"], x["digest"], [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _ident(response[x["digest"]]))], b""))
                put_file(folder, f"{name}.warc.gz", b"".join(out))
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(records)], pa.int64())})

    n = staged.select("file", "records").join(answers, "file", "left").mapInArrow(copy, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drop_folder(spark, place)
    drop_written(staged)
    return n


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Rows of the archives below `folder`; a revisit has the size of the payload it refers to.

    With `with_payload`, column payload (binary) holds a response's own payload.
    """
    names = "page_id long, own_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    ident = lambda text: int(t) if (t := text[len("<urn:page:") : -1]) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for heads, block in read_records(content.as_buffer()):
                    if (kind := heads["warc-type"]) in ("response", "revisit"):
                        refers = ident(heads["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((ident(heads["warc-record-id"]), len(block) if kind == "response" else None, heads["warc-payload-digest"].removeprefix("sha1:"), kind, refers, *[block] * with_payload))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in names.split(", ")])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(read, names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The rows of :func:`read_archives` with payload_bytes: a revisit's is that of the response it refers to."""
    own = records.where("record_type = 'response'").select("page_id", "payload_digest", F.col("own_bytes").alias("payload_bytes"), "record_type", "refers_to")
    first = own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), "payload_bytes").distinct()
    again = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    again = again.join(first, again["refers_to"].eqNullSafe(first["refers_to"]) & (again["payload_digest"] == first["d"])).select(again["page_id"], "payload_digest", "payload_bytes", "record_type", again["refers_to"])
    return own.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def store_and_read(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write `pages` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    if not write_archives(pages, folder, min_bytes):
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return resolve_revisits(read_archives(pages.sparkSession, folder))
