"""PCM WAV files as frames, and their durations, from Spark's binary file source."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

RATE = 16_000


def parse_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate, of 16-bit PCM; an unreadable file has none."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.zeros(0, np.float32), 0
    at, channels, rate, samples = 12, 1, 0, np.zeros(0, np.float32)
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if bits != 16:
                return np.zeros(0, np.float32), 0
        elif name == b"data":
            raw = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").astype(np.float32) / 32768
            samples = raw.reshape(-1, channels).mean(1)
        at += 8 + size + size % 2
    return samples.astype(np.float32), rate


def wav_bytes(samples: np.ndarray, rate: int = RATE, channels: int = 1) -> bytes:
    """A 16-bit PCM file with the 44-byte header; samples of several channels alternate."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, 2 * channels * rate, 2 * channels, 16) + b"data" + struct.pack("<I", len(data)) + data


def _opened(path: str):
    """A file that Spark names, to be read at any place."""
    from pyarrow import fs

    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    store, name = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(name)


def wav_layout(source) -> tuple[int, int, int, int] | None:
    """Where the samples of an open 16-bit PCM file begin, frames, channels and rate; None if unreadable. Only headers are read."""
    size = source.size()
    head = source.read_at(min(size, 12), 0)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, channels, rate = 12, 0, 0
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", source.read_at(8, at))
        if name == b"fmt " and at + 24 <= size:
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", source.read_at(16, at + 8))
            if bits != 16:
                return None
        elif name == b"data":
            return (at + 8, min(length, size - at - 8) // (2 * channels), channels, rate) if channels and rate else None
        at += 8 + length + length % 2
    return None


def _window(source, layout: tuple[int, int, int, int], first: int, after: int, rate: int) -> np.ndarray:
    """Samples `first` to `after` at `rate` of a file, of which only the frames that they need are read: the same as of the whole file."""
    begin, frames, channels, own = layout
    step = own / rate
    lo, hi = int(first * step), min(int((after - 1) * step) + 2, frames)
    raw = np.frombuffer(source.read_at((hi - lo) * 2 * channels, begin + lo * 2 * channels), "<i2").astype(np.float32) / 32768
    samples = raw.reshape(-1, channels).mean(1).astype(np.float32)
    return samples[: after - first] if own == rate else np.interp(np.arange(first, after) * step, np.arange(lo, hi), samples).astype(np.float32)


_HEADERS = "path string, begin long, frames long, channels int, rate int, n long"


def _paths(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """The files of a folder, or those that a table names, dealt to all cores: Spark reads small files by the dozen, so that many of them are many tasks; their names are few bytes."""
    found = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    return found.select("path").repartition(spark.sparkContext.defaultParallelism)


def headers(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, begin, frames, channels, rate of the readable files in a folder or a table (path), and n, their samples at 16 kHz. Only headers are read."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch.path:
                with _opened(name) as source:
                    layout = wav_layout(source)
                if layout:
                    rows.append((name, *layout, int(layout[1] * RATE / layout[3])))
            yield pd.DataFrame(rows, columns=["path", "begin", "frames", "channels", "rate", "n"])

    return _paths(spark, path).mapInPandas(plan, _HEADERS)


#: Ranges of a file that one task reads one after the other, and rows that it gives out at once.
_RANGES, _ROWS = 16, 10_000


def _each_range(ranges: DataFrame, found: Callable, returns: str) -> DataFrame:
    """Columns that `found` (range, source) makes of each range (columns of :func:`headers`, nr, first, after), in batches; a file is opened once for ranges that follow one another."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        rows = (r for batch in batches for r in batch.itertuples())
        for path, file in groupby(rows, key=lambda r: r.path):
            with _opened(path) as source:
                for r in file:
                    out.append(found(r, source))
                    n += len(out[-1][-1])
                    if n >= _ROWS:
                        yield _table(out, returns)
                        out, n = [], 0
        if out:
            yield _table(out, returns)

    rows = ranges.where("after > first").repartition("path", F.expr(f"nr div {_RANGES}")).sortWithinPartitions("path", "nr")
    return rows.mapInPandas(read, returns)


def _table(found: list[tuple], returns: str) -> pd.DataFrame:
    """One table of ranges' columns; a value that is no array holds for all rows of its range."""
    sizes = [len(f[-1]) for f in found]
    names = [x.split()[0] for x in returns.split(", ")]
    return pd.DataFrame({c: np.concatenate([f[k] for f in found]) if isinstance(found[0][k], np.ndarray) else np.repeat(np.array([f[k] for f in found], object), sizes) for k, c in enumerate(names)})


def read_ranges(ranges: DataFrame, window: int | None = None) -> DataFrame:
    """path, nr, at, n, rms of ranges (columns of :func:`headers`, nr, first, after) of samples at 16 kHz, or of each whole window of so many samples in them; `at` is its first sample.

    Each range reads its own part of its file, so a task holds one range, however long the sound is, and the ranges of one file are spread over many tasks.
    """

    def levels(r, source) -> tuple:
        x = _window(source, (r.begin, r.frames, r.channels, r.rate), r.first, r.after, RATE).astype(float)
        size = window or len(x)
        parts = x[: len(x) // size * size].reshape(-1, size)
        return r.path, r.nr, r.first + size * np.arange(len(parts)), size, np.sqrt((parts * parts).mean(1))

    rows = ranges.select("path", "begin", "frames", "channels", "rate", "nr", "first", "after")
    return _each_range(rows, levels, "path string, nr int, at long, n long, rms double")


def read_chunks(spark: SparkSession, path: str | DataFrame, chunk_s: float = 30.0, overlap_s: float = 0.0) -> DataFrame:
    """path, chunk, start_s, rms, n of each file: chunks of `chunk_s` that overlap by `overlap_s`, at 16 kHz; the last may be short."""
    size, step, overlap = int(chunk_s * RATE), int((chunk_s - overlap_s) * RATE), int(overlap_s * RATE)
    chunks = F.expr(f"cast(ceil(greatest(n - {overlap}, least(n, 1)) / {step}) as int)")
    each = headers(spark, path).where("n > 0").withColumn("nr", F.explode(F.sequence(F.lit(0), chunks - 1)))
    found = read_ranges(each.withColumn("first", F.col("nr") * F.lit(step)).withColumn("after", F.least(F.col("first") + size, F.col("n"))))
    return found.select("path", F.col("nr").alias("chunk"), (F.col("at") / RATE).alias("start_s"), "rms", "n")


def levels(files: DataFrame, window_s: float = 0.025, windows: int = 2400) -> DataFrame:
    """path, frame, rms: the level of each whole window of files (:func:`headers`), `windows` of them read at once."""
    size = int(RATE * window_s)
    each = files.where("n > 0").withColumn("nr", F.explode(F.expr(f"sequence(0, cast((n - 1) div {size * windows} as int))")))
    found = read_ranges(each.withColumn("first", F.col("nr").cast("long") * size * windows).withColumn("after", F.least(F.col("first") + size * windows, F.col("n"))), size)
    return found.select("path", F.expr(f"at div {size}").alias("frame"), "rms")


def chunks_at_cuts(files: DataFrame, cuts: DataFrame, hard_overlap_s: float = 0.0, silence_overlap_s: float = 0.0) -> DataFrame:
    """path, chunk, start_s, overlap (samples), n, rms: the chunks of files (:func:`headers`) from cut to cut (path, nr, cut_s, at_silence) and to the file's end.

    A chunk begins early, by the one overlap after a cut at a silence and by the other after a hard cut, unless the chunk before is shorter.
    """
    ends = cuts.select("path", "nr", F.floor(F.col("cut_s") * RATE).alias("after"), "at_silence").unionByName(files.select("path", F.lit(2**31 - 1).alias("nr"), F.col("n").alias("after"), F.lit(True).alias("at_silence")))
    order = Window.partitionBy("path").orderBy("nr")
    rows = ends.withColumn("begins", F.lag("after", 1, 0).over(order)).withColumn("before", F.lag("after", 2, 0).over(order)).withColumn("quiet", F.lag("at_silence").over(order)).withColumn("nr", F.row_number().over(order) - 1)
    overlap = F.when(F.col("quiet"), int(silence_overlap_s * RATE)).when(~F.col("quiet"), int(hard_overlap_s * RATE)).otherwise(0).cast("long")
    rows = rows.withColumn("overlap", F.when(F.col("begins") - F.col("before") >= overlap, overlap).otherwise(0)).withColumn("first", F.col("begins") - F.col("overlap")).where("after > begins")
    found = read_ranges(files.join(rows, "path"))
    return found.join(rows.select("path", "nr", "overlap"), ["path", "nr"]).select("path", F.col("nr").alias("chunk"), (F.col("at") / RATE).alias("start_s"), "overlap", "n", "rms")


def durations(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, duration_s as the headers state it, cut to the bytes that are there; 0 for an unreadable file. Samples are not read."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch.path:
                with _opened(name) as source:
                    layout = wav_layout(source)
                found.append(layout[1] / layout[3] if layout else 0.0)
            yield pd.DataFrame({"path": batch.path, "duration_s": found})

    return _paths(spark, path).mapInPandas(probe, "path string, duration_s double")


def read_samples(spark: SparkSession, path: str | DataFrame, rate: int | None = None) -> DataFrame:
    """path, nr, x: mono samples of each file, brought to `rate` if one is given; a task holds a range of them."""
    size = 60 * RATE
    n = F.floor(F.col("frames") * F.lit(rate) / F.col("rate")) if rate else F.col("frames")
    files = headers(spark, path).withColumn("n", n).withColumn("to", F.lit(rate) if rate else F.col("rate")).where("n > 0")
    ranges = files.withColumn("nr", F.explode(F.expr(f"sequence(0, cast((n - 1) div {size} as int))"))).withColumn("first", F.col("nr").cast("long") * size).withColumn("after", F.least(F.col("first") + size, F.col("n")))

    def samples(r, source) -> tuple:
        x = _window(source, (r.begin, r.frames, r.channels, r.rate), r.first, r.after, r.to)
        return r.path, np.arange(r.first, r.after), x.astype(float)

    return _each_range(ranges, samples, "path string, nr long, x double")


#: Frames of a part of a sound that is written.
PART = 4096


def _pcm(x: Column) -> Column:
    """A sample as 16-bit PCM in hexadecimal digits, the low byte first."""
    x = F.coalesce(F.nanvl(x.cast("float"), F.lit(0.0).cast("float")), F.lit(0.0).cast("float"))
    v = (F.least(F.greatest(x, F.lit(-1.0).cast("float")), F.lit(1.0).cast("float")) * F.lit(32767).cast("float")).cast("int")
    return F.lpad(F.hex(F.shiftleft(v.bitwiseAND(255), 8).bitwiseOR(F.shiftright(v, 8).bitwiseAND(255))), 4, "0")


def _whole(n: Column, size: int) -> Column:
    """A whole number as bytes in hexadecimal digits, the low byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])


def sounds(frames: DataFrame, name: Column, channels: int = 1) -> DataFrame:
    """name, part, body: WAV files of the recordings' frames (recording_id, frame, and x, or with two channels x and y) in parts for :func:`files.write_parts`, the header before the first.

    Instead of a sample x and y may hold an array of those from `frame` on. Parts are small and counted by a window that spills, so no recording is held whole.
    """
    columns = ["x", "y"][:channels]
    if isinstance(frames.schema["x"].dataType, ArrayType):
        digits = F.array_join(F.transform(F.arrays_zip(*columns), lambda s: F.concat(*[_pcm(s[c]) for c in columns])), "")
    else:
        digits = F.concat(*[_pcm(F.col(c)) for c in columns])
    rows = frames.select("recording_id", F.expr(f"frame div {PART}").alias("part"), F.struct("frame", digits.alias("digits")).alias("s"))
    rows = rows.groupBy("recording_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["digits"]), "").alias("digits"))
    by_part = Window.partitionBy("recording_id").orderBy("part")
    size = F.sum(F.length("digits") / 2).over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    head, rest = wav_bytes(np.zeros(0, np.float32), RATE, channels).hex().upper(), 36
    header = F.concat(F.lit(head[:8]), _whole(F.col("size") + rest, 4), F.lit(head[16:80]), _whole(F.col("size"), 4))
    rows = rows.withColumn("size", size).withColumn("first", F.row_number().over(by_part) == 1)
    return rows.select(name.alias("name"), "part", F.unhex(F.concat(F.when(F.col("first"), header).otherwise(""), "digits")).alias("body"))
