"""Exact repeats across documents by common-prefix interval trees of enhanced suffix arrays.

Every window of `LENGTH` bytes has an anchor: the run of `GRAM` bytes in it with the least
hash. Equal windows have equal anchors, so the suffixes that begin with equal windows
always meet in the hash bucket of their anchor. The work goes in three passes over blocks of documents:

1. Blocks ask buckets which anchors occur in several documents (sorted 32-bit values in a bucket; a chance
   collision only means a needless candidate).
2. Around those anchors, blocks send each different stretch of text once: all windows with one anchor in a
   row, from the first byte of the first to the last byte of the last, with the smallest
   doc_id that holds it. A stretch of an anchor with over `HOT` different stretches is sent window by window, dealt
   by the window's own hash, so a common line with many surroundings is spread as well. A line that is
   everywhere with the same surroundings is one text for each block.
   A bucket sorts the suffixes of its different stretches, takes the longest common prefixes of neighbours, and scans
   them with a stack: each interval of prefix length `LENGTH` or more is a repeat with
   all its occurrences. It is maximal to the left if different bytes, or a document's start, stand
   before its occurrences. Outermost intervals give each window its first document.
3. Blocks learn the first document of each window and cover the windows whose first
   document has a smaller doc_id.

Stretches have fewer than 2 * LENGTH bytes. `maximal_repeats` gathers the windows before which different bytes
stand, compares the repeated texts after them by hashes of chunks, and finds repeats of any length; `repeat_spans` lists the covered spans of documents.

Defined cases: a null text is an empty one; texts shorter than `LENGTH` bytes lose nothing; documents
with equal doc_id do not cover one another; a null doc_id counts as smaller than any
other, the least long as a null one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.blocks import BLOCK_BYTES, doc_id_array, make_blocks, open_block, plain, press, with_answers
from voxloom.llm.shared import drop_written, written

LENGTH, GRAM = 50, 24
#: Different stretches that an anchor may have, summed over the blocks (up to 255 in each), before its windows are dealt one by one.
HOT = 16_384
#: A bucket is worked through in `SUB` parts one after the other, so that a block's rows to the buckets stay few and large
#: while a suffix array stays small: for each bucket there are `BLOCKS_OF_BUCKET` blocks, `LEAST_BUCKETS` at least for parallelism.
SUB, BLOCKS_OF_BUCKET, LEAST_BUCKETS = 32, 8, 32
#: Bytes whose windows are hashed at once; below 2**24.
_PART = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _doubled(x: np.ndarray, steps: list[int], join) -> np.ndarray:
    """Combine each element with those after it, each step that many places on."""
    for step in steps:
        x = join(x[:-step], x[step:], step)
    return x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    power = [_U(pow(int(_BASE), n, 1 << 64)) for n in range(17)]
    eight = _doubled(data.astype(_U), [1, 2, 4], lambda a, b, n: a * power[n] + b)
    sixteen = eight[:-8] * power[8] + eight[8:]
    n = len(data) - GRAM + 1
    return _mixed(sixteen[:n] * power[8] + eight[16 : 16 + n])


def stretches(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each row of windows with one anchor, and a hash of its text.

    `data` are the bytes of documents one after the other, `begin` where they begin (and the end).
    """
    out: list[tuple[np.ndarray, ...]] = []
    end = np.repeat(begin[1:], np.diff(begin)).astype(np.int32)
    width = LENGTH - GRAM + 1
    steps = [1, 2, 4, 8]
    for x in range(0, len(data), _PART):
        part = data[x : x + _PART + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            break
        hashes = _gram_hashes(part)
        place = (hashes & ~_U(0xFFFFFF)) | np.arange(len(hashes), dtype=_U)
        least = _doubled(place, steps, lambda a, b, _: np.minimum(a, b))  # of 16 places
        least = np.minimum(least[:n], least[width - 16 : width - 16 + n])
        where = (least & _U(0xFFFFFF)).astype(np.int64)
        ok = np.arange(x, x + n) + LENGTH <= end[x : x + n]
        edge = np.ones(n, bool)
        edge[1:] = (where[1:] != where[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, n))
        keep = ok[first]
        first, count = first[keep], count[keep]
        # runs of GRAM bytes that together hold the whole text, which has fewer than 4 * GRAM
        last = first + count + LENGTH - 1 - GRAM
        name = hashes[first]
        for at in (np.minimum(first + GRAM, last), np.minimum(first + 2 * GRAM, last), last):
            name = _mixed(name + _BASE) + hashes[at]
        out.append((first + x, count, _mixed(hashes[where[first]] + _BASE), name + count.astype(_U)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _planes(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return press(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(plain(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class _Block:
    """A block's documents, stretches and their anchors' places among the buckets."""

    def __init__(self, heads: bytes, data: bytes, buckets: int):
        self.ids, self.begin, self.raw = open_block(heads, data)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.first, self.count, self.anchor, self.name = stretches(self.data, self.begin)
        self.doc = np.searchsorted(self.begin, self.first, side="right") - 1
        key = (self.anchor & _U(0xFFFFFFFF)) % _U(buckets) << _U(32) | self.anchor >> _U(32)
        self.keys, self.which = np.unique(key, return_inverse=True)
        self.edges = np.searchsorted(self.keys >> _U(32), np.arange(buckets + 1, dtype=_U))

    def variety(self) -> np.ndarray:
        """For each key, how many different stretches it has (255 stands for more)."""
        order = np.lexsort((self.name, self.which))
        which, name = self.which[order], self.name[order]
        new = np.ones(len(order), bool)
        new[1:] = (which[1:] != which[:-1]) | (name[1:] != name[:-1])
        return np.minimum(np.bincount(which[new], minlength=len(self.keys)), 255).astype(np.uint8)

    def several(self) -> np.ndarray:
        """For each key, whether documents of different ids have it."""
        ids = self.ids[self.doc]
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        return low < high


def shared_anchors(blocks: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """A written table of answers (block, bucket, data): for each anchor of the block 0, or 1 if it is in several documents, or 2 if it has more than `hot` different stretches besides."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, heads, data in zip(*batch.columns, strict=True):
                mine = _Block(heads.as_py(), data.as_py(), buckets)
                several, variety, rows = mine.several(), mine.variety(), []
                for k in range(buckets):
                    a, b = mine.edges[k], mine.edges[k + 1]
                    if a < b:
                        values = (mine.keys[a:b] & _U(0xFFFFFFFF)).astype("<u4")
                        rows.append((k, _planes(np.diff(values, prepend=np.uint32(0)).astype("<u4")), press(np.packbits(several[a:b]).tobytes()), press(variety[a:b].tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(rows), pa.int64()), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]], names=["block", "bucket", "values", "several", "variety"])

    def answer(key: tuple, found: pa.Table) -> pa.Table:
        values = [np.cumsum(_unplanes(x.as_py(), "<u4"), dtype=np.uint32) for x in found["values"]]
        several = [np.unpackbits(np.frombuffer(plain(x.as_py()), np.uint8), count=len(v)) for x, v in zip(found["several"], values, strict=True)]
        different, which, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        state = (n > 1).astype(np.uint8)
        state[which[np.concatenate(several) > 0]] = 1
        variety = np.concatenate([np.frombuffer(plain(x.as_py()), np.uint8) for x in found["variety"]])
        state[(np.bincount(which, variety, len(different)) > hot) & (state == 1)] = 2
        parts = np.split(state[which], np.cumsum([len(x) for x in values])[:-1])
        return pa.table({"block": found["block"], "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()), "data": pa.array([press(x.tobytes()) for x in parts], pa.binary())})

    rows = blocks.select("block", "heads", "data").mapInArrow(ask, "block long, bucket int, values binary, several binary, variety binary")
    return written(rows.groupBy("bucket").applyInArrow(answer, "block long, bucket int, data binary"), "anchors")


class _Candidates:
    """A block's stretches with shared anchors, and their different texts dealt to the parts of buckets."""

    def __init__(self, mine: _Block, said: dict[int, bytes], buckets: int):
        fine = buckets * SUB
        state = np.zeros(len(mine.keys), np.uint8)
        for k in range(buckets):
            if mine.edges[k] < mine.edges[k + 1]:
                state[mine.edges[k] : mine.edges[k + 1]] = np.frombuffer(plain(said[k]), np.uint8)
        state = state[mine.which]
        one, many = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        times = mine.count[many]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.first = np.concatenate([mine.first[one], np.repeat(mine.first[many], times) + inner])
        end = np.concatenate([mine.first[one] + mine.count[one] + LENGTH - 1, self.first[len(one) :] + LENGTH])
        self.doc = np.concatenate([mine.doc[one], np.repeat(mine.doc[many], times)])
        deal = ((mine.anchor[one] >> _U(11)) % _U(fine)).astype(np.int64).tolist()
        raw, index = mine.raw, {}
        number, homes = [], []
        for k, (a, b) in enumerate(zip(self.first.tolist(), end.tolist(), strict=True)):
            text = raw[a:b]
            nr = index.setdefault(text, len(index))
            if nr == len(homes):
                homes.append(deal[k] if k < len(deal) else zlib.crc32(text) % fine)
            number.append(nr)
        self.number, self.homes, self.texts = np.array(number, np.int64), np.array(homes, np.int64), list(index)
        #: Texts in the order in which they go to the buckets and their parts.
        self.order = np.argsort(self.homes, kind="stable")

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bucket its number, the texts that go there in order, and how many go to each part."""
        bucket = self.homes[self.order] // SUB
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)][: len(cuts)], strict=True):
            part = self.order[a:b]
            yield int(bucket[a]), part, np.bincount(self.homes[part] % SUB, minlength=SUB)


def _first_answers(answers) -> dict[int, bytes]:
    return {x["bucket"]: x["said"] for x in answers or ()}


def candidate_stretches(blocks: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, data: the block's different texts for a bucket, part after part, their smallest
    doc_ids and the bytes before them (256: different ones, 257: a document's start)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, heads, data, answers in zip(*batch.columns, strict=True):
                mine = _Block(heads.as_py(), data.as_py(), buckets)
                c = _Candidates(mine, _first_answers(answers.as_py()), buckets)
                before = np.where(c.first == mine.begin[c.doc], 257, mine.data[c.first - 1])
                low, high = np.full(len(c.texts), 999), np.full(len(c.texts), -1)
                smallest = np.full(len(c.texts), np.iinfo(np.int64).max)
                np.minimum.at(low, c.number, before)
                np.maximum.at(high, c.number, before)
                np.minimum.at(smallest, c.number, mine.ids[c.doc])
                left = np.where(low == high, low, 256)
                rows = []
                for bucket, part, parts in c.rows():
                    chosen = [c.texts[k] for k in part.tolist()]
                    rows.append((bucket, _pack(np.array([len(x) for x in chosen], "u1"), np.frombuffer(b"".join(chosen), np.uint8), smallest[part].astype("<i8"), left[part].astype("<i2"), parts.astype("<u4"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bucket", "data"])

    return with_answers(blocks, anchors).mapInArrow(send, "block long, bucket int, data binary")


def _pack(*arrays: np.ndarray) -> bytes:
    """Some arrays, each compressed, with their sizes in front."""
    parts = [_planes(x) if x.itemsize > 1 else press(x.tobytes()) for x in arrays]
    return np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(parts)


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data[: 8 * len(kinds)], "<i8").tolist(), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        part = data[at : at + size]
        out.append(_unplanes(part, kind) if np.dtype(kind).itemsize > 1 else np.frombuffer(plain(part), kind))
        at += size
    return out


class SuffixArray:
    """Suffixes of some texts that begin with a whole window, in order, with the common prefixes of neighbours."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        sizes = np.array([len(x) for x in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        longest = int(sizes.max(initial=0))
        data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(longest + 16, np.uint8)]).astype(_U)
        word = _doubled(data, [1, 2, 4], lambda a, b, n: a << _U(8 * n) | b)
        n = np.maximum(sizes - length + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), n)
        self.offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = begin[self.text] + self.offset
        left = sizes[self.text] - self.offset  # bytes to the text's end
        keep = np.array([0, *((0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9))], _U)
        order = np.argsort(word[at] & keep[np.clip(left, 0, 8)], kind="stable")
        same = np.zeros(len(order), bool)  # as far as the words compared, equal to the one before
        common = np.zeros(len(order), np.int64)
        here, group, j = np.arange(len(order)), np.zeros(len(order), np.int64), 0
        while len(here):
            rows = order[here]
            value = word[at[rows] + 8 * j] & keep[np.clip(left[rows] - 8 * j, 0, 8)]
            sub = np.lexsort((value, group)) if j else np.arange(len(here))
            order[here], value = rows[sub], value[sub]
            tied = np.zeros(len(here), bool)
            tied[1:] = group[1:] == group[:-1]
            differ = np.zeros(len(here), _U)
            differ[1:] = value[1:] ^ value[:-1]
            common[here[tied]] = 8 * j + _zero_bytes(differ[tied])
            same[here] = tied & (differ == 0)
            j += 1
            if 8 * j >= longest:
                break
            more = same.copy()
            more[:-1] |= same[1:]
            here = np.flatnonzero(more)
            group = np.cumsum(~same)[here]
        self.order = order
        rest = left[order]
        common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
        self.common = common


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit words."""
    return sum((x < _U(1 << 8 * k)).astype(np.int64) for k in range(8))


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """Common-prefix intervals (prefix length, first, last, outermost) of `least` or more, inner ones first, by one scan with a stack."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(common) + 1):
        here = common[k] if k < len(common) else 0
        here = here if here >= least else 0
        first = k - 1
        while stack and stack[-1][0] > here:
            length, first = stack.pop()
            yield length, first, k - 1, not here and not stack
        if here and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def _parts(found: pa.Table) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """For each part of a bucket its different texts, their smallest doc_ids, the bytes before them, and each block's texts by number."""
    sent = []
    for data in found["data"]:
        sizes, raw, ids, before, parts = _unpack(data.as_py(), ["u1", "u1", "<i8", "<i2", "<u4"])
        sent.append((raw.tobytes(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), ids, before.astype(np.int64), np.concatenate([[0], np.cumsum(parts, dtype=np.int64)])))
    for part in range(SUB):
        index: dict[bytes, int] = {}
        asks, smallest, left = [], [], []
        for k, (raw, ends, ids, before, parts) in enumerate(sent):
            a, b = int(parts[part]), int(parts[part + 1])
            if a < b:
                cuts = ends[a : b + 1].tolist()
                asks.append((k, np.array([index.setdefault(raw[x:y], len(index)) for x, y in pairwise(cuts)], np.int64)))
                smallest.append(ids[a:b])
                left.append(before[a:b])
        if not asks:
            continue
        number, before = np.concatenate([x for _, x in asks]), np.concatenate(left)
        first, low, high = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), 999), np.full(len(index), -1)
        np.minimum.at(first, number, np.concatenate(smallest))
        np.minimum.at(low, number, before)
        np.maximum.at(high, number, before)
        yield list(index), first, np.where(low == high, low, 256), asks


def _answers(key: tuple, found: pa.Table, answers: list[list[tuple[np.ndarray, ...]]]) -> pa.Table:
    """A row for each block that asked: its answers, part after part."""
    packed = [_pack(*(np.concatenate(x) for x in zip(*mine, strict=True))) for mine in answers]
    return pa.table({"block": found["block"], "bucket": pa.array([key[0].as_py()] * len(packed), pa.int32()), "data": pa.array(packed, pa.binary())})


def _first_documents(key: tuple, found: pa.Table) -> pa.Table:
    """For each asking block and text, the smallest doc_id that holds each window, in runs of equal ones."""
    out: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(found.num_rows)]
    for texts, first, _, asks in _parts(found):
        array = SuffixArray(texts)
        window = first[array.text]
        rank = np.flatnonzero(_touched(array.common))
        common = array.common[rank].tolist()
        for _, a, b, outermost in intervals(common, LENGTH):
            if outermost:
                rows = array.order[rank[a : b + 1]]
                window[rows] = window[rows].min()
        edge = np.ones(len(window), bool)
        edge[1:] = (window[1:] != window[:-1]) | (array.text[1:] != array.text[:-1])
        run = np.flatnonzero(edge)
        size, value, owner = np.diff(np.append(run, len(window))), window[run], array.text[run]
        runs = np.bincount(owner, minlength=len(texts))
        start = np.cumsum(runs) - runs
        for k, mine in asks:
            n = runs[mine]
            at = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[k].append((n.astype("u1"), size[at].astype("u1"), value[at].astype("<i8")))
    return _answers(key, found, out)


def _groups(texts: list[bytes], left: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, offset)]) of each repeat that different bytes stand before, or that begins where a text does; `left` has the byte before each text.

    What stands before all members inside their texts is found with it as part of a longer repeat.
    """
    array = SuffixArray(texts)
    rank = np.flatnonzero(_touched(array.common))
    rows = array.order[rank]
    text, offset = array.text[rows].tolist(), array.offset[rows].tolist()
    sides = [int(left[t]) if o == 0 else texts[t][o - 1] for t, o in zip(text, offset, strict=True)]
    whole = set()  # texts that are themselves the repeat of some interval
    for length, a, b, _ in intervals(array.common[rank].tolist(), LENGTH):
        members = range(a, b + 1)
        seen = {sides[k] for k in members}
        if len(seen) > 1 or any(offset[k] == 0 for k in members):
            yield length, [(text[k], offset[k]) for k in members]
        whole.update(text[k] for k in members if offset[k] == 0 and len(texts[text[k]]) == length)
    for t in range(len(texts)):
        if t not in whole:  # the same whole text, perhaps in several places
            yield len(texts[t]), [(t, 0)]


def _repeats_of_texts(key: tuple, found: pa.Table) -> pa.Table:
    """For each asking block and text, its repeats: offset, length and a number made from the first `LENGTH` of the repeated bytes."""
    import xxhash

    out: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(found.num_rows)]
    for texts, _, left, asks in _parts(found):
        mine: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for length, members in _groups(texts, left):
            t, o = members[0]
            number = xxhash.xxh64_intdigest(texts[t][o : o + LENGTH]) - 2**63
            for t, o in members:
                mine[t].append((o, length, number))
        for k, numbers in asks:
            all_ = [x for t in numbers.tolist() for x in mine[t]]
            n = np.array([len(mine[t]) for t in numbers.tolist()], "<i4")
            out[k].append((n, np.array([x[0] for x in all_], "u1"), np.array([x[1] for x in all_], "u1"), np.array([x[2] for x in all_], "<i8")))
    return _answers(key, found, out)


def _touched(common: np.ndarray) -> np.ndarray:
    """Ranks that have LENGTH bytes in common with a neighbour."""
    long = common >= LENGTH
    out = long.copy()
    out[:-1] |= long[1:]
    return out


def _covered(heads: bytes, data: bytes, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """doc_ids, begin, bytes of a block, and which bytes are covered."""
    said = _first_answers(answers)
    mine = _Block(heads, data, buckets)
    c = _Candidates(mine, said, buckets)
    ids, begin, raw, first, number, order = mine.ids, mine.begin, mine.raw, c.first, c.number, c.order
    found = [_unpack(said[-1 - k], ["u1", "u1", "<i8"]) for k, _, _ in c.rows()]
    runs, size, value = np.zeros(len(order), np.int64), [x for _, x, _ in found], [x for _, _, x in found]
    if found:
        runs[order] = np.concatenate([x for x, _, _ in found])
    change = np.zeros(len(raw) + 1, np.int32)
    if len(first):
        size, value = np.concatenate(size).astype(np.int64), np.concatenate(value)
        start = np.zeros(len(order), np.int64)
        start[order] = np.cumsum(runs[order]) - runs[order]
        n = runs[number]
        at = np.repeat(start[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # a run begins where those before it in its text end
        ends = np.cumsum(size[at])
        text_begin = np.repeat(np.concatenate([[0], ends])[np.cumsum(n) - n], n)
        place = np.repeat(first.astype(np.int64), n) + ends - size[at] - text_begin
        doc = ids[np.searchsorted(begin, place, side="right") - 1]
        later = value[at] < doc
        np.add.at(change, place[later], 1)
        np.add.at(change, place[later] + size[at][later] + LENGTH - 1, -1)
    return ids, begin, raw, np.cumsum(change[:-1]) > 0


def answered_blocks(docs: DataFrame, block_bytes: int, hot: int, answer) -> tuple[DataFrame, int, DataFrame]:
    """Blocks with the anchors' and the texts' answers, the number of buckets, and the blocks."""
    blocks = make_blocks(docs, block_bytes)
    buckets = max(LEAST_BUCKETS, -(-blocks.count() // BLOCKS_OF_BUCKET))
    anchors = shared_anchors(blocks, buckets, hot)
    sent = candidate_stretches(blocks, anchors, buckets)
    found = written(sent.groupBy("bucket").applyInArrow(answer, "block long, bucket int, data binary"), "answers")
    return with_answers(blocks, anchors.unionAll(found.selectExpr("block", "-1 - bucket as bucket", "data"))), buckets, blocks


_PLACES = "seed long, doc_id long, start long, left int, rest long, size long, block long, place long"


def _places(docs: DataFrame, block_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """A written table of all places of the windows at which a maximal repeat may begin, and the blocks.

    A seed names a window that different bytes stand before; left is the byte before the place (-1 at a document's start). Repeats cover the
    document from there to some byte without a gap: rest is the hash of that text and size its bytes. The text itself stays in its block, at `place`.
    """
    import xxhash

    rows, buckets, blocks = answered_blocks(docs, block_bytes, hot, _repeats_of_texts)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, heads, data, answers in zip(*batch.columns, strict=True):
                said = _first_answers(answers.as_py())
                mine = _Block(heads.as_py(), data.as_py(), buckets)
                c = _Candidates(mine, said, buckets)
                repeats: dict[int, list[tuple[int, int, int]]] = {}
                for k, part, _ in c.rows():
                    n, offset, length, number = _unpack(said[-1 - k], ["<i4", "u1", "u1", "<i8"])
                    ends = np.cumsum(n)
                    for t, a, b in zip(part.tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
                        repeats[t] = list(zip(number[a:b].tolist(), offset[a:b].tolist(), length[a:b].tolist(), strict=True))
                found = [(number, d, first + o, n) for first, d, t in zip(c.first.tolist(), c.doc.tolist(), c.number.tolist(), strict=True) for number, o, n in repeats[t]]
                if not found:
                    continue
                at, n = (np.array([x[k] for x in found], np.int64) for k in (2, 3))
                change = np.zeros(len(mine.raw) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + n, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.unique(np.concatenate([np.flatnonzero(~gone[1:] & gone[:-1]) + 1, mine.begin]))  # where covered runs end, and documents
                raw, out = memoryview(mine.raw), []
                for number, d, place in sorted({x[:3] for x in found}):
                    end = int(edge[np.searchsorted(edge, place, side="right")])
                    begin = int(mine.begin[d])
                    out.append((number, mine.ids[d], place - begin, raw[place - 1] if place > begin else -1, xxhash.xxh64_intdigest(raw[place:end]) - 2**63, end - place, block.as_py(), place))
                    if len(out) == 4096:
                        yield _place_rows(out)
                        out = []
                if out:
                    yield _place_rows(out)

    return written(rows.mapInArrow(unpack, _PLACES), "places"), blocks


def _place_rows(rows: list[tuple]) -> pa.RecordBatch:
    seed, ids, start, left, *rest = zip(*rows, strict=True)
    columns = [pa.array(seed, pa.int64()), doc_id_array(np.array(ids, np.int64)), pa.array(start, pa.int64()), pa.array(left, pa.int32()), *[pa.array(x, pa.int64()) for x in rest]]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PLACES.split(", ")])


def _looked_up(blocks: DataFrame, asks: DataFrame, find, columns: str) -> DataFrame:
    """Rows `asks` (block, place and more) with the further columns that `find` makes of a block's bytes and its rows as a table."""
    kept = [x for x in asks.columns if x != "block"]
    rows = blocks.select("block", "data").join(asks.groupBy("block").agg(F.collect_list(F.struct(*kept)).alias("asks")), "block").select("block", "data", "asks")
    types = ", ".join(f"{x} {asks.schema[x].dataType.simpleString()}" for x in kept)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, mine = plain(batch.column(1)[k].as_py()), pa.table(dict(zip(kept, batch.column(2).slice(k, 1).flatten().flatten(), strict=True)))
                for x in range(0, mine.num_rows, 4096):
                    part = mine.slice(x, 4096).combine_chunks()
                    block = pa.array([batch.column(0)[k].as_py()] * part.num_rows, pa.int64())
                    more = find(raw, part)
                    yield pa.RecordBatch.from_arrays([block, *[c.combine_chunks() for c in part.columns], *more.values()], names=["block", *kept, *more])

    return rows.mapInArrow(look, f"block long, {types}, {columns}")


def _chunk_edges() -> list[int]:
    """Where the chunks of a text begin: each has an eighth of what is before it, 64 bytes at least."""
    edges = [0]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] + max(64, edges[-1] // 8))
    return edges


_EDGES = _chunk_edges()


def _prints(raw: bytes, asked: pa.Table) -> dict[str, pa.Array]:
    """The hashes of each text's whole chunks, one after the other."""
    import xxhash

    view, out = memoryview(raw), []
    for at, size in zip(asked["place"].to_pylist(), asked["size"].to_pylist(), strict=True):
        out.append(b"".join(xxhash.xxh64_digest(view[at + a : at + b]) for a, b in takewhile(lambda e: e[1] <= size, pairwise(_EDGES))))  # noqa: B023
    return {"prints": pa.array(out, pa.binary())}


def _chunks(raw: bytes, asked: pa.Table) -> dict[str, pa.Array]:
    """The chunks at which a text and its neighbours in the order of prints differ: from the one before, and from the one after if that is another."""
    out: dict[str, list] = {"from_before": [], "from_after": []}
    for at, size, before, after in zip(*[asked[x].to_pylist() for x in ("place", "size", "before", "after")], strict=True):
        for name, c in (("from_before", before), ("from_after", None if after == before else after)):
            out[name].append(None if c is None else raw[at + min(_EDGES[c], size) : at + min(_EDGES[c + 1], size)])
    return {name: pa.array(x, pa.binary()) for name, x in out.items()}


def _bodies(raw: bytes, asked: pa.Table) -> dict[str, pa.Array]:
    return {"text": pa.array([raw[at : at + n] for at, n in zip(asked["place"].to_pylist(), asked["length"].to_pylist(), strict=True)], pa.binary())}


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two texts begin with in common."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return int(differ[0]) if len(differ) else n


_TEXT = "seed long, rest long, size long, n long, low int, high int, first long, last long, block long, place long"
_RANKED = f"{_TEXT}, rank long, before int, after int, name_before long, name_after long"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of seed and prints with a window's texts numbered; before and after: chunks in common with the neighbours, and names for what these hold.

    A row goes out when the one after it is known, so rows stream by, however many texts a window has.
    """
    import xxhash

    kept = [x.split()[0] for x in _TEXT.split(", ")]
    held, seed, prints, rank, here, name = None, None, b"", 0, None, None
    for batch in batches:
        added: tuple[list, ...] = ([], [], [], [], [])
        if held is not None:  # the last row of the batch before
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(held.columns, batch.columns, strict=True)], names=batch.schema.names)
        fresh = zip(batch["seed"].to_pylist()[held is not None :], batch["prints"].to_pylist()[held is not None :], strict=True)
        for s, x in fresh:
            if s == seed:
                c = _common(prints, x) // 8
                after = (c, xxhash.xxh64_intdigest(x[: 8 * c]) - 2**63)
            else:
                after = (None, None)
            if seed is not None:
                for column, value in zip(added, (rank, here, after[0], name, after[1]), strict=True):
                    column.append(value)
            rank, seed, prints, (here, name) = rank + 1 if s == seed else 0, s, x, after
        if batch.num_rows:
            yield _numbered(batch.slice(0, batch.num_rows - 1).select(kept), added)
            held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield _numbered(held.select(kept), ([rank], [here], [None], [name], [None]))


def _numbered(rows: pa.RecordBatch, added: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(x, kind) for x, kind in zip(added, kinds, strict=True)]], names=[x.split()[0] for x in _RANKED.split(", ")])


def _in_order(found: dict[str, list]) -> tuple[list[int], list[int], list[int]]:
    """An order of the texts in which those with a common beginning stand together; the bytes in common with the one before, and a name for these bytes.

    Texts that share chunks stand together already. Where ranges of them part, the chunks at which they do give their order.
    """
    import xxhash

    n = len(found["rank"])
    shared = np.array([-1, *found["before"][1:]], np.int64)
    order, common, names = [], [], []
    todo = [(0, n, 0, 0)]
    while todo:
        a, b, length, name = todo.pop()
        if b - a == 1:
            order.append(a)
            common.append(length)
            names.append(name)
            continue
        c = int(shared[a + 1 : b].min())
        cuts = [a, *(a + 1 + np.flatnonzero(shared[a + 1 : b] == c)).tolist(), b]
        ranges = []
        for x, y in pairwise(cuts):
            k, side = (x, "before") if x > a else (y - 1, "after")
            chunk = found["from_before"][k] if side == "before" or found["before"][k] == c else found["from_after"][k]
            ranges.append((chunk, x, y))
        ranges.sort()
        prefix = found["name_before"][cuts[1]]
        parts = [(*ranges[0][1:], length, name)]
        for (u, *_), (v, x, y) in pairwise(ranges):
            m = _common(u, v)
            parts.append((x, y, _EDGES[c] + m, xxhash.xxh64_intdigest(v[:m], prefix & (2**64 - 1)) - 2**63))
        todo += reversed(parts)
    return order, common, names


_MAXIMAL = "seed long, rest long, lengths array<long>, repeat_ids array<long>, own int, block long, place long"
#: Repeats, over the texts of a batch, that leave Python at once.
_LISTED = 100_000


def _nodes(common: list[int], names: list[int], sides: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, length, name) of the common-prefix intervals of `LENGTH` or more that stand behind different bytes (or a document's start) in several documents; sides are the least and greatest byte before each text and doc_id of it."""
    stack: list[tuple[int, int, int, tuple[int, int, int, int]]] = []
    for k in range(1, len(common) + 1):
        here = common[k] if k < len(common) else 0
        here = here if here >= LENGTH else 0
        first, seen = k - 1, sides[k - 1]
        while stack and stack[-1][0] >= here:
            length, first, name, side = stack.pop()
            seen = (min(side[0], seen[0]), max(side[1], seen[1]), min(side[2], seen[2]), max(side[3], seen[3]))
            if length == here:
                stack.append((length, first, name, seen))
                break
            if _maximal_left(seen):
                yield first, k - 1, length, name
        else:
            if here:
                stack.append((here, first, names[k], seen))


def _maximal_left(side: tuple[int, int, int, int]) -> bool:
    low, high, first, last = side
    return (low < 0 or low != high) and first != last


def _of_texts(rows: dict[str, list]) -> Iterator[tuple[int, list[int], list[int], int, int, int]]:
    """rest, lengths and repeat_ids of the maximal repeats that begin with one window, for each of its different texts that has some; block and place of the text, which
    stands for the last `own` repeats of its lists: each repeat has one such text.

    The texts in order are a piece of the corpus's suffix array; their common-prefix intervals and the texts that stand several times are the
    repeats that cannot be extended to the right. Those with different bytes before them, or a document's start, are maximal.
    """
    order, common, names = _in_order(rows)
    common[0] = 0
    sides = list(zip(*([rows[x][k] for k in order] for x in ("low", "high", "first", "last")), strict=True))
    nodes = sorted(_nodes(common, names, sides), key=lambda x: (-x[0], -x[2]))  # taken from the end: by first text, outer ones first
    lengths: list[int] = []
    ids: list[int] = []
    ends: list[int] = []
    for k, row in enumerate(order):
        while ends and ends[-1] < k:
            ends.pop(), lengths.pop(), ids.pop()
        own = 0
        while nodes and nodes[-1][0] == k:
            _, end, length, name = nodes.pop()
            ends.append(end), lengths.append(length), ids.append(name)
            own += 1
        size, rest = rows["size"][row], rows["rest"][row]
        if rows["n"][row] > 1 and _maximal_left(sides[k]) and size not in (common[k], common[k + 1] if k + 1 < len(order) else 0):
            yield rest, [*lengths, size], [*ids, rest], own + 1, rows["block"][row], rows["place"][row]
        elif lengths:
            yield rest, lengths[:], ids[:], own, rows["block"][row], rows["place"][row]


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal repeats of each text, from rows in order of seed and rank. One window's texts are held at a time, and a batch of its repeats."""
    out: list[tuple] = []
    listed = 0

    def packed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _MAXIMAL.split(", ")])

    for seed, rows in _by_seed(batches):
        for found in _of_texts(rows):
            out.append((seed, *found))
            listed += len(found[1])
            if listed >= _LISTED:
                yield packed()
                out, listed = [], 0
    if out:
        yield packed()


def _by_seed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Each seed with its rows, column by column, from batches in which the rows of one stand together."""
    seed, held = None, None
    for batch in batches:
        columns = batch.to_pydict()
        seeds = np.array(columns.pop("seed"), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(seeds)) + 1).tolist(), len(seeds)] if len(seeds) else []
        for a, b in pairwise(cuts):
            mine = {x: values[a:b] for x, values in columns.items()}
            if held is not None and seeds[a] == seed:
                for x, values in mine.items():
                    held[x] += values
                continue
            if held is not None:
                yield seed, held
            seed, held = int(seeds[a]), mine
    if held is not None:
        yield seed, held


def maximal_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT, bodies: bool = True) -> DataFrame:
    """repeat_id, doc_id, start, length and with `bodies` text: every occurrence (in bytes) of each repeat of `LENGTH` bytes or more, of several documents, that can be extended neither to the left nor to the right.

    Such a repeat begins with a window that different bytes stand before. All places of those windows are gathered, each with the
    hash of the text that follows as far as repeats cover it. Of windows with different such texts one text each is compared by hashes of its chunks, and
    only the chunks at which texts part are fetched from the blocks: a long copy is full of windows, so whole texts would be its size squared.
    A stack scan of their common prefixes gives all its repeats with all occurrences, also those of which every part occurs elsewhere, too.
    """
    places, blocks = _places(docs, block_bytes, hot)
    id_ = F.coalesce("doc_id", F.lit(-(2**63)))
    any_ = F.min_by(F.struct("block", "place"), F.xxhash64("block", "place"))
    texts = places.groupBy("seed", "rest").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.min("left").alias("low"), F.max("left").alias("high"), F.min(id_).alias("first"), F.max(id_).alias("last"), any_.alias("at"))
    texts = texts.withColumn("texts", F.count("*").over(Window.partitionBy("seed"))).select(*[x.split()[0] for x in _TEXT.split(", ")[:-2]], "at.block", "at.place", "texts")
    texts = written(texts, "texts")
    prints = _looked_up(blocks, texts.where("texts > 1").drop("texts"), _prints, "prints binary").select(*[x.split()[0] for x in _TEXT.split(", ")], "prints")
    # windows are many and mostly small: a task streams past all of its own, as a call for each would take most of the time
    ranked = written(prints.repartition("seed").sortWithinPartitions("seed", "prints").mapInArrow(_ranked, _RANKED), "ranked")
    parted = _looked_up(blocks, ranked, _chunks, "from_before binary, from_after binary")
    found = parted.repartition("seed").sortWithinPartitions("seed", "rank").mapInArrow(_maximal, _MAXIMAL)
    alone = texts.where("texts = 1 and n > 1 and (low < 0 or low <> high) and first <> last").selectExpr("seed", "rest", "array(size) as lengths", "array(rest) as repeat_ids", "1 as own", "block", "place")
    found = written(found.unionByName(alone), "maximal")
    for done in (texts, ranked):
        drop_written(done)
    # the repeats of a text become rows after the join, which then moves each text once
    rows = places.select("seed", "rest", "doc_id", "start").join(found.select("seed", "rest", "lengths", "repeat_ids"), ["seed", "rest"])
    rows = rows.select("doc_id", "start", F.inline(F.arrays_zip("repeat_ids", "lengths")).alias("repeat_id", "length")).select("repeat_id", "doc_id", "start", "length")
    if not bodies:
        return rows
    mine = F.expr("inline(slice(arrays_zip(repeat_ids, lengths), -own, own))").alias("repeat_id", "length")
    text = _looked_up(blocks, found.where("own > 0").select("block", "place", mine), _bodies, "text binary").select("repeat_id", "text")
    return rows.join(text, "repeat_id").select("repeat_id", "doc_id", "start", "length", "text")


def drop_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary: the bytes that stay) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    rows, buckets, _ = answered_blocks(docs, block_bytes, hot, _first_documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, heads, data, answers in zip(*batch.columns, strict=True):
                ids, begin, raw, gone = _covered(heads.as_py(), data.as_py(), answers.as_py(), buckets)
                bytes_, out = np.frombuffer(raw, np.uint8), []
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    mask = gone[a:b]
                    n = int(np.count_nonzero(mask))
                    kept = raw[a:b] if not n else bytes_[a:b][~mask].tobytes()
                    spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if n else 0
                    out.append((b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([doc_id_array(ids), *[pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeat_spans(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, start, end (bytes) of each maximal covered span."""

    rows, buckets, _ = answered_blocks(docs, block_bytes, hot, _first_documents)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, heads, data, answers in zip(*batch.columns, strict=True):
                ids, begin, _, gone = _covered(heads.as_py(), data.as_py(), answers.as_py(), buckets)
                first = np.zeros(len(gone) + 1, bool)
                first[begin] = True
                starts = np.flatnonzero(gone & (first[:-1] | ~np.concatenate([[False], gone[:-1]])))
                ends = np.flatnonzero(gone & (first[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
                doc = np.searchsorted(begin, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays([doc_id_array(ids[doc]), pa.array(starts - begin[doc]), pa.array(ends - begin[doc])], names=["doc_id", "start", "end"])

    return rows.mapInArrow(spans, "doc_id long, start long, end long")
