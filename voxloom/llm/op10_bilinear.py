"""Language-model scores: word counts and a log-bilinear model trained by noise contrast.

Counts of all words of the training documents are summed in hash buckets and sent
back to the blocks that hold the words. They give the base score (add-one unigram).

The model is a tree of log-bilinear choices, each normalised over its own few outcomes, so that the
probabilities of all words sum to one at a cost that hardly grows with the vocabulary:

* P(class | a, b): the `TOP` most frequent words and the end are classes of their own, the others are in one of `TAIL`
  classes by their last two bytes and a hash. score(class | a, b) = (u * R[a] + v * S[b]) . Q[class] + bias[class] = h . Q[class] +
  bias[class], a and b being the classes of the two words before, R, S, Q vectors and u, v weights of the two places.
* P(group | class, h): a tail class has `GROUPS` groups of words by hash, each with a vector and a bias.
* P(word | group, h): every word that is at least `LEAST_SHARE` of all tokens (and occurs `LEAST_COUNT` times) has a vector
  and a bias of its own. Their number grows with the corpus and is below 1 / `LEAST_SHARE`, which bounds what tasks
  hold. The words of a group that are rarer share one vector and go by add-one counts among themselves.

Classes are trained on all training trigrams of a block, weighted by how often they occur, against shared noise classes
drawn from the class frequencies; the blocks' parameters are averaged by their numbers of tokens, for `ROUNDS` rounds. Groups and words are
trained in the last round with h as the round before has left it, by the noise-contrastive loss in which a choice's few outcomes
all stand for the noise with their expected number (no draw is needed), and averaged by each choice's tokens.

Defined cases: a null or empty text is one end token; without training documents the base
score is zero a token and the model's score equals it; rows that repeat a doc_id are each
counted and scored; a null doc_id (or the least long) is a training document without an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.blocks import NULL_ID, doc_id_array, lower_words, make_blocks, plain, press, with_answers
from voxloom.llm.shared import drop_written, written

TOP, TAIL, GROUPS = 255, 256, 16
#: The end token has the class after the top words; tail classes follow.
END = TOP
CLASSES = TOP + 1 + TAIL
DIM, NOISE, BATCH, RATE, EPOCHS, ROUNDS = 24, 64, 2048, 0.08, 1, 2
#: Which words have parameters of their own: their part of all training tokens, and their least count.
LEAST_SHARE, LEAST_COUNT = 1e-6, 5
#: Steps over a choice's tokens, their rate, and noise outcomes for each token.
STEPS, STEP_RATE, NOISE_OF_CHOICE = 4, 0.2, 4
#: Tokens of a choice that are worked on at once.
ROWS = 2048
#: The end's place among the words; no word holds a space.
END_WORD = b" "
LOG10 = float(np.log(10))


def is_held_out(doc_id: int) -> bool:
    """crc32 of the doc_id as text, mod 7, is 2."""
    return doc_id != NULL_ID and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tail_groups(words: list[bytes], hashes: np.ndarray | None = None) -> np.ndarray:
    """Each word's group among the `TAIL * GROUPS` of all tail classes: the class goes by the last two bytes, for a fourth by the whole word, as some endings are very common."""
    whole = word_hashes(words) if hashes is None else hashes
    end = np.fromiter((zlib.crc32(w[-2:]) for w in words), np.int64, len(words))
    return (end % (TAIL // 4) * 4 + whole // GROUPS % 4) * GROUPS + whole % GROUPS


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


#: Columns of a block: doc_ids, held-out flags, words of each document, the different words in order of appearance, how
#: often each is in training documents, and the number of each word of the documents.
BLOCK = "ids binary, held binary, sizes binary, words binary, counts binary, text binary"


def pack_words(ids: list[int], texts: list[bytes]) -> tuple[bytes, ...]:
    """The columns `BLOCK` of some documents; words are lower-cased (A-Z only, as these are bytes)."""
    held = np.array([is_held_out(x) for x in ids], bool)
    different, place, sizes = lower_words(texts)
    counts = np.bincount(place[np.repeat(~held, sizes)], minlength=len(different))
    arrays = (np.array(ids, "<i8").tobytes(), held.tobytes(), sizes.astype("<i8").tobytes(), b" ".join(different), counts.astype("<u4").tobytes(), planes(place))
    return tuple(map(press, arrays))


def _words(data: bytes) -> list[bytes]:
    return data.split(b" ") if data else []


def _dealt(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, their order by bucket, and where each bucket begins in it (and the end)."""
    hashes = word_hashes(words)
    bucket = hashes // (TAIL * GROUPS) % buckets
    order = np.argsort(bucket, kind="stable")
    return hashes, order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """A written table of kind, block, bucket, n, data, words, counts.

    kind 0: answers, a block's words' counts in its order; 1: a bucket's number of
    different training words and of tokens in each tail group (n: all tokens), and in words and counts its words that
    occur `LEAST_COUNT` times.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*batch.columns, strict=True):
                words, counts = _words(plain(words.as_py())), np.frombuffer(plain(counts.as_py()), "<u4")
                _, order, edges = _dealt(words, buckets)
                rows = []
                for k, (a, b) in enumerate(pairwise(edges.tolist())):
                    if a < b:
                        part = order[a:b]
                        rows.append((block.as_py(), k, press(b" ".join([words[x] for x in part.tolist()])), press(counts[part].tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "words", "counts"])

    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])

    def answer(key: tuple, found: pa.Table) -> pa.Table:
        bucket, index, asks, sent = key[0].as_py(), {}, [], []
        for block, words, counts in zip(found["block"], found["words"], found["counts"], strict=True):
            asks.append((block.as_py(), np.array([index.setdefault(w, len(index)) for w in plain(words.as_py()).split(b" ")], np.int64)))
            sent.append(np.frombuffer(plain(counts.as_py()), "<u4"))
        total = np.bincount(np.concatenate([x for _, x in asks]), np.concatenate(sent), len(index)).astype(np.int64)
        rows = [(0, block, bucket, None, press(total[mine].astype("<i8").tobytes()), None, None) for block, mine in asks]
        words = list(index)
        known = np.flatnonzero(total)
        groups = tail_groups([words[k] for k in known.tolist()])
        sums = np.stack([np.bincount(groups, minlength=TAIL * GROUPS), np.bincount(groups, total[known], TAIL * GROUPS).astype(np.int64)])
        often = np.flatnonzero(total >= LEAST_COUNT)
        rows.append((1, -1, bucket, int(total.sum()), press(sums.astype("<i8").tobytes()), press(b" ".join([words[k] for k in often.tolist()])), press(total[often].astype("<i8").tobytes())))
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = blocks.select("block", "words", "counts").mapInArrow(ask, "block long, bucket int, words binary, counts binary")
    return written(rows.groupBy("bucket").applyInArrow(answer, "kind int, block long, bucket int, n long, data binary, words binary, counts binary"), "counts")


@dataclass
class Corpus:
    """What all documents say: training documents, tokens (with ends), different words (with the end), the words with parameters of
    their own (most frequent first) and their counts, and the tail groups' different words and tokens beyond these.

    A token's code is its class if that is a top word or the end. Other codes are places: each tail group has one place
    for its rare words and then one for each word of its own, group after group.
    """

    documents: int
    tokens: int
    words: int
    own: list[bytes]
    own_counts: np.ndarray
    rare_words: np.ndarray
    rare_tokens: np.ndarray

    def __post_init__(self) -> None:
        late = self.own[TOP:]
        group = tail_groups(late)
        order = np.argsort(group, kind="stable")
        self.size = np.bincount(group, minlength=TAIL * GROUPS) + 1
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        place = np.empty(len(late), np.int64)
        place[order] = np.arange(len(late)) + group[order] + 1
        #: Code of each own word, the group of each place, and each place's training tokens.
        self.codes = np.concatenate([np.arange(min(TOP, len(self.own))), END + 1 + place])
        self.group = np.repeat(np.arange(TAIL * GROUPS), self.size)
        self.place_tokens = np.zeros(len(self.group))
        self.place_tokens[self.begin[:-1]] = self.rare_tokens
        self.place_tokens[place] = self.own_counts[TOP:]

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Class of each code."""
        table = np.concatenate([np.arange(END + 1), END + 1 + self.group // GROUPS]).astype(np.int64)
        return table[codes]

    def group_tokens(self) -> np.ndarray:
        return np.add.reduceat(self.place_tokens, self.begin[:-1])

    def class_counts(self) -> np.ndarray:
        out = np.zeros(CLASSES)
        out[: len(self.own_counts[:TOP])] = self.own_counts[:TOP]
        out[END] = self.documents
        out[END + 1 :] = self.group_tokens().reshape(TAIL, GROUPS).sum(1)
        return out


def corpus_of(docs: DataFrame, counted: DataFrame) -> Corpus:
    """Sum up the table of :func:`word_counts`. The driver gets the tail groups' sums and fewer than 1 / `LEAST_SHARE` words."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, TAIL * GROUPS), np.int64)
            for x in batch.column(0):
                sums += np.frombuffer(plain(x.as_py()), "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL * GROUPS)), pa.array(sums[0]), pa.array(sums[1])], names=["k", "words", "tokens"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    documents = docs.where(~held).count()
    buckets = counted.where("kind = 1")
    tails = buckets.select("data").mapInArrow(unpack, "k long, words long, tokens long").groupBy("k").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).toArrow()
    words, tokens = np.zeros(TAIL * GROUPS, np.int64), np.zeros(TAIL * GROUPS, np.int64)
    words[tails["k"].to_numpy()], tokens[tails["k"].to_numpy()] = tails["words"].to_numpy(), tails["tokens"].to_numpy()
    n_words, n_tokens = int(words.sum()), int(tokens.sum())
    least = max(LEAST_COUNT, int(np.ceil(n_tokens * LEAST_SHARE)))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, counts in zip(*batch.columns, strict=True):
                counts = np.frombuffer(plain(counts.as_py()), "<i8")
                chosen = np.flatnonzero(counts >= least)
                if len(chosen):
                    found = plain(found.as_py()).split(b" ")
                    yield pa.RecordBatch.from_arrays([pa.array([found[k] for k in chosen.tolist()], pa.binary()), pa.array(counts[chosen])], names=["word", "n"])

    best = buckets.select("words", "counts").mapInArrow(often, "word binary, n long").toArrow()
    pairs = sorted(zip(best["word"].to_pylist(), best["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    own, counts = [w for w, _ in pairs], np.array([n for _, n in pairs], np.int64)
    group = tail_groups(own)
    np.subtract.at(words, group, 1)  # a word of its own is not among its group's rare ones
    np.subtract.at(tokens, group, counts)
    return Corpus(documents, n_tokens + documents, n_words + (documents > 0), own, counts, words, tokens)


def code_documents(blocks: DataFrame, counted: DataFrame, corpus: Corpus, buckets: int) -> DataFrame:
    """A written table of block, ids, held, figures, codes: each document's id and figures, and the codes of all its words and ends."""
    log_all = np.log10(max(corpus.tokens + corpus.words + 1, 1))
    log_rare = np.log10(corpus.rare_tokens + corpus.rare_words + 1.0)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = dict(zip(corpus.own, corpus.codes.tolist(), strict=True))
        for batch in batches:
            for block, ids, held, sizes, names, _, text, answers in zip(*batch.columns, strict=True):
                names, sizes = _words(plain(names.as_py())), np.frombuffer(plain(sizes.as_py()), "<i8")
                hashes, order, edges = _dealt(names, buckets)
                counts = np.full(len(names) + 1, float(corpus.documents))  # the last is the end
                for x in answers.as_py() or ():
                    counts[order[edges[x["bucket"]] : edges[x["bucket"] + 1]]] = np.frombuffer(plain(x["said"]), "<i8")
                log_counts = np.log10(counts + 1)
                inside = np.zeros(len(names) + 1)
                kinds = np.array([code_of.get(w, -1) for w in names] + [END], np.int64)
                late = np.flatnonzero(kinds < 0)
                groups = tail_groups([names[k] for k in late.tolist()], hashes[late])
                kinds[late] = END + 1 + corpus.begin[groups]
                inside[late] = log_counts[late] - log_rare[groups]
                # an end after each document
                n = sizes + 1
                begin = np.concatenate([[0], np.cumsum(n)])
                whole = np.full(begin[-1], len(names), np.int64)
                whole[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = unplanes(plain(text.as_py()))
                figures = np.column_stack([n, np.add.reduceat(counts[whole] > 0, begin[:-1], dtype=np.int64), np.add.reduceat(log_counts[whole], begin[:-1]) - n * log_all, np.add.reduceat(inside[whole], begin[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([ids.as_py()], pa.binary()), pa.array([held.as_py()], pa.binary()), *[pa.array([press(x)], pa.binary()) for x in (figures.astype("<f8").tobytes(), planes(kinds[whole]))]], names=["block", "ids", "held", "figures", "codes"])

    both = with_answers(blocks, counted.where("kind = 0").select("block", "bucket", "data"))
    return written(both.mapInArrow(code, "block long, ids binary, held binary, figures binary, codes binary"), "coded")


def planes(codes: np.ndarray) -> bytes:
    """Codes by byte planes, which compress better than whole integers."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def contexts(classes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before each token; before a document all is END."""
    one, two = np.empty_like(classes), np.empty_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[begin[:-1]] = END
    two[:2] = END
    two[begin[:-1]] = END
    second = begin[:-1] + 1
    two[second[second < begin[1:]]] = END
    return one, two


class Bilinear:
    """Parameters in one vector: R, S, Q, bias, u, v."""

    SIZE = 3 * CLASSES * DIM + CLASSES + 2 * DIM

    def __init__(self, theta: np.ndarray):
        a = CLASSES * DIM
        self.theta = theta
        self.R, self.S, self.Q = (theta[k * a : (k + 1) * a].reshape(CLASSES, DIM) for k in range(3))
        self.bias, self.u, self.v = theta[3 * a : 3 * a + CLASSES], theta[3 * a + CLASSES :][:DIM], theta[3 * a + CLASSES + DIM :]

    @staticmethod
    def start(class_counts: np.ndarray, seed: int = 11) -> np.ndarray:
        theta = np.random.default_rng(seed).normal(0, 0.1, Bilinear.SIZE)
        model = Bilinear(theta)
        model.bias[:] = np.log((class_counts + 0.5) / (class_counts + 0.5).sum())
        model.u[:], model.v[:] = 1, 0.5
        return theta.astype(np.float32)

    def train(self, grams: np.ndarray, weight: np.ndarray, noise: np.ndarray, seed: int) -> None:
        """Noise-contrastive steps (Adagrad) over trigrams (a, b, class), sorted by class, each `weight` times."""
        draw = np.random.default_rng(seed)
        log_noise = np.log(NOISE * noise).astype(np.float32)
        square = np.full(self.SIZE, 1.0, np.float32)
        grad, step = np.zeros(self.SIZE, np.float32), np.empty(self.SIZE, np.float32)
        g = Bilinear(grad)
        cumulated = np.cumsum(noise)
        weight = (weight / weight.mean()).astype(np.float32)
        columns = [np.ascontiguousarray(x) for x in grams.T]
        for _ in range(EPOCHS):
            # every so many-th of the trigrams, which are sorted by class, so a batch is spread over all classes
            parts = max(1, round(len(grams) / BATCH))
            for at in draw.permutation(parts).tolist():
                a, b, c = (x[at::parts] for x in columns)
                w = weight[at::parts]
                r = self.context(a, b)
                others = np.minimum(np.searchsorted(cumulated, draw.random(NOISE)), CLASSES - 1)
                qc, qo = self.Q[c], self.Q[others]
                gc = log_noise[c] - self.bias[c] - np.einsum("ij,ij->i", r, qc)
                gc = _shares(w, gc) - w
                go = r @ -qo.T
                go += log_noise[others] - self.bias[others]
                go = _shares(w[:, None], go)
                qc *= gc[:, None]
                dr = go @ qo
                dr += qc
                grad[:] = 0
                np.add.at(g.Q, others, go.T @ r)
                g.bias += np.bincount(c, gc, CLASSES).astype(np.float32)
                g.bias += np.bincount(others, go.sum(0), CLASSES).astype(np.float32)
                r *= gc[:, None]
                _scatter_sorted(g.Q, c, r)
                _scatter(g.R, a, dr)
                _scatter(g.S, b, dr)
                # the sums of dr for each class give the gradients of the weights, and times the weights those of the vectors
                g.u[:], g.v[:] = (g.R * self.R).sum(0), (g.S * self.S).sum(0)
                g.R *= self.u
                g.S *= self.v
                np.multiply(grad, grad, out=step)
                square += step
                np.sqrt(square, out=step)
                np.divide(grad, step, out=step)
                step *= RATE
                self.theta -= step

    def context(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """h of the classes one and two places before."""
        h = (self.u * self.R)[a]
        h += (self.v * self.S)[b]
        return h

    def log_probability(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(c | a, b) of each token: each different context is normalised over all classes once."""
        code = a.astype(np.int64) * CLASSES + b
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        different, which = code[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(code)))
        out = np.empty(len(code))
        edges = [*first[::4096].tolist(), len(code)]
        for k, at in enumerate(range(0, len(different), 4096)):
            part = different[at : at + 4096]
            scores = self.context(part // CLASSES, part % CLASSES) @ self.Q.T
            scores += self.bias
            mine = slice(edges[k], edges[k + 1])
            row = which[mine] - at
            said = scores[row, c[order[mine]]]
            out[order[mine]] = said - _log_sums(scores)[row]
        return out / LOG10


def _shares(weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """weight / (1 + exp(x)), written over x."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.divide(weight, x, out=x)


def _log_sums(scores: np.ndarray) -> np.ndarray:
    """log of the sum of exp(scores) in each row; `scores` is written over. Only scores whose exponentials may leave single precision are shifted first."""
    top = None
    if scores.size and max(scores.max(), -scores.min()) > 60:
        top = scores.max(1)
        scores -= top[:, None]
    np.exp(scores, out=scores)
    sums = np.log(scores @ np.ones(scores.shape[1], scores.dtype))
    return sums if top is None else sums + top


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to rows, those of one row summed up first."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # by radix
    _scatter_sorted(into, rows[order], values[order])


def _scatter_sorted(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """The same for ascending rows."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    into[rows[first]] += np.add.reduceat(values, first, axis=0)


class Choices:
    """Some choices over outcomes that lie one after the other: outcome k of choice c is at begin[c] + k. A vector and a bias for each.

    `tokens` are the outcomes' training tokens; an outcome without any keeps a little of its choice.
    """

    def __init__(self, begin: np.ndarray, tokens: np.ndarray, theta: np.ndarray | None = None):
        self.begin, size = begin, np.diff(begin)
        total = np.add.reduceat(tokens + 0.5, begin[:-1])
        self.log_noise = np.log((tokens + 0.5) / np.repeat(total, size)).astype(np.float32)
        #: Vectors, and what is added to the outcome's logarithmic share.
        self.theta = np.zeros((len(tokens), DIM + 1), np.float32) if theta is None else theta

    def _parts(self, outcome: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(choice, first and last token, first and last outcome) of outcomes in ascending order."""
        choice = np.searchsorted(self.begin, outcome, side="right") - 1
        edges = np.flatnonzero(np.diff(choice, prepend=-1))
        for at, end in zip(edges.tolist(), [*edges[1:].tolist(), len(outcome)][: len(edges)], strict=True):
            c = int(choice[at])
            yield c, at, end, int(self.begin[c]), int(self.begin[c + 1])

    def learn(self, h: np.ndarray, outcome: np.ndarray, weight: np.ndarray, sums: np.ndarray, tokens: np.ndarray) -> None:
        """Take some steps on tokens with contexts `h` (the last column one) and ascending outcomes; add each choice's parameters, times its tokens, to `sums`, and these to `tokens`."""
        log_k = np.float32(np.log(NOISE_OF_CHOICE))
        share = NOISE_OF_CHOICE * np.exp(self.log_noise)
        parts = list(self._parts(outcome))
        # memory that all choices use; tokens go by `ROWS`, which stay in the cache
        room = np.empty(max(((end - at) * (hi - lo) for _, at, end, lo, hi in parts), default=0), np.float32)
        part = np.empty(ROWS * max((hi - lo for *_, lo, hi in parts), default=0), np.float32)
        for c, at, end, lo, hi in parts:
            w, mine = weight[at:end], self.theta[lo:hi].copy()
            n, size = w.sum(), hi - lo
            tokens[c] += n
            if size > 1:
                own = room[: (end - at) * size].reshape(-1, size)
                rows = [(h[at + k : min(at + k + ROWS, end)], own[k : k + ROWS]) for k in range(0, end - at, ROWS)]
                # what each token adds to its own outcome, whatever the parameters are
                own[:] = 0
                own[np.arange(end - at), outcome[at:end] - lo] = w
                right = sum(mark.T @ x for x, mark in rows)
                own += w[:, None] * share[lo:hi]
                square = np.ones_like(mine)
                for _ in range(STEPS):
                    # times the probability that an outcome is no noise; the last column of x is one
                    minus = -mine
                    minus[:, -1] += log_k
                    grad = -right
                    for x, expected in rows:
                        g = np.matmul(x, minus.T, out=part[: expected.size].reshape(-1, size))
                        grad += _shares(expected, g).T @ x
                    square += grad * grad
                    mine -= STEP_RATE * grad / np.sqrt(square)
            sums[lo:hi] += mine * n

    def log_probability(self, h: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """log10 of each token's outcome within its choice; `h` and outcomes as in :meth:`learn`."""
        out = np.zeros(len(outcome))
        theta = self.theta.copy()
        theta[:, -1] += self.log_noise
        for _, at, end, lo, hi in self._parts(outcome):
            if hi - lo > 1:
                scores = h[at:end] @ theta[lo:hi].T
                said = scores[np.arange(end - at), outcome[at:end] - lo]
                out[at:end] = said - _log_sums(scores)
        return out / LOG10


def choices_of(corpus: Corpus, theta: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Choices, Choices]:
    """The choices of a group within its class, and of a place within its group."""
    groups = Choices(np.arange(TAIL + 1) * GROUPS, corpus.group_tokens(), theta and theta[0])
    return groups, Choices(corpus.begin, corpus.place_tokens, theta and theta[1])


def _opened(ids, held, figures, codes):
    figures = np.frombuffer(plain(figures.as_py()), "<f8").reshape(-1, 4)
    begin = np.concatenate([[0], np.cumsum(figures[:, 0].astype(np.int64))])
    return np.frombuffer(plain(ids.as_py()), "<i8"), np.frombuffer(plain(held.as_py()), bool), figures, unplanes(plain(codes.as_py())), begin


#: Kinds of parameters: of groups, of places, and of classes.
OF_GROUPS, OF_PLACES, OF_CLASSES = 0, 1, 2


@dataclass
class Model:
    """Parameters: of classes, of the contexts that groups and places see (classes one round earlier), and of groups and places."""

    classes: np.ndarray
    seen: np.ndarray
    groups: np.ndarray
    places: np.ndarray


def _by_choice(corpus: Corpus, kind: int, n: np.ndarray) -> np.ndarray:
    """The tokens of the choice that each row of parameters belongs to."""
    return n if kind == OF_CLASSES else np.repeat(n, np.diff(choices_of(corpus)[kind].begin))[:, None]


def train(coded: DataFrame, corpus: Corpus, rounds: int = ROUNDS) -> Model:
    """Parameters averaged over the blocks, which all train on all their training trigrams: classes every round, groups and places in the last one.

    What tasks send is first added up in groups of tasks, then for each kind, so the driver gets one row of each.
    """
    counts = corpus.class_counts()
    noise = (counts + 0.5) / (counts + 0.5).sum()
    theta = Bilinear.start(counts)
    parts = max(1, round(coded.rdd.getNumPartitions() ** 0.5))
    names = "g int, kind int, n binary, theta binary"

    def row(g: int, kind: int, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        mean = (total / np.maximum(_by_choice(corpus, kind, n), 1)).astype("<f4" if kind == OF_CLASSES else "<f2")
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([kind], pa.int32()), pa.array([press(n.astype("<f8").tobytes())], pa.binary()), pa.array([press(mean.tobytes())], pa.binary())], names=["g", "kind", "n", "theta"])

    def read(kind: int, n: bytes, theta: bytes) -> tuple[np.ndarray, np.ndarray]:
        theta = np.frombuffer(plain(theta), "<f4" if kind == OF_CLASSES else "<f2").astype(np.float32)
        return np.frombuffer(plain(n), "<f8"), theta if kind == OF_CLASSES else theta.reshape(-1, DIM + 1)

    def add(found: pa.Table) -> pa.Table:
        kind, total, tokens = found["kind"][0].as_py(), 0, 0
        for n, theta in zip(found["n"], found["theta"], strict=True):
            n, theta = read(kind, n.as_py(), theta.as_py())
            total, tokens = total + theta * _by_choice(corpus, kind, n), tokens + n
        return pa.Table.from_batches([row(0, kind, tokens, total)])

    seen, found = theta, {}
    for turn in range(max(rounds, 2)):
        last = turn == max(rounds, 2) - 1
        seen = theta

        def learn(batches: Iterator[pa.RecordBatch], theta=theta, turn=turn, last=last) -> Iterator[pa.RecordBatch]:
            context, choices = Bilinear(theta), choices_of(corpus) if last else ()
            sums = [np.zeros((len(x.theta), DIM + 1), np.float32) for x in choices] + [np.zeros(Bilinear.SIZE)]
            tokens = [np.zeros(len(x.begin) - 1) for x in choices] + [np.zeros(1)]
            g = 0
            for batch in batches:
                for block, *columns in zip(*batch.columns, strict=True):
                    _, held, _, codes, begin = _opened(*columns)
                    classes = corpus.classes(codes)
                    one, two = contexts(classes, begin)
                    keep = np.repeat(~held, np.diff(begin))
                    code = (classes[keep] * CLASSES + one[keep]) * CLASSES + two[keep]
                    if not len(code):
                        continue
                    g = block.as_py() % parts
                    code, weight = np.unique(code, return_counts=True)
                    model = Bilinear(theta.copy())
                    model.train(np.column_stack([code // CLASSES % CLASSES, code % CLASSES, code // CLASSES**2]), weight, noise, seed=turn * 1_000_003 + block.as_py() % 1_000_003)
                    n = float(weight.sum())
                    sums[-1] += model.theta * n
                    tokens[-1] += n
                    if last:
                        keep &= codes > END
                        code, weight = np.unique(_trigrams(codes[keep], one[keep], two[keep]), return_counts=True)
                        h, place = _late(context, code // CLASSES**2, code // CLASSES % CLASSES, code % CLASSES)
                        weight = weight.astype(np.float32)
                        for k, outcome in enumerate((corpus.group[place], place)):
                            choices[k].learn(h, outcome, weight, sums[k], tokens[k])
            if tokens[-1][0]:
                for kind, n, total in zip((OF_GROUPS, OF_PLACES, OF_CLASSES) if last else (OF_CLASSES,), tokens, sums, strict=True):
                    yield row(g, kind, n, total)

        once = coded.mapInArrow(learn, names).groupBy("kind", "g").applyInArrow(add, names)
        found = {r.kind: read(r.kind, r.n, r.theta)[1] for r in once.groupBy("kind").applyInArrow(add, names).collect()}
        theta = found.get(OF_CLASSES, theta)
    empty = [x.theta for x in choices_of(corpus)]
    return Model(theta, seen, found.get(OF_GROUPS, empty[0]), found.get(OF_PLACES, empty[1]))


def _late(context: Bilinear, code: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h (with a column of ones) and place of tokens beyond the top words and the end, by their codes and the classes before them."""
    h = np.ones((len(code), DIM + 1), np.float32)
    h[:, :DIM] = context.context(one, two)
    return h, code - END - 1


def _trigrams(codes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each token's code and the classes before it, in the order of codes."""
    return (codes * CLASSES + one) * CLASSES + two


def token_scores(corpus: Corpus, model: Model, choices: tuple[Choices, Choices], codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class and place; a rare word's part of its place comes on top."""
    one, two = contexts(corpus.classes(codes), begin)
    different, which = np.unique(_trigrams(codes, one, two), return_inverse=True)
    code, one, two = different // CLASSES**2, different // CLASSES % CLASSES, different % CLASSES
    out = Bilinear(model.classes).log_probability(one, two, corpus.classes(code))
    late = np.searchsorted(code, END, side="right")
    h, place = _late(Bilinear(model.seen), code[late:], one[late:], two[late:])
    out[late:] += choices[0].log_probability(h, corpus.group[place]) + choices[1].log_probability(h, place)
    return out[which]


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`."""
    blocks = make_blocks(docs, pack=pack_words, columns=BLOCK)
    buckets = max(1, blocks.count() // 2)
    counted = word_counts(blocks, buckets)
    corpus = corpus_of(docs, counted)
    coded = code_documents(blocks, counted, corpus, buckets)
    drop_written(blocks)
    drop_written(counted)
    model = train(coded, corpus, rounds) if corpus.documents else None
    tokens = corpus.tokens

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = model and choices_of(corpus, (model.groups, model.places))
        for batch in batches:
            for _, *parts in zip(*batch.columns, strict=True):
                ids, held, figures, codes, begin = _opened(*parts)
                base = figures[:, 2]
                said = base if model is None else np.add.reduceat(token_scores(corpus, model, choices, codes, begin), begin[:-1]) + figures[:, 3]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([doc_id_array(ids), pa.array(held), pa.array(figures[:, 0].astype(np.int64)), pa.array(figures[:, 1].astype(np.int64)), pa.array([tokens] * n, pa.int64()), pa.array(base), pa.array(said)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
