"""Ids of words by a public tokenizer.

The tokenizer file `word_bpe_49k.json` normalises by NFC, white space and lower
case and then splits at white space, so ASCII white space always ends a token:
the ids of a text are the ids of its words one after the other. Arrow cuts the texts
and numbers their different words; the tokenizers library encodes each of these
once a chunk of texts, and numpy puts the ids in the order of the texts. Nothing is kept
from one chunk to the next, so a Python worker holds the tokenizer and one chunk.

Most words are letters and then punctuation. The file's pre-tokenizer cuts these
in two, and NFC and lower case change the letters A-Z and those of Latin-1 as Arrow does; so their different parts go
to the library's BPE model without normaliser, lower-cased, with bytes as the byte-level characters and
many in one string: the last token of each part has the model's suffix for the end of a word.
All other words go through the whole tokenizer.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text at which a chunk is closed. A longer text is a chunk of its own.
CHUNK_BYTES = 4_000_000
#: Parts of words that are sent to the model in one string.
PARTS_AT_ONCE = 4096
#: The id that ends a document.
END_ID = 1
END = np.array([END_ID], "<u4").tobytes()
#: Letters of ASCII and Latin-1, then ASCII punctuation without the apostrophe.
_PLAIN = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[!-&(-/:-@\[-`{-~]*)\z"


def default_tokenizer() -> str:
    """Place of the tokenizer file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """Characters that stand for bytes: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of chunks of `texts` that hold about `chunk_bytes`."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, done + chunk_bytes, side="right")))
        yield at, end - at
        at, done = end, int(ends[end - 1])


def _runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `start`, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return flat[at]


class WordEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        suffix, vocabulary = said["model"].get("end_of_word_suffix"), said["model"]["vocab"]
        characters = byte_characters()
        self.two_parts = (
            steps == ["NFC", "Replace", "Lowercase"] and said["model"]["type"] == "BPE" and not said["model"]["ignore_merges"]
            and bool(suffix) and all(x + end in vocabulary for x in characters.values() for end in ("", suffix))
        )
        if self.two_parts:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            #: Whether a token ends a part. A space is the border of parts.
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True
            self.table = {b: x for b, x in characters.items() if b != 0x20}

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts of words, one after the other, and the size of each; an empty part has none."""
        full = pc.greater(pc.binary_length(parts), 0)
        plain = pc.string_is_ascii(parts)
        flat, sizes = [np.zeros(0, np.int64)], np.zeros(len(parts), np.int64)
        starts = np.zeros(len(parts), np.int64)
        done = 0
        for ascii_, mask in ((True, pc.and_(full, plain)), (False, pc.and_(full, pc.invert(plain)))):
            places = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if not len(places):
                continue
            edges = np.unique(np.append(np.arange(0, len(places), PARTS_AT_ONCE), len(places)))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts.take(pa.array(places))), " ").to_pylist()
            if not ascii_:
                joined = [x.encode().decode("latin-1").translate(self.table) for x in joined]
            ids = np.concatenate([np.array(x.ids, np.int64) for x in self.model.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            sizes[places] = np.diff(ends, prepend=0)
            starts[places] = done + ends - sizes[places]
            flat.append(ids)
            done += len(ids)
        return np.concatenate(flat), starts, sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where in them each of some different words begins and how many it has."""
        n = len(words)
        cut = pc.extract_regex(words, _PLAIN) if self.two_parts else pa.nulls(n, pa.struct({"letters": pa.string(), "rest": pa.string()}))
        plain, other = np.flatnonzero(pc.is_valid(cut).to_numpy(zero_copy_only=False)), np.flatnonzero(pc.is_null(cut).to_numpy(zero_copy_only=False))
        start, size, flat = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        if len(plain):
            cut = cut.take(pa.array(plain))
            parts = pa.concat_arrays([pc.utf8_lower(pc.struct_field(cut, "letters")), pc.struct_field(cut, "rest")]).dictionary_encode()
            ids, at, many = self._parts(parts.dictionary)
            two = parts.indices.to_numpy().reshape(2, -1).T
            size[plain] = many[two].sum(1)
            flat.append(_runs(ids, at[two].ravel(), many[two].ravel()))
            start[plain] = np.cumsum(size[plain]) - size[plain]
        if len(other):
            found = [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(words.take(pa.array(other)).to_pylist(), add_special_tokens=False)]
            size[other] = [len(x) for x in found]
            start[other] = sum(map(len, flat)) + np.cumsum(size[other]) - size[other]
            flat += found
        return np.concatenate([*flat, [END_ID]]), start, size

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text with the end id; a null text counts as empty. Different words are encoded once a call, so calls should have many texts (:func:`chunks`)."""
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        coded = split.flatten().dictionary_encode()
        flat, start, size = self._words(coded.dictionary)
        # the end of a document is one more word
        start, size = np.append(start, len(flat) - 1), np.append(size, 1)
        n = pc.list_value_length(split).to_numpy().astype(np.int64)
        words = np.insert(coded.indices.to_numpy(), np.cumsum(n), len(start) - 1)
        ids = _runs(flat.astype("<u4"), start[words], size[words]).tobytes()
        first = np.cumsum(n + 1) - (n + 1)
        ends = 4 * np.cumsum(np.add.reduceat(size[words], first))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    return WordEncoder(path)
