"""Byte-level BPE over a corpus.

A text is cut into words by the vocabulary's own pattern. The symbols of a word, its bytes at
first, form a doubly linked list; a priority queue holds the merge rank of each neighbouring
pair, the leftmost first among equals. The pair taken from the queue is merged and its new
neighbours are queued; an entry whose symbols have changed since is stale and is skipped.
Decoding concatenates the strings of the vocabulary.

Words repeat, so each worker remembers the ids of at most ``REMEMBERED`` words and starts over
when that is full; longer words than ``LONGEST`` bytes aren't remembered.

Special tokens that stand in a text are ordinary text. A null or empty text has no ids: its
list is empty.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

REMEMBERED, LONGEST = 1 << 19, 64
#: Where the vocabulary files are, unless a path is given.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Fixed value: the pattern that cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII, likelier words first: no word that begins with a letter, a digit or one blank before them begins like a contraction.
ASCII_PATTERN = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = itertools.count(256)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids and merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        as_byte = {c: b for b, c in enumerate(byte_letters())}
        spell = lambda token: bytes(as_byte[c] for c in token)
        ids = {}
        for token, i in model["vocab"].items():
            if all(c in as_byte for c in token):
                ids[spell(token)] = i
        self.strings = {i: b for b, i in ids.items()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        #: left id << 32 | right id -> rank; the symbol that a rank makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = (spell(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)
            self.made.append(ids[a + b])

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word: merges by rank from a priority queue over a linked list of symbols."""
        of_byte, rank_of, made = self.of_byte, self.ranks.get, self.made
        symbols = [of_byte[b] for b in word]
        n = len(symbols)
        # an entry of the queue is rank << 32 | place of the left symbol
        queue = [r << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a << 32 | b)) is not None]
        if not queue:
            return symbols
        heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            # stale: a symbol of the pair is gone or has become another
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != entry >> 32:
                continue
            symbols[i] = new = made[entry >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | symbols[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << 32 | new)) is not None:
                heappush(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 come out as U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Ids by word, as bytes of 32-bit integers; a word that is missing is encoded."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        ids = array("i", self.vocabulary.encode_word(raw)).tobytes()
        if len(raw) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


_UNICODE, _ASCII = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
#: A line break after something visible begins a word, whatever stands before; so a text may be cut there.
_CUT = re.compile(r"(?<=[^\s])(?=\n)")


def words(text: str) -> list[str]:
    """The words of a text. Stretches of ASCII lines take the faster of the two patterns, with the same result."""
    if text.isascii():
        return _ASCII.findall(text)
    out: list[str] = []
    for plain, part in itertools.groupby(_CUT.split(text), str.isascii):
        out += (_ASCII if plain else _UNICODE).findall("".join(part))
    return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def _words_of(path: str) -> _Words:
    return _Words(vocabulary(path))


def encode(text: str | None, path: str) -> list[int]:
    """Ids of one text; none for a null or empty one."""
    return array("i", b"".join(map(_words_of(path).__getitem__, words(text)))).tolist() if text else []


def encode_texts(documents: DataFrame, path: str = f"{FOLDER}/byte_bpe_50k.json", id_column: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """``id_column, ids``: the list of ids of every text, without special tokens.

    One pass without a shuffle; the vocabulary is loaded once in each worker from ``path``,
    which every machine must have (or ``SparkContext.addFile`` may bring it by its base name).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        lookup = _words_of(here).__getitem__
        for batch in batches:
            found = [b"".join(map(lookup, words(t))) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, ids])

    d = documents.select(id_column, text)
    return d.mapInArrow(run, f"`{id_column}` {dict(d.dtypes)[id_column]}, `{ids}` array<int>")
