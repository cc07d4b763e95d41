"""Tokenizing, and best-fit packing of documents into sequences.

Packing is bounded-space online best-fit. Pieces arrive one by one; each goes into the
open bin with the least free space that still holds it, found as the lowest set bit, at
or above its length, of a bitset keyed by free space. At most `open_bins` bins are open;
when none fits and all are in use, the fullest closes first. Every input partition packs
its own documents, so texts need no exchange. The pieces of bins that are open at a
partition's end, as rows without their ids, are packed once more by the same rule, REPACK
of them to a task, so that partly filled bins do not grow with the number of partitions.

A document is its tokens and an end id. One longer than a sequence is cut into pieces of
full length, of which only the first may be shorter; pieces of full length are sequences
of their own. Null and empty texts are the end id alone. Repeated rows are packed as
often as they occur, null ids are carried. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm import kit

LENGTH = 2048
OPEN_BINS = 1024
WORDS_KEPT = 400_000
REPACK = 250_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def plane_pieces() -> re.Pattern:
    """Encoder.PIECES for texts below U+10000, with its classes written out: the plain library takes half the time."""
    plane = "".join(map(chr, range(1 << 16)))
    classes = [regex.findall(pattern, plane) for pattern in (r"\p{L}+", r"\p{N}+", r"\p{White_Space}+")]
    letter, digit, space = ("".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in found) for found in classes)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


class Encoder:
    """The tokenizers library with a memory of words.

    A byte-level vocabulary encodes each piece of its splitting pattern by itself, so the
    library is asked once per distinct piece and a text's ids are looked up. Texts that
    hold a special token's string go to the library whole. The memory keeps the words
    used since it last had WORDS_KEPT, and those of the turn before.
    """

    #: Fixed value: the splitting pattern of byte-level vocabularies; and the same for ASCII texts.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
    ASCII_PIECES = re.compile(r" ?[a-zA-Z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sa-zA-Z0-9]+|\s+(?!\S)|\s+", re.ASCII)

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more edge at the end)."""
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        known = self.known.__getitem__
        ids = []
        for t in texts:
            if not t:
                ids.append(b"")
            elif any(s in t for s in self.special):
                ids.append(self.whole(t).tobytes())
            else:
                pieces = (self.ASCII_PIECES if t.isascii() else plane_pieces() if t.__sizeof__() < 4 * len(t) else self.PIECES).findall(t)  # strings with others take four bytes each
                try:
                    ids.append(b"".join(map(known, pieces)))
                except KeyError:
                    self.learn(set(pieces).difference(self.known))
                    ids.append(b"".join(map(known, pieces)))
        edges = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids])]).astype(np.int64)
        return np.frombuffer(b"".join(ids), np.uint32), edges

    def learn(self, words: set[str]) -> None:
        new = []
        for word in words:
            if (was := self.older.get(word)) is not None:
                self.known[word] = was
            else:
                new.append(word)
        for lo in range(0, len(new), 10_000):
            part = new[lo : lo + 10_000]
            for word, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = array("I", got.ids).tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(column: pa.Array, path: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, edges) by runs of documents of about `most` bytes."""
    for lo, hi, _, _ in kit.text_chunks(column, most):
        yield lo, hi, *encoder(path)(column.slice(lo, hi - lo).to_pylist())


class Packer:
    """Places lengths of 1 to `length` into numbered bins."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.most = length, open_bins
        self.free = 0  # bit f is set if an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0
        self.closed: list[int] = []  # bins that take no more, until the caller clears it

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of n tokens."""
        fits = self.free >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            bin_ = self.bins[space].pop()
            if not self.bins[space]:
                self.free &= ~(1 << space)
            self.open -= 1
        else:
            if self.open == self.most and n < self.length:
                fullest = (self.free & -self.free).bit_length() - 1
                self.closed.append(self.bins[fullest].pop())
                if not self.bins[fullest]:
                    self.free &= ~(1 << fullest)
                self.open -= 1
            space, bin_ = self.length, self.made
            self.made += 1
        left = space - n
        if left:
            self.bins[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        else:
            self.closed.append(bin_)
        return bin_, self.length - space


def cuts(n: int, length: int) -> list[int]:
    """Piece lengths of a document of n ids."""
    return ([n % length] if n % length else []) + [length] * (n // length)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """A packer that keeps the rows of its open bins until they close."""

    def __init__(self, length: int, open_bins: int, high: int) -> None:
        self.packer, self.high = Packer(length, open_bins), high
        self.held: dict[int, list[tuple]] = {}

    def place(self, row: tuple) -> list[tuple]:
        """Places a row (its length is the fourth value); the rows of bins that closed, with sequence_id and offset."""
        bin_, offset = self.packer.place(row[3])
        self.held.setdefault(bin_, []).append((*row, self.high | bin_, offset))
        done = [x for b in self.packer.closed for x in self.held.pop(b)]
        self.packer.closed.clear()
        return done

    def rest(self) -> list[tuple]:
        rows, self.held = [x for b in self.held.values() for x in b], {}
        return rows


def _batch(rows: list[tuple], open_: bool | None = None) -> pa.RecordBatch:
    names = [x.split()[0] for x in PACKED.split(", ")]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)]
    return pa.RecordBatch.from_arrays(cols, names) if open_ is None else pa.RecordBatch.from_arrays([*cols, pa.array([open_] * len(rows), pa.bool_())], [*names, "open"])


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece; sequence_id is the turn (bit 60) and the partition's number in the high bits, then the bin's."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(length, open_bins, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], np.uint32)
        for b in batches:
            names = b.column(0).to_pylist()
            rows = []
            for lo, hi, ids, edges in encoded(b.column(1), path):
                for i in range(hi - lo):
                    own = np.append(ids[edges[i] : edges[i + 1]], end)
                    start = 0
                    for k, n in enumerate(cuts(len(own), length)):
                        rows += bins.place((names[lo + i], k, start, n, zlib.crc32(own[start : start + n].tobytes())))
                        start += n
            yield _batch(rows, False)
        yield _batch(bins.rest(), True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(length, open_bins, 1 << 60 | TaskContext.get().partitionId() << 36)
        for b in batches:
            yield _batch([x for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in bins.place(row)])
        yield _batch(bins.rest())

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = kit.stored(own.mapInArrow(run, f"{PACKED}, open boolean"), "packed")
    left = first.filter("open").select("doc_id", "piece", "start", "length", "ids_crc32")
    parts = 1 + left.count() // REPACK
    return first.filter("not open").drop("open").union(left.coalesce(parts).mapInArrow(again, PACKED))
