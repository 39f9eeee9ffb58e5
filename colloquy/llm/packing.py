"""Best-fit packing into sequences of bounded length, online and in bounded space.

Each task packs the pieces of its own rows as they come: a piece goes to the open sequence with the least free space that
still takes it, found in a bitset keyed by free space. A fixed number of sequences is open; when one more is
needed, the fullest closes first. Pieces pass a buffer of ``AHEAD``, which is emptied longest first, so that short ones
find the gaps; it is the same for every caller and every size of input. Nothing is shuffled, so a repeated task packs
the same rows alike, and a task holds no more than its open sequences and its buffer.

Defined results: null and empty texts are one piece that holds the end token alone; documents
longer than a sequence are cut so that only the first piece is short; repeated rows are packed each; of pieces of equal length the
earlier is placed first, of sequences with equal free space the one that got it last takes the piece, and closes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common, vocab

CAPACITY = 1024
END = 2
#: Open sequences, and pieces of the buffer, of a task.
OPEN, AHEAD = 512, 1024


class OpenBins:
    """Open sequences by free space: bit f of ``bits`` is set while a sequence with f free places is open."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.bits, self.open, self.closed = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to ``capacity`` tokens."""
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, bin_ = self.capacity, self.next
            self.next += 1
        if left := free - length:
            self.at[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: only the first may be short."""
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def pack(documents: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, ahead: int = AHEAD, vocabulary_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document with their places; with ``keep_ids`` also their token ids."""
    shared = documents.sparkSession.sparkContext.broadcast(vocab.vocabulary("byte_bpe_50k.json", vocabulary_path))
    end = np.array([END], "<u4").tobytes()

    def make():
        encode = vocab.kept(vocab.Encoder, shared.value)
        bins = OpenBins(capacity, most_open, TaskContext.get().partitionId() << 40)
        waiting: list[tuple] = []

        def placed() -> list[list]:
            waiting.sort(key=lambda row: -row[3])
            columns = list(map(list, zip(*((*row[:5], *bins.place(row[3])) for row in waiting), strict=True)))
            if keep_ids and waiting:
                ends = np.cumsum([0, *(row[3] for row in waiting)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(row[5] for row in waiting), "<i4")))
            waiting.clear()
            return columns

        def run(c):
            out = []
            for doc_id, text in zip(*c, strict=True):
                ids, start = encode(text) + end, 0
                for piece, n in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    waiting.append((doc_id, piece, start, n, zlib.crc32(own), own if keep_ids else b""))
                    start += n
                if len(waiting) >= ahead:
                    out.append(placed())
            if len(out) < 2:
                return out[0] if out else []
            return [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else [v for part in x for v in part] for x in zip(*out, strict=True)]

        return run, placed

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return common.map_rows(documents.select("doc_id", F.col("text").cast("string").alias("text")), make, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
