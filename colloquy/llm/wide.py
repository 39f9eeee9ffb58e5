"""SimHash of 128 bits over five-word shingles: near copies of a Jaccard similarity of about 0.8 or more.

Each shingle's XXH3 of 128 bits votes for every bit, so two texts differ in a share of bits that is the angle between their
shingle vectors over pi. Up to ``FAR`` bits is what a Jaccard similarity of 0.8 makes on average (the cosine is then 0.89, the share
0.15). Unrelated texts differ in so few bits with a chance of about 1e-16, so that no links arise by chance at any number of documents
that there is; with 64 bits and as wide an angle they would.

Candidates come from the pigeonhole twice. The bits are dealt to ``PARTS`` parts, of which one has at most
``FAR // PARTS`` differing bits; that part is cut into blocks, of which all but so many agree. Each choice of part and blocks is a key,
so no pair within ``FAR`` bits is lost. Rows of a key meet in one task, which verifies whole distances and
gives spanning stars, never all pairs; crowded keys are dealt to tiles, as in ``simhash``.

A node is the first half of a fingerprint: texts that agree in it are linked whatever the second half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import common

SHINGLE, SEED, FAR, PARTS, CROWD = 5, 42, 19, 7, 8192
#: Shingles whose votes are unpacked at once, and pairs that are compared at once.
SLICE, TILE = 65_536, 250_000


def fingerprint(text: str | None) -> tuple[int, int]:
    """Both halves, as signed 64-bit integers; zeros for a text without words. Repeated shingles vote each time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh3_128_digest, np.zeros(128, np.int64)
    for k in range(0, n, SLICE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + SLICE], ends[k : k + SLICE], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    first, second = np.packbits(2 * ones > n).view(">i8").tolist()
    return first, second


def fingerprints(documents: DataFrame, row: str) -> DataFrame:
    """doc_id, both halves of the fingerprint (fp, more) and the column of numbers ``row`` of every row."""

    def make():
        def run(c):
            halves = list(map(fingerprint, c[1]))
            return [c[0], [h[0] for h in halves], [h[1] for h in halves], c[2]]

        return run

    names = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col(row).alias("row"))
    return common.map_rows(names, make, "doc_id long, fp long, more long, row long")


def blocks_for(fingerprints: int) -> int:
    """Blocks of a part, by which few fingerprints meet by chance: 42, 70, 105 or 147 keys of 9, 11, 12 or 13 bits for each."""
    return 4 + sum(fingerprints > 1 << b for b in (20, 24, 26))


def masks(blocks: int) -> list[tuple[int, int]]:
    """Masks of both halves, signed: one for each choice of a part and of the blocks that agree in it."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out = []
    for part in np.array_split(np.arange(128), PARTS):
        cut = np.array_split(part, blocks)
        for chosen in combinations(cut, blocks - FAR // PARTS):
            mask = sum(1 << int(b) for block in chosen for b in block)
            out.append((signed(mask & (1 << 64) - 1), signed(mask >> 64)))
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of fingerprints, arrays of (..., 2)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def _with_links(values: np.ndarray) -> np.ndarray:
    """Whether each of (n, 2) fingerprints is linked with another of them. First halves alone exclude nearly all pairs."""
    n, linked = len(values), np.zeros(len(values), bool)
    first = np.ascontiguousarray(values[:, 0])
    k = 0
    while k < n:
        step = max(1, TILE // (n - k))
        i, j = np.nonzero(np.bitwise_count(first[k : k + step, None] ^ first[None, k:]) <= FAR)
        other = j > i
        i, j = i[other] + k, j[other] + k
        near = _apart(values[i], values[j]) <= FAR
        linked[i[near]] = linked[j[near]] = True
        k += step
    return linked


def stars(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """(first halves of the members, that of the centre) of each group that links join, from (n, 2) fingerprints."""
    left = values[_with_links(values)]
    left = left[np.lexsort((left[:, 1], left[:, 0]))]
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front, members = seed[None, :], []
        while len(front) and len(left):
            hit, step = np.zeros(len(left), bool), max(1, TILE // len(left))
            for k in range(0, len(front), step):
                hit |= (_apart(front[k : k + step, None], left[None, :]) <= FAR).any(0)
            front, left = left[hit], left[~hit]
            members.append(front[:, 0])
        if members and sum(map(len, members)):
            yield np.concatenate(members), seed[0]


def _link_groups(batches: Iterable[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """From (key, fp, more) sorted by key: links (a, b), and the rows of keys with over ``crowd`` as (a, b, key) with crowded set."""
    waiting: list[np.ndarray] = []
    count, crowded_key = 0, None

    def out(a, b, key, crowded: bool) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b, key)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(a), crowded))], names=["a", "b", "key", "crowded"])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal waiting, count
        group = np.concatenate(waiting) if waiting else np.zeros((0, 3), np.uint64)
        waiting, count = [], 0
        if len(group) > 1:
            for members, seed in stars(group[:, 1:]):
                centre = np.full(len(members), seed)
                yield out(members, centre, np.zeros(len(members), np.uint64), False)

    last = None
    for batch in batches:
        table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns], axis=1)
        if not len(table):
            continue
        for piece in np.split(table, np.flatnonzero(table[1:, 0] != table[:-1, 0]) + 1):
            if piece[0, 0] != last:
                yield from close()
                last, crowded_key = piece[0, 0], None
            waiting.append(piece)
            count += len(piece)
            if crowded_key is not None or count > crowd:
                crowded_key = last
                for part in waiting:
                    yield out(part[:, 1], part[:, 2], part[:, 0], True)
                waiting, count = [], 0
    yield from close()


def links(distinct: DataFrame, blocks: int, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) of first halves, whose components are those of all pairs of ``distinct`` (fp, more) within ``FAR`` bits."""
    common.ship(distinct.sparkSession)
    found = masks(blocks)
    kinds = F.explode(F.array(*[F.lit(k).cast("short") for k in range(len(found))]))

    def masked(name: str, half: int) -> Column:
        return F.col(name).bitwiseAND(F.element_at(F.array(*[F.lit(m[half]).cast("long") for m in found]), F.col("kind").cast("int") + 1))

    # Keys of 64 bits that meet by chance cost a comparison, as distances are verified.
    key = F.xxhash64("kind", masked("fp", 0), masked("more", 1))
    laid = distinct.select("fp", "more", kinds.alias("kind")).repartition(key).select(key.alias("key"), "fp", "more")

    def linked(rows: DataFrame, most: int) -> DataFrame:
        ordered = rows.sortWithinPartitions("key").select("key", "fp", "more")
        return common.staged(ordered.mapInArrow(lambda batches: _link_groups(batches, most), "a long, b long, key long, crowded boolean"), "links")

    got = linked(laid, crowd)
    out = got.where("not crowded").select("a", "b")
    crowded = got.where("crowded").select(F.col("a").alias("fp"), F.col("b").alias("more"), "key")
    if crowded.limit(1).count():
        # Values of a crowded key fall into chunks, and every two chunks meet in a task.
        chunks = common.staged(crowded.groupBy("key").agg(F.ceil(F.count("*") / crowd).cast("int").alias("chunks")), "chunks")
        placed = crowded.join(chunks, "key").withColumn("own", F.pmod(F.xxhash64("fp", "more"), F.col("chunks")).cast("int"))
        tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> own or chunks = 1")
        tiles = tiles.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "more")
        out = out.unionByName(linked(tiles.repartition("key"), 1 << 62).select("a", "b"))
    return out.where("a <> b").distinct()
