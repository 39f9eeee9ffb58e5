"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits in ``BLOCKS`` blocks. Two fingerprints that differ in at most ``DISTANCE`` bits agree in at
least ``BLOCKS - DISTANCE`` whole blocks, so each distinct fingerprint is dealt out once for every choice
of that many blocks, with their bits as the key. Rows of a key meet in one task, which verifies Hamming
distances and gives back a spanning star for each group of linked ones: never all pairs. A key with more
than ``CROWD`` fingerprints is cut into chunks of about that many, and every two chunks meet in a task of their own, so
no link is lost and no task holds an unbounded group. Components are then found by alternating large and
small stars, each step written to the shared folder.

Rows meet the classes of their fingerprints in a join, in which copies of one text are one key. Fingerprints that have more
than a ``HOT``-th of all rows, of which there are fewer than ``HOT``, are sent to all tasks instead.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal fingerprints are
linked; a row without doc_id gets the component of its fingerprint; repeated rows give equal rows. Of a group one row stays: that with
the smallest doc_id, those without come last, and of rows that tie the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common, wide
from colloquy.operators.graph import components

SHINGLE, SEED, DISTANCE, BLOCKS, CROWD = 4, 42, 4, 6, 8192
#: A fingerprint of more than this part of all rows is hot.
HOT = 1000


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return _vote([xxhash.xxh64_intdigest(joined, seed)])
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, hash_ = ends - lengths, xxhash.xxh64_intdigest
    return _vote([hash_(joined[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])


def _vote(hashes: list[int]) -> int:
    values = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), 65536):
        ones += np.unpackbits(values[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id and fp of every row, and ``row``, the name of a column of numbers, if given."""

    def make():
        return lambda c: [c[0], list(map(fingerprint, c[1])), *c[2:]]

    names = [F.col("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(row).alias("row")] if row else [])]
    return common.map_rows(documents.select(*names), make, "doc_id long, fp long" + ", row long" * bool(row))


def masks(open_bits: list[int], blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks (signed) over the given bits: one for each choice of blocks that any two close values agree in."""
    parts = [p for p in np.array_split(np.array(open_bits), blocks) if len(p)]
    if len(parts) <= distance:  # too few bits to tell apart: such values are close
        return []
    out = [sum(1 << int(b) for k in chosen for b in parts[k]) for chosen in combinations(range(len(parts)), len(parts) - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def stars(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.uint64]]:
    """(members, smallest) of each group of two or more that links of up to ``distance`` bits join."""
    left, out = np.sort(values), []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front, members = np.array([seed]), []
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, 2_000_000 // len(left))
            for k in range(0, len(front), step):
                hit |= (np.bitwise_count(front[k : k + step, None] ^ left[None, :]) <= distance).any(0)
            front, left = left[hit], left[~hit]
            members.append(front)
        if sum(map(len, members)):
            out.append((np.concatenate(members), seed))
    return out


def _link_groups(batches: Iterable[pa.RecordBatch], crowd: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key). Gives links (a, b), and the rows of crowded keys as (fp, mask) with crowded set."""
    kept: list[tuple] = []

    def out(a, b, crowded):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64)), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

    def groups(mask, key, fp, last: bool):
        """Links of all groups but an unfinished one, which stays for the next batch."""
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        edges = np.concatenate([[0], cuts, [len(fp)]])
        done = len(edges) - 1 if last else len(edges) - 2
        sizes = np.diff(edges)[:done]
        pairs = edges[:done][sizes == 2]
        near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance]
        found = [(np.maximum(fp[near], fp[near + 1]), np.minimum(fp[near], fp[near + 1]))]
        crowds = []
        for i in np.flatnonzero(sizes > 2):
            own = fp[edges[i] : edges[i + 1]]
            if len(own) > crowd:
                crowds.append((own, mask[edges[i] : edges[i + 1]]))
            else:
                found += [(m, np.full(len(m), s)) for m, s in stars(own, distance)]
        return found, crowds, edges[done]

    crowded_key = None
    for batch in batches:
        mask, key, fp = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        fp = fp.view(np.uint64)
        if crowded_key is not None:
            same = (mask == crowded_key[0]) & (key == crowded_key[1])
            n = len(mask) if same.all() else int(np.argmin(same))
            if n:
                yield out(fp[:n], mask[:n], True)
                mask, key, fp = mask[n:], key[n:], fp[n:]
            if len(mask):
                crowded_key = None
        if kept:
            mask, key, fp = (np.concatenate(x) for x in zip(*kept, (mask, key, fp), strict=True))
            kept = []
        if not len(mask):
            continue
        found, crowds, rest = groups(mask, key, fp, False)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield out(a, b, False)
        for own, m in crowds:
            yield out(own, m, True)
        mask, key, fp = mask[rest:], key[rest:], fp[rest:]
        if len(fp) > crowd:  # the unfinished group is crowded already: pass it on as it comes
            crowded_key = (mask[0], key[0])
            yield out(fp, mask, True)
        elif len(fp):
            kept = [(mask, key, fp)]
    if kept:
        found, crowds, _ = groups(*kept[0], True)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield out(a, b, False)


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs within ``distance`` bits."""
    common.ship(distinct.sparkSession)
    kinds = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(list(range(64)), blocks, distance)]))
    dealt = distinct.select("fp", kinds.alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")

    def linked(rows: DataFrame, most: int) -> DataFrame:
        laid = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
        return common.staged(laid.mapInArrow(lambda batches: _link_groups(batches, most, distance), "a long, b long, crowded boolean"), "links")

    found = linked(dealt, crowd)
    out = found.where("not crowded").select("a", "b")
    crowded = found.where("crowded")
    if crowded.limit(1).count():
        # A crowded key is dealt to tiles: its values fall into chunks, and every two chunks meet in a task.
        crowded = crowded.select(F.col("a").alias("fp"), F.col("b").alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        chunks = common.staged(crowded.groupBy("mask", "key").agg(F.ceil(F.count("*") / crowd).cast("int").alias("chunks")), "chunks")
        placed = crowded.join(chunks, ["mask", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> own or chunks = 1")
        tiles = tiles.select("mask", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        out = out.unionByName(linked(tiles, 1 << 62).select("a", "b"))
    return out.distinct()


def blocks_for(fingerprints: int) -> int:
    """Blocks whose keys have so many bits that few fingerprints meet by chance: 21, 27 or 32 bits, for 15, 35 or 70 rows each."""
    return BLOCKS if fingerprints <= 1 << 24 else BLOCKS + 1 if fingerprints <= 1 << 30 else BLOCKS + 2


def _classes(marked: DataFrame, blocks: int | None, distance: int, crowd: int) -> DataFrame:
    """fp, n (rows that have it) and of, the component, of every distinct fingerprint of (doc_id, fp)."""
    distinct, got = common.staged_with(marked.groupBy("fp").agg(F.count("*").alias("n")), "distinct", count=F.count(F.lit(1)))
    roots = components(links(distinct, blocks or blocks_for(got["count"]), distance, crowd))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("of"))


def _meet(marked: DataFrame, known: DataFrame) -> DataFrame:
    """``marked`` joined with ``known`` (fp, n, further columns) by fp; hot fingerprints don't travel."""
    total = known.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(1000, total // HOT)
    hot = F.broadcast(known.where(is_hot).drop("n"))  # fewer than HOT rows
    return marked.join(hot, "fp").unionByName(marked.join(hot.select("fp"), "fp", "left_anti").join(known.where(~is_hot).drop("n"), "fp"))


def near_duplicates(documents: DataFrame, blocks: int | None = None, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, of every document.

    Any number of ``blocks`` over ``distance`` finds the same links; by default it follows the number of fingerprints.
    """
    marked = common.staged(fingerprints(documents), "fingerprints")
    rooted = common.staged(_classes(marked, blocks, distance, crowd), "rooted")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = common.staged(rooted.join(first, "fp"), "firsts")
    named = rooted.groupBy("of").agg(F.min("first").alias("component_id"))
    known = common.staged(rooted.select("fp", "n", "of").join(named, "of").select("fp", "n", "component_id"), "known")
    return _meet(marked, known).select("doc_id", "fp", "component_id")


def drop_near_duplicates(documents: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest doc_id.

    Near copies are those that fingerprints of five-word shingles with 128 bits link (``wide``): a similarity of about 0.8 or more. Rows are
    numbered, so repeated ids and null ones are rows like any. Any number of ``blocks`` over 2 finds the same links.
    """
    columns = documents.columns
    numbered = common.staged(documents.select(F.struct("*").alias("_document"), F.monotonically_increasing_id().alias("_number")), "numbered")
    marked = wide.fingerprints(numbered.select("_document.doc_id", "_document.text", "_number"), "_number")
    marked = common.staged(marked, "fingerprints")
    distinct, got = common.staged_with(marked.select("fp", "more").distinct(), "distinct", count=F.count(F.lit(1)))
    roots = components(wide.links(distinct, blocks or wide.blocks_for(got["count"])))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    first = marked.groupBy("fp").agg(F.count("*").alias("n"), best.alias("best"))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "n", "best", F.coalesce("root", "fp").alias("of"))
    rooted = common.staged(rooted, "rooted")
    kept = rooted.groupBy("of").agg(F.min("best").alias("kept"), F.sum("n").alias("all"))
    known = common.staged(rooted.select("fp", "n", "of").join(kept.where("all > 1"), "of").select("fp", "n", "kept.row"), "known")
    copies = _meet(marked.select("fp", F.col("row").alias("_copy")), known).where("_copy <> row").select("_copy")
    copies = common.staged(copies, "copies")
    return numbered.join(copies, F.col("_number") == F.col("_copy"), "left_anti").select(*[F.col("_document").getField(c).alias(c) for c in columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
