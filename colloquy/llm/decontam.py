"""Benchmark decontamination with suffix arrays of the training text.

Each task turns shards of its documents into streams of word numbers and builds the suffix array of each by
prefix doubling: the places of all its suffixes, in the order of their first ``DEPTH`` words. Every test suffix (each
place of a benchmark item) is binary-searched in it word by word, all of them at once, which narrows
ranges of training places. A range that is left after a window's words holds the window's occurrences; longest matches grow from
those that can't be extended to the left. No rows move between tasks.

The benchmark is sent in blocks of whole items, bounded by words and bytes; a task builds each array once and holds one block at
a time beside it, so more blocks cost more searches but no more memory and no more passes.

Defined results: null and empty texts have no words, no hits and no items; items without words match
nothing; an item given twice counts once; one without an id hits words but isn't named; repeated documents are judged each;
where a window occurs at several places, or in several items, all count. Spans of ``contamination`` are unions of hits, so that one may be longer than
what any item holds; ``longest_matches`` gives what single items hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common

#: Words of a window, and of a suffix by which suffixes are sorted at least.
WINDOW, DEPTH = 10, 16
#: Words and (about) bytes of a block of items, words of a shard and pairs that a search holds, unless one item, document or place has more.
BLOCK_WORDS, BLOCK_BYTES, SHARD_WORDS, PAIRS = 1_000_000, 48_000_000, 400_000, 500_000
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "n_words long, spans array<struct<start: int, end: int>>, items array<long>"
MATCHES = "doc_id long, start int, end int, n_words int, item_id long, item_start int"


def words(text: str | None) -> list[bytes]:
    """Words of a whole text; bytes lower-case A-Z alone, and those beyond ASCII belong to words."""
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class _Numbers(dict):
    """Numbers from 1 for words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Block:
    """Test suffixes of some items as arrays: the items' words one after the other with a 0 before and between them, and where their windows are."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        numbers = _Numbers()
        self.window = window
        lengths = np.array([len(own) for _, own in items], np.int64)
        self.flat = np.zeros(int(lengths.sum()) + len(items) + 1, np.int32)
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths
        for (_, own), start in zip(items, self.starts, strict=True):
            self.flat[start : start + len(own)] = np.fromiter(map(numbers.__getitem__, own), np.int32, len(own))
        self.words = list(numbers)
        self.named = np.array([i is not None for i, _ in items], bool)
        self.item_ids = np.array([i or 0 for i, _ in items], np.int64)
        each = np.where(lengths > 0, np.maximum(1, lengths - window + 1), 0)
        self.item = np.repeat(np.arange(len(items)), each)
        self.at = np.repeat(self.starts, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.sizes = np.minimum(np.repeat(lengths, each), window)


def suffix_array(stream: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places of all words of the stream, in the order of the ``depth`` numbers that follow from there (or a power of two above). 0 isn't a word."""
    rank = stream.astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < min(depth, len(rank)):
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - width] = rank[width:]
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[1], np.cumsum(key[1:] != key[:-1]) + 1])
        width *= 2
        if rank[order[-1]] == len(rank):
            break
    return order[stream[order] > 0]


class Shard:
    """Some documents as a stream of numbers, a 0 after each, and its suffix array."""

    def __init__(self, texts: list[list[bytes]], window: int = WINDOW):
        self.numbers = _Numbers()
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths + 1)
        self.starts = self.ends - lengths - 1
        self.depth = max(DEPTH, window)
        n = int(self.ends[-1]) if len(texts) else 0
        self.stream = np.zeros(n + 2 * self.depth, np.int64)  # padded, so that reading on needs no check
        for t, start in zip(texts, self.starts, strict=True):
            self.stream[start : start + len(t)] = np.fromiter(map(self.numbers.__getitem__, t), np.int64, len(t))
        self.places = suffix_array(self.stream[:n], self.depth)

    def test(self, block: Block) -> np.ndarray:
        """The block's stream in this shard's numbers; 0 for words that it doesn't have."""
        return np.concatenate([[0], np.fromiter(map(self.numbers.get, block.words, repeat(0)), np.int64, len(block.words))])[block.flat]

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, column: int, right: bool) -> np.ndarray:
        """Where ``word`` would stand among the words at ``column`` of the suffixes from ``low`` to ``high``, before (or after) equal ones."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            there = self.stream[self.places[mid] + column]
            go = open_ & ((there <= word) if right else (there < word))
            low, high = np.where(go, mid + 1, low), np.where(open_ & ~go, mid, high)
        return low

    def search(self, test: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with ``sizes`` words of ``test`` from ``at`` on, empty where there is none."""
        first, last = np.zeros(len(at), np.int64), np.full(len(at), len(self.places), np.int64)
        for column in range(int(sizes.max()) if len(sizes) else 0):
            asked = np.flatnonzero((column < sizes) & (first < last))
            if not len(asked):
                break
            word, low, high = test[at[asked] + column], first[asked], last[asked]
            high = np.where(word > 0, high, low)  # a word that the shard doesn't have is in no suffix
            first[asked] = self._bound(low, high, word, column, False)
            last[asked] = self._bound(first[asked], high, word, column, True)
        return first, last

    def windows(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(test stream, windows of the block that occur, their ranges)."""
        test = self.test(block)
        known = np.flatnonzero(test[block.at] > 0)
        first, last = self.search(test, block.at[known], block.sizes[known])
        found = first < last
        return test, known[found], first[found], last[found]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all ranges, and the range of each."""
    count = last - first
    of = np.repeat(np.arange(len(count)), count)
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), of


def judge(shard: Shard, block: Block) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each document of a shard: merged spans of hit words, and the items that occur."""
    n = len(shard.starts)
    _, window, first, last = shard.windows(block)
    if not len(window):
        return [([], [])] * n
    # Equal windows have one range: each place is met once for each size of window at most.
    sizes = block.sizes[window]
    _, at, of = np.unique(first * (block.window + 1) + sizes, return_index=True, return_inverse=True)
    row, which = _spread(first[at], last[at])
    places, long = shard.places[row], sizes[at][which]
    edge = np.bincount(places, minlength=len(shard.stream) + 1) - np.bincount(places + long, minlength=len(shard.stream) + 1)
    hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    opens, closes = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for d, a, b in zip((np.searchsorted(shard.starts, opens, "right") - 1).tolist(), opens.tolist(), closes.tolist(), strict=True):
        spans.setdefault(d, []).append((a - int(shard.starts[d]), b - int(shard.starts[d])))
    named = block.named[block.item[window]]
    order = np.argsort(of[named], kind="stable")
    ids, cuts = block.item_ids[block.item[window]][named][order], np.searchsorted(of[named][order], np.arange(len(at) + 1))
    of_range: dict[int, set] = {}
    for pair in np.unique((np.searchsorted(shard.starts, places, "right") - 1) * len(at) + which).tolist():
        d, k = divmod(pair, len(at))
        if k not in of_range:
            of_range[k] = set(ids[cuts[k] : cuts[k + 1]].tolist())
        items.setdefault(d, set()).update(of_range[k])
    return [(spans.get(d, []), sorted(items.get(d, ()))) for d in range(n)]


def longest(shard: Shard, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, end, item's place in the block, start in the item) of every match that neither side can extend."""
    test, window, first, last = shard.windows(block)
    many = np.cumsum(last - first)
    for part in np.split(np.arange(len(window)), np.flatnonzero(np.diff(many // PAIRS)) + 1) if len(window) else []:
        row, which = _spread(first[part], last[part])
        place, at = shard.places[row], block.at[window[part]][which]
        before = np.where(place > 0, shard.stream[np.maximum(place, 1) - 1], 0)
        begins = (test[at - 1] != before) | (before == 0)
        place, at, long = place[begins], at[begins], block.sizes[window[part]][which][begins].copy()
        item = block.item[window[part]][which][begins]
        limit = len(test)
        grows = np.arange(len(place))
        while len(grows):
            there = at[grows] + long[grows]
            mine = np.where(there < limit, test[np.minimum(there, limit - 1)], 0)
            grows = grows[(mine > 0) & (mine == shard.stream[place[grows] + long[grows]])]
            long[grows] += 1
        of = np.searchsorted(shard.starts, place, "right") - 1
        start = place - shard.starts[of]
        yield from zip(of.tolist(), start.tolist(), (start + long).tolist(), item.tolist(), (at - block.starts[item]).tolist(), strict=True)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark (item_id, text) in blocks of whole items that the driver holds one at a time."""
    held, total, size, seen = [], 0, 0, set()
    for row in benchmark.select("item_id", "text").toLocalIterator():
        own = words(row["text"])
        if held and (total + len(own) > block_words or size > block_bytes):
            yield Block(held, window)
            held, total, size, seen = [], 0, 0, set()
        held.append((row["item_id"], own))
        total += len(own)
        size += 40 * len(own) + sum(len(w) + 60 for w in {*own} - seen)  # arrays of the windows, and each word once
        seen.update(own)
    yield Block(held, window)


def _sent(benchmark: DataFrame, spark: SparkSession, window: int, block_words: int) -> list[Broadcast]:
    return [spark.sparkContext.broadcast(b) for b in blocks(benchmark, window, block_words)]


def _each(sent: list[Broadcast]) -> Iterator[Block]:
    """The blocks in a task: a single one is kept for the worker's next tasks, of several one at a time is in memory."""
    for block in sent:
        yield block.value
        if len(sent) > 1 and hasattr(block, "_value"):
            del block._value  # its file stays on the executor's disk


def shards(texts: list[list[bytes]], most: int = SHARD_WORDS) -> Iterator[slice]:
    start, total = 0, 0
    for k, t in enumerate(texts):
        if k > start and total + len(t) > most:
            yield slice(start, k)
            start, total = k, 0
        total += len(t)
    if texts:
        yield slice(start, len(texts))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans of hit words (start, end) and items of every document."""
    sent = _sent(benchmark, documents.sparkSession, window, block_words)

    def make():
        def run(c):
            texts = list(map(words, c[1]))
            spans, items = [], []
            for part in shards(texts):
                shard = Shard(texts[part], window)
                judged = [judge(shard, block) for block in _each(sent)]
                for found in zip(*judged, strict=True):
                    all_spans = found[0][0] if len(found) == 1 else merge_spans([x for s, _ in found for x in s])
                    spans.append([{"start": a, "end": b} for a, b in all_spans])
                    items.append(found[0][1] if len(found) == 1 else sorted({i for _, own in found for i in own}))
            return [c[0], [len(t) for t in texts], spans, items]

        return run

    return common.map_rows(documents.select("doc_id", F.col("text").cast("string").alias("text")), make, f"doc_id long, {FOUND}")


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every longest verbatim match of at least a window (a whole item, if that is shorter) with its places, in words: doc_id, start, end, n_words, item_id, item_start.

    Each match lies in one item and one document, and no longer one holds it at the same places.
    """
    sent = _sent(benchmark, documents.sparkSession, window, block_words)

    def make():
        def run(c):
            texts = list(map(words, c[1]))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for part in shards(texts):
                shard = Shard(texts[part], window)
                for block in _each(sent):
                    for d, start, end, item, item_start in longest(shard, block):
                        item_id = int(block.item_ids[item]) if block.named[item] else None
                        for column, value in zip(out, (c[0][part.start + d], start, end, end - start, item_id, item_start), strict=True):
                            column.append(value)
            return list(out)

        return run

    return common.map_rows(documents.select("doc_id", F.col("text").cast("string").alias("text")), make, MATCHES)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` without those that hold a window of any item; all columns stay, no shuffle."""
    sent = _sent(benchmark, documents.sparkSession, window, block_words)

    def make():
        def run(texts):
            split, keep = list(map(words, texts)), []
            for part in shards(split):
                shard = Shard(split[part], window)
                clean = np.ones(part.stop - part.start, bool)
                for block in _each(sent):
                    _, window_, first, last = shard.windows(block)
                    _, at = np.unique(first * (window + 1) + block.sizes[window_], return_index=True)
                    hit = shard.places[_spread(first[at], last[at])[0]]
                    clean[np.searchsorted(shard.starts, np.unique(hit), "right") - 1] = False
                keep += clean.tolist()
            return None, keep

        return run

    return common.map_text(documents, make)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: The contract of op9 for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS win, least(len(w), 10) AS size FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i+size-1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (win) WHERE dw.size = bw.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
