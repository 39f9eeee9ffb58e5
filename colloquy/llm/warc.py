"""WARC archives of pages, and their capture index by an external merge.

Writing: every page becomes a record in plain WARC text, put together by built-in functions and written by
Spark's text sink, whose line separator is the pair of line ends that closes a record; any file system and lost executors are thus
Spark's matter. Of equal payloads one is stored, the others become revisits that refer to it.

Files have a bounded number of records, and those with a payload over ``LARGE`` bytes are in files of their own, so a file is
bounded in bytes too, unless one page is larger.

Reading: each archive is parsed by its lengths, payload digests are recomputed, and its captures are
sorted by URL key and time into a run. A loser tree merges the runs of the archives that a task reads into longer ones, of up to
``RUN_CAPTURES`` captures. These are cut into ranges of (URL key, time, page), and in each
range a loser tree merges the slices of all runs, so that the ranges in a row hold every URL's capture history in order. A
range has a bounded number of captures even where one URL has most of them.

Copies of a payload meet the page that is kept by digest; digests that have more than a ``HOT``-th of all pages, of which there are fewer
than ``HOT``, are sent to all tasks instead.

Defined results: null html is an empty payload, null urls have an empty key; equal payloads are told by SHA-1
and length; rows that repeat both page_id and payload are each stored as a response if that page is the one kept; a null
page_id is always a response. No pages give an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common

#: Records of an archive file, and captures of a range, at most (about, for ranges).
FILE_RECORDS, RANGE_CAPTURES = 1024, 20_000
#: Captures of a merged run at most; payload bytes from which a record has a file of its own; the part of all pages from which a payload is hot.
RUN_CAPTURES, LARGE, HOT = 50_000, 1 << 18, 1000
#: Payloads from this size on are stored once.
LEAST_BYTES = 0
EPOCH = 1_577_836_800
END = "\r\n\r\n"
CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, place long, size long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 40 hex digits as eight groups of 20 bits, each four base-32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files into a new folder."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    body = payload.cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    facts, got = common.staged_with(rows.select("page_id", "digest", "n"), "payloads", rows=F.count(F.lit(1)), large=F.count(F.when(F.col("n") > LARGE, 1)))
    kept = facts.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    kept = common.staged(kept.where("copies > 1"), "responses")
    is_hot = F.col("copies") > max(1000, got["rows"] // HOT)
    hot = F.broadcast(kept.where(is_hot).drop("copies"))  # fewer than HOT rows
    cold = facts.join(hot.select("digest", "n"), ["digest", "n"], "left_anti").join(kept.where(~is_hot).drop("copies"), ["digest", "n"])
    again = facts.join(hot, ["digest", "n"]).unionByName(cold).where("page_id <> refers_to").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    again = common.staged(again, "revisits")
    rows = rows.join(again, (rows["page_id"] == again["_page"]) & (rows["digest"] == again["_digest"]), "left")
    seconds = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))
    captured = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), seconds.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda page: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), captured,
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "%0A"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    out = rows.select("n", record.alias("value"))
    for some, most in ((out.where(F.col("n") <= LARGE), file_records), (out.where(F.col("n") > LARGE), 1)) if got["large"] else ((out, file_records),):
        some.select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, place, size) of each record of an archive."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.index(end, at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        start, n = stop + 4, int(headers["Content-Length"])
        if data[start + n : start + n + 4] != end:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, data[start : start + n], at, start + n + 4 - at
        at = start + n + 4


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def captures(data: bytes, file: str) -> list[tuple]:
    """A run: the captures of an archive in order, each payload checked against its digest."""
    out = []
    for headers, block, place, size in records(data):
        head, _, payload = block.partition(END.encode())
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        n = int(head.rsplit(b"Content-Length: ", 1)[1])
        kind = headers["WARC-Type"]
        page = headers["WARC-Record-ID"].split(":")[2]
        refers = headers["WARC-Refers-To"].split(":")[2] if kind == "revisit" else ""
        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{file}: the payload at byte {place} doesn't have its digest")
        out.append((url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], int(page) if page else None, n, digest, kind, int(refers) if refers else None, file, place, size))
    return sorted(out, key=order)


def order(capture: Sequence) -> tuple:
    return capture[0], capture[1], -1 if capture[2] is None else capture[2], capture[7], capture[8]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path only."""

    def __init__(self, runs: Iterable[Iterable], key=order):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads: list = [None] * self.k
        for i in range(len(self.runs)):
            self._advance(i)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _advance(self, i: int) -> None:
        value = next(self.runs[i], None)
        self.heads[i] = None if value is None else (self.key(value), value)

    def _before(self, i: int, j: int) -> bool:
        if self.heads[i] is None or self.heads[j] is None:
            return self.heads[j] is None and self.heads[i] is not None
        return (self.heads[i][0], i) < (self.heads[j][0], j)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # while the tree is built: wait here for the match
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.heads[i := max(0, self.losers[0])] is not None:
            yield self.heads[i][1]
            self._advance(i)
            self._replay(i)


def merge_runs(rows: list[tuple]) -> list[tuple]:
    """The slices of several runs, each in order and named by its rows' last column, as one sorted list without it."""
    runs: dict[str, list] = {}
    for row in rows:
        runs.setdefault(row[-1], []).append(row[:-1])
    return list(LoserTree(runs.values()))


def read_index(spark: SparkSession, path: str, range_captures: int = RANGE_CAPTURES, run_captures: int = RUN_CAPTURES) -> DataFrame:
    """All captures of the archives under ``path``, in the global order of URL key, time and page."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    except AnalysisException:
        return spark.createDataFrame([], CAPTURE)

    def parse():
        held: list[list[tuple]] = []

        def merged() -> list[list]:
            rows = [(*row[:-1], held[0][0][7]) for row in LoserTree(held)]
            held.clear()
            return list(map(list, zip(*rows, strict=True)))

        def run(c):
            for file, data in zip(*c, strict=True):
                if found := captures(data, file):
                    held.append([(*row, None) for row in found])
            return merged() if sum(map(len, held)) >= run_captures else []

        return run, lambda: merged() if held else []

    runs, got = common.staged_with(common.map_rows(files, parse, CAPTURE + ", run string", slice_rows=1), "runs", rows=F.count(F.lit(1)))
    ranges = max(1, -(-got["rows"] // range_captures))

    def merge():
        rows: list[tuple] = []

        def take(c):
            rows.extend(zip(*c, strict=True))
            return []

        return take, lambda: list(map(list, zip(*merge_runs(rows), strict=True)))

    cut = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "file", "place").sortWithinPartitions("run", "url_key", "captured", "page_id", "file", "place")
    return common.map_rows(cut, merge, CAPTURE)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "archives")
    write_archives(common.read(spark, sf_dir, "pages"), path)
    return read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def _sql() -> str:
    """The contract of op3 for DuckDB."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = lambda k, shift: f"substr('{alphabet}', 1 + ((('0x' || substr(x, {1 + 5 * k}, 5))::INTEGER >> {shift}) & 31), 1)"
    digest = " || ".join(digit(k, shift) for k in range(8) for shift in (15, 10, 5, 0))
    return rf"""
WITH d AS (SELECT page_id, coalesce(url, '') AS u, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS x FROM pages),
k AS (SELECT x, n, max(page_id) AS keep FROM d WHERE n >= {LEAST_BYTES} GROUP BY x, n),
p AS (SELECT d.*, keep, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q FROM d LEFT JOIN k USING (x, n))
SELECT page_id, n AS payload_bytes, {digest} AS payload_digest, CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to,
  lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END) AS url_key,
  strftime(make_timestamp(({EPOCH} + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM p
"""


SQL = _sql()
