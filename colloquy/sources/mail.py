"""Mail as tables: raw messages from folders and mbox files, and their headers as mailbox columns.

Storage formats come with Spark's readers; folders of messages and mbox files are an addition of this engine.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from email.parser import BytesHeaderParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import decode_text
from colloquy.operators.threading import thread_messages
from colloquy.session import ship

HEADERS = {"message_id": "Message-ID", "in_reply_to": "In-Reply-To", "references": "References", "subject": "Subject", "sent_date": "Date"}
_FROM = re.compile(rb"(?:\A|(?<=\n))From [^\n]*\r?\n")


def header_texts(raw: bytes | None) -> dict[str, str | None]:
    """The five headers that threading reads, decoded; absent ones are null."""
    message = BytesHeaderParser().parsebytes(raw or b"")
    return {name: None if (value := message.get(header)) is None else decode_text(str(value)) for name, header in HEADERS.items()}


def parse_emails(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with the headers of its column of raw messages as mailbox columns.

    The other columns stay as payload, the raw one too; one with a header column's name stays as ``given_`` and that name.
    """
    ship(df.sparkSession)
    if raw in HEADERS:
        raw, df = f"given_{raw}", df.withColumnRenamed(raw, f"given_{raw}")
    df = df.withColumnsRenamed({c: f"given_{c}" for c in df.columns if c in HEADERS})
    before, names = df.columns, list(HEADERS)
    place = before.index(raw)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.StringType()) for n in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_texts(x) for x in batch.column(place).to_pylist()]
            columns = [pa.array([f[n] for f in found], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*before, *names])

    return df.mapInArrow(run, schema)


def thread_email_messages(df: DataFrame, raw: str = "raw", *, group_by_subject: bool = False, sort_by_sent_date: bool = False) -> DataFrame:
    """The forest of raw messages with input_pos; sequence numbers and uids are used where given and never invented."""
    return thread_messages(parse_emails(df, raw), group_by_subject=group_by_subject, sort_by_sent_date=sort_by_sent_date)


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of every message file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(path).select("path", F.col("content").alias("raw"))


def split_mbox(data: bytes) -> list[bytes]:
    """Messages of an mbox file, their quoted From lines restored."""
    cuts = [m.span() for m in _FROM.finditer(data)]
    ends = [*[a for a, _ in cuts[1:]], *([len(data)] if cuts else [])]
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", data[start:end]) for (_, start), end in zip(cuts, ends, strict=True)]


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx from 1, raw) of every message of the mbox files at ``path``."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                messages = split_mbox(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(messages), pa.string()), pa.array(range(1, len(messages) + 1), pa.int64()), pa.array(messages, pa.binary())], names=["path", "idx", "raw"])

    return files.mapInArrow(run, "path string, idx long, raw binary")
