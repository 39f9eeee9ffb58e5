import threading

from pyspark.sql import functions as F

from colloquy.operators.threading import thread_messages
from colloquy.sources.mail import header_texts, parse_emails, read_eml, read_mbox, split_mbox, thread_email_messages
from colloquy.streaming.incremental import IncrementalThreads

RAW = b"Message-ID: <a@x>\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nReferences: <r@x>\r\n\t<s@x>\r\nDate: Tue, 06 Jun 2017 07:39:33 +0000\r\n\r\nbody"


def test_headers():
    got = header_texts(RAW)
    assert got["message_id"] == "<a@x>" and got["subject"] == "café" and got["in_reply_to"] is None and got["references"].split() == ["<r@x>", "<s@x>"]
    assert header_texts(None) == header_texts(b"") == dict.fromkeys(got)


def test_emails(spark):
    second = RAW.replace(b"<a@x>", b"<b@x>").replace(b"<r@x>\r\n\t<s@x>", b"<a@x>")
    df = spark.createDataFrame([(1, "keep", "clash", RAW), (2, "me", "clash", second)], "input_pos long, note string, subject string, raw binary")
    parsed = parse_emails(df).orderBy("input_pos").collect()
    assert [r["given_subject"] for r in parsed] == ["clash", "clash"]
    assert [r["note"] for r in parsed] == ["keep", "me"] and parsed[0]["subject"] == "café" and bytes(parsed[0]["raw"]) == RAW
    rows = {r["input_pos"]: r["parent_id"] for r in thread_email_messages(df, sort_by_sent_date=True).collect()}
    assert rows == {1: None, 2: "n:1"}


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.eml").write_bytes(RAW)
    assert bytes(read_eml(spark, str(tmp_path / "in")).first()["raw"]) == RAW
    box = b"From a@b Mon\nSubject: one\n\n>From here\n\nFrom c@d Tue\r\nSubject: two\r\n\r\nx\r\n"
    (tmp_path / "x.mbox").write_bytes(box)
    rows = read_mbox(spark, str(tmp_path / "x.mbox")).orderBy("idx").collect()
    assert [bytes(r["raw"]) for r in rows] == split_mbox(box) and b"\nFrom here" in split_mbox(box)[0] and split_mbox(b"") == []


def test_incremental(spark, tmp_path):
    schema = "mailbox_id string, input_pos long, message_id string, references array<string>"
    threads = IncrementalThreads(str(tmp_path / "store"))
    first = spark.createDataFrame([("a", 1, "x", None), ("b", 1, "y", None)], schema)
    second = spark.createDataFrame([("a", 2, "z", ["<x>"])], schema)
    threads.update(first, 0)
    threads.update(second, 1)
    threads.update(second, 1)  # a batch that is repeated
    got = {tuple(r) for r in threads.forest(spark).collect()}
    assert got == {tuple(r) for r in thread_messages(first.unionByName(second)).collect()}


def test_stream(spark, tmp_path):
    schema = "mailbox_id string, input_pos long, message_id string, references array<string>"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", ["<x>"])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    threads = IncrementalThreads(str(tmp_path / "store"))
    query = threads.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "check"), availableNow=True)
    stop = threading.Timer(120, query.stop)
    stop.start()
    query.awaitTermination()
    stop.cancel()
    assert threads.forest(spark).where(F.col("parent_id") == "n:1").count() == 1
