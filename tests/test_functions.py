import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions.dates import EARLIEST, micros_of, sent_us
from colloquy.functions.headers import effective_references, email_fingerprint, extract_reference_ids, normalize_message_id
from colloquy.functions.text import base_subject, base_subject_of, casemap, decode_header_text, decode_text, unicode_casemap_key


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_message_ids(spark):
    given_ = ["<x@y>", "  <a@b>  ", "", "<>", "   ", None, "<<a@b>>", "\t a@b\n", " <a@b>\xa0", "a b"]
    assert column(spark, given_, "string", normalize_message_id) == ["x@y", "a@b", None, None, None, None, "a@b", "a@b", "a@b", "a b"]


def test_reference_ids(spark):
    given_ = ["<a@x> <b@y> <a@x>", "a@x b@y", "", None, "< > foo", "<a@x>\r\n\t<b@y>junk", "  a@x  "]
    assert column(spark, given_, "string", extract_reference_ids) == [["a@x", "b@y"], ["a@x", "b@y"], [], [], [], ["a@x", "b@y"], ["a@x"]]


def test_effective_references(spark):
    rows = [(["<a@e> <b@e>", "<b@e> <c@e>"], None), ([], ["<a> <b>"]), (None, [" <> ", "x y"]), ([None, "<>"], None)]
    df = spark.createDataFrame(rows, "r array<string>, t array<string>")
    assert [r[0] for r in df.select(effective_references("r", "t")).collect()] == [["a@e", "b@e", "c@e"], ["a"], ["x"], []]


def test_fingerprint(spark):
    df = spark.createDataFrame([("Hi ", "D", None, "Me"), (" hi", "d", "", "ME")], "a string, b string, c string, d string")
    a, b = (r[0] for r in df.select(email_fingerprint("a", "b", "c", "d")).collect())
    assert a == b and re.fullmatch("[0-9a-f]{64}", a)


SUBJECTS = {
    "RE: fw: Fwd: Minutes": ("Minutes", True), "=?utf-8?b?UkU6IENhZsOp?=": ("Café", True), "  FWD:\t\r\n  Budget    draft ": ("Budget draft", True), "[ops] Fw: Outage": ("Outage", True),
    "Fw [ops] : Outage": ("Outage", True), "[a] [b] Outage": ("Outage", False), "[a] [b]": ("[b]", False), "[ops]": ("[ops]", False), "Outage(FWD) (fwd)": ("Outage", True),
    "[FWD: [ops] re: Outage (fwd)]": ("Outage", True), "Outage (fwd)": ("Outage", True), "[fwd: Outage]": ("Outage", True), "": ("", False), "Outage": ("Outage", False), "Fwd": ("Fwd", False),
    "re:re:": ("", True), "[ops]  ": ("[ops]", False), "[a][b] re[c]:[d]x": ("x", True), "(fwd)": ("", True), "[[a]] x": ("[[a]] x", False), "[]": ("[]", False),
}


def test_subjects(spark):
    assert {s: base_subject_of(s) for s in SUBJECTS} == SUBJECTS
    assert [tuple(x) for x in column(spark, [*SUBJECTS, None], "string", base_subject)] == [*SUBJECTS.values(), ("", False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["re", "fwd", "Fw", ":", " ", "[x]", "[", "]", "(fwd)", "[fwd:", "T", "\t"]), max_size=12).map("".join))
def test_base_subject_is_stable(subject):
    base, _ = base_subject_of(subject)
    assert base == base.strip(" ") and base_subject_of(base) == (base, False)


def test_plain_subjects_need_no_python(spark):
    r = random.Random(3)
    some = ["".join(r.choice("ab \t\r\nreRE") for _ in range(12)) for _ in range(300)]
    assert [tuple(x) for x in column(spark, some, "string", base_subject)] == [base_subject_of(s) for s in some]


def test_encoded_words(spark):
    pairs = {"a =?koi8-r?b?8NLJ18XU?= b": "a Привет b", "=?iso-8859-15?q?10_=A4?=": "10 €", "=?no-such?q?plain_words?=": "plain words", "=?utf-8?b?QUJDR?=": "=?utf-8?b?QUJDR?=", "ü plain": "ü plain", "=?base64?q?abc?=": "abc"}
    assert {k: decode_text(k) for k in pairs} == pairs
    assert column(spark, [*pairs, None], "string", decode_header_text) == [*pairs.values(), None]


def test_casemap(spark):
    assert casemap("ǉ") == casemap("ǈ") == casemap("Ǉ") == "Lj"
    assert casemap("ſ") == "S" and casemap("ﬁn") == "fiN" and casemap("ñ") == casemap("Ñ") and casemap("B") != casemap("Β")
    some = ["Mail", "Ｍａｉｌ", "ñ", "", None, "straße ǉ", "ọ̇"]
    assert column(spark, some, "string", unicode_casemap_key) == [None if s is None else casemap(s) for s in some]


def test_dates(spark):
    some = [
        "Mon, 9 May 2011 23:15:40 +0430", "9 May 2011 23:15:40 +9930", "9 May 2011 25:15:40 +0300", "9 May 2011", "Wed, 31 Dec 2008 23:59:60 GMT", "9 May 2011 noon MST",
        "31 Apr 2011 10:00:00 +0000", "31 Dec 9999 23:00:00 -1200", "9 May 11 10:00:00 GMT", "", None, "2011-05-09T00:00:00Z", "Mon, 9 May 2011 00:00:00 +1459", "9 May 1580 00:00:00 +0000",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(some)], "i int, a string").withColumn("b", F.lit(None).cast("string"))
    got = [r[0] for r in df.orderBy("i").select(sent_us("a", "b")).collect()]
    assert got == [EARLIEST if (m := micros_of(s)) is None else m for s in some]
    assert got[:6] == [1_304_966_740_000_000, 1_304_982_940_000_000, 1_304_888_400_000_000, 1_304_899_200_000_000, 1_230_767_999_999_999, 1_304_924_400_000_000]


def test_hostile_subjects_take_linear_time():
    for subject in ("(fwd)" * 40_000 + "x", "[a]" * 60_000 + "x", "[a]" * 60_000, "x" + " (fwd)" * 40_000, "re:" * 60_000, "[" * 200_000):
        began = time.perf_counter()
        base_subject_of(subject)
        assert time.perf_counter() - began < 2


def test_naive_timestamps_count_as_utc(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS t, CAST(NULL AS string) AS s")
    assert df.select(sent_us("s", "s", F.col("t"), None)).first()[0] == 1_767_225_600_000_000


def test_schema_checks(spark):
    from colloquy.schema import as_mailbox

    with pytest.raises(ValueError):
        as_mailbox(spark.createDataFrame([(1, True)], "input_pos long, uid boolean"))
    with pytest.raises(TypeError):
        as_mailbox(spark.createDataFrame([(1, 2)], "input_pos long, sent_date int"))
    with pytest.raises(ValueError):
        as_mailbox(spark.createDataFrame([(1,)], "uid long"))
    assert as_mailbox(spark.createDataFrame([(1, True, 2)], "input_pos long, uid boolean, sent_date int"), strict=False).first()["uid"] is None
