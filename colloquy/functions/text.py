"""Header text: encoded words, base subjects, and keys that ignore case.

Most headers are plain, so each function has a path of built-in expressions for those; Python gets the rest, in
Arrow batches in which the plain ones are null.
"""

from __future__ import annotations

import re
import unicodedata
from email.errors import HeaderParseError
from email.header import decode_header
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "base string, is_reply boolean"
_GAPS = re.compile(r"[ \t\r\n]+")
#: Fixed by RFC 5256: blobs, what may stand before a subject, and the trailer. A blob has no brackets in it.
_BLOBS = re.compile(r"(?:\[[^\[\]]*\] *+)*+")
_LEAD = re.compile(r"(?:re|fwd?) *(?:\[[^\[\]]*\] *)?:", re.I)
_TRAILER = "(fwd)"
#: A subject without these needs no more than its gaps closed.
_PLAIN = r"(?i)=\?|\[|\(fwd\)|\b(re|fwd?)\b|:"


@lru_cache(maxsize=1024)
def _codec(charset: str | None) -> str:
    """The name of a text encoding to read a part by: its own, or else UTF-8."""
    name = charset or "ascii"
    try:
        b"x".decode(name, "replace")
    except LookupError:
        return "utf-8"
    return name


def _part_text(part: tuple) -> str:
    raw, charset = part
    return raw if isinstance(raw, str) else raw.decode(_codec(charset), "replace")


def decode_text(text: str) -> str:
    """RFC 2047 words decoded; a malformed header stays as it is."""
    try:
        return "".join(map(_part_text, decode_header(text)))
    except HeaderParseError:
        return text


def _before_trailers(text: str) -> tuple[int, bool]:
    """Where the trailers and spaces at the end begin, and whether a trailer is among them."""
    end, found = len(text), False
    while True:
        if end and text[end - 1] == " ":
            end -= 1
        elif text[max(0, end - 5) : end].lower() == _TRAILER:
            end, found = end - 5, True
        else:
            return end, found


def _after_leaders(text: str) -> tuple[int, bool]:
    """Where the subject begins behind leaders, spaces and blobs, and whether a leader is among them."""
    at, found = 0, False
    while True:
        if text.startswith(" ", at):
            at += 1
            continue
        run = _BLOBS.match(text, at).end()
        if lead := _LEAD.match(text, run):
            at, found = lead.end(), True
        elif run == at:
            return at, found
        elif run < len(text):
            at = run
        else:  # nothing follows the last blob: it is the subject
            return text.rindex("[", at, run), found


def base_subject_of(subject: str | None) -> tuple[str, bool]:
    """(base subject, whether it was a reply or forward) by the rules of RFC 5256; linear but for wrappers in wrappers."""
    if not subject:
        return "", False
    text, reply = _GAPS.sub(" ", decode_text(subject)), False
    while True:
        end, trailed = _before_trailers(text)
        text = text[:end]
        start, led = _after_leaders(text)
        text, reply = text[start:], reply or trailed or led
        if text[:5].casefold() != "[fwd:" or text[-1:] != "]":
            return text, reply
        text, reply = text[5:-1], True


@lru_cache(maxsize=65536)
def _prepared(character: str) -> str:
    title = character.title()
    return unicodedata.normalize("NFKD", title if len(title) == 1 else character)


def casemap(text: str) -> str:
    """RFC 5051 key: every code point by itself in simple titlecase, then decomposed."""
    return text.upper() if text.isascii() else "".join(map(_prepared, text))


def _apply(function, kind: str):
    from pyspark.sql.functions import pandas_udf

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return pandas_udf(run, kind)


def decode_header_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    encoded = F.contains(c, F.lit("=?"))
    return F.when(encoded, _apply(decode_text, "string")(F.when(encoded, c))).otherwise(c)


def base_subject(c: Column | str) -> Column:
    """A struct of the base subject and whether the subject is one of a reply or forward; null gives ("", false)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(BASE)
    def parsed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([("", False) if x is None else base_subject_of(x) for x in s], columns=["base", "is_reply"])

    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    closed = F.regexp_replace(F.regexp_replace(c, "[ \\t\\r\\n]+", " "), "^ +| +$", "")
    plain = F.struct(closed.alias("base"), F.lit(False).alias("is_reply"))
    dressed = c.rlike(_PLAIN)
    return F.when(dressed, parsed(F.when(dressed, c))).otherwise(plain)


def unicode_casemap_key(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    foreign = c.rlike("[^\\x00-\\x7f]")
    return F.when(foreign, _apply(casemap, "string")(F.when(foreign, c))).otherwise(F.upper(c))


def normalize_subject(c: Column | str) -> Column:
    """The base subject."""
    return base_subject(c)["base"]


def is_reply_or_forward_subject(c: Column | str) -> Column:
    """Whether a leader, a trailer or a wrapper marks a reply or forward; a list's tag alone doesn't."""
    return base_subject(c)["is_reply"]


is_reply_subject = is_reply_or_forward_subject
