"""Identification headers as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an identifier in angle brackets.
REFERENCE_PATTERN = "<([^>]+)>"
#: Fixed value: the white space that Python's str methods strip.
_SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Most identifiers: plain ASCII in at most one pair of brackets.
_TIDY = "^<?[!-;=?-~]+>?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def normalize_message_id(c: Column | str) -> Column:
    """An identifier without white space and angle brackets around it; null if nothing is left."""
    c = _col(c)
    inner = F.regexp_replace(strip(c), "^[<>]+|[<>]+$", "")
    return F.when(c.rlike(_TIDY), F.btrim(c, F.lit("<>"))).otherwise(F.nullif(strip(inner), F.lit("")))


def extract_reference_ids(c: Column | str) -> Column:
    """Identifiers of a header in order, each once: the bracketed ones, or all words if none is bracketed."""
    text = F.coalesce(_col(c), F.lit(""))
    bracketed = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), F.lit(1))
    found = F.when(F.size(bracketed) > 0, bracketed).otherwise(F.split(text, f"{_SPACE}+"))
    return F.array_distinct(F.filter(F.transform(found, normalize_message_id), lambda x: x.isNotNull()))


def reference_ids(fragments: Column | str) -> Column:
    """Identifiers of an array of headers, each once."""
    some = F.coalesce(F.filter(_col(fragments), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(some, extract_reference_ids)))


def effective_references(references: Column | str, in_reply_to: Column | str) -> Column:
    """The chain of ancestors of a message: its references, or else the first identifier that it replies to."""
    own = reference_ids(references)
    return F.when(F.size(own) > 0, own).otherwise(F.slice(reference_ids(in_reply_to), 1, 1))


def email_fingerprint(subject: Column | str, date: Column | str, sender: Column | str, recipient: Column | str) -> Column:
    """SHA-256 in hex over the four parts, stripped, lower-cased and joined by bars."""
    parts = [strip(F.coalesce(_col(c), F.lit(""))) for c in (subject, date, sender, recipient)]
    return F.sha2(F.lower(F.concat_ws("|", *parts)), 256)
