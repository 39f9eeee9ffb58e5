"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Kinds are email, ip, card and phone, and beyond these iban, local_phone (without a country's prefix), tax_id and secret. Cards
must pass Luhn, IBANs mod 97, parts of an ip address be at most 255, phones have 9 to 15 digits. A
proposal starts from the prior of its kind, gains by a checksum, by a telling format and by a context word nearby, and loses by
one that speaks against it. The first four kinds stay whatever their score is, as their patterns are those of a
contract; of the others none reaches ``LEAST_SCORE`` by its pattern alone in running text, so context decides: the same digits are kept behind
"call" and dropped behind "invoice". They also give way to a span of the first four that they overlap.

Defined results: null and empty texts have no spans; offsets count code points, the end is exclusive;
the first four kinds are searched apart, so their spans may overlap; of overlapping spans of the others the higher score stays, in a tie the
earlier, then the kind listed first; repeated rows give equal spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "tax_id", "secret")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![\w+.,/-])(?:\(0?[0-9]{2,4}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,2}(?![\w/-]|[.,][0-9])")
TAX_ID = re.compile(r"(?<![\w.,/-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w/-]|[.,][0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9+/_=-])")
#: Scores before evidence, what a checksum, a telling format, a supporting and an opposing word add, and the characters on either side in which words count.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.0, "local_phone": 0.3, "tax_id": 0.3, "secret": 0.2}
CHECKSUM, FORMAT, SUPPORT, OPPOSE, WINDOW, LEAST_SCORE = 0.4, 0.1, 0.2, -0.3, 48, 0.5
SUPPORTING = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|client|proxy)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|amex|payment|tarjeta|carte|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|cell|telefon|tel[eé]fono|t[eé]l[eé]phone|whatsapp)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte|transfer)\b", re.I),
    "tax_id": re.compile(r"\b(?:ssn|social security|tax(?:payer)? (?:id|number)|national id|steuernummer|nif)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|pass(?:word|wd)|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|bearer)\b", re.I),
}
SUPPORTING["local_phone"] = SUPPORTING["phone"]
OPPOSING = {
    "ip": re.compile(r"\b(?:version|release|section|chapter)\b", re.I),
    "card": re.compile(r"\b(?:isbn|order|serial|tracking|invoice)\b", re.I),
    "phone": re.compile(r"\b(?:version|score|serial)\b", re.I),
    "iban": re.compile(r"\b(?:isbn|order|serial|tracking|invoice|part|model)\b", re.I),
    "secret": re.compile(r"\b(?:commit|checksum|sha-?1|sha-?256|md5|hash|digest|example)\b", re.I),
}
OPPOSING["local_phone"] = OPPOSING["tax_id"] = OPPOSING["iban"]
SPANS = "spans array<struct<kind: string, start: int, end: int, score: double>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Walks from each @ to both sides, so a text without one costs a single search."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed by a checksum) of what passes its kind's checks."""
    for start, end in emails(text):
        yield "email", start, end, False
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span(), False
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", *m.span(), False
    for m in IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare):
            yield "iban", *m.span(), True
    for m in LOCAL_PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 12:
            yield "local_phone", *m.span(), False
    for m in TAX_ID.finditer(text):
        yield "tax_id", *m.span(), False
    for m in SECRET.finditer(text):
        if mixed(m[0]):
            yield "secret", *m.span(), False


def mixed(word: str) -> bool:
    """Whether a long word is of letters and digits that change places as often as in a random one."""
    digits = [c.isdigit() for c in word]
    return 4 <= sum(digits) <= len(word) - 4 and 4 * sum(a != b for a, b in zip(digits, digits[1:], strict=False)) >= len(word)


def _telling(kind: str, span: str) -> bool:
    """A format that others hardly have: groups of four, an area in brackets."""
    return kind == "iban" and " " in span or kind == "local_phone" and span[0] == "("


def find(text: str | None) -> list[dict]:
    """All spans of a whole text with their scores, by start, then kind."""
    out, others = [], []
    for kind, start, end, confirmed in proposals(text or ""):
        near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}"
        score = PRIOR[kind] + CHECKSUM * confirmed + FORMAT * _telling(kind, text[start:end])
        score += SUPPORT * bool(SUPPORTING[kind].search(near)) + OPPOSE * bool(kind in OPPOSING and OPPOSING[kind].search(near))
        if kind == "secret" and SUPPORTING[kind].search(text[max(0, start - 16) : start]):
            score += SUPPORT  # named right before it
        span = {"kind": kind, "start": start, "end": end, "score": round(min(1.0, max(0.0, score)), 6)}
        if kind in BASE:
            out.append(span)
        elif span["score"] >= LEAST_SCORE:
            others.append(span)
    if others:
        taken: list[tuple[int, int]] = []  # disjoint and in order
        for start, end in sorted((x["start"], x["end"]) for x in out):
            if taken and start < taken[-1][1]:
                start, end = taken[-1][0], max(end, taken.pop()[1])
            taken.append((start, end))
        for span in sorted(others, key=lambda x: (-x["score"], x["start"], KINDS.index(x["kind"]))):
            if _free(taken, span["start"], span["end"]):
                insort(taken, (span["start"], span["end"]))
                out.append(span)
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether none of the disjoint spans overlaps."""
    at = bisect_left(taken, (end, 0))
    return not at or taken[at - 1][1] <= start


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        first, end = spans[k], spans[k]["end"]
        while k < len(spans) and spans[k]["start"] < end:
            end = max(end, spans[k]["end"])
            k += 1
        out += [text[at : first["start"]], f"<{first['kind'].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id and spans of every whole text."""

    def make():
        return lambda c: [c[0], list(map(find, c[1]))]

    return common.map_rows(documents.select("doc_id", F.col("text").cast("string").alias("text")), make, f"doc_id long, {SPANS}")


def redact_texts(documents: DataFrame) -> DataFrame:
    """``documents`` with personal data replaced in text and n_chars following it; other columns stay."""

    def make():
        return lambda texts: ([redact(t, find(t)) for t in texts], None)

    out = common.map_text(documents, make)
    names = documents.columns
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256")
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *map(count, BASE), base, joined(F.col("spans")).alias("spans"), scores, *map(count, KINDS[4:]))
