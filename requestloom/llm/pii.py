"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are ``email``, ``ip``, ``card`` (12 to 19 digits that pass Luhn) and ``phone`` (9 to 15 digits).  The method
adds ``iban`` (mod-97), and ``id`` for numbers of nine digits in groups of three, two and four.  Added spans count from a
score of ``LEAST``; base spans always stay.  Patterns are searched left to right without overlap, in time linear in the
text.

Null and empty texts have no spans.  Rows are independent; repeated rows and ids give repeated rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from . import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id")
#: Score of a confirmed proposal, of one without a checksum, what a context word adds, and from where added kinds count.
CONFIRMED, PROPOSED, CONTEXT, LEAST = 0.8, 0.4, 0.2, 0.6
#: Characters before and after a span that are searched for context words.
NEAR = 40
WORDS = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|visa|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank)\b"),
    "id": re.compile(r"(?i)\b(?:ssn|social security|identity|id)\b"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from every later digit too, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
PHONE_BODY = re.compile(r"\+(?=[0-9])[ ().0-9-]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        # What lies left of this sign ends with it: a later match starts behind it.
        done = max(done, at + 1)
        at = text.find("@", done)


def ips(text: str):
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in match[0].split(".")):
            yield match.span()


def cards(text: str):
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = match[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def phones(text: str):
    at = text.find("+")
    while at >= 0:
        body = PHONE_BODY.match(text, at)
        end = len(body[0].rstrip(" ().-")) + at if body else at
        if end - at >= 4:
            if 9 <= sum(map(str.isdigit, text[at:end])) <= 15:
                yield at, end
        at = text.find("+", max(end, at + 1))


def ibans(text: str):
    for match in IBAN.finditer(text):
        if mod97(match[0].replace(" ", "")):
            yield match.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + "\n" + text[end : end + NEAR]
    return (PROPOSED if kind == "id" else CONFIRMED) + CONTEXT * bool(WORDS[kind].search(near))


def find_spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, number of the kind, end, score) of all spans, in order; offsets count code points."""
    if not text:
        return []
    found = []
    for number, kind in enumerate(KINDS):
        spans = FINDERS[kind](text) if kind in FINDERS else (m.span() for m in ID.finditer(text))
        for start, end in spans:
            points = score(text, kind, start, end)
            if kind in BASE or points >= LEAST:
                found.append((start, number, end, points))
    return sorted(found)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col`` and spans, an array of (kind, start, end, score) in order of start, then kind."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>"

    def find(batches):
        import pyarrow as pa

        row = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in find_spans(text.as_py())]
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(row))], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(find, schema)
