"""Personal data: patterns propose spans, checksums confirm, context words score.

Every kind has one pattern. A proposal becomes a span when its check holds (octets
of an address, Luhn for cards, mod-97 for IBANs, digit counts for phones) and its
score, raised by context words close by, reaches the threshold. The four base kinds
(email, ip, card, phone) start above the threshold, so context never removes them;
``iban`` is confirmed by its checksum alone, while ``local_phone`` and
``national_id`` are weak patterns that only context words lift over the threshold.

Defined results: a null or empty text has no spans; spans are leftmost and do not
overlap within a kind; positions are code points, the end exclusive; repeated rows
are handled row by row; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import map_batches, small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "national_id")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5
#: Score before context words.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.3, "national_id": 0.3}
#: Words that raise the score of a kind when they stand within WINDOW code points.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "national_id": ("ssn", "social security", "national id", "passport"),
}
WINDOW = 40
BOOST = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CONTEXT_RE = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")(?![a-z])") for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: country and check digits moved to the end, letters as 10 to 35."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the local part is the run of its
    characters before it, back to the last match; linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in s.split("."))


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass the checks of their kind, before scoring."""
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    for m in _IP.finditer(text):
        if _octets(m[0]):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for kind, pattern in (("local_phone", _LOCAL_PHONE), ("national_id", _NATIONAL)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` ordered by start, then kind as listed."""
    out = []
    for kind, a, b in propose(text or ""):
        near = text[max(0, a - WINDOW) : a].lower() + " " + text[b : b + WINDOW].lower()
        score = min(1.0, PRIOR[kind] + BOOST * bool(_CONTEXT_RE[kind].search(near)))
        if score >= THRESHOLD:
            out.append((kind, a, b, round(score, 2)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect_pii(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Adds ``out``, the spans of every whole text; a column of that name is replaced. A null
    or empty text has none, repeated rows are repeated, an empty table stays empty. Map-only:
    nothing is shuffled."""

    small_batches(df.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_spans(t)] for t in texts])

    return df.withColumn(out, spans(F.col(text)))


def redact(text: str | None) -> str | None:
    """Each span becomes its kind in angle brackets; of overlapping spans the
    earliest, then the longest, is replaced. Null stays null."""
    if not text:
        return text
    parts, last = [], 0
    for kind, a, b, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= last:
            parts += [text[last:a], f"<{kind.upper()}>"]
            last = b
    return "".join([*parts, text[last:]]) if parts else text


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the spans in ``text``; rows without personal data, null and empty texts are
    unchanged, and so are all other columns. Repeated rows are repeated."""

    small_batches(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact)

    return df.withColumn(text, clean(F.col(text)))


def pii_report(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans. A null text
    counts as empty (no spans, the digest of nothing); repeated ids and rows give a row each;
    an empty table gives none; other columns are not returned."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def report(batches):
        for batch in batches:
            ids, found = batch.column("doc_id"), [find_spans(t.as_py()) for t in batch.column("text")]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            write = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in x)
            yield {
                "doc_id": ids,
                **{f"n_{k}": [sum(s[0] == k for s in x) for x in base] for k in BASE_KINDS},
                "base_sha256": [hashlib.sha256(write(x).encode()).hexdigest() for x in base],
                "spans": [write(x) for x in found],
            }

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), report, schema)
