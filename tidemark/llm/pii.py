"""Personal data: regular expressions propose spans, checksums confirm, context words score.

Cases: a null text is an empty text; a null doc_id is kept; repeated rows give repeated
results; an empty table gives no rows; other columns are dropped by scan_documents and kept
by redact_documents. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS

# The characters of an address before its @, and the patterns of the base kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can't begin inside a run of digits, as an earlier begin would match as well: hence
# the look-behind and the possessive runs, which keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Lengths of international account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

#: What follows the first four characters of an account number, by country.
_REST = {c: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}") for c, n in IBAN_LENGTH.items()}

#: Score without context, and words that raise it when they stand near.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3}
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "address", "addresse", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "national_id": ("ssn", "social", "security", "identity"),
}
CONTEXT_REACH, CONTEXT_GAIN, ACCEPT = 48, 0.4, 0.5
#: A context word stands by itself, or in the plural: "ip" isn't in "ship".
_NEAR = {kind: re.compile(rf"(?<![a-z])(?:{'|'.join(words)})s?(?![a-z])") for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Goes from @ to @, so that a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done_here = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = done_here = m.end()
        else:
            done = max(done, at + 1)  # no later match begins at or before this @
        at = text.find("@", done_here)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Proposes the country's length at each begin; the search goes on after a number, or after a begin that fails."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done or not (rest := _REST.get(m[0][:2])) or not (r := rest.match(text, m.end())):
            continue
        if not text[r.end() : r.end() + 1].isalnum() and mod97(text[m.start() : r.end()].replace(" ", "")):
            yield m.start(), r.end()
            done = r.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All accepted spans as (kind, start, end, score), by kind as in KINDS, then start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    found += [("iban", a, b) for a, b in _ibans(text)]
    for m in _NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            found.append(("national_id", *m.span()))
    out = []
    for kind, a, b in found:
        near = (text[max(0, a - CONTEXT_REACH) : a] + " " + text[b : b + CONTEXT_REACH]).lower()
        score = SCORE[kind] + CONTEXT_GAIN * (1 - SCORE[kind]) * 2 * bool(_NEAR[kind].search(near))
        score = min(1.0, score)
        if kind in BASE_KINDS or score >= ACCEPT:
            out.append((kind, a, b, round(score, 4)))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def join_spans(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """Puts <KIND> in the place of each span; overlapping spans give one mark, of the first kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_COUNTS = "n_email long, n_ip long, n_card long, n_phone long, n_iban long, n_national_id long"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts by kind, digests, the joined spans and their top score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for text in batch.column(1).to_pylist():
                spans = find_spans(text)
                for i, kind in enumerate(KINDS):
                    cols[i].append(sum(s[0] == kind for s in spans))
                base = [s for s in spans if s[0] in BASE_KINDS]
                cols[6].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                cols[7].append(join_spans(spans))
                cols[8].append(max((s[3] for s in spans), default=0.0))
            types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "top_score"]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(scan, f"doc_id long, {_COUNTS}, base_sha256 string, spans string, top_score double")


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every accepted span of text_col replaced by its mark; all other columns stay."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    at = docs.columns.index(text_col)
    return docs.mapInArrow(scan, docs.schema)
