"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are email, ip, card and phone, each leftmost and non-overlapping in itself; card needs 13
to 19 digits and Luhn's check, ip parts of at most 255, phone 9 to 15 digits, and what fails is
dropped without another try. The method adds iban (the country's length, mod-97) and secret (a run of 20
or more hexadecimal or base-64 characters, letters and digits among them, as credentials look).

A confirmed span has a score: a prior by kind; more where words that speak for the kind stand within
`window` characters (a bank for an iban, a credential's name for a secret), and where it is assigned to
something; less where words speak for another thing (a checksum, a serial number). Base spans stay
whatever their score, as their contract says; the added kinds must reach `threshold`, and there context
decides: a long token that nothing names a secret is none, and an iban among serial numbers is none.

Offsets are code points, the end exclusive. Null texts are empty. Patterns run in linear time on
any text, however long: look-behinds stop a run of digits from being tried at each of its digits, and an email is
sought around each at sign.
"""

from __future__ import annotations

import hashlib
import re
from collections import namedtuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Span = namedtuple("Span", "kind start end score")
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_ASSIGNED = re.compile(r"[:=]\s{0,3}[\"']?$")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Fixed lengths of an iban by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_OTHER = r"(?i)\b(?:serial|part|order|invoice|tracking|isbn|sku|version|build|example)\b"
#: Prior score, words that raise it by 0.3 when they stand near, and words that lower it by 0.3.
CONTEXT = {
    "email": (0.6, re.compile(r"(?i)mail|contact|write|reach"), re.compile(r"(?i)example|noreply")),
    "ip": (0.5, re.compile(r"(?i)\bip\b|address|host|server|login"), re.compile(r"(?i)\b(?:version|release|section|chapter)\b")),
    "card": (0.6, re.compile(r"(?i)card|visa|master|credit|payment|carte|tarjeta|karte"), re.compile(_OTHER)),
    "phone": (0.5, re.compile(r"(?i)phone|tel|call|mobile|fax|handy"), re.compile(_OTHER)),
    "iban": (0.6, re.compile(r"(?i)iban|bank|account|konto|compte|cuenta"), re.compile(_OTHER)),
    "secret": (0.3, re.compile(r"(?i)token|secret|api[_-]?key|passw(?:or)?d|access[_-]?key|private[_-]?key|credential|bearer"), re.compile(r"(?i)\b(?:sha-?\d*|md5|checksum|digest|commit|uuid|etag|hash)\b")),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return len(s) == IBAN_LENGTHS.get(s[:2]) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)  # the class has no at sign, so no later local part reaches over it
        at = text.find("@", free)


def _digits(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def find(text: str | None, window: int = 40, threshold: float = 0.5) -> list[Span]:
    """All spans, by kind as KINDS lists them and then by start."""
    text = text or ""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if re.search(r"[0-9]", text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0])]
        found += [("secret", *m.span()) for m in _SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    out = []
    for kind, start, end in found:
        prior, speaks_for, speaks_against = CONTEXT[kind]
        about = [text[max(0, start - window) : start], text[end : end + window]]
        score = prior + 0.3 * any(map(speaks_for.search, about)) - 0.3 * any(map(speaks_against.search, about))
        if kind == "secret":
            score += 0.2 * bool(_ASSIGNED.search(about[0]))
        score = round(min(1.0, max(0.0, score)), 6)
        if kind in BASE or score >= threshold:
            out.append(Span(kind, start, end, score))
    return out


def _joined(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """Columns `keep` with counts of the base kinds, base_sha256, spans, and found (spans with scores)."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.select(*keep).schema
    for k in BASE:
        out = out.add(f"n_{k}", "long")
    out = out.add("base_sha256", "string").add("spans", "string")
    out = out.add("found", docs.sparkSession.createDataFrame([], "x array<struct<kind:string,start:long,end:long,score:double>>").schema[0].dataType)
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(batch.num_columns - 1).to_pylist():
                spans = find(t, **options)
                base = [s for s in spans if s.kind in BASE]
                for c, v in zip(cols, (*(sum(s.kind == k for s in base) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [s._asdict() for s in spans]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[-7:], strict=True))], schema=arrow)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, out)


def redact_text(text: str | None, **options) -> str | None:
    """text with each span replaced by its kind in brackets; of overlapping spans the leftmost, longest."""
    if not text:
        return text
    out, at = [], 0
    for s in sorted(find(text, **options), key=lambda s: (s.start, -s.end)):
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """docs with the spans in `text` replaced; column `length`, where named, gets the new length."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text), docs.schema

    def run(batches):
        for batch in batches:
            new = pa.array([redact_text(t, **options) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    return out.withColumn(length, F.length(text).cast(schema[length].dataType)) if length else out
