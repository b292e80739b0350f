"""Personal data: patterns propose spans, checksums confirm them, words nearby
adjust the score.

Kinds and what confirms them: email; ip (four parts of at most 255); card (13 to
19 digits, Luhn); phone (9 to 15 digits after a plus); iban (letters, the
country's length and mod-97 of ISO 13616; codes without a known length end at
the last border of a word that mod-97 confirms); ssn (three groups of digits, ruled-out areas left out).
Every confirmed span starts with its kind's score; words of the kind's context
within CONTEXT code points before it raise the score, words that tell of other
numbers lower it. Spans of the first four kinds stay at any score; the added
kinds need THRESHOLD, which ssn reaches only with its context.

Positions are code points, ends exclusive. Per kind the spans are the leftmost
non-overlapping matches, and a match that a check rejects is dropped without
another try inside it; only after a rejected iban the search goes on behind its
first four characters. The search runs from the characters that a kind can't
miss (an @, a plus, a digit run), so it takes time in proportion to the text,
also for very long runs.

Defined results: null and empty texts have no spans; rows are independent, so
repeated rows repeat results; an empty table gives an empty result; other
columns are passed through by `redact` and not looked at by `find`. Redaction
replaces the union of overlapping spans by the first one's kind in angle
brackets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.text import trimmed
from flowlens.session import configure

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = (*BASE, *ADDED)
CONTEXT = 48
THRESHOLD = 0.5

#: Start scores, context words that raise a kind's score, words that lower it.
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
RAISING = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "pay"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
LOWERING = ("version", "order", "invoice", "isbn", "build", "ticket", "page")
RAISE, LOWER = 0.25, 0.25

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ALNUM = re.compile(r"[A-Za-z0-9]")
#: Characters of an account number by country, of ISO 13616's registry and of countries that use IBANs outside it.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
    "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 "
    "YE30 AO25 BF28 BJ28 CF27 CG27 CI28 CM27 CV25 DZ26 GA27 GQ27 GW25 IR26 KM27 MA28 MG27 ML28 MZ25 NE28 SN28 TD27 "
    "TG28").split()}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 on a compact IBAN."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)  # no local part goes over an @
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if len(m[0]) >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def _account_end(text: str, m: re.Match, lengths: Iterable[int], bound: int) -> int:
    """End of the proposed account by the first length that fits, 0 for none."""
    account = m[0].replace(" ", "")
    ends = [m.start() + i + 1 for i, c in enumerate(m[0]) if c != " "]
    for n in lengths:
        if n <= len(account) and ends[n - 1] <= bound and not ALNUM.match(text, ends[n - 1]) and mod97(account[:n]):
            return ends[n - 1]
    return 0


def ibans(text: str) -> Iterator[tuple[int, int]]:
    found, others, at = [], [], 0
    while m := IBAN.search(text, at):
        at = m.start() + 4
        if not (length := IBAN_LENGTHS.get(m[0][:2])):
            others.append(m)
        elif end := _account_end(text, m, (length,), len(text)):
            found.append((m.start(), end))
            at = end
    starts, k, last = [s for s, _ in found], 0, 0
    for m in others:  # not over an account of a known length
        while k < len(starts) and starts[k] < m.start():
            k += 1
        bound = starts[k] if k < len(starts) else len(text)
        if m.start() >= last and (end := _account_end(text, m, range(34, 14, -1), bound)):
            found.append((m.start(), end))
            last = end
    yield from sorted(found)


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def score(kind: str, text: str, start: int) -> float:
    near = set(WORD.findall(text[max(0, start - CONTEXT):start].lower()))
    value = START[kind] + RAISE * (not near.isdisjoint(RAISING[kind])) - LOWER * (not near.isdisjoint(LOWERING))
    return min(1.0, max(0.0, value))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    if not text:
        return []
    out = []
    for kind, find in FINDERS.items():
        for start, end in find(text):
            value = score(kind, text, start)
            if kind in BASE or value >= THRESHOLD:
                out.append((kind, start, end, value))
    return out


def redacted(text: str | None) -> str | None:
    found = sorted((s, e, k) for k, s, e, _ in spans(text))
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][1])
            i += 1
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def _texts(column: pa.Array, at_once: int = 64) -> Iterator[str | None]:
    """Python strings a few at a time, whatever the batch holds."""
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


FOUND = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: counts of the first four kinds, a digest of
    their spans, all spans as kind:start:end and the largest score."""
    configure(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                found = spans(text)
                names = [f"{k}:{s}:{e}" for k, s, e, _ in found]
                kinds = [f[0] for f in found]
                base = ",".join(n for n, k in zip(names, kinds) if k in BASE)
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(names),
                             max((f[3] for f in found), default=0.0)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)],
                                             [c.split()[0] for c in FOUND.split(", ")])

    ids = F.col(id_col).cast("long").alias("id")
    return docs.select(ids, F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND) \
        .withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """`docs` with the personal data in `text_col` replaced, and `chars_col`
    (if there is one) set to the new length; all other columns as they are."""
    configure(docs.sparkSession)
    names, place = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            column = pa.array((redacted(t) for t in _texts(batch.column(place))), batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place).name, column)

    schema = T.StructType([T.StructField(f"c{i}", T.StringType() if i == place else f.dataType, True)
                           for i, f in enumerate(docs.schema.fields)])
    plain = docs.toDF(*schema.names).withColumn(f"c{place}", F.col(f"c{place}").cast("string"))
    out = plain.mapInArrow(trimmed(run), schema).toDF(*names)
    if chars_col not in names:
        return out
    kind = docs.schema[chars_col].dataType
    return out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col))
                          .otherwise(F.char_length(text_col)).cast(kind))
