"""Personal data: patterns propose spans, checksums confirm them, and nearby
words adjust the score.

Base kinds (leftmost, non-overlapping within a kind; a proposal that fails
its check is dropped and not retried): ``email``, ``ip`` (parts up to 255),
``card`` (14 to 19 digits passing Luhn), ``phone`` (a plus, 10 to 15 digits).
The method adds ``iban`` (mod-97; of a longer run of groups, the length that
its country code has) and, where words nearby speak for them,
``ssn`` and ``account`` (8 to 13 digits).  Base spans always stay; an added
span stays if its score reaches ``LEAST_SCORE``.

Rows: null text counts as empty and has no span; offsets are code points, the
end exclusive; spans of different kinds may overlap; equal rows are treated
alike.  Other columns are kept but for those named like an output.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.llm import shared

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account")
BASE = KINDS[:4]
#: Code points before a span in which words count.
NEARBY = 40
LEAST_SCORE = 0.5

#: Score of a proposal that passed its check, by kind.
_START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.3, "account": 0.1}
#: Words that speak for a kind, in the languages of the corpus.
_SPEAKS = {
    "email": r"e-?mail|mail|correo|courriel",
    "ip": r"ip|address|host|server|adresse|dirección",
    "card": r"card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": r"phone|tel|telephone|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social security|taxpayer",
    "account": r"account|acct|customer no|konto|kontonummer|compte|cuenta",
}
#: Words that speak against any kind.
_AGAINST = re.compile(r"\b(?:example|sample|version|order|invoice|isbn|beispiel|exemple|ejemplo)\b", re.I)
_NEAR = {kind: re.compile(rf"\b(?:{words})\b", re.I) for kind, words in _SPEAKS.items()}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN, by country code.
_IBAN_LENGTH = {country: int(n) for n, countries in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
    "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST "
    "26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE "
    "31:MT,SC 32:LC 33:RU").split()) for country in countries.split(",")}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![0-9.+-])[0-9]{8,13}(?![0-9.-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the check digits of an IBAN hold."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ibans(text: str) -> list[tuple[int, int]]:
    """From each place where one can begin: its country's length if a group
    ends there, else the whole run of groups; the search goes on after the
    span, or after the check digits if there is none."""
    out, m = [], _IBAN.search(text)
    while m:
        run, ends = m[0], [len(m[0])]
        at = [i for i, c in enumerate(run) if c != " "]
        n = _IBAN_LENGTH.get(run[:2], 0)
        if 0 < n < len(at) and at[n - 1] + 1 < at[n]:
            ends.insert(0, at[n - 1] + 1)
        end = next((e for e in ends if mod97(run[:e])), 0)
        if end:
            out.append((m.start(), m.start() + end))
        m = _IBAN.search(text, m.start() + (end or 4))
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> list[tuple[int, int]]:
    """From each at sign: the local part before it, the domain after it, so
    that the work is linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        back = _LOCAL.match(text[free:at][::-1])
        domain = _DOMAIN.match(text, at + 1)
        if back and domain:
            out.append((at - back.end(), domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of all kinds."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    found += [("iban", a, b) for a, b in _ibans(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)] if "-" in text else []
    return found + [("account", *m.span()) for m in _ACCOUNT.finditer(text)]


def spans(text: str | None) -> list[dict]:
    """All spans with their scores, by start and then kind."""
    text = text or ""
    out = []
    for kind, start, end in proposals(text):
        before = text[max(0, start - NEARBY):start]
        score = _START[kind] + 0.4 * bool(_NEAR[kind].search(before)) - 0.2 * bool(_AGAINST.search(before))
        score = min(1.0, max(0.0, score))
        if kind in BASE or score >= LEAST_SCORE:
            out.append({"kind": kind, "start": start, "end": end, "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def joined(found: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the
    first, and the longest of those that start together, names the whole."""
    found = spans(text)
    if text is None or not found:
        return text
    out, at, reach = [], 0, 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= reach:
            out += [text[at:s["start"]] if at <= s["start"] else "", f"<{s['kind'].upper()}>"]
        reach = at = max(reach, s["end"])
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns with ``pii``, the spans (kind, start, end, score)."""
    kept = [f for f in docs.schema if f.name != "pii"]
    schema = StructType([*kept, *_parse_datatype_string("pii array<struct<kind:string,start:int,end:int,score:double>>").fields])

    def start():
        def apply(batch):
            return {f.name: batch.column(f.name) for f in kept} | {"pii": [*map(spans, batch.column(text).to_pylist())]}

        return apply

    return shared.map_slices(docs.select(*(F.col(f"`{f.name}`") for f in kept)), start, schema, text)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, with the spans in the text masked."""
    names = docs.columns

    def start():
        def apply(batch):
            return {n: batch.column(n) for n in names} | {text: [*map(masked, batch.column(text).to_pylist())]}

        return apply

    return shared.map_slices(docs, start, docs.schema, text)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")

    def listed(which: str):
        return F.expr(f"array_join(transform({which}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    base = "filter(pii, s -> s.kind IN ('email', 'ip', 'card', 'phone'))"
    return find(docs).select(
        "doc_id", *(F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("pii").alias("spans"))


__all__ = ["find", "joined", "mask", "masked", "op3_pii", "spans"]
