"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Each proposal starts with the score of its pattern.  A passed checksum raises it, a failed one drops
the span; whole words near the span that name its kind raise it, words that name another use lower it, the
nearest of each sort by its distance.  Only what stands right before a secret may be part of a longer name.
Spans of the four base kinds (email, ip, card, phone) are exactly those of the base rules and always
stay.  The method adds spans of the kinds ``iban`` (mod 97), ``ssn`` and ``phone_local``, shorter card numbers
(13 to 15 digits, Luhn) and ``secret`` (keys and tokens), where the score reaches ``MIN_SCORE``; an added
span that overlaps one before it, in the order of kinds, is left out.

Defined results: a null text counts as empty and gives no span; texts are read whole, in time that grows
with their length; repeated rows give repeated results; an empty table gives no rows; other columns of
the input play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import read

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "card_short", "phone_local", "secret")
BASE_KINDS = KINDS[:4]
MIN_SCORE = 0.6
#: Characters on either side of a span in which context words count.
CONTEXT = 48

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match never begins inside a digit run: what fails from its first digit fails from the others too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_PHONE_LOCAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w.-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9+/_-])")
_HINT = re.compile(r"[0-9@]")

#: What a context word adds or takes: the first at the edge of CONTEXT, both next to the span.
FAR, NEAR = 0.25, 0.1


def _words(*forms: str) -> re.Pattern:
    """Any of the forms as whole words: no letter, digit or underscore on either side."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(forms)})(?!\w)", re.I)


#: kind: (score of the pattern, gain of a passed checksum, words for it, words against it)
RULES = {
    "iban": (0.3, 0.4, _words("iban", "(?:bank )?account", "konto(?:nummer)?", "compte", "cuenta", "bank"), None),
    "ssn": (0.35, 0.0, _words("ssn", "social security", "sozialversicherung(?:snummer)?", "s[eé]curit[eé] sociale", "seguridad social"), _words("isbn", "orders?", "invoices?", "version")),
    "card_short": (0.3, 0.2, _words("(?:credit ?)?cards?", "(?:kredit)?karten?", "cartes?", "tarjetas?", "visa", "amex", "credit"), _words("orders?", "invoices?", "isbn", "tracking", "serial")),
    "phone_local": (0.4, 0.0, _words("(?:tele)?phones?", "tel", "calls?", "call(?:ed|ing)", "mobile", "fax", "t[eé]l[eé]phone", "telefon(?:nummer)?", "anruf(?:en)?", "tel[eé]fono", "ll[aá]m(?:e|a|ar|enos|ame)", "appel(?:ez|er)?"), _words("orders?", "invoices?", "isbn", "version", "serial")),
    "secret": (0.0, 0.35, re.compile(r"(?:token|secret|passw(?:or)?d|pwd|credentials?|(?:api|access|private|auth)[ _-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?$", re.I), None),
}


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check digits of account numbers: rearranged and spelt as a number, the rest by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    # The part before each @ is the run of its characters up to there, after the match before: one pass
    # back from each @ instead of a scan from every character.
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        tail = _TAIL.match(text, at) if start < at else None
        if tail:
            end = tail.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def mixed(key: str) -> bool:
    """Letters and digits in turn, as keys have them: not a word, not a number."""
    return len(re.findall(r"[0-9]+", key)) >= 3 and any(c.isalpha() for c in key)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base kinds; code points, end exclusive."""
    out = {k: [] for k in BASE_KINDS}
    if not _HINT.search(text):
        return out
    out["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


def _score(kind: str, text: str, start: int, end: int, checked: bool) -> float:
    score, gain, good, bad = RULES[kind]
    if kind == "secret":  # what makes a key a secret stands right in front of it
        return score + gain * checked + 0.3 * bool(good.search(text[max(0, start - CONTEXT) : start]))
    return score + gain * checked + _weight(good, text, start, end) - (_weight(bad, text, start, end) if bad else 0)


def _weight(words: re.Pattern, text: str, start: int, end: int) -> float:
    """What the nearest of the words within CONTEXT characters counts; 0 if there is none."""
    far = []
    for m in words.finditer(text, max(0, start - CONTEXT), min(len(text), end + CONTEXT)):
        cut = m.end() == end + CONTEXT < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_")  # a pattern sees nothing beyond its last place
        if (m.end() <= start or m.start() >= end) and not cut:
            far.append(start - m.end() if m.end() <= start else m.start() - end)
    return FAR + NEAR * (1 - min(far) / CONTEXT) if far else 0.0


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans beyond the base rules whose score reaches MIN_SCORE; none overlaps a span kept before."""
    out = {k: [] for k in KINDS[4:]}
    if not _HINT.search(text):
        return out
    taken = bytearray(len(text))
    for spans in base.values():
        for a, b in spans:
            taken[a:b] = b"\1" * (b - a)

    def add(kind: str, start: int, end: int, checked: bool) -> None:
        if _score(kind, text, start, end, checked) >= MIN_SCORE and taken.find(1, start, end) < 0:
            out[kind].append((start, end))
            taken[start:end] = b"\1" * (end - start)

    for m in _IBAN.finditer(text):
        # a greedy match may run on into a following capital word: the longest checked prefix counts
        for cut in [len(m[0]), *(i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]:
            code = m[0][:cut].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                add("iban", m.start(), m.start() + cut, True)
                break
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            add("ssn", *m.span(), True)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 15 and luhn(digits):
            add("card_short", *m.span(), True)
    for m in _PHONE_LOCAL.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 12:
            add("phone_local", *m.span(), False)
    for m in _SECRET.finditer(text):
        if mixed(m[0]):
            add("secret", *m.span(), True)
    return out


def spans_line(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def find_private(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: base counts, digest of the base spans, all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base)
                digest = hashlib.sha256(spans_line(base).encode()).hexdigest()
                rows.append((doc_id, *(len(base[k]) for k in BASE_KINDS), digest, spans_line(base | more), (n := sum(map(len, more.values()))), n + sum(map(len, base.values()))))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(read(spark, sf_dir, "documents"))
