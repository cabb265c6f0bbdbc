"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds email, ip, card and phone follow the base patterns (leftmost, non-overlapping for each kind; a failing match is
dropped without a retry). The method adds iban (mod-97; of a failing match the shorter ends at its spaces are tried,
then later starts), ssn and secret (of any length from LEAST_TOKEN). Each span has a score: its kind's own confidence,
raised by a context word within CONTEXT_CHARS before it. Added spans need LEAST_SCORE: the checksum alone is enough for
an iban, while ssn and secret, which no checksum confirms, need the context word.

Defined cases: null text is the empty text, which has no spans; offsets are code points, end exclusive; long runs of
one character class are scanned once, not once for each start; repeated rows are treated row by row; other columns
are ignored (find) or kept as they are (redact). In redact, overlapping spans are merged and replaced together by the
name of the one that starts first.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_documents, narrow, numbered, read_table, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
CONTEXT_CHARS = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
TOKEN = re.compile(r"[A-Za-z0-9_+/-]++")
TOKEN_START = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_+/-]")
LEAST_TOKEN = 20
NOT_LETTERS = "0123456789_+/-"
NOT_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_+/-"
KEYED = re.compile(r"(?i)(?:secret|token|passw|key|auth|bearer|credential)")

#: (own confidence, words that raise it)
CONTEXT = {
    "email": (0.9, re.compile(r"(?i)\b(?:e-?mail|contact|write|mail)\b")),
    "ip": (0.6, re.compile(r"(?i)\b(?:ip|host|server|address|login)\b")),
    "card": (0.8, re.compile(r"(?i)\b(?:card|visa|credit|payment|mastercard)\b")),
    "phone": (0.7, re.compile(r"(?i)\b(?:phone|call|tel|mobile|fax)\b")),
    "iban": (0.9, re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b")),
    "ssn": (0.4, re.compile(r"(?i)\b(?:ssn|social|security)\b")),
    "secret": (0.4, KEYED),
}
RAISE = 0.3
LEAST_SCORE = 0.5


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn test."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces passes ISO 7064 mod 97-10."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        else:  # the run before the next sign starts after this one, which is no local character
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(map(_small, m.groups()))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    found, m = [], IBAN.search(text)
    while m:
        spaces = [i for i in range(m.start(), m.end()) if text[i] == " "]
        for end in [m.end(), *reversed(spaces)]:
            bare = text[m.start() : end].replace(" ", "")
            if 15 <= len(bare) <= 34 and mod97(bare):
                found.append((m.start(), end))
                break
        else:
            end = spaces[0] if spaces else m.end()
        m = IBAN.search(text, end)
    return found


def ssns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SSN.finditer(text)] if "-" in text else []


def secrets(text: str) -> list[tuple[int, int]]:
    """Long tokens with a letter and a digit near a word that announces a key; only the text just after such words is searched.

    A token has no greatest length. Its end, last letter and last digit are looked up once for all starts in it.
    """
    found, last = [], 0
    start = end = letter = digit = 0
    for k in KEYED.finditer(text):
        for m in TOKEN_START.finditer(text, k.end(), k.end() + CONTEXT_CHARS + 1):
            a = m.start()
            if not start <= a < end:
                start, end = TOKEN.match(text, a).span()
                token = text[start:end]
                letter, digit = (start + len(token.rstrip(others)) - 1 for others in (NOT_LETTERS, NOT_DIGITS))
            if end - a >= LEAST_TOKEN and a <= letter and a <= digit:
                if a >= last:
                    found.append((a, end))
                    last = end
                break
    return found


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns, "secret": secrets}


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind in the order of FINDERS, then start. Added kinds need LEAST_SCORE; base kinds all stay."""
    found = []
    for kind, find in FINDERS.items():
        own, words = CONTEXT[kind]
        for a, b in find(text):
            score = min(1.0, own + RAISE * bool(words.search(text, max(0, a - CONTEXT_CHARS), a)))
            if kind in BASE or score >= LEAST_SCORE:
                found.append((kind, a, b, round(score, 2)))
    return found


def listed(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def masked(text: str, found) -> str:
    """`text` with each span replaced by its kind in angle brackets."""
    merged: list[list] = []
    for kind, a, b, *_ in sorted(found, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) of every text."""

    def run(columns):
        return {"doc_id": columns["doc_id"], "spans": [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t)] for t in columns["text"]]}

    return map_documents(_rows(docs), run, "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in text masked and n_chars brought up to date; other columns and null texts stay."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t, spans(t)))

    plain, places, at = numbered(docs)
    text = at["text"]
    out = plain.withColumn(text, mask(F.col(text).cast("string")))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.char_length(text).cast(plain.schema[at["n_chars"]].dataType))
    return out.select(*places).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, the list of all spans, their number, and their scores in the same order."""

    def run(columns):
        out = {"doc_id": columns["doc_id"], **{f"n_{k}": [] for k in BASE}, "base_sha256": [], "spans": [], "n_spans": [], "scores": []}
        for text in columns["text"]:
            found = spans(text)
            for k in BASE:
                out[f"n_{k}"].append(sum(s[0] == k for s in found))
            out["base_sha256"].append(hashlib.sha256(listed(s for s in found if s[0] in BASE).encode()).hexdigest())
            out["spans"].append(listed(found))
            out["n_spans"].append(len(found))
            out["scores"].append(",".join(f"{s[3]:.2f}" for s in found))
        return out

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return map_documents(_rows(docs), run, f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long, scores string")


def _rows(docs: DataFrame) -> DataFrame:
    return narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"))
