"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and gives anchors: at-signs,
schemes' `://`, plus signs, digits, cue words of identifiers and first characters
of keys.  From each anchor a deterministic local parser expands to the exact boundaries and
validates what it found.  Kinds with their bounds (BASE kinds equal a search
by the pattern, leftmost and non-overlapping; a match that fails its test is
consumed, not retried):

    email    local part, at-sign, at least two labels
    ip       four runs of digits with dots, each at most 255
    card     14 to 19 digits, single blanks or hyphens between, Luhn
    phone    plus sign, digits with blanks, brackets, dots, hyphens; 10 to 15 digits
    account  after a cue word: IBAN with its check number, or 6 to 20 digits
    url      scheme, host with a dot, up to a blank, quote or bracket, that carries user data: a user part or a query
    secret   after a cue word and a sign of assignment: 16 or more key characters with letters and digits; or a key that its first characters give away

Defined results: null or empty text has no spans; spans are code points, end
exclusive; equal matches in repeated rows are reported in each; an empty table
gives an empty result; a very long text is read whole, in time proportional to
its length (a parser that fails in a run of characters isn't tried again in it).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .tokens import per_task

KINDS = ("email", "ip", "card", "phone", "account", "url", "secret")
BASE = KINDS[:4]
RANK = {k: i for i, k in enumerate(KINDS)}

#: Cue words, matched in lower, title and upper case at word bounds.
ACCOUNT_CUES = ("iban", "account", "account number", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "passport", "tax id")
SECRET_CUES = ("token", "password", "passwd", "secret", "api key", "api_key", "apikey", "access_key", "private_key", "bearer")

#: First characters of well-known keys, and their forms.
KEYS = {
    "AKIA": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "AIza": r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])",
    "ghp_": r"ghp_[A-Za-z0-9]{36,}",
    "gho_": r"gho_[A-Za-z0-9]{36,}",
    "sk-": r"sk-[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*(?<=[A-Za-z0-9_-]{23})",
    "sk_live_": r"sk_live_[A-Za-z0-9]{16,}",
    "xoxb-": r"xoxb-[A-Za-z0-9-]{20,}",
    "xoxp-": r"xoxp-[A-Za-z0-9-]{20,}",
    "eyJ": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "-----BEGIN ": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|id)\b\.?)?[\x20:=#]{0,4}(?P<v>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9](?:[\x20-]?[0-9]){5,19})(?![A-Za-z0-9])")
URL = re.compile(r"(?:(?P<user>[^\s/?#\"'<>()@]+)@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?P<path>/[^\s?#\"'<>()]*)?(?P<query>\?[^\s#\"'<>()]+)?")
SECRET = re.compile(r"[\x20]{0,2}[=:][\x20]{0,2}[\"']?(?P<v>[A-Za-z0-9_+/=.-]{16,})")

KEY_RUN = re.compile(r"[A-Za-z0-9_-]*")

RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Finder:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind in [("@", "at"), ("://", "scheme"), ("+", "plus"), *((d, "digit") for d in "0123456789")]:
            self.automaton.add_word(word, (kind, len(word)))
        for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for cue in cues:
                for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
                    self.automaton.add_word(form, (kind, len(form)))
        self.keys = {start: re.compile(form) for start, form in KEYS.items()}
        for start in KEYS:
            self.automaton.add_word(start, ("key", len(start)))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind as listed."""
        found: list[tuple[int, int, str]] = []
        after = dict.fromkeys(KINDS, 0)
        #: Ends of runs of key characters in which a cue or a key's start has failed: later ones in the same run fail too.
        dead: dict[str, int] = {}
        run = -2
        for last, (anchor, length) in self.automaton.iter(text):
            if anchor == "digit":
                fresh, run = run != last - 1, last
                if fresh and last >= after["ip"] and (m := IP.match(text, last)):
                    after["ip"] = m.end()
                    if all(octet(p) for p in m[0].split(".")):
                        found.append((last, m.end(), "ip"))
                if last >= after["card"] and (m := CARD.match(text, last)):
                    after["card"] = m.end()
                    digits = re.sub("[^0-9]", "", m[0])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, m.end(), "card"))
            elif anchor == "at":
                start = last
                while start > after["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < last and (m := DOMAIN.match(text, last + 1)):
                    after["email"] = m.end()
                    found.append((start, m.end(), "email"))
            elif anchor == "plus":
                if last >= after["phone"] and (m := PHONE.match(text, last)):
                    after["phone"] = m.end()
                    if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                        found.append((last, m.end(), "phone"))
            elif anchor == "scheme":
                start = last - 2
                while start > after["url"] and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                    start -= 1
                if start < last - 2 and (m := URL.match(text, last + 1)):
                    after["url"] = m.end()
                    if m["user"] or m["query"]:
                        found.append((start, m.end(), "url"))
            elif anchor == "key":
                start = last + 1 - length
                if start >= after["secret"] and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                    form = text[start : last + 1]
                    if start < dead.get(form, 0):
                        continue
                    if m := self.keys[form].match(text, start):
                        after["secret"] = m.end()
                        found.append((start, m.end(), "secret"))
                    elif form in ("sk-", "eyJ"):
                        dead[form] = KEY_RUN.match(text, start).end()
            else:
                start = last + 1 - length
                if start >= after[anchor] and not (start and text[start - 1].isalnum()):
                    m = None if start < dead.get(anchor, 0) else (ACCOUNT if anchor == "account" else SECRET).match(text, last + 1)
                    if m:
                        value = m["v"]
                        if anchor == "account":
                            good = iban(value) if value[0].isalpha() else True
                        else:
                            good = any(c in DIGITS for c in value) and any(c.isalpha() for c in value)
                        if good:
                            after[anchor] = m.end()
                            found.append((m.start("v"), m.end("v"), anchor))
                        elif anchor == "secret" and not any(c in DIGITS for c in value):
                            dead[anchor] = m.end()
        return sorted(found, key=lambda x: (x[0], RANK[x[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """RESULT, one row per document."""
    finder = per_task(Finder)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digest, spans = [], []
            for text in batch.column(1):
                own = finder().find(text.as_py() or "")
                base = [x for x in own if x[2] in BASE]
                for k in BASE:
                    counts[k].append(sum(x[2] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(step, RESULT)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span (of overlapping ones the first, widened over the others) as its kind in brackets."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += (text[at:start], f"<{kind}>")
        at = end
        k += 1
    return "".join((*out, text[at:]))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal data of one text column masked; null stays null, other columns stay."""
    finder = per_task(Finder)
    schema = docs.schema
    at = schema.fieldNames().index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, finder().find(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(step, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))


def brute(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """BASE spans by searching with the contract's patterns; for tests."""
    text = text or ""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(octet(x) for x in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out
