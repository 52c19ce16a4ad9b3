"""Personal data: expressions propose spans, checks confirm them, context words adjust their score."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, chunks, map_text, tidied

#: Order of the kinds where spans start together; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
RANK = {kind: k for k, kind in enumerate(KINDS)}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive digits, from a run's start: the same matches without retries inside a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
# A whole run of the characters that keys are written in; and keys that name their issuer by how they begin.
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=])")
_ISSUED = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abps]-|sk_live_|rk_live_|AIza|eyJ)")

#: Score that a confirmed candidate starts with, before its context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.4, "local_phone": 0.4, "secret": 0.4, "issued": 0.8}
#: Words that raise a kind's score when they stand within WINDOW code points.
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|whatsapp)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|whatsapp)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|transfer)\b"),
    "national_id": re.compile(r"(?i)\b(?:ssn|social security|insurance|tax id)\b"),
    "secret": re.compile(r"(?i)(?:\b|_)(?:token|secret|passw(?:or)?d|passwort|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|authorization|bearer|credentials?|key)\b"),
}
CONTEXT["issued"] = CONTEXT["secret"]
WINDOW = 40
#: What context adds, and the score from which a candidate of the method's own kinds counts.
BONUS, ENOUGH = 0.2, 0.5
#: Bits a character that a key needs: half of what 16 or 64 equally frequent ones would have, and more.
HEX_BITS, KEY_BITS = 3.0, 3.5
_HEX = re.compile(r"[0-9a-fA-F]+")


class Span(NamedTuple):
    """A find: half-open, in code points."""

    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    odd = sum(int(x) for x in digits[-1::-2])
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """The checksum of bank account numbers."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(x, 36)) for x in moved)) % 97 == 1


def entropy(code: str) -> float:
    """Bits a character, from how often each occurs."""
    n = len(code)
    return -sum(k / n * math.log2(k / n) for k in Counter(code).values())


def random_looking(code: str) -> bool:
    """Whether a run of key characters looks drawn at random: it has digits and letters, changes often between them, and has enough bits a character.

    Words, numbers, paths and identifiers made of words change seldom; hexadecimal keys have at most four bits a character.
    """
    core = code.rstrip("=")
    digits = [x.isdigit() for x in core]
    if not any(digits) or all(digits) or not any(x.isalpha() for x in core) or sum(a != b for a, b in zip(digits, digits[1:])) < len(core) / 8:
        return False
    return entropy(core) >= (HEX_BITS if _HEX.fullmatch(core) else KEY_BITS)


def _emails(text: str):
    """Leftmost matches of a local part, an at sign and a dotted domain, in one pass over the at signs."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The four base kinds, each with its own leftmost non-overlapping matches; matches that fail their check are dropped."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], RANK[x[2]]))


def _scored(text: str, start: int, end: int, kind: str) -> float:
    near = bool(CONTEXT[kind].search(text, max(0, start - WINDOW), start) or CONTEXT[kind].search(text, end, min(len(text), end + WINDOW)))
    return round(min(1.0, PRIOR[kind] + BONUS * near), 2)


class _Taken:
    """Intervals that are taken, merged and in order."""

    def __init__(self, found):
        self.starts, self.ends = [], []
        for a, b in sorted(found):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Take an interval, unless it touches one that is taken."""
        at = bisect_left(self.ends, a + 1)
        if at < len(self.starts) and self.starts[at] < b:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def spans(text: str | None, base: list[tuple[int, int, str]] | None = None) -> list[Span]:
    """All finds, by start and then kind. Base finds stay whatever their score; the method's own need ENOUGH.

    Own finds touch no other find, but for secrets, which may hold base finds: a key's digits can pass for a card.
    """
    text = text or ""
    base = base_spans(text) if base is None else base
    found = [Span(a, b, kind, _scored(text, a, b, kind)) for a, b, kind in base]
    more = [(*m.span(), "iban", "iban") for m in _IBAN.finditer(text) if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c)]
    more += [(*m.span(), "national_id", "national_id") for m in _NATIONAL.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    more += [(*m.span(), "phone", "local_phone") for m in _LOCAL_PHONE.finditer(text)]
    taken, own = _Taken(x[:2] for x in base), _Taken(())
    for a, b, kind, rule in more:
        score = _scored(text, a, b, rule)
        if score >= ENOUGH and taken.take(a, b):
            own.take(a, b)
            found.append(Span(a, b, kind, score))
    for m in _SECRET.finditer(text):
        score = _scored(text, *m.span(), "issued" if _ISSUED.match(m[0]) else "secret")
        if score >= ENOUGH and random_looking(m[0]) and own.take(*m.span()):
            found.append(Span(*m.span(), "secret", score))
    return sorted(found, key=lambda x: (x.start, RANK[x.kind], x.end))


def _joined(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans and their scores.

    A null or empty text has no spans; a null id stays null; repeated rows are found each. Texts of any length are read whole,
    in time linear in their length. Empty tables give empty tables.
    """

    def rows(ids, texts):
        out = {x: [] for x in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")}
        for text in texts:
            base = base_spans(text) if text else []
            every = spans(text, base) if text else []
            kinds = [x[2] for x in base]
            for kind in KINDS[:4]:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(x[:3] for x in every))
            out["scores"].append(",".join(f"{x.score:.2f}" for x in every))
        return out

    return map_text(docs, id_col, text_col, rows, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def mask(text: str | None) -> str | None:
    """The text with each find replaced by its kind in brackets; overlapping finds become one, named by the longer."""
    if not text:
        return text
    parts, last, group = [], 0, None
    for x in [*spans(text), None]:
        if group and x and x.start < group.end:
            longer = max(group, x, key=lambda y: y.end - y.start)
            group = Span(group.start, max(group.end, x.end), longer.kind, longer.score)
            continue
        if group:
            parts += [text[last : group.start], f"[{group.kind.upper()}]"]
            last = group.end
        group = x
    return "".join([*parts, text[last:]])


def mask_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The same rows and columns, with finds masked in ``text_col``; null and empty texts stay as they are.

    ``chars_col``, where given and present, becomes the new length of a text that changed.
    """
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for part in chunks(batches, at):
            old = part.column(at).to_pylist()
            new = [mask(x) for x in old]
            if chars is not None:
                counts = [n if a == b else len(b) for a, b, n in zip(old, new, part.column(chars).to_pylist())]
                part = part.set_column(chars, part.schema.field(chars), pa.array(counts, type=part.schema.field(chars).type))
            yield part.set_column(at, part.schema.field(at), pa.array(new, type=part.schema.field(at).type))

    return bounded(docs).withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(tidied(run), docs.schema)


#: The counts of the base kinds; where they stand is beyond SQL.
ORACLE = r"""
WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+') AS card, regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]') AS phone FROM documents),
d AS (SELECT *, [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN card] AS digits, [len(regexp_replace(x, '[^0-9]', '', 'g')) FOR x IN phone] AS lengths FROM m)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len([x FOR x IN ip IF len([p FOR p IN string_split(x, '.') IF coalesce(TRY_CAST('0' || ltrim(p, '0') AS INTEGER), 256) > 255]) = 0]) AS BIGINT) AS n_ip,
  CAST(len([x FOR x IN digits IF len(x) BETWEEN 14 AND 19
    AND list_sum([CAST(x[len(x) - i + 1] AS INTEGER) * (2 - i % 2) - CASE WHEN i % 2 = 0 AND CAST(x[len(x) - i + 1] AS INTEGER) > 4 THEN 9 ELSE 0 END FOR i IN range(1, len(x) + 1)]) % 10 = 0]) AS BIGINT) AS n_card,
  CAST(len([x FOR x IN lengths IF x BETWEEN 10 AND 15]) AS BIGINT) AS n_phone FROM d
"""
