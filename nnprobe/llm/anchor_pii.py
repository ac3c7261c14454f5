"""Personal data by anchor expansion (operator 7).

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs,
digits, schemes and identifier cues (these two in any mix of A-Z and a-z).
Parsers then expand each anchor to its boundaries and check it: e-mail
addresses to both sides of an at-sign; IP
addresses, card and phone numbers from their first sign on, as leftmost
non-overlapping matches; web addresses after a scheme; handles after an
at-sign that is no e-mail; account values after a cue.  The last three kinds
are added spans; the base kinds are exactly the patterns of the contract.

Account values: an IBAN, with blanks or not, to the place where its check
number holds (mod 97); a social security number of valid shape, and none of
another; account and passport numbers with blanks or hyphens between groups of
digits; else the run of letters, digits and ``+/_.-`` of six signs or more that
holds a digit, or, for tokens, keys, passwords and secrets behind ":" or "=",
any run of six signs without a cue in it.  A date is no account value.

All parsers move forward only, so a text costs time linear in its length.
Offsets are code points, end exclusive.  Edge cases: null and empty texts
have no spans; repeated rows repeat their spans; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.llm.common import LOWER, UPPER

KINDS = ("email", "ip", "card", "phone", "account", "handle", "url")
BASE = KINDS[:4]
# Characters and patterns of the contract, cues and schemes.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "api key", "api_key", "apikey", "password", "passwd", "secret", "iban", "account number", "account no",
        "passport", "ssn", "social security number")
URL = re.compile(r"[^\s\"'<>`]+")
HANDLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@])")
LINK = re.compile(r"[ \t]{0,3}(?:is|no\.?|number|(?ai:is|no|number)(?![A-Za-z0-9])\.?)?[ \t]{0,3}([:=#]?)[ \t]{0,3}[\"']?")
VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.-]{5,}")
SECRET = re.compile(r"[^\s\"'`<>,;:=]{6,}")
SECRETS = frozenset(("token", "api key", "api_key", "apikey", "password", "passwd", "secret"))
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
GROUPS = re.compile(r"[0-9]{2,}(?:[ -][0-9]{2,})+")
SSN = re.compile(r"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![0-9])")
DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})[.,]?")
_DIGITS = re.compile(r"[0-9]+")
_LOW = str.maketrans(UPPER, LOWER)
OUT = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _automaton():
    a = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789")):
        for w in words:
            a.add_word(w, (kind, len(w)))
    for kind, words in (("s", SCHEMES), ("c", CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def _lowered(text: str) -> str:
    """A-Z in lower case; every place keeps its offset."""
    return text.lower() if text.isascii() else text.translate(_LOW)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _local_start(text: str, at: int, least: int) -> int:
    """Start of the run of local-part characters that ends before ``at``."""
    while at > least:
        lo = max(least, at - 64)
        part = text[lo:at]
        rest = part.rstrip(LOCAL)
        if rest:
            return lo + len(rest)
        at = lo
    return least


def _iban_end(text: str, at: int) -> int:
    """End of the longest valid IBAN at ``at`` that ends with a word, or 0."""
    m = IBAN.match(text, at)
    if m is None:
        return 0
    for end in range(m.end(), at + 14, -1):               # 45 places at most
        if text[end - 1] != " " and not text[end:end + 1].isalnum():
            code = text[at:end].replace(" ", "").upper()
            if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return end
    return 0


def _account(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """The value behind a cue that ends at ``at``."""
    link = LINK.match(text, at)
    start, named = link.end(), link[1] in (":", "=")
    if cue == "iban" and (end := _iban_end(text, start)):
        return start, end
    if cue in ("ssn", "social security number") and (m := SSN.match(text, start)):
        right = m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000"
        return (start, m.end()) if right else None
    if cue in ("account number", "account no", "passport") and (m := GROUPS.match(text, start)):
        if sum(map(str.isdigit, m[0])) >= 6 and not text[m.end():m.end() + 1].isalnum() and not DATE.fullmatch(m[0]):
            return start, m.end()
    m = VALUE.match(text, start)
    if m and any(c.isdigit() for c in m[0]):
        value = m[0].rstrip(".-/")
        return None if DATE.fullmatch(value) else (start, start + len(value))
    if cue in SECRETS and named and (m := SECRET.match(text, start)):
        value = m[0].rstrip(".!?)]}")
        words = _lowered(value)                            # "password: password" tells none
        if len(value) >= 6 and not DATE.fullmatch(value) and not any(c in words for c in SECRETS):
            return start, start + len(value)
    return None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    if not text:
        return []
    found: dict[str, list] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in _AUTOMATON.iter(_lowered(text)):
        at = last - n + 1
        if kind == "0":
            if at >= done["ip"]:
                m = IP.match(text, at)
                if m is None:       # no later start in this run of digits can match either
                    done["ip"] = _DIGITS.match(text, at).end()
                else:
                    done["ip"] = m.end()
                    if all(map(_byte, m[0].split("."))):
                        found["ip"].append((at, m.end()))
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append((at, m.end()))
        elif kind == "@":
            start = _local_start(text, at, done["email"])
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                done["email"] = m.end()
                found["email"].append((start, m.end()))
            elif start == at and (m := HANDLE.match(text, at + 1)) and (at == 0 or not text[at - 1].isalnum()):
                found["handle"].append((at, m.end()))
        elif kind == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append((at, m.end()))
        elif kind == "s":
            if at >= done["url"] and (m := URL.match(text, last + 1)):
                end = at + len(text[at:m.end()].rstrip(".,;:!?)]}"))
                done["url"] = m.end()
                if end > last + 1:
                    found["url"].append((at, end))
        elif at >= done["account"] and not text[last + 1:last + 2].isalnum() and (at == 0 or not text[at - 1].isalnum()):
            span = _account(text, _lowered(text[at:last + 1]), last + 1)
            if span:
                done["account"] = span[1]
                found["account"].append(span)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def _row(text: str | None) -> tuple:
    spans = find_spans(text)
    text_of = [f"{k}:{s}:{e}" for k, s, e in spans]
    n = [sum(x[0] == k for x in spans) for k in BASE]
    base = ",".join(text_of[:sum(n)])
    return (*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(text_of), len(spans) - sum(n))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the counts of base spans, their digest, all spans, and n_added."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = rows.select(id_col).schema
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    for part in OUT.split(", "):
        name, kind = part.split(" ")
        schema = schema.add(name, kind)
    names = schema.names

    def run(batches):
        for batch in batches:
            got = list(zip(*map(_row, batch.column(1).to_pylist()), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(got, types, strict=True)]], names=names)

    return rows.mapInArrow(run, schema)
