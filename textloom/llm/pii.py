"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, schemes, identifier and street cues, a dot before a digit,
two digits side by side or over a blank or hyphen); local parsers expand each anchor to its boundaries, however far,
and validate what they find. Offsets are code points, end exclusive.

Base kinds, leftmost and non-overlapping within a kind; a match that fails its test is dropped and not retried:
email, ip, card, phone. Further kinds: account (cue, then an identifier; IBANs by their check digits), address
(street with a house number), url (a link that carries user information).

Defined results: null and empty texts have no spans; overlapping spans of different kinds are all listed, and
``redact`` replaces their union once, under the kind that starts first; repeated rows give repeated results; an empty
table gives an empty one; other columns, of any name, are not read. Every parser reads a run of one character once, so
a text of any length takes time in proportion to it.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "url")

#: Cues before an account or identity number.
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "social security", "passport", "customer id", "konto", "kontonummer", "compte", "cuenta", "tax id")
#: Street words whose house number stands before them, and those that it follows.
NUMBER_FIRST = ("Street", "Avenue", "Road", "Lane", "Boulevard", "rue", "avenue", "boulevard")
NUMBER_LAST = ("straße", "strasse", "Straße", "Strasse", "Calle", "Avenida", "calle", "avenida")

DIGITS = frozenset("0123456789")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
USER_URL = re.compile(r"://[^\s/?#@<>\"']++@[A-Za-z0-9.-]++(?::[0-9]++)?(?:[/?#][^\s<>\"']*+)?")
#: Blank runs are possessive and a run has one place, so a long one is read once.
IDENTIFIER = re.compile(r"[ \t]*+(?:(?:number|num|no|nr|nummer|numéro|número|is|ist)[ \t]*+)?(?:[.:#=]{1,2}[ \t]*+)?([A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]{2,4}){3,8}|[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])", re.ASCII)
HOUSE_NUMBER = re.compile(r"(?<![\w.])[0-9]{1,5}[A-Za-z]?,?\Z")
STREET_WORD = re.compile(r"[^\W\d_][\w'-]*+")
HOUSE_AFTER = re.compile(r"(?:\s++[^\W\d_][\w'-]*+){0,3}?\s++[0-9]{1,5}[a-z]?\b")


@functools.lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            found.add_word(form, ("account", len(form)))
    for a in "0123456789":
        found.add_word(f".{a}", ("dot", 2))
        for b in "0123456789":
            for joint in ("", " ", "-"):
                found.add_word(f"{a}{joint}{b}", ("digits", 2 + len(joint)))
    for kind, cues in (("before", NUMBER_FIRST), ("after", NUMBER_LAST)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, not before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL_CHARS:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def ips(chain: re.Match):
    """The addresses in a run of digits joined by single dots, four parts at a time from the left."""
    at, parts = chain.start(), chain[0].split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        stop = at + sum(map(len, four)) + 3
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
            yield at, stop
        at = stop + 1


def house_before(text: str, at: int, floor: int) -> int | None:
    """Where a house number starts that stands before ``at``, with up to three words between."""
    found = None
    for _ in range(4):
        end = at
        while end > floor and text[end - 1].isspace():
            end -= 1
        if end == at:
            break
        start = end
        while start > floor and not text[start - 1].isspace():
            start -= 1
        if m := HOUSE_NUMBER.search(text, start, end):
            found = m.start()
        if not STREET_WORD.fullmatch(text, start, end):
            break
        at = start
    return found


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed in ``KINDS``, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_floor = phone_floor = account_floor = address_floor = url_floor = ip_floor = card_floor = 0
    for last, (what, size) in anchors().iter(text):
        first = last + 1 - size
        if what == "digits":
            if first >= card_floor:
                m = CARD.match(text, first)
                card_floor = m.end()
                if m.end() - first >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif what == "dot":
            if first >= ip_floor:
                start = first
                while start > ip_floor and text[start - 1] in DIGITS:
                    start -= 1
                if start < first and (m := CHAIN.match(text, start)):
                    found["ip"] += ips(m)
                    ip_floor = m.end()
        elif what == "at":
            if hit := email_at(text, first, email_floor):
                found["email"].append(hit)
                email_floor = hit[1]
        elif what == "plus":
            if first >= phone_floor and (m := PHONE.match(text, first)):
                phone_floor = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "scheme":
            if first >= url_floor and (m := USER_URL.match(text, first)):
                start = first
                while start > url_floor and text[start - 1] in SCHEME_CHARS:
                    start -= 1
                if start < first:
                    found["url"].append((start, m.end()))
                    url_floor = m.end()
        elif what == "account":
            if first >= account_floor and not (first and text[first - 1].isalnum()) and (m := IDENTIFIER.match(text, last + 1)) and m.start(1) > last + 1:
                code = m[1]
                while code and not (code[0].isdigit() or iban(code)):
                    code = code.rpartition(" ")[0]  # words after an IBAN look like its last groups
                if code:
                    found["account"].append((m.start(1), m.start(1) + len(code)))
                    account_floor = m.start(1) + len(code)
        elif first >= address_floor:
            after = text[last + 1 : last + 2]
            if what == "before" and not after.isalnum() and not text[first - 1 : first].isalnum() and (start := house_before(text, first, address_floor)) is not None:
                found["address"].append((start, last + 1))
                address_floor = last + 1
            elif what == "after" and not after.isalnum() and (m := HOUSE_AFTER.match(text, last + 1)):
                start = first
                while start > address_floor and text[start - 1].isalpha():
                    start -= 1
                found["address"].append((start, m.end()))
                address_floor = m.end()
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def redacted(text: str | None) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by its kind in angle brackets."""
    hits = sorted((a, b, k) for k, a, b in spans(text))
    if not hits:
        return text
    out, at, k = [], 0, 0
    while k < len(hits):
        start, stop, kind = hits[k]
        while k < len(hits) and hits[k][0] < max(stop, start + 1):
            stop, k = max(stop, hits[k][1]), k + 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = stop
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def pii_spans(text: Column) -> Column:
    """All spans of a text column, as an array of (kind, start, end)."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        offsets, kinds, starts, ends = [0], [], [], []
        for x in texts:
            for k, a, b in spans(x.as_py()):
                kinds.append(k)
                starts.append(a)
                ends.append(b)
            offsets.append(len(kinds))
        items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return run(text)


def redact(text: Column) -> Column:
    """A text column with its personal data replaced; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(x.as_py()) for x in texts], pa.string())

    return run(text)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col)).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
