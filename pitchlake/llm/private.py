"""Personal data by anchor expansion: one Aho-Corasick pass finds the anchors, local parsers expand and check each.

Anchors are at-signs, plus signs, digits, schemes and the words that announce an identifier.  A parser looks only at the
characters around its anchor and skips anchors inside what it has consumed, so a text takes time linear in its length.

Base kinds, leftmost and non-overlapping within a kind, failing matches consumed and dropped:
``email``, ``ip`` (four parts up to 255), ``card`` (13 to 19 digits that pass Luhn), ``phone`` (9 to 15 digits).
Kinds that only anchors can tell: ``account`` (an identifier of at least four digits after a word such as "iban" or "token"; an IBAN must
pass its check digits) and ``link`` (an address that names a person: ``mailto:``, ``tel:``, ``sip:`` or a scheme with user information).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pitchlake.llm.common import filled

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "link")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))

# Words before an identifier, and schemes whose address is a person's (fixed values).
CUES = (
    "account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn", "social security", "tax id", "licence", "license no",
    "member id", "customer id", "user id", "token", "password", "passwd", "secret", "api key", "api_key", "apikey", "access key",
)
SCHEMES = ("mailto:", "tel:", "sip:", "sips:", "xmpp:", "://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TO_ID = re.compile(r"""(?:[ \t]{0,2}(?:no|nr|number|id|is|key)\b\.?)?[ \t]{0,2}[:=#]?[ \t]{0,2}["']?""", re.IGNORECASE)
_ID = re.compile(r"[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
_PERSON = re.compile(r"[A-Za-z0-9._%+-]+(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)?")
_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?")


def anchors() -> ahocorasick.Automaton:
    """The automaton over all anchors; its values are what to expand and the anchor's length."""
    automaton = ahocorasick.Automaton()
    for mark in "0123456789":
        automaton.add_word(mark, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for word in CUES:
        automaton.add_word(word, ("cue", len(word)))
    for word in SCHEMES:
        automaton.add_word(word, ("scheme", len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def checked_iban(found: str) -> bool:
    """Whether the country, check digits and account leave 1 modulo 97."""
    plain = found.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def small(part: str) -> bool:
    """Whether a run of digits is at most 255; leading zeros don't count."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


class Finder:
    """All spans of a text."""

    def __init__(self) -> None:
        self.automaton = anchors()

    def spans(self, text: str, lowered: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in the order of kinds, then starts; ``lowered`` is the text with A-Z in lower case."""
        found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        taken = dict.fromkeys(KINDS, 0)
        for last, (anchor, size) in self.automaton.iter(lowered):
            at = last + 1 - size
            if anchor == "digit":
                if at >= taken["card"]:
                    taken["card"] = self.card(text, at, found["card"])
                if at >= taken["ip"]:
                    taken["ip"] = self.ip(text, at, found["ip"])
            elif anchor == "at":
                taken["email"] = self.email(text, at, taken["email"], found["email"])
            elif anchor == "plus":
                self.phone(text, at, found["phone"])
            elif anchor == "cue":
                if at >= taken["account"]:
                    taken["account"] = self.account(text, at, last + 1, taken["account"], found["account"])
            elif at >= taken["link"]:
                taken["link"] = self.link(text, at, last + 1, taken["link"], found["link"])
        return [(kind, start, end) for kind in KINDS for start, end in found[kind]]

    @staticmethod
    def email(text: str, at: int, taken: int, found: list) -> int:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host is None:
            return taken
        found.append((start, host.end()))
        return host.end()

    @staticmethod
    def ip(text: str, at: int, found: list) -> int:
        """From the first digit of a run: four parts are consumed whole, a run that starts none is passed over."""
        four = _FOUR.match(text, at)
        if four is None:
            return _DIGITS.match(text, at).end()
        if all(map(small, four.group().split("."))):
            found.append(four.span())
        return four.end()

    @staticmethod
    def card(text: str, at: int, found: list) -> int:
        run = _RUN.match(text, at)
        if run is None:
            return at + 1
        if run.end() - at <= 37:  # 19 digits with separators between
            digits = run.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(run.span())
        return run.end()

    @staticmethod
    def phone(text: str, at: int, found: list) -> None:
        run = _PHONE.match(text, at)
        if run is not None and 9 <= len(_digits(run.group())) <= 15:
            found.append(run.span())

    @staticmethod
    def account(text: str, at: int, end: int, taken: int, found: list) -> int:
        """The identifier after a cue that is a word of its own."""
        if (at and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            return taken
        start = _TO_ID.match(text, end).end()
        if start == end:
            return taken
        iban = _IBAN.match(text, start)
        if iban is not None and checked_iban(iban.group()):
            found.append(iban.span())
            return iban.end()
        own = _ID.match(text, start)
        if own is None or own.end() - start > 128 or len(_digits(own.group())) < 4:
            return taken
        found.append(own.span())
        return own.end()

    @staticmethod
    def link(text: str, at: int, end: int, taken: int, found: list) -> int:
        start = at
        if text[at] == ":":
            while start > taken and text[start - 1] in _SCHEME:
                start -= 1
            rest = _USER.match(text, end) if start < at else None
        else:
            whole = at == 0 or not text[at - 1].isalnum()
            rest = _PERSON.match(text, end) if whole else None
            if rest is not None and "@" not in rest.group() and len(_digits(rest.group())) < 5:
                rest = None
        if rest is None:
            return taken
        found.append((start, rest.end()))
        return rest.end()


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced by their kind in brackets; of overlapping ones the first stands, of those that begin together the longest."""
    parts, at = [], 0
    for start, less, kind in sorted((start, -end, kind) for kind, start, end in spans):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
            at = -less
    return "".join([*parts, text[at:]])


def personal_data(docs: DataFrame, *, text: str = "text", mask: bool = False) -> DataFrame:
    """The rows with ``spans``: kind, start and end (code points, end exclusive), in the order of kinds, then of starts.

    With ``mask`` the text's spans are replaced by their kinds (a null text stays null).  All other columns and all rows stay, repeated
    ones too (a column named ``spans`` is replaced).  Null and empty texts have no spans; an empty table stays empty.  Texts of any
    length are read whole, in batches bounded by bytes.
    """
    docs = docs.drop("spans").withColumn(text, F.col(text).cast("string"))
    schema = StructType([*docs.schema.fields, StructField("spans", SPANS)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = filled(batch.column(text))
            plain = texts.to_pylist()
            spans = [finder.spans(*pair) for pair in zip(plain, pc.ascii_lower(texts).to_pylist(), strict=True)]
            rows = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own] for own in spans], kind)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if mask:
                hidden = pa.array([masked(*pair) for pair in zip(plain, spans, strict=True)], pa.string())
                columns[text] = pc.if_else(pc.is_null(batch.column(text)), pa.scalar(None, pa.string()), hidden)
            yield pa.RecordBatch.from_arrays([*columns.values(), rows], [*columns, "spans"])

    return docs.mapInArrow(find, schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
