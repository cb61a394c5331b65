"""Personal data by anchors: an automaton finds at-signs, schemes, groups of digits and identifier cues, and small
parsers expand each anchor to both sides and validate what they find.

One pass of an Aho-Corasick automaton runs over the bytes of a text with A-Z in lower case and every digit as "0". No text
without an anchor is looked at again, and a parser reads only the run of characters around its anchor; runs of one kind
don't overlap, so all of it is linear in the text.

Base kinds, leftmost and without overlap within a kind; a failing match is dropped and not tried again from further right:

* email: local part, "@", and labels with at least one dot
* ip: four numbers with dots, each at most 255
* card: digits with single blanks or hyphens between them, 12 to 19 of them, that pass Luhn
* phone: "+" and 9 to 15 digits among blanks, dots, brackets and hyphens

The anchors of a card are its densest spots: twelve digits hold either four in a row or a separator between two.

Added kinds, which never touch the base ones and are left out where they overlap one: url (known scheme and a host with a dot),
iban (cue and checksum), ssn (cue and valid ranges), account (a cue like "account no", and six digits or more behind it).
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import text_of

#: Kinds in the order of a tie; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account")
BASE = 4
SCHEMES = frozenset("http https ftp ftps sftp ssh ws wss git ldap ldaps smb rtsp".split())
#: Words in front of an identifier, in English, German, French and Spanish.
CUES = {
    "iban": "iban",
    "ssn": "ssn", "social security number": "ssn", "social security no": "ssn",
    "account": "account", "acct": "account", "account number": "account", "customer number": "account", "passport": "account",
    "konto": "account", "kontonummer": "account", "kundennummer": "account", "reisepass": "account",
    "compte": "account", "passeport": "account", "cuenta": "account", "pasaporte": "account",
}
ANCHORS = {"@": "email", "0.0": "ip", "0000": "card", "0 0": "card", "0-0": "card", "+0": "phone", "://": "url"}

_SHAPE = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset(b"0123456789")
_SCHEME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+")
_WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_") | frozenset(range(128, 256))
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(rb"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(rb"[^\x00-\x20\"'<>\\^`{|}\x7f]++")
_HOST = re.compile(rb"(?:[^/?#@]*@)?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::[0-9]{1,5})?(?=[/?#]|$)")
_BETWEEN = re.compile(rb"(?:[ \t]{1,3}(?:no|nr|num|number|nummer|n\xc3\xbamero|num\xc3\xa9ro|id|is|ist|est|es)\b\.?){0,2}[ \t]{0,3}[:#=]?[ \t]{0,3}", re.I)
_IBAN = re.compile(rb"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}+")
_SSN = re.compile(rb"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(rb"(?:[A-Za-z]{1,3}[ -]?)?[0-9](?:[ -]?[0-9]){5,33}+(?![0-9A-Za-z])")

Span = tuple[int, int, int]  # start, number of the kind, end


def passes_luhn(digits: bytes) -> bool:
    """
    >>> [passes_luhn(x) for x in (b"4111111111111111", b"4111111111111112")]
    [True, False]
    """
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _back(raw: bytes, at: int, least: int, kinds: frozenset[int]) -> int:
    """Where the run of these bytes that ends at ``at`` begins, ``least`` at the earliest."""
    while at > least and raw[at - 1] in kinds:
        at -= 1
    return at


class Finder:
    """The state of one text: where the last match or run of each kind ended, and the spans so far."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.ends = dict.fromkeys(KINDS, 0)
        self.base: list[Span] = []
        self.added: list[Span] = []

    def email(self, at: int) -> None:
        start = _back(self.raw, at, self.ends["email"], _LOCAL)
        if start < at and (m := _DOMAIN.match(self.raw, at + 1)):
            self.ends["email"] = m.end()
            self.base.append((start, 0, m.end()))

    def ip(self, at: int) -> None:
        raw, kinds = self.raw, _DIGITS
        if at < self.ends["ip"]:
            return
        start = at
        while True:  # over numbers with single dots between them
            start = _back(raw, start, 0, kinds)
            if start > 1 and raw[start - 1] == 46 and raw[start - 2] in kinds:
                start -= 1
            else:
                break
        run = _NUMBERS.match(raw, start)
        self.ends["ip"] = run.end()
        parts = run.group().split(b".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                self.base.append((start, 1, start + size))
            start += size + 1

    def card(self, at: int) -> None:
        raw, kinds = self.raw, _DIGITS
        if at < self.ends["card"]:
            return
        start = at
        while True:  # over digits with single separators between them
            start = _back(raw, start, 0, kinds)
            if start > 1 and raw[start - 1] in b" -" and raw[start - 2] in kinds:
                start -= 1
            else:
                break
        run = _CARD.match(raw, start)
        self.ends["card"] = run.end()
        digits = run.group().translate(None, b" -")
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            self.base.append((start, 2, run.end()))

    def phone(self, at: int) -> None:
        if (m := _PHONE.match(self.raw, at)) and 9 <= len(m.group().translate(None, b"+ ().-")) <= 15:
            self.base.append((at, 3, m.end()))

    def url(self, at: int) -> None:
        if at < self.ends["url"]:
            return
        start = _back(self.raw, at, self.ends["url"], _SCHEME)
        if self.raw[start:at].decode("latin-1").lower() not in SCHEMES or not (m := _URL.match(self.raw, at + 3)):
            return
        self.ends["url"] = m.end()
        rest = m.group().rstrip(b".,;:!?)]*_")
        if _HOST.match(rest):
            self.added.append((start, 4, at + 3 + len(rest)))

    def cue(self, kind: str, start: int, end: int) -> None:
        raw = self.raw
        if start and raw[start - 1] in _WORD or end < len(raw) and raw[end] in _WORD:
            return
        at = _BETWEEN.match(raw, end).end()
        if at < self.ends[kind]:
            return
        found = 0
        if kind == "iban" and (m := _IBAN.match(raw, at)):
            found = at + _iban(m.group())
        elif kind == "ssn" and (m := _SSN.match(raw, at)):
            area, group, serial = m.groups()
            found = m.end() if area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000" else 0
        elif kind == "account" and (m := _ACCOUNT.match(raw, at)):
            found = m.end()
        if found > at:
            self.ends[kind] = found
            self.added.append((at, KINDS.index(kind), found))

    def spans(self) -> tuple[list[Span], list[Span]]:
        """Base spans, and all of them, in order."""
        base, every, ends = sorted(self.base), [], 0
        if not self.added:
            return base, base
        # An added span stays where it overlaps no base span and no added one before it.
        cuts: list[tuple[int, int]] = []
        for s, _, e in base:
            if cuts and s < cuts[-1][1]:
                cuts[-1] = (cuts[-1][0], max(cuts[-1][1], e))
            else:
                cuts.append((s, e))
        i = 0
        for s, k, e in sorted(self.added):
            while i < len(cuts) and cuts[i][1] <= s:
                i += 1
            if s >= ends and (i == len(cuts) or cuts[i][0] >= e):
                every.append((s, k, e))
                ends = e
        return base, sorted(base + every)


def _iban(run: bytes) -> int:
    """The length of the longest beginning of ``run`` with 15 to 34 letters and digits that passes the checksum, or 0.

    >>> _iban(b"DE89 3704 0044 0532 0130 00 and")
    27
    """
    for end in range(len(run), 14, -1):
        code = run[:end].replace(b" ", b"").decode().upper()
        if run[end - 1] != 32 and 15 <= len(code) <= 34 and (end == len(run) or run[end : end + 1] == b" "):
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return end
    return 0


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        found.add_word(word, (kind, len(word), False))
    for word, kind in CUES.items():
        found.add_word(word, (kind, len(word), True))
    found.make_automaton()
    return found


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, as (start, number of the kind, end) in code points.

    >>> find_spans("é a@b.de, 1.2.3.4")[0]
    [(2, 0, 8), (10, 1, 17)]
    """
    held = sys.modules.setdefault("chainloom_worker", types.ModuleType("chainloom_worker")).__dict__
    if "anchors" not in held:
        held["anchors"] = _automaton()
    raw = text.encode("utf-8", "surrogatepass")
    finder = Finder(raw)
    for end, (kind, size, cue) in held["anchors"].iter(raw.translate(_SHAPE).decode("latin-1")):
        if cue:
            finder.cue(kind, end + 1 - size, end + 1)
        else:
            getattr(finder, kind)(end + 1 - size)
    base, every = finder.spans()
    if every and len(raw) != len(text):
        points, at, n = {}, 0, 0
        for x in sorted({x for s, _, e in every for x in (s, e)}):
            n += len(raw[at:x].decode("utf-8", "surrogatepass"))
            points[x], at = n, x
        base, every = ([(points[s], k, points[e]) for s, k, e in x] for x in (base, every))
    return base, every


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as kind:start:end),
    spans (all of them) and, if asked for, masked (the text with each span, or run of overlapping ones, as <KIND>).

    Edge cases: a null or empty text has no spans, and so the hash of nothing. Ties at a start go by the order of KINDS.
    Repeated rows give a row each, null ids stay null. Very long texts are read whole, in linear time. An empty table gives
    no rows. Only the id and text columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

    def scan(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts, hashes, spans, masked = [], [], [], []
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(BASE)])
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                if mask:
                    masked.append(masked_text(text, every))
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(masked, pa.string())] * mask, names=[x.split()[0] for x in (schema + ", masked string" * mask).split(", ")])

    return rows.mapInArrow(scan, schema + ", masked string" * mask).withColumnRenamed("id", id_col)


def masked_text(text: str, spans: list[Span]) -> str:
    """
    >>> masked_text("mail a@b.de now", [(5, 0, 11)])
    'mail <EMAIL> now'
    """
    out, at, end = [], 0, 0
    for s, k, e in spans:
        if s >= end:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = end = max(end, e)
    return "".join([*out, text[at:]])
