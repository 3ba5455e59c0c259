"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, dots, schemes, digits and
cues of identifiers. At each anchor a deterministic local parser walks to the
left and right, bounded by the previous span of its kind, and validates what it
finds: part ranges of addresses, digit counts, Luhn and mod-97 checksums.

Kinds: email, ip, card and phone as leftmost non-overlapping matches; beyond
them ``account`` (IBANs with a right checksum, and digits or values after a
cue such as ``account``, ``ssn``, ``password``, ``token``), ``key`` (access-key
ids) and ``login`` (user and password in a URL).

Edge cases: null and empty texts have no span; repeated rows each have theirs;
offsets count code points; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.common import prepare, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "key", "login")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_WORDS = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_VALUE = re.compile(r"""(?:\s?(?:no|nr|number|id)\b\.?)?\s?[:=#]\s?["']?([A-Za-z0-9][A-Za-z0-9_./+-]{5,})""", re.IGNORECASE)
_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_LOGIN = re.compile(r"://([^\s/:@]+:[^\s/@]+)@")
#: Cues after which a value is taken as an identifier or secret.
CUES = ("account", "iban", "ssn", "passport", "password", "passwd", "secret", "token", "api_key", "apikey")
_machine = None


def _anchors():
    """The automaton over anchors; built once in each worker."""
    global _machine
    if _machine is None:
        import ahocorasick

        _machine = ahocorasick.Automaton()
        for c in "0123456789":
            _machine.add_word(c, ("digit", 1))
        _machine.add_word("@", ("at", 1))
        _machine.add_word("+", ("plus", 1))
        _machine.add_word("://", ("scheme", 3))
        _machine.add_word("AKIA", ("key", 4))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize()}:
                _machine.add_word(form, ("cue", len(form)))
        _machine.make_automaton()
    return _machine


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    free = dict.fromkeys((*BASE, *ADDED), 0)  # where the next span of the kind may start

    def put(kind: str, a: int, z: int, good: bool = True) -> None:
        free[kind] = z
        if good:
            found[kind].append((a, z))

    for last, (what, size) in _anchors().iter(text):
        at = last - size + 1
        if what == "digit":
            # Runs are parsed from their first digit; a later digit of a parsed run is behind `free`.
            if at >= free["ip"] and (at == free["ip"] or text[at - 1] not in _DIGITS):
                m = _IP.match(text, at)
                if m:
                    put("ip", at, m.end(), all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))))
            if at >= free["card"]:
                m = _CARD.match(text, at)
                if m:
                    number = m[0].replace(" ", "").replace("-", "")
                    put("card", at, m.end(), 16 <= len(number) <= 19 and luhn(number))
            if at >= 2 and at >= free["account"] + 2 and text[at - 2 : at].isupper() and text[at - 2 : at].isascii() and not text[at - 3 : at - 2].isalnum():
                m = _IBAN.match(text, at - 2)
                while m and not iban(m[0]) and " " in m[0]:  # the next word may be no part of it
                    m = _IBAN_WORDS.match(text, at - 2, at - 2 + m[0].rindex(" "))
                if m and iban(m[0]):
                    put("account", at - 2, m.end())
        elif what == "at":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                put("email", start, m.end())
        elif what == "plus":
            if at >= free["phone"]:
                m = _PHONE.match(text, at)
                if m:
                    put("phone", at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif what == "scheme":
            m = _LOGIN.match(text, at)
            if m and at >= free["login"]:
                put("login", m.start(1), m.end(1))
        elif what == "key":
            m = _KEY.match(text, at)
            if m and at >= free["key"] and not text[at - 1 : at].isalnum():
                put("key", at, m.end())
        elif at >= free["account"] and not text[at - 1 : at].isalpha():
            m = _VALUE.match(text, last + 1)
            if m and (any(c in _DIGITS for c in m[1])):
                put("account", m.start(1), m.end(1))
    return [(k, a, z) for k in (*BASE, *ADDED) for a, z in found[k]]


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first kind listed."""
    out, at = [], 0
    merged: list[tuple[int, int, str]] = []
    for a, z, k in sorted((a, z, k) for k, a, z in spans(text)):
        if merged and a < merged[-1][1]:
            b, y, kind = merged[-1]
            merged[-1] = (b, max(y, z), min(kind, k, key=(*BASE, *ADDED).index))
        else:
            merged.append((a, z, k))
    for a, z, k in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = z
    return "".join([*out, text[at:]])


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in found)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [spans(t or "") for t in b.column(1).to_pylist()]
        counts = [pa.array([sum(x[0] == k for x in r) for r in rows], pa.int64()) for k in BASE]
        shas = [hashlib.sha256(_joined([x for x in r if x[0] in BASE]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(shas, pa.string()), pa.array([_joined(r) for r in rows], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans of every row."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, the spans of ``text`` masked."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("text")
            new = pa.array([None if t is None else masked(t) for t in b.column(k).to_pylist()], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([new if i == k else b.column(i) for i in range(b.num_columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Contract of query 8."""
    return find(table(spark, sf_dir, "documents"))
