"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the places where personal data can be: at-signs, plus signs, digits, schemes
and identifier cues. Local parsers expand each anchor to its boundaries and validate it: an at-sign grows to
both sides into an address, a digit or plus sign to the right into a network address, card or phone number,
a scheme into a web address, a cue into the account number after it.

Four kinds are exact by definition (``BASE``): the leftmost non-overlapping matches of a pattern, kept where a
check holds. ``url`` and ``account`` are added by the method.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from labelq.llm.base import batch, query, small_batches, table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")

# The definition of the four base kinds.
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGITS = re.compile(r"[0-9]+")
SCHEMES = ("http://", "https://", "ftp://")
URL = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:[0-9]{1,5})?(/[^\s<>\"']*)?")
CUES = ("iban", "IBAN", "account", "Account", "acct", "ssn", "SSN", "passport", "Passport")
ACCOUNT = re.compile(r"(?:\s+(?:no|number|nr)\.?)?[\s:#=]{1,3}([A-Z0-9][A-Z0-9\x20-]{4,40}[A-Z0-9])")


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (c > "4")) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))
    if kind == "card":
        digits = _digits(found)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_digits(found)) <= 15
    return True


def account_end(cue: str, found: str) -> int:
    """Characters of ``found`` that belong to the number after a cue; 0 if it does not hold."""
    solid = ""
    if cue.lower() == "iban":
        for i, c in enumerate(found):
            if c not in " -":
                solid += c
                if len(solid) >= 15 and re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", solid):
                    turned = solid[4:] + solid[:4]
                    if int("".join(str(int(x, 36)) for x in turned)) % 97 == 1:
                        return i + 1
        return 0
    token = re.match(r"[A-Z0-9]+(?:-[A-Z0-9]+)*", found).group()
    return len(token) if len(_digits(token)) >= 6 else 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789", *SCHEMES, *CUES):
        a.add_word(word, word)
    a.make_automaton()
    return a


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all personal data in a text, in order."""
    out, free = [], dict.fromkeys(KINDS, 0)

    def take(kind: str, start: int, end: int, keep: bool) -> None:
        free[kind] = end
        if keep:
            out.append((start, KINDS.index(kind), end))

    for last, word in anchors.iter(text):
        if word == "@":
            start = last
            while start > free["email"] and EMAIL_NAME.match(text, start - 1):
                start -= 1
            host = EMAIL_HOST.match(text, last + 1) if start < last else None
            if host:
                take("email", start, host.end(), True)
        elif word == "+":
            if last >= free["phone"] and (m := PHONE.match(text, last)):
                take("phone", last, m.end(), valid("phone", m.group()))
        elif word.isdigit():
            if last >= free["ip"]:
                if m := IP.match(text, last):
                    take("ip", last, m.end(), valid("ip", m.group()))
                else:  # no later start in this run of digits can match either
                    take("ip", last, DIGITS.match(text, last).end(), False)
            if last >= free["card"] and (m := CARD.match(text, last)):
                take("card", last, m.end(), valid("card", m.group()))
        elif word in SCHEMES:
            start = last + 1 - len(word)
            if start >= free["url"] and (m := URL.match(text, last + 1)):
                take("url", start, m.end(), True)
        elif last >= free["account"] and not text[last + 1 - len(word) - 1:last + 1 - len(word)].isalnum():
            m = ACCOUNT.match(text, last + 1)
            if m and (n := account_end(word, m.group(1))):
                take("account", m.start(1), m.start(1) + n, True)
    return sorted(out)


_ANCHORS: list = []


def _shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _ANCHORS:
            _ANCHORS.append(automaton())
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                found = spans(text, _ANCHORS[0])
                base = [x for x in found if x[1] < len(BASE)]
                out["doc_id"].append(doc_id)
                for i, kind in enumerate(BASE):
                    out[f"n_{kind}"].append(sum(x[1] == i for x in base))
                out["base_sha256"].append(hashlib.sha256(_shown(base).encode()).hexdigest())
                out["spans"].append(_shown(found))
            yield batch(schema, out)
    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null or empty text has
    none. Repeated rows and null ids keep a row each; an empty table gives an empty result; other columns are
    ignored. Texts are never cut; one pass over the scan, no shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", {"bigint": pa.int64(), "int": pa.int32()}[kind]), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select("doc_id", "text").mapInArrow(_rows(schema), f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def _masked(docs_columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _ANCHORS:
            _ANCHORS.append(automaton())
        for b in batches:
            masked = []
            for text in b.column(docs_columns.index("text")):
                x = text.as_py()
                if x:
                    at, kept = 0, []
                    for s, k, e in spans(x, _ANCHORS[0]):
                        if e <= at:
                            continue
                        kept += [x[at:max(s, at)], f"<{KINDS[k]}>" if s >= at else ""]
                        at = e
                    x = "".join([*kept, x[at:]])
                masked.append(x)
            columns = [pa.array(masked, b.schema.field(i).type) if n == "text" else b.column(i) for i, n in enumerate(docs_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
    return run


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; null texts stay null."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_masked(docs.columns), docs.schema)


@query("op9_personal_data")
def op9_personal_data(spark, sf):
    return personal_data(table(spark, sf, "documents"))
