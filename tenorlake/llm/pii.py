"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and reports anchors: at-signs,
scheme separators, plus signs, digits and identifier cues. At each anchor a
small deterministic parser expands to both sides and validates what it found.
All parsers are linear in the text, also for long runs without any match.

Kinds, in this order: email, ip, card, phone (the base kinds), then iban, key
(secret after a cue such as ``password=``, or an access key id) and login
(user part of ``scheme://user:secret@host``).

Defined results: a null or empty text has no spans; very long texts are walked
whole; offsets are code points, end exclusive; spans of one kind don't overlap,
spans of different kinds may, and go by start, then kind as listed; repeated
rows have equal spans; an empty table gives an empty one; other columns stay,
but one called like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenorlake.llm.common import col, without

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "key", "login")
ORDER = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_digits = re.compile(r"[0-9]+")
_ip = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+)(?![A-Za-z0-9])")
_value = re.compile(r"[^\s&;,'\"<>]{6,}")
_key_id = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_userinfo = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")

CUES = ("password=", "passwd=", "pwd=", "token=", "api_key=", "apikey=", "secret=")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    a.add_word("@", "at")
    a.add_word("+", "plus")
    a.add_word("://", "scheme")
    a.add_word("AKIA", "akia")
    for form in ("IBAN", "Iban", "iban"):
        a.add_word(form, "iban")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, "cue")
    a.make_automaton()
    return a


_anchors = _automaton()


def luhn(digits: str) -> bool:
    """The check sum of card numbers: from the right, every second digit counts twice."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start and then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    run_end = ip_end = card_end = email_end = key_end = 0
    for at, tag in _anchors.iter(text):
        if tag == "digit":
            if at < run_end:
                continue
            run_end = _digits.match(text, at).end()
            if at >= ip_end and text[run_end : run_end + 1] == "." and (m := _ip.match(text, at)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    found.append(("ip", at, ip_end))
            if at >= card_end and (m := _card.match(text, at)):
                card_end = m.end()
                if card_end - at >= 14:
                    number = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(number) <= 19 and luhn(number):
                        found.append(("card", at, card_end))
        elif tag == "plus":
            if m := _phone.match(text, at):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(("phone", at, m.end()))
        elif tag == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := _domain.match(text, at + 1)):
                email_end = m.end()
                found.append(("email", start, email_end))
        elif tag == "cue":
            if at >= key_end and (m := _value.match(text, at + 1)):
                key_end = m.end()
                found.append(("key", *m.span()))
        elif tag == "akia":
            if at - 3 >= key_end and not (at > 3 and text[at - 4].isalnum()) and (m := _key_id.match(text, at + 1)):
                key_end = m.end()
                found.append(("key", at - 3, key_end))
        elif tag == "iban":
            if (m := _iban.match(text, at + 1)) and _iban_ok(m[1]):
                found.append(("iban", *m.span(1)))
        elif m := _userinfo.match(text, at + 1):
            found.append(("login", *m.span()))
    found.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return found


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every maximal run of overlapping spans becomes one mark, named by its first span."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``df`` with an array of (kind, start, end) in ``spans``; a column of that name is replaced."""
    keep = without(df, spans)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(spans, SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(cells, _SPAN_ARROW)], names=[*keep, spans])

    wanted = df.select(*(col(c) for c in keep))
    return wanted.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``df`` with each span replaced by its kind in brackets; ``n_chars``, if there, follows the new text.

    Same columns in the same order. Null texts stay null.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else _redacted(t, scan(t)) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else b.column(c) for c in names], names=names)

    out = df.mapInArrow(run, df.schema)
    return out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)) if n_chars in names else out


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: counts and digests of its spans, from ``find``."""
    s = find(df.select(col(key).alias(key), col(text).alias("text")), "text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select(key, *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
