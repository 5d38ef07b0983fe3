"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus signs, digits,
schemes and identifier cues in one pass, and a deterministic parser at each anchor expands to the
bounds of the value and validates it. Secrets and URLs have no greatest length.

Kinds, in the order in which spans with one start are listed: email, ip, card, phone (the base
kinds, leftmost and without overlap within a kind; those that fail validation go, without retries),
then url, key, secret, iban, account, ssn, address, which the anchors add. An added span that lies
inside a base span is dropped; otherwise spans of different kinds may overlap. Offsets are code
points, ends exclusive. Every parser passes a stretch of text a fixed number of times at most, so a
text takes time in proportion to its length."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, trim

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "key", "secret", "iban", "account", "ssn", "address")
_PLACE = {k: i for i, k in enumerate(KINDS)}
SPANS = "array<struct<kind:string,start:long,end:long>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]++")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_CLOUD = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_GIVES = re.compile(r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9_/+=.\-]*+")
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:no|number|nr)\.?)?[ :#.]{0,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_SSN = re.compile(r"[ :#]{0,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'.-")
_HOUSE = re.compile(r"(?<![0-9])[0-9]{1,5}[A-Za-z]?\Z")
_NAMES_AFTER = re.compile(r" (?:[A-ZÀ-Þ][^\W\d_]*+ ?){1,4},? [0-9]{1,5}(?![0-9])")
_LETTERS = re.compile(r"[^\W\d_]*+")
_NUMBER_AFTER = re.compile(r" [0-9]{1,4}[a-z]?(?![0-9])")

_SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "api-key", "access_key")
_ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
_STREETS = (" Street", " Avenue", " Road", " Lane", " Boulevard", " Drive", "Street", "Avenue")
_STREETS_BEFORE = ("Calle", "Rue", "rue", "Avenida", "straße", "strasse")


@lru_cache(1)
def anchors():
    """The automaton; a match's value is (what to parse, length of the pattern)."""
    found: dict[str, str] = {"@": "email", "+": "phone", "://": "url", "mailto:": "mailto", "AKIA": "key", "ASIA": "key"}
    found |= {str(d): "digit" for d in range(10)}
    for cues, what in ((_SECRET_CUES, "secret"), (("iban",), "iban"), (_ACCOUNT_CUES, "account"), (("ssn", "social security number"), "ssn")):
        for c in cues:
            found |= {x: what for x in (c, c.capitalize(), c.upper())}
    found |= {s: "street" for s in _STREETS[:6]} | {s: "street_before" for s in _STREETS_BEFORE}
    automaton = ahocorasick.Automaton()
    for word, what in found.items():
        automaton.add_word(word, (what, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _house(text: str, at: int) -> int | None:
    """Start of the house number before one to three capitalised names that end at the blank
    text[at]; None if there is none."""
    for _ in range(3):
        start = at
        while start and text[start - 1] in _NAME:
            start -= 1
        if start == at or not ("A" <= text[start] <= "Z") or not start or text[start - 1] != " ":
            return None
        at = start - 1
        if m := _HOUSE.search(text, max(0, at - 7), at):
            return m.start()
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text by start, then kind; [] for null and empty texts."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    added: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)
    dotted = spaced = value = letters = 0
    digit = -1
    for end, (what, n) in anchors().iter(text):
        at = end + 1 - n
        if what == "digit":
            if at >= dotted:
                m = _DOTTED.match(text, at)
                dotted = m.end()
                parts, start = m.group().split("."), at
                for i in range(0, len(parts) - 3, 4):
                    size = sum(map(len, parts[i : i + 4])) + 3
                    if all(map(_octet, parts[i : i + 4])):
                        out.append(("ip", start, start + size))
                    start += size + 1
            if at >= spaced:
                m = _SPACED.match(text, at)
                spaced = m.end()
                if 12 <= spaced - at <= 37:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, spaced))
        elif what == "email":
            start, low = at, after["email"]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                out.append(("email", start, m.end()))
        elif what == "phone":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", at, m.end()))
        elif what == "url":
            start, low = at, after["url"]
            while start > low and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := _URL.match(text, end + 1)):
                stop = m.end()
                while stop > end + 1 and text[stop - 1] in ".,;:!?)]":
                    stop -= 1
                if stop > end + 1:
                    after["url"] = stop
                    added.append(("url", start, stop))
        elif what == "mailto":
            continue  # its address is an email of its own
        elif what == "key":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _CLOUD.match(text, end + 1)):
                added.append(("key", at, m.end()))
        elif what == "secret":
            if (m := _GIVES.match(text, end + 1)) and (start := m.end()) >= after["secret"]:
                if start >= value:  # cues within one run of the value's signs share its end and last digit
                    value = _VALUE.match(text, start).end()
                    digit = value - 1
                    while digit >= start and not text[digit].isdigit():
                        digit -= 1
                if value - start >= 8 and digit >= start:
                    after["secret"] = value
                    added.append(("secret", start, value))
        elif what == "iban":
            m = _IBAN.match(text, end + 1)
            if m and _mod97(m.group(1).replace(" ", "")):
                added.append(("iban", m.start(1), m.end(1)))
        elif what == "account":
            if m := _ACCOUNT.match(text, end + 1):
                added.append(("account", m.start(1), m.end(1)))
        elif what == "ssn":
            if m := _SSN.match(text, end + 1):
                added.append(("ssn", m.start(1), m.end(1)))
        elif what == "street":
            if (end + 1 == len(text) or not text[end + 1].isalnum()) and (start := _house(text, at)) is not None:
                added.append(("address", start, end + 1))
        elif what == "street_before":
            if m := _NAMES_AFTER.match(text, end + 1):
                added.append(("address", at, m.end()))
            else:
                if end + 1 >= letters:  # cues within one word share its end
                    letters = _LETTERS.match(text, end + 1).end()
                if m := _NUMBER_AFTER.match(text, letters):
                    added.append(("address", at, m.end()))
    base = sorted(out, key=lambda s: s[1])
    starts, reach = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    for s in added:
        before = bisect_right(starts, s[1])
        if not before or reach[before - 1] < s[2]:
            out.append(s)
    return sorted(set(out), key=lambda s: (s[1], _PLACE[s[0]], s[2]))


def masked(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by <KIND> of its first."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def with_spans(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the column `out` (SPANS) of the personal data in the whole text; other columns pass
    through, one already named `out` is replaced. Null and empty texts have no spans. No shuffle."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts.to_pylist()]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.list_(kind))

    return small_batches(df).withColumn(out, run(F.col(f"`{text}`")))


def without_pii(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with all personal data in the text masked and, where the column exists, `length` set to
    the new text's code points. Rows and columns stay; null texts stay null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        found = pa.array([masked(t) for t in texts.to_pylist()], pa.string())
        trim()
        return found

    new = small_batches(df).withColumn(text, run(F.col(f"`{text}`")))
    if length and length in df.columns:
        new = new.withColumn(length, F.char_length(text).cast(df.schema[length].dataType))
    return new.select(*[f"`{c}`" for c in df.columns])


def report(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, counts of the base kinds, the digest of the base spans and all
    spans as text."""
    s = with_spans(df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    s = s.select("doc_id", "pii")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))


    def count(kind):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return s.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))
