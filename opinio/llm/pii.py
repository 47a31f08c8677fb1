"""Personal data: patterns propose spans, checksums confirm them, context words
near them adjust the score; spans from ``MIN_SCORE`` on are personal data.

Base kinds (their patterns and checks alone decide): email, ip (parts at most
255), card (16 to 19 digits, Luhn) and phone (8 to 15 digits after a plus).
Added kinds, by score: shorter cards (13 to 15 digits, Luhn), iban (country's
letters and mod 97), phone numbers without a country code, national ids
(123-45-6789) and numbers near a word that names them.

Matches are leftmost and non-overlapping a kind; one that fails its check is
dropped, not retried, but for cards (an added span where groups inside the failed run form
a card as cards are written, beside an expiry date or another number) and for iban: its pattern may run on into the words behind
the number, so a match is first cut to its country's length, and after one that
fails the search goes on inside it. The patterns are written so that each runs in linear
time on whole texts of any length (possessive runs, emails found from the @).
Offsets are code points, the end exclusive.

Edge cases: a null text is empty and has no spans; repeated rows are each
reported; other columns pass through. ``mask`` puts ``[KIND]`` in place of
spans (overlapping spans become one, named by the first), keeps a null text null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")
MIN_SCORE = 0.6
CONTEXT_CHARS = 40
#: Fixed: words that name a kind of number.
CONTEXT = {
    "card": ("card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "passport", "id"),
}

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Fixed: lengths of the IBAN registry by country.
_IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

_GROUP = re.compile(r"[0-9]+")
#: Fixed: how card numbers are written, in groups of digits, and their issuers' first digits.
_CARD_GROUPS = ((4, 4, 4, 4), (16,), (4, 6, 5), (15,))
_ISSUERS = "3456"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            done = m.end()
            yield "email", start, m.end()


def base_spans(text: str) -> list[Span]:
    """Confirmed spans of the base kinds, by kind, then start."""
    out = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _named(text: str, kind: str, start: int, end: int) -> bool:
    """Is a word that names the kind near the span?"""
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}"
    return not set(CONTEXT[kind]).isdisjoint(w.lower() for w in _WORD.findall(near))


def _ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """Proposed ibans and whether mod 97 confirms them."""
    at, failed = 0, 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        places = [i for i in range(start, end) if text[i] != " "]
        n = _IBAN_LENGTHS.get(text[start:start + 2], 0)
        ends = [end]
        if 0 < n < len(places) and places[n] > places[n - 1] + 1:  # a blank follows the country's length
            ends.insert(0, places[n - 1] + 1)
        found = next((e for e in ends if mod97(text[start:e])), None)
        if found is not None:
            yield start, found, True
        elif start >= failed:
            yield start, end, False
            failed = end
        at = found or start + 1


def _grouped_cards(m: re.Match) -> Iterator[tuple[int, int]]:
    """Cards inside a run of digit groups that is no card as a whole: an expiry date, a
    check number or another number stands beside them."""
    groups = [g.span() for g in _GROUP.finditer(m[0])]
    sizes, at = [b - a for a, b in groups], 0
    while at < len(groups):
        for shape in _CARD_GROUPS:
            n = len(shape)
            start, end = groups[at][0], groups[min(at + n, len(groups)) - 1][1]
            if tuple(sizes[at:at + n]) == shape and m[0][start] in _ISSUERS and luhn(_digits(m[0][start:end])):
                yield m.start() + start, m.start() + end
                at += n - 1
                break
        at += 1


def proposed(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Spans of the added kinds with their scores."""
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 15:
            yield "card", *m.span(), 0.2 + 0.2 * luhn(d) + 0.3 * _named(text, "card", *m.span())
        if m.end() - m.start() > 16 and not (16 <= len(d := _digits(m[0])) <= 19 and luhn(d)):
            for start, end in _grouped_cards(m):
                yield "card", start, end, 0.6 + 0.3 * _named(text, "card", start, end)
    for m in _LOCAL_PHONE.finditer(text):
        yield "phone", *m.span(), 0.3 + 0.3 * _named(text, "phone", *m.span())
    for start, end, confirmed in _ibans(text):
        yield "iban", start, end, 0.1 + 0.6 * confirmed + 0.2 * _named(text, "iban", start, end)
    for m in _NATIONAL.finditer(text):
        yield "national_id", *m.span(), 0.3 + 0.4 * _named(text, "national_id", *m.span())


def find_spans(text: str, min_score: float = MIN_SCORE) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    added = {(kind, a, b) for kind, a, b, score in proposed(text) if score >= min_score} - set(base)
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def masked(text: str, spans: list[Span]) -> str:
    out, done, reach = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= reach:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = reach = max(reach, b)
    return "".join([*out, text[done:]])


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans_of(text: Column) -> Column:
    """Column: struct(base, spans), arrays of (kind, start, end)."""
    @F.pandas_udf(f"base {_SPANS}, spans {_SPANS}")
    def find(texts: pd.Series) -> pd.DataFrame:
        def rows(spans: list[Span]) -> list[dict]:
            return [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return pd.DataFrame([tuple(map(rows, find_spans(t or ""))) for t in texts], columns=["base", "spans"])

    return find(text)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: struct(base, spans)."""
    return small_batches(docs).withColumn(out, spans_of(F.col(text_col)))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text masked."""
    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, find_spans(t)[1]) for t in texts], dtype="object")

    return small_batches(docs).withColumn(text_col, hide(F.col(text_col)))
