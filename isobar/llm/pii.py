"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits side by side, digits around a full stop, "://" and words that
announce an identifier.  A parser for each kind of anchor works out the
boundaries around it and validates what it found.  Every match of the base
patterns holds such an anchor, and a parser takes matches from left to right
without overlap, so the base spans are those of the patterns themselves.

Further kinds: url (scheme, host, path), account (IBANs whose check digits are
right, access key ids, numbers after an account word) and secret (what follows a
password or token word and an equals sign or colon).

Cases: null and empty texts hold nothing; repeated rows give equal rows; an empty
table gives an empty result; columns besides doc_id and text are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, whole

Span = tuple[int, int]

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

#: Words that announce identifiers, in lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "customer id")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL_REST = re.compile(r"://(?:[^\s/@\"'<>]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NUMBER = re.compile(r"(?: ?(?:number|no\.?|nr\.?))?[ \t]*[:=#]?[ \t]*([A-Z]{0,2}[0-9][0-9-]{5,})(?![A-Za-z0-9])", re.IGNORECASE)
KEY_ID = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/.-]{8,})")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Check digits: 97 leaves one."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


# Parsers: (text, where the anchor starts, where the last match ended) to the end
# of what was consumed and the valid spans in it.
Parsed = tuple[int, list[Span]]


def email(text: str, at: int, done: int) -> Parsed:
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    rest = DOMAIN.match(text, at + 1) if start < at else None
    return (rest.end(), [(start, rest.end())]) if rest else (done, [])


def ip(text: str, at: int, done: int) -> Parsed:
    """A run of dotted numbers; every four from its start are a match."""
    start = at
    while start > done and (text[start - 1] in DIGITS or text[start - 1] == "." and start - 1 > done and text[start - 2] in DIGITS):
        start -= 1
    run = DOTTED.match(text, start)
    spans, parts, place = [], run.group().split("."), start
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = place + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and int(p) <= 255 for p in four):
            spans.append((place, end))
        place = end + 1
    return run.end(), spans


def card(text: str, at: int, done: int) -> Parsed:
    start = at
    while start > done:
        if text[start - 1] in DIGITS:
            start -= 1
        elif start - 1 > done and text[start - 1] in " -" and text[start - 2] in DIGITS:
            start -= 2
        else:
            break
    run = DIGIT_RUN.match(text, start)
    digits = run.group().replace(" ", "").replace("-", "")
    return run.end(), [(start, run.end())] if 16 <= len(digits) <= 19 and luhn(digits) else []


def phone(text: str, at: int, done: int) -> Parsed:
    run = PHONE.match(text, at)
    if not run:
        return done, []
    return run.end(), [run.span()] if 8 <= sum(c in DIGITS for c in run.group()) <= 15 else []


def url(text: str, at: int, done: int) -> Parsed:
    start = at
    while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+."):
        start -= 1
    rest = URL_REST.match(text, at) if at - start >= 2 and text[start].isalpha() else None
    return (rest.end(), [(start, rest.end())]) if rest else (done, [])


def account(text: str, at: int, done: int) -> Parsed:
    """at: where an account word or a key id starts."""
    key = KEY_ID.match(text, at)
    if key and (not at or not text[at - 1].isalnum()):
        return key.end(), [key.span()]
    cue = next((c for c in ACCOUNT_CUES if text[at : at + len(c)].lower() == c), "")
    place = at + len(cue)
    while cue and place < len(text) and text[place] in " \t:=#":
        place += 1
    number = IBAN.match(text, place) if cue else None
    if number and iban(number.group()):
        return number.end(), [number.span()]
    number = NUMBER.match(text, at + len(cue)) if cue else None
    return (number.end(), [number.span(1)]) if number else (done, [])


def secret(text: str, at: int, done: int) -> Parsed:
    cue = next((c for c in SECRET_CUES if text[at : at + len(c)].lower() == c), "")
    value = SECRET.match(text, at + len(cue)) if cue else None
    return (value.end(), [value.span(1)]) if value and any(c in DIGITS for c in value.group(1)) else (done, [])


PARSERS: dict[str, Callable[[str, int, int], Parsed]] = {"email": email, "ip": ip, "card": card, "phone": phone, "url": url, "account": account, "secret": secret}


def _automaton(made: dict[str, str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for anchor, kind in made.items():
        automaton.add_word(anchor, (len(anchor), kind))
    automaton.make_automaton()
    return automaton


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    """Anchor to (its length, its kind)."""
    made: dict[str, str] = {"@": "email", "+": "phone", "://": "url"}
    for a in "0123456789":
        for b in "0123456789":
            made |= {f"{a}.{b}": "ip", f"{a}{b}": "card", f"{a} {b}": "card", f"{a}-{b}": "card"}
    return _automaton(made)


@lru_cache(1)
def cues() -> ahocorasick.Automaton:
    """Anchors of accounts and secrets, to be met in text whose A to Z are in lower
    case; the parsers look at the text itself."""
    return _automaton(dict.fromkeys((*ACCOUNT_CUES, "akia"), "account") | dict.fromkeys(SECRET_CUES, "secret"))


def find(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, in order."""
    spans: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)
    lowered = text.lower() if text.isascii() else text.encode().translate(_LOWER).decode()  # of the same length
    for last, (length, kind) in chain(anchors().iter(text), cues().iter(lowered)):  # no kind is in both
        start = last - length + 1
        if start >= done[kind]:
            done[kind], found = PARSERS[kind](text, start, done[kind])
            spans[kind] += found
    return spans


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (kind, start, end) of each whole text, by kind as listed,
    then start."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(text.as_py()) for text in batch.column(1)]
            spans = [[{"kind": kind, "start": a, "end": b} for kind in KINDS for a, b in x[kind]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole().alias("text")).mapInArrow(mapped, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(_count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
