"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

A proposal is a span of a kind. Kinds with a checksum (cards, account numbers) drop proposals
that fail it. The words near a span then move its score up or down; the four base kinds are
reported with any score, the further ones only with ``LEAST_SCORE`` or more.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.llm.stored import by_place, extended, plain

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "findings array<struct<kind: string, start: int, end: int, score: double>>"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Code points before and after a span in which context words are looked for.
NEAR = 48
LEAST_SCORE = 0.5

Span = tuple[int, int]

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never ends inside a run of digits, so a match cannot begin inside one either.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Characters of an account number by country, from the public registry of the standard.
ACCOUNT_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA",
        30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}
LEAST_ACCOUNT = 15
SOCIAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[a-z]+")


def emails(text: str) -> Iterator[Span]:
    """Local part, at sign, dotted domain. The local part is read backwards from the sign.

    Long runs without a sign cost nothing, and a run before one is read once.
    """
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def addresses(text: str) -> Iterator[Span]:
    for match in DOTTED.finditer(text):
        parts = [p.lstrip("0") for p in match.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield match.span()


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right counts twice, cast into one."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for match in DIGITS.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[Span]:
    for match in DIALLED.finditer(text):
        if 9 <= sum(c.isdecimal() for c in match.group()) <= 15:
            yield match.span()


def mod97(account: str) -> bool:
    """The check of international account numbers: country and check digits go last, letters from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def account_end(text: str, start: int, end: int) -> int | None:
    """Where the account number of a match ends: the country's length first, then the longest that passes.

    A match can go on into groups of capitals or digits that follow the number, so shorter ends
    at blanks are tried too; a country that is listed has them at its length only.
    """
    ends = [end, *(e for e in range(end - 1, start, -1) if text[e] == " ")]
    length = ACCOUNT_LENGTHS.get(text[start: start + 2])
    sizes = {e: e - start - text.count(" ", start, e) for e in ends}
    ends.sort(key=lambda e: sizes[e] != length)
    for e in ends:
        right = e == end or (sizes[e] == length if length else sizes[e] >= LEAST_ACCOUNT)
        if right and mod97(text[start:e].replace(" ", "")):
            return e
    return None


def accounts(text: str) -> Iterator[Span]:
    match = ACCOUNT.search(text)
    while match:
        start, end = match.span()
        found = account_end(text, start, end)
        if found:
            yield start, found
        # What a match went on into, or a false start, can hold the next number.
        match = ACCOUNT.search(text, found or start + 1)


def socials(text: str) -> Iterator[Span]:
    for match in SOCIAL.finditer(text):
        yield match.span()


@dataclass(frozen=True)
class Rule:
    find: Callable[[str], Iterator[Span]]
    score: float
    raised_by: frozenset[str]
    lowered_by: frozenset[str] = frozenset({"version", "invoice", "order", "isbn", "serial", "example", "test"})


RULES: dict[str, Rule] = {
    "email": Rule(emails, 0.8, frozenset({"email", "mail", "contact", "write", "reach"})),
    "ip": Rule(addresses, 0.5, frozenset({"ip", "host", "server", "address", "login", "client"})),
    "card": Rule(cards, 0.7, frozenset({"card", "visa", "credit", "debit", "payment", "mastercard", "paid"})),
    "phone": Rule(phones, 0.6, frozenset({"phone", "tel", "telephone", "call", "mobile", "fax", "cell"})),
    "iban": Rule(accounts, 0.8, frozenset({"iban", "account", "bank", "transfer", "swift", "bic"})),
    "ssn": Rule(socials, 0.4, frozenset({"ssn", "social", "security", "taxpayer"})),
}


def words_near(text: str, start: int, end: int) -> set[str]:
    """The whole words within ``NEAR`` code points of a span; one that the bound cuts does not count."""
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    while 0 < low < start and text[low - 1].isalpha() and text[low].isalpha():
        low += 1
    while end < high < len(text) and text[high - 1].isalpha() and text[high].isalpha():
        high -= 1
    return {*WORD.findall(text[low:start].lower()), *WORD.findall(text[end:high].lower())}


def context_score(rule: Rule, text: str, start: int, end: int) -> float:
    """The rule's score, 0.2 higher if a word near the span speaks for it, 0.2 lower if against."""
    near = words_near(text, start, end)
    score = rule.score + 0.2 * bool(near & rule.raised_by) - 0.2 * bool(near & rule.lowered_by)
    return round(min(max(score, 0.0), 1.0), 2)


def findings(text: str) -> list[dict]:
    """All findings by kind as listed, then start; offsets are code points, the end exclusive."""
    found = []
    for kind in KINDS:
        rule = RULES[kind]
        for start, end in rule.find(text):
            score = context_score(rule, text, start, end)
            if kind in BASE_KINDS or score >= LEAST_SCORE:
                found.append({"kind": kind, "start": start, "end": end, "score": score})
    return found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus ``findings``; a map without a shuffle.

    A null or empty text has no findings; repeated rows are scanned one by one, an empty table
    stays empty. Bytes that are not UTF-8 count as one replacement character each.
    """
    carried = [c for c in docs.columns if c not in (text, "findings")]
    source = by_place(docs, carried, __text=F.coalesce(F.col(plain(text)), F.lit("")).cast("binary"))
    out = extended(source, SCHEMA, without=("__text",))
    names = out.names
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
    ]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            found = [findings(t.as_py().decode("utf-8", "replace")) for t in batch.column(at)]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=names)

    return source.mapInArrow(scanned, out).toDF(*carried, "findings")


def listed(findings: Column) -> Column:
    """``kind:start:end`` of each finding, joined by commas."""
    return F.concat_ws(",", F.transform(
        findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    ))
