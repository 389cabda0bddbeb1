"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
YEARS = range(1900, 2100)
# Country calling codes of two digits. Those that begin with 1 or 7 have one digit, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

# What is looked for. A kind that has a validator counts only if it holds.
PATTERNS = (
    ("email", r"(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9+/_-]{16,})"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
)
ONE = dict(PATTERNS)
PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))


def luhn_digit(payload: str) -> str:
    """The check digit that follows the payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def country_code(digits: str) -> str:
    """The calling code that an international number begins with."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3]


@functools.lru_cache(maxsize=16)
def dates(orders: tuple[str, ...], wide: tuple[bool, bool]) -> np.ndarray:
    """All dates of YEARS that one form can hold, as year * 10000 + one number * 100 + the other, in order.

    orders: how the form may be read ("md": the first of the two numbers is the month); a
    string that is a date in any of them is one. wide: whether each number has two digits or one.
    """
    year, one, other = np.meshgrid(np.array(YEARS), np.arange(1, 32), np.arange(1, 32), indexing="ij")
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    valid = np.zeros(year.shape, bool)
    for order in orders:
        m, d = (one, other) if order == "md" else (other, one)
        valid |= (m <= 12) & (d <= days[np.minimum(m, 12)] + ((m == 2) & leap))
    for number, two in ((one, wide[0]), (other, wide[1])):
        valid &= two | (number < 10)
    return (year * 10000 + one * 100 + other)[valid]


def readings(kind: str, text: str) -> list[tuple[int, int]]:
    """The spans of shorter cards or IBANs in a match that failed its check, the longest first: cards start and end at separators, IBANs end at one."""
    cuts = [m.start() for m in re.finditer("[ -]" if kind == "card" else " ", text)]
    starts = [0, *(c + 1 for c in cuts)] if kind == "card" else [0]
    found = [(a, b) for a in starts for b in [*cuts, len(text)] if b - a < len(text) and re.fullmatch(ONE[kind], text[a:b])]
    return sorted(found, key=lambda x: (-sum(c.isalnum() for c in text[x[0] : x[1]]), x))


class Pseudonyms:
    """Keyed permutations within formats; the same value always gets the same pseudonym."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()
        self.of = functools.lru_cache(maxsize=100_000)(self._of)

    def _round(self, kind: str, n: int, i: int, half: int) -> int:
        said = f"{kind}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, size: int, kind: str) -> int:
        """A permutation of 0..size-1: a Feistel network on the two parts of a number, walked until it falls in range."""
        left_size = max(2, round(size**0.5)) if size < 1 << 100 else 1 << (size.bit_length() // 2)
        right_size = -(-size // left_size)
        while True:
            a, b = divmod(value, right_size)  # a < left_size, b < right_size
            for i in range(ROUNDS):
                if i % 2:
                    b = (b + self._round(kind, size, i, a)) % right_size
                else:
                    a = (a + self._round(kind, size, i, b)) % left_size
            value = a * right_size + b
            if value < size:
                return value

    def string(self, text: str, alphabet: str, kind: str) -> str:
        """A permutation of the strings of one length over an alphabet."""
        n, value = len(alphabet), 0
        for c in text:
            value = value * n + alphabet.index(c)
        value, out = self.permute(value, n ** len(text), kind), []
        for _ in text:
            value, c = divmod(value, n)
            out.append(alphabet[c])
        return "".join(reversed(out))

    def mixed(self, text: str, kind: str) -> str:
        """Each class of characters (digits, letters) permuted within the text, capitals and the rest in place."""
        if not text:
            return text
        for alphabet in (DIGITS, LOWER):
            own = "".join(c for c in text.lower() if c in alphabet)
            if own:
                new = iter(self.string(own, alphabet, f"{kind}|{''.join('9' if c in DIGITS else 'a' if c in LOWER else c for c in text.lower())}"))
                text = "".join((n.upper() if c.isupper() else n) if c.lower() in alphabet and (n := next(new)) else c for c in text)
        return text

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None if the text isn't valid."""
        digits = re.sub("[^0-9]", "", text)
        lay = lambda new: (lambda it: re.sub("[0-9]", lambda _: next(it), text))(iter(new))
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            new = self.string(digits[:-1], DIGITS, kind)
            return lay(new + luhn_digit(new))
        if kind == "iban":
            plain = text.replace(" ", "")
            if iban_digits(plain[:2], plain[4:]) != plain[2:4]:
                return None
            account = self.mixed(plain[4:], kind)
            new = iter(plain[:2] + iban_digits(plain[:2], account) + account)
            return "".join(" " if c == " " else next(new) for c in text)
        if kind == "ssn":
            if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
                return None
            areas = [a for a in range(1, 900) if a != 666]
            at = (areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
            at, serial = divmod(self.permute(at, len(areas) * 99 * 9999, kind), 9999)
            return f"{areas[at // 99]:03d}-{at % 99 + 1:02d}-{serial + 1:04d}"
        if kind == "ip":
            parts = [int(x) for x in text.split(".")]
            if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
                return None
            value = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, kind)
            return ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "date":
            return self._date(text)
        if kind == "phone":
            if not 7 <= len(digits) <= 15:
                return None
            code = country_code(digits)
            return lay(code + self.string(digits[len(code) :], DIGITS, f"phone|{code}"))
        if kind == "email":
            local, _, host = text.rpartition("@")
            if any(c.isascii() and c.isalnum() for c in local) and not any(c.isalnum() and not c.isascii() for c in local):
                return f"{self.mixed(local, 'email')}@{host}"
            plain = local.encode("utf-8", "surrogatepass").hex()
            return f"x{self.string(plain, HEX, 'email')}@{host}"
        if re.fullmatch("[0-9a-f]+", text.lower()) and not text.isdigit():
            low = self.string(text.lower(), HEX, "secret")
            return low.upper() if text == text.upper() else low
        return self.mixed(text, "secret")

    def _date(self, text: str) -> str | None:
        """A permutation of the dates of one form: mark, order and digits of each number."""
        mark = re.search("[^0-9]", text)[0]
        parts = text.split(mark)
        first = len(parts[0]) == 4
        year, one, other = parts if first else (parts[2], *parts[:2])
        orders = ("md",) if first else ("dm", "md") if mark == "/" else ("dm",)
        form = dates(orders, (len(one) == 2, len(other) == 2))
        own = int(year) * 10000 + int(one) * 100 + int(other)
        at = int(np.searchsorted(form, own))
        if at == len(form) or form[at] != own:
            return None
        new = int(form[self.permute(at, len(form), f"date|{mark}|{first}|{len(one)}{len(other)}")])
        year, one, other = f"{new // 10000}", f"{new // 100 % 100:0{len(one)}d}", f"{new % 100:0{len(other)}d}"
        return mark.join((year, one, other) if first else (one, other, year))

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """A text with its personal data replaced, and (kind, start, end) of each in the text as given."""
        out, spans, done, at = [], [], 0, 0
        while match := PATTERN.search(text, at):
            kind = match.lastgroup if match.lastgroup != "secret_value" else "secret"
            kind = "secret" if match["secret"] else kind
            start, end = match.span("secret_value" if kind == "secret" else kind)
            new = self.of(kind, text[start:end])
            if new is None and kind in ("card", "iban"):
                for a, b in readings(kind, text[start:end]):
                    if new := self.of(kind, text[start + a : start + b]):
                        start, end = start + a, start + b
                        break
            if new is None:
                # A number may start within another that failed.
                at = start + 1 if kind == "iban" else start + re.search("[ -]|$", match[0]).end() if kind == "card" else end
                continue
            out += [text[done:start], new]
            spans.append((kind, start, end))
            done = at = end
        return "".join([*out, text[done:]]), spans


SPANS = "array<struct<kind:string,start:int,end:int>>"


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with the text's personal data replaced, then n_pii and pii (kind, start, end in characters of the input).

    Cards (Luhn), IBANs (modulo 97), IPv4 addresses, SSNs and dates (1900 to 2099) must be
    valid and stay so; a date is permuted among all dates of its form (order, marks, digits),
    and where day and month can't be told apart the form has both readings. Phone numbers have a + and keep their country
    code, e-mail addresses their host; a local part with letters beyond ASCII, or without any, becomes x and hexadecimal digits;
    values assigned to a token, key or password keep their alphabet. Equal values become
    equal pseudonyms in every document, under one key, whatever separators a number has.
    Other dates and phone numbers without a + stay as they are.
    Null texts stay null with 0, empty ones stay empty, long ones are read whole; repeated rows are repeated, an
    empty table gives no rows; clashing columns are replaced; rows are independent.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_pii", "pii")]
    if text not in keep:
        keep = [*keep, text]
    source, at = docs.select(*keep), keep.index(text)
    schema = source.select("*", F.lit(0).alias(free_name(source, "n_pii")), F.lit(None).cast(SPANS).alias("pii")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                done = [pseudonyms.text(t) if t else (t, []) for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array([t for t, _ in done], pa.string())
                found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for _, spans in done], kind)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for _, s in done], pa.int32()), found], schema.names)

    return source.mapInArrow(run, schema)
