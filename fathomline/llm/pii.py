"""Format-preserving pseudonyms for personal data.

What is found is first validated (Luhn for card numbers, mod 97 for IBANs, the calendar for dates,
octets for addresses, area rules for social security numbers); what fails, such as an order number of 16
digits, stays as it is. Its free characters, as one number in
a mixed radix, go through a keyed Feistel network with cycle walking: a permutation of exactly the
values of that format. Separators, letter case, prefixes and check digits stay or are recomputed, so
a pseudonym passes the same validation, equal values get equal pseudonyms in every document, and who
has the key can undo it. A value's separators, its letter case and how a date is written don't matter:
the same digits, letters or day stay linked. A phone number keeps its country code; dates are permuted
among those that any format writes alike (months and days of as many digits, days that can't be months).

The key is the session's spark.fathomline.pii.key, or given. Without one, local sessions (tests) use
PUBLISHED_KEY, which protects nothing; others get a random one, which the session then names. Who wants
to undo or link pseudonyms beyond a session has to keep it or set one.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_chunks, table

PUBLISHED_KEY = b"fathomline: set a secret of your own"
KEY_SETTING = "spark.fathomline.pii.key"
ROUNDS = 8
#: The years whose days are permuted.
FIRST_YEAR, LAST_YEAR = 1900, 2099
# Country calling codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Secrets, each with literals of which a text (in lower case) must have one before its pattern is tried at all.
SECRETS = [
    (("akia", "asia"), re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    (("sk-",), re.compile(r"\bsk-[A-Za-z0-9]{20,}")),
    (("password", "passwd", "pwd", "secret", "token", "api_key", "apikey"), re.compile(r"(?i:password|passwd|pwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}(?![\"']?(?:A[KS]IA|gh[pousr]_|sk-)|[\"'][0-9a-f]{32,64}[\"'])[\"']?[^\s\"',;]{6,}")),
    (('"', "'"), re.compile(r"(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])")),
]
DIGIT, DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
#: How far before its first digit a number can begin: two letters, or a bracket.
LEAD = 2
#: Digits are ASCII ones, beside a number too; those of other scripts stay as they are.
NUMBER = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<iso>(?<![0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-]))|(?P<dmy>(?<![0-9./])[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9/]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
    r"|(?P<phone>(?<!\w)\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-]))")  # fmt: skip


class Feistel:
    """A keyed permutation of range(n) for any n, by alternating modular Feistel rounds with cycle walking."""

    def __init__(self, key: bytes, n: int, tweak: str):
        self.n = n
        self.a = max(1, int(n**0.5)) if n < 1 << 52 else 1 << ((n.bit_length() + 1) // 2)
        self.b = -(-n // self.a)
        self.key = hashlib.blake2b(tweak.encode() + n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"), key=key[:64], digest_size=32).digest()

    def _f(self, r: int, x: int) -> int:
        data = bytes([r]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + self._f(r, left)) % self.b
            else:
                left = (left + self._f(r, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for r in reversed(range(ROUNDS)):
            if r % 2:
                right = (right - self._f(r, left)) % self.b
            else:
                left = (left - self._f(r, right)) % self.a
        return left * self.b + right

    def permute(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def invert(self, x: int) -> int:
        x = self._back(x)
        while x >= self.n:
            x = self._back(x)
        return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz")
_PLACE = {c: (i, alphabet) for alphabet in _CLASSES for i, c in enumerate(alphabet)}
_PLACE |= {c.upper(): x for c, x in _PLACE.items()}


def _kind_of_day(month: int, day: int) -> tuple[bool, int]:
    """What every way to write a date keeps: the digits of the month and of the day, and whether the day can't be a month."""
    return month > 9, (day > 9) + (day > 12)


@functools.cache
def _days(kind: tuple[bool, int]) -> tuple[list[datetime.date], dict[datetime.date, int]]:
    """All days of a kind in order, and their numbers."""
    first, end = datetime.date(FIRST_YEAR, 1, 1).toordinal(), datetime.date(LAST_YEAR, 12, 31).toordinal() + 1
    days = [d for d in map(datetime.date.fromordinal, range(first, end)) if _kind_of_day(d.month, d.day) == kind]
    return days, {d: i for i, d in enumerate(days)}


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


class Pseudonyms:
    """Replaces the personal data of a text; undo=True restores it. accounts: long numbers that fail the check digit are taken for account numbers, not only those that pass it for cards."""

    def __init__(self, key: bytes = PUBLISHED_KEY, undo: bool = False, accounts: bool = False):
        self.key, self.undo, self.accounts = key, undo, accounts
        self.feistel = functools.lru_cache(4096)(lambda n, tweak: Feistel(key, n, tweak))
        self.found = 0

    def _walk(self, n: int, tweak: str, x: int) -> int:
        f = self.feistel(n, tweak)
        return f.invert(x) if self.undo else f.permute(x)

    def characters(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """Permutes the ASCII digits and letters of text jointly, each within its class; letter case and the rest stay."""
        alphabets = dict.fromkeys("0123456789abcdef", "0123456789abcdef") if hexadecimal else {}
        places = [(i, *((alphabets[c].index(c), alphabets[c]) if c in alphabets else _PLACE[c])) for i, c in enumerate(text) if c in alphabets or c in _PLACE]
        n = x = 0
        for k, (_, value, alphabet) in enumerate(places):
            n, x = (n if k else 1) * len(alphabet), x * len(alphabet) + value
        if n < 2:
            return text
        x = self._walk(n, tweak, x)
        out = list(text)
        for i, _, alphabet in reversed(places):
            x, value = divmod(x, len(alphabet))
            out[i] = alphabet[value].upper() if out[i].isupper() else alphabet[value]
        return "".join(out)

    def _digits(self, shown: str, digits: str) -> str:
        """shown with its digits replaced in order."""
        each = iter(digits)
        return "".join(next(each) if c in _CLASSES[0] else c for c in shown)

    def _counted(self, new: str | None, old: str) -> str:
        if new is None:
            return old
        self.found += 1
        return new

    def email(self, m: re.Match) -> str:
        name, _, rest = m.group().rpartition(".")
        return self._counted(f"{self.characters(name, 'email')}.{rest}", m.group())

    def secret(self, m: re.Match) -> str:
        text = m.group()
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|[A-Za-z_]+\s{0,2}[=:]\s{0,2}[\"']?", text)
        kept = head.group() if head else ""
        rest = text[len(kept):]
        return self._counted(kept + self.characters(rest, "secret", hexadecimal=re.fullmatch("[0-9a-f]{32,64}", rest) is not None), text)

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self.characters(plain[4:], "iban " + plain[:2])
        new = iter(plain[:2] + f"{98 - _iban_number(body + plain[:2] + '00') % 97:02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def _date(self, year: int, month: int, day: int) -> datetime.date | None:
        if not (FIRST_YEAR <= year <= LAST_YEAR and 1 <= month <= 12 and day >= 1):
            return None
        kind = _kind_of_day(month, day)
        days, number = _days(kind)
        try:
            at = number[datetime.date(year, month, day)]
        except ValueError:  # no such day
            return None
        return days[self._walk(len(days), f"date {kind[0]:d}{kind[1]}", at)]

    def iso(self, text: str) -> str | None:
        new = self._date(*map(int, text.split("-")))
        return new and new.isoformat()

    def dmy(self, text: str) -> str | None:
        """Day first with dots, and with slashes where the first number can't be a month; else month first."""
        sep = "." if "." in text else "/"
        first, second, year = text.split(sep)
        month_first = sep == "/" and int(first) <= 12
        new = self._date(int(year), *((int(first), int(second)) if month_first else (int(second), int(first))))
        if new is None:
            return None
        a, b = (new.month, new.day) if month_first else (new.day, new.month)
        return f"{a:0{len(first)}d}{sep}{b:0{len(second)}d}{sep}{new.year}"

    def ip(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        x = self._walk(2**32, "ip", int.from_bytes(bytes(octets), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        x = self._walk(898 * 99 * 9999, "ssn", (area * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, text: str) -> str | None:
        digits = re.sub("[ -]", "", text)
        if luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = digits[0] + self.characters(digits[1:-1], "card " + digits[0])
        return self._digits(text, body + str(luhn(body)))

    def account(self, text: str) -> str:
        """A long number that fails the check digit: it fails afterwards too."""
        digits = re.sub("[ -]", "", text)
        body = digits[0] + self.characters(digits[1:-1], "account " + digits[0])
        last = [d for d in _CLASSES[0] if int(d) != luhn(body)]  # so that it still fails
        was = [d for d in _CLASSES[0] if int(d) != luhn(digits[:-1])].index(digits[-1])
        return self._digits(text, body + last[was])

    def phone(self, text: str) -> str:
        """Numbers without a country code are in a North American format: their code is 1."""
        digits = re.sub(r"\D", "", text)
        size = next((n for n in (1, 2) if digits[:n] in SHORT_CODES), 3) if text[0] == "+" else 0
        code = digits[:size] or "1"
        return self._digits(text, digits[:size] + self.characters(digits[size:], "phone " + code))

    def number(self, m: re.Match) -> str:
        kind, text = m.lastgroup if m.lastgroup != "sep" else "dmy", m.group()
        new = getattr(self, kind)(text)
        if new is None and kind == "card" and self.accounts:
            new = self.account(text)
        return self._counted(new, text)

    def numbers(self, text: str) -> str:
        """Patterns are tried only where a digit is: most characters are passed over by one character search."""
        out, last, at = [], 0, 0
        while found := DIGIT.search(text, at):
            first = found.start()
            m = None
            for start in range(max(last, at, first - LEAD), first + 1):
                m = NUMBER.match(text, start)
                if m:
                    break
            if m:
                out += text[last:m.start()], self.number(m)
                last = at = m.end()
            else:
                at = DIGITS.match(text, first).end()
        return "".join([*out, text[last:]]) if out else text

    def emails(self, text: str) -> str:
        return EMAIL.sub(self.email, text) if "@" in text else text

    def secrets(self, text: str) -> str:
        low = text.lower()
        for literals, pattern in reversed(SECRETS) if self.undo else SECRETS:
            if any(x in low for x in literals):
                text = pattern.sub(self.secret, text)
        return text

    def replace(self, text: str) -> str:
        steps = [self.emails, self.secrets, self.numbers]
        for step in reversed(steps) if self.undo else steps:
            text = step(text)
        return text


def _run(key: bytes, columns: list[str], counted: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in by_chunks(batches, "text", 16 << 20):
            out, n = [], []
            for x in batch.column("text").to_pylist():
                p.found = 0
                out.append(x and p.replace(x))
                n.append(p.found)
            new = {c: batch.column(c) for c in columns} | {"text": pa.array(out, pa.string())}
            if "n_chars" in new:
                new["n_chars"] = pa.array([a if x is None else len(x) for x, a in zip(out, batch.column("n_chars").to_pylist(), strict=True)], pa.int64())
            if counted:
                new["n_replaced"] = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_pydict(new)

    return run


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names in KEY_SETTING."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"no key for pseudonyms: set {KEY_SETTING}")
    return key.encode() if key else PUBLISHED_KEY


def run_key(spark: SparkSession) -> bytes:
    """session_key, but a session that would have none gets a random one, which KEY_SETTING then holds: all runs of a session link, and no published key stands in."""
    if spark.conf.get(KEY_SETTING, None) is None and not spark.sparkContext.master.startswith("local"):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return session_key(spark)


def pseudonymised(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with its text column pseudonymised under key or else the session's (and n_chars, where there is one, counted anew); null texts stay null, empty ones empty, repeated rows alike, other columns as they are; an empty table gives none."""
    return docs.mapInArrow(_run(key or run_key(docs.sparkSession), docs.columns, False), docs.schema)


def pseudonyms(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text, n_replaced for each row of docs (doc_id, text; other columns are ignored).

    Null stays null, empty stays empty, repeated rows stay alike, an empty table gives none. Whole
    texts are scanned; a text without personal data comes back unchanged.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_run(key or run_key(docs.sparkSession), ["doc_id", "text"], True), f"doc_id {kind}, text string, n_replaced long")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(table(spark, sf_dir, "documents"))

