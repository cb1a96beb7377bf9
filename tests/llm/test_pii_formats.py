"""Pseudonyms against an independent version: the network restated, values numbered by other rules, and round trips over every format."""

from __future__ import annotations

import calendar
import hashlib
import itertools
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import pii

P, BACK = pii.Pseudonyms(b"a key"), pii.Pseudonyms(b"a key", undo=True)


def permuted(n: int, tweak: str, x: int, key: bytes = b"a key") -> int:
    """Eight rounds over two halves modulo a and b, again until the result is below n."""
    a = max(1, math.isqrt(n)) if n < 1 << 52 else 1 << (n.bit_length() + 1) // 2
    b = -(-n // a)
    own = hashlib.blake2b(tweak.encode() + n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"), key=key, digest_size=32).digest()

    def f(r, half):
        return int(hashlib.blake2b(bytes([r]) + half.to_bytes(max(1, -(-half.bit_length() // 8)), "big"), key=own, digest_size=32).hexdigest(), 16)

    while True:
        left, right = x // b, x % b
        for r in range(0, 8, 2):
            left = (left + f(r, right)) % a
            right = (right + f(r + 1, left)) % b
        x = left * b + right
        if x < n:
            return x


def days():
    for year, month in itertools.product(range(1900, 2100), range(1, 13)):
        for day in range(1, calendar.monthrange(year, month)[1] + 1):
            yield year, month, day


def kind(month, day):
    return f"{int(month >= 10)}{0 if day < 10 else 1 if day < 13 else 2}"


@pytest.fixture(scope="module")
def by_kind():
    found = {}
    for y, m, d in days():
        found.setdefault(kind(m, d), []).append((y, m, d))
    return found


DATES = [(2020, 3, 25), (1999, 4, 13), (2020, 1, 2), (1984, 2, 29), (1900, 1, 1), (2099, 12, 31), (2011, 10, 11), (2012, 12, 12), (1970, 9, 9)]


@pytest.mark.parametrize(("y", "m", "d"), DATES)
def test_dates(by_kind, y, m, d):
    same = by_kind[kind(m, d)]
    a, b, c = same[permuted(len(same), f"date {kind(m, d)}", same.index((y, m, d)))]
    written = {f"{y}-{m:02d}-{d:02d}": f"{a}-{b:02d}-{c:02d}", f"{d:02d}.{m:02d}.{y}": f"{c:02d}.{b:02d}.{a}", f"{d}.{m}.{y}": f"{c}.{b}.{a}", f"{m}/{d}/{y}": f"{b}/{c}/{a}", f"{m:02d}/{d:02d}/{y}": f"{b:02d}/{c:02d}/{a}"}
    if d > 12:
        written[f"{d}/{m}/{y}"], written[f"{d}/{m:02d}/{y}"] = f"{c}/{b}/{a}", f"{c}/{b:02d}/{a}"
    for text, expected in written.items():
        assert P.replace(text) == expected and BACK.replace(expected) == text


@pytest.mark.parametrize("text", ["31/02/2020", "13/13/2020", "2021-02-29", "0/1/2020", "1/0/2020", "30.02.2000", "2100-01-01", "1899-12-31"])
def test_no_dates(text):
    assert P.replace(text) == text


@pytest.mark.parametrize(("code", "national", "ways"), [
    ("1", "7225558977", ["+17225558977", "+1 (722) 555-8977", "+1 722 555 8977", "(722) 555-8977", "722-555-8977", "+1.722.555.8977"]),
    ("44", "2079460958", ["+442079460958", "+44 20 7946 0958", "+44 (20) 7946 0958"]), ("353", "12345678", ["+35312345678", "+353 1234 5678", "+353 12 34 56 78"])])
def test_phones(code, national, ways):
    n = 10 ** len(national)
    expected = f"{permuted(n, 'phone ' + code, int(national)):0{len(national)}d}"
    for way in ways:
        found = P.replace(f"call {way} now")[5:-4]
        digits = re.sub(r"\D", "", found)
        assert digits == (code if way[0] == "+" else "") + expected
        assert re.sub(r"\d", "0", found) == re.sub(r"\d", "0", way) and BACK.replace(found) == way


def test_letter_case_does_not_matter():
    low, high, other = P.replace("anna.b@mail.com"), P.replace("Anna.B@Mail.com"), P.replace("ANNA.B@MAIL.COM")
    assert low == high.lower() == other.lower() != "anna.b@mail.com"
    assert [c.isupper() for c in high] == [c.isupper() for c in "Anna.B@Mail.com"] and BACK.replace(high) == "Anna.B@Mail.com"
    letters, value, n = "annabmail", 0, 26**9
    for c in letters:
        value = value * 26 + ord(c) - 97
    new, out = permuted(n, "email", value), ""
    for _ in letters:
        new, k = divmod(new, 26)
        out = chr(97 + k) + out
    assert low.replace(".", "").replace("@", "") == out + "com"


def test_cards_ssns_and_addresses():
    body = permuted(10**14, "card 4", int("11111111111111"))
    digits = f"4{body:014d}"
    check = next(d for d in range(10) if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits + str(d)))) % 10 == 0)
    assert P.replace("4111-1111-1111-1111").replace("-", "") == f"{digits}{check}"
    ip = permuted(2**32, "ip", 10 << 24 | 20 << 16 | 30 << 8 | 40)
    assert P.replace("10.20.30.40") == ".".join(str(ip >> s & 255) for s in (24, 16, 8, 0))


@settings(max_examples=300, deadline=None)
@given(st.one_of(
    st.dates().map(lambda d: f"{d.day}/{d.month}/{d.year:04d}"), st.dates().map(lambda d: f"{d.month:02d}/{d.day}/{d.year:04d}"), st.dates().map(str), st.dates().map(lambda d: f"{d.day:02d}.{d.month}.{d.year:04d}"),
    st.from_regex(r"\A\+[1-9]\d{9,11}\Z", fullmatch=True).filter(str.isascii), st.from_regex(r"\A\(\d{3}\) \d{3}-\d{4}\Z", fullmatch=True).filter(str.isascii), st.from_regex(r"\A\d{4}( \d{4}){3}\Z", fullmatch=True).filter(str.isascii),
    st.from_regex(r"\A[A-Za-z][a-z0-9.]{0,8}@[a-zA-Z]{1,9}\.(com|org|DE)\Z", fullmatch=True).filter(str.isascii), st.from_regex(r"\A\d{3}-\d{2}-\d{4}\Z", fullmatch=True).filter(str.isascii), st.from_regex(r"\A\d{1,3}(\.\d{1,3}){3}\Z", fullmatch=True).filter(str.isascii)))
def test_any_value_comes_back(text):
    new = P.replace(text)
    assert BACK.replace(new) == text
    if not re.fullmatch(r"\d+(\.\d+){3}", text):  # octets may get shorter or longer
        assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", new))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", text)))


def test_a_key_is_needed_off_local_sessions():
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return settings_.get(name, default)

        class sparkContext:
            master = "spark://host:7077"

    settings_ = {}
    with pytest.raises(ValueError, match=pii.KEY_SETTING):
        pii.session_key(Session)
    settings_[pii.KEY_SETTING] = "own"
    assert pii.session_key(Session) == b"own"


def test_a_session_without_a_key_gets_its_own():
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return settings_.get(name, default)

            @staticmethod
            def set(name, value):
                settings_[name] = value

        class sparkContext:
            master = "spark://host:7077"

    settings_ = {}
    key = pii.run_key(Session)
    assert len(key) >= 32 and key != pii.PUBLISHED_KEY and pii.run_key(Session) == key == settings_[pii.KEY_SETTING].encode()
    settings_.clear()
    assert pii.run_key(Session) != key


@pytest.mark.parametrize("text", ["123456789012345\u0664", "1\u0662345678901234\u0666", "4111 1111 1111 111\uff11", "+1\u0662 555 123 4567", "12\u0663-45-6789", "1\uff192.168.0.1", "\uff1220\uff124-01-02"])
def test_digits_of_other_scripts(text):
    new = P.replace(text)
    assert BACK.replace(new) == text
    assert [c for c in new if not c.isascii()] == [c for c in text if not c.isascii()]


@pytest.mark.parametrize("text", ["order 4000123412341235 today", "at 1718704800124 ms", "ISBN 978-3-16-148410-1", "id 1234567890123456789", "4111 1111 1111 1112", "4111-1111-1111-1112", "day 2024-02-30", "addr 300.1.1.1", "666-12-1234", "GB00 WEST 1234 5698 7654 32"])
def test_what_fails_its_validation_stays(text):
    assert pii.Pseudonyms(b"k").replace(text) == text


def test_accounts_are_an_option():
    """Long numbers that fail the check digit: with the option they are permuted, fail afterwards too, stay linked and can be undone; valid ones don't depend on it."""
    text = "card 4111 1111 1111 1111, account 4111 1111 1111 1112 and 4111-1111-1111-1112"
    plain, both = pii.Pseudonyms(b"k").replace(text), pii.Pseudonyms(b"k", accounts=True).replace(text)
    assert plain.endswith("account 4111 1111 1111 1112 and 4111-1111-1111-1112")
    assert plain[:25] == both[:25] != text[:25]
    first, second = (re.sub("[ -]", "", x) for x in re.findall(r"[0-9]{4}(?:[ -][0-9]{4}){3}", both)[1:])
    assert first == second != "4111111111111112"
    assert pii.luhn(first[:-1]) != int(first[-1])
    assert pii.Pseudonyms(b"k", undo=True, accounts=True).replace(both) == text
    assert pii.Pseudonyms(b"k", undo=True).replace(plain) == text
