"""Format-preserving Feistel pseudonyms for personal data (operator 6).

Found in whole texts: e-mail addresses, payment card numbers (Luhn), IBANs
(modulo 97), US social security numbers (valid areas), IPv4 addresses,
telephone numbers and dates. A candidate that fails its validation may have
taken in neighbours: its prefixes are tried, then the search goes on after its
first group. A valid one is mapped by a keyed permutation of all values of its
format, so it stays valid where it has check digits, keeps its punctuation,
and equal values, in whatever document, get equal pseudonyms; the key undoes it
(beside other digits, by the finds' places: a pseudonym and its neighbour may
happen to validate as one).

The key comes from the caller. :func:`session_key` takes it from the setting
``spark.millrace.pii.key``; where none is set it draws one for this process, so
that nobody can undo what was written, and other runs give other pseudonyms.

The permutation is a Feistel network over [0, n) with n = a * b split in two
near-equal halves; values beyond n walk the cycle until they fall inside.

Cases: a null text stays null with no finds; an empty one stays empty; a text
of any length is searched whole, in time that follows its length, unbroken
tokens too; each
row is treated alone, so repeated rows, ties and null ids change nothing;
an empty table gives no rows. Other columns, whatever their names, pass
through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "card", "iban", "ssn", "ipv4", "phone", "date")
#: Where a session keeps the key.
KEY_SETTING = "spark.millrace.pii.key"
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

_FIND = re.compile(
    r"(?<![\w.+-])[_.+-]*+(?P<email>[^\W_][\w.+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"
    r"|(?<![\w.])(?:"
    r"(?P<ipv4>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\w]|\.\d)"
    r"|(?P<date>\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![\w]|[./-]\d)"
    r"|(?P<ssn>\d{3}-\d\d-\d{4})(?![\w]|-\d)"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30})(?!\w)"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)"
    r")"
)
#: The kinds whose candidates may take in neighbours, each alone, in the order of the search.
_GREEDY = {
    "card": re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"),
    "iban": re.compile(r"(?<![\w.])[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}(?!\w)"),
    "phone": re.compile(
        r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)"
    ),
}
#: The telephone country codes of one and of two digits; all others have three.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
_GROUP = re.compile(r"[^\W_]+")
#: A text without one of these holds nothing that is looked for.
_ANY = re.compile(r"@|\d[\d ().-]*\d")


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10


class Pseudonyms:
    """Keyed permutations; ``back`` undoes them."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back
        self.permute = lru_cache(1 << 16)(self._permute)

    def _round(self, tweak: str, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{x}".encode(), key=self.key, digest_size=16).digest(), "little")

    def _once(self, tweak: str, a: int, b: int, x: int) -> int:
        left, right = divmod(x, b)
        for i in range(8):
            i = 7 - i if self.back else i
            sign = -1 if self.back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left)) % b
            else:
                left = (left + sign * self._round(tweak, i, right)) % a
        return left * b + right

    def _permute(self, tweak: str, n: int, x: int) -> int:
        """The image of x under the permutation of [0, n) that the tweak names."""
        a = isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        x = self._once(tweak, a, b, x)
        while x >= n:
            x = self._once(tweak, a, b, x)
        return x

    def walk(self, tweak: str, n: int, x: int, valid: Callable[[int], bool]) -> int:
        """As ``permute``, but among the valid values alone."""
        x = self.permute(tweak, n, x)
        while not valid(x):
            x = self.permute(tweak, n, x)
        return x

    def digits(self, tweak: str, s: str) -> str:
        """A digit string of the same length."""
        return str(self.permute(f"{tweak}{len(s)}", 10 ** len(s), int(s))).zfill(len(s)) if s else s

    def mixed(self, tweak: str, s: str) -> str:
        """Digits to digits, letters to letters of the same case, the rest as it is."""
        sizes, base, value = [], [], 0
        for c in s:
            if "0" <= c <= "9":
                sizes.append(10), base.append("0")
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                sizes.append(26), base.append("a" if c >= "a" else "A")
            elif c.isalpha() and ord(c) > 127:
                letters, places = _other_letters()
                sizes.append(len(letters)), base.append("L")
                value = value * sizes[-1] + places[c]
                continue
            else:
                sizes.append(1), base.append(c)
            value = value * sizes[-1] + ord(c) - ord(base[-1])
        n = 1
        for k in sizes:
            n *= k
        if n == 1:
            return s
        shape = "".join("9" if k == 10 else "a" if b == "a" else "A" if k == 26 else "\x00" if k > 26 else b for k, b in zip(sizes, base, strict=True))
        value = self.permute(f"{tweak}{shape}", n, value)
        out = []
        for k, b in zip(reversed(sizes), reversed(base), strict=True):
            value, d = divmod(value, k)
            out.append(_other_letters()[0][d] if k > 26 else chr(ord(b) + d))
        return "".join(reversed(out))

    # --- one method a kind: the pseudonym, or None when the candidate isn't valid

    def email(self, s: str) -> str:
        """Local part and host labels are permuted; the last label stays."""
        local, _, host = s.rpartition("@")
        head, _, top = host.rpartition(".")
        return f"{self.mixed('email', local)}@{'.'.join(self.mixed('host', x) for x in head.split('.'))}.{top}"

    def card(self, s: str) -> str | None:
        """All digits but the last are permuted; the last makes the sum right."""
        d = re.sub(r"\D", "", s)
        if luhn(d) or len(set(d)) == 1:
            return None
        body = self.digits("card", d[:-1])
        return _refill(s, body + str(-luhn(body + "0") % 10))

    def iban(self, s: str) -> str | None:
        """The account is permuted by class; the check digits are made anew."""
        d = s.replace(" ", "")
        if not 15 <= len(d) <= 34 or _mod97(d[4:] + d[:4]) != 1:
            return None
        body = self.mixed(d[:2], d[4:])
        return _refill(s, f"{d[:2]}{98 - _mod97(body + d[:2] + '00'):02d}{body}")

    def ssn(self, s: str) -> str | None:
        """Permuted among numbers with a valid area, group and serial."""

        def valid(x: int) -> bool:
            area, rest = divmod(x, 10**6)
            return area not in (0, 666) and area < 900 and rest // 10**4 > 0 and rest % 10**4 > 0

        x = int(s.replace("-", ""))
        return _refill(s, f"{self.walk('ssn', 10**9, x, valid):09d}") if valid(x) else None

    def ipv4(self, s: str) -> str | None:
        """Permuted among all addresses."""
        parts = [int(p) for p in s.split(".")]
        if max(parts) > 255 or any(p != str(int(p)) for p in s.split(".")):
            return None
        x = self.permute("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def phone(self, s: str) -> str | None:
        """A leading + and its country code stay; all other digits are permuted."""
        code = re.match(r"\+\d{1,3}(?=\D)", s) or _COUNTRY.match(s)
        d = re.sub(r"\D", "", s)
        if not 8 <= len(d) <= 15 and not (len(d) == 7 and code):
            return None
        keep = len(code[0]) - 1 if code else 0
        return _refill(s, d[:keep] + self.digits("phone", d[keep:]))

    def date(self, s: str) -> str | None:
        """Permuted among the days from 1900 to 2099; day and month keep their order and width.

        With slashes the month is first; where it can't be, the day is, and
        the image has such a day too, so that the order can be told again.
        """
        mark = re.search(r"\D", s)[0]
        parts = [int(p) for p in s.split(mark)]
        orders = [(0, 1, 2)] if mark == "-" else [(2, 0, 1), (2, 1, 0)] if mark == "/" else [(2, 1, 0)]
        for order in orders:
            try:
                day = datetime.date(*(parts[i] for i in order)).toordinal() - _FIRST_DAY
                break
            except ValueError:
                pass
        else:
            return None
        if not 0 <= day < _DAYS:
            return None
        of = lambda x: datetime.date.fromordinal(_FIRST_DAY + x)
        if order == orders[0]:
            new = of(self.permute("date", _DAYS, day))
        else:
            new = of(self.walk("date, day first", _DAYS, day, lambda x: of(x).day > 12))
        wide = mark == "-" or all(len(p) != 1 for p in s.split(mark))
        fields = [0, 0, 0]
        for i, v in zip(order, (new.year, new.month, new.day), strict=True):
            fields[i] = v
        return mark.join(str(v).zfill(2) if wide else str(v) for v in fields)


@lru_cache(1)
def _other_letters() -> tuple[str, dict[str, int]]:
    """All letters beyond ASCII, and the place of each."""
    letters = "".join(c for c in map(chr, range(128, 0x110000)) if c.isalpha())
    return letters, {c: i for i, c in enumerate(letters)}


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _refill(shape: str, chars: str) -> str:
    """``chars`` in place of the alphanumerics of ``shape``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


_READY: dict[tuple[bytes, bool], Pseudonyms] = {}


def replace(text: str, keys: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the old text."""
    if not _ANY.search(text):
        return text, []
    out, finds, last, at = [], [], 0, 0
    while m := _FIND.search(text, at):
        kind = m.lastgroup
        begin, end = m.span(kind)
        new = getattr(keys, kind)(m[kind])
        if new is None:
            kind, end, new = _shorter(text, m, keys)
        if new is None:
            at = _GROUP.search(text, begin).end()
            continue
        out += [text[last:begin], new]
        last = at = end
        finds.append((kind, begin, end))
    return "".join([*out, text[last:]]), finds


def _shorter(text: str, m: re.Match, keys: Pseudonyms) -> tuple[str, int, str | None]:
    """Kind, end and pseudonym of the longest valid candidate at the start of one that failed.

    A candidate may have taken in what stands after it, so its prefixes that
    end at a separator are tried, as that kind and as the kinds after it.
    """
    kinds = list(_GREEDY)
    for kind in kinds[kinds.index(m.lastgroup) if m.lastgroup in kinds else 0 :]:
        whole = _GREEDY[kind].match(text, m.start())
        if not whole:
            continue
        s = whole[0]
        for n in range(len(s), 0, -1):
            if n < len(s) and (s[n].isalnum() or not s[n - 1].isalnum()):
                continue
            if _GREEDY[kind].fullmatch(text, m.start(), m.start() + n):
                new = getattr(keys, kind)(s[:n])
                if new is not None:
                    return kind, m.start() + n, new
    return "", 0, None


_RESULT = pa.struct(
    [
        ("text", pa.string()),
        ("finds", pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
    ]
)


@lru_cache(1)
def _drawn() -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or one drawn for this process."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _drawn()


def pseudonymise(text: Column, key: bytes, back: bool = False) -> Column:
    """A struct of the text with pseudonyms and its ``finds`` (kind, first, last)."""

    @F.arrow_udf("struct<text:string,finds:array<struct<kind:string,first:bigint,last:bigint>>>")
    def run(texts: pa.Array) -> pa.Array:
        keys = _READY.setdefault((key, back), Pseudonyms(key, back))
        out = []
        for at in range(0, len(texts), 256):
            for t in texts.slice(at, 256).to_pylist():
                if t is None:
                    out.append({"text": None, "finds": []})
                    continue
                new, finds = replace(t, keys)
                out.append({"text": new, "finds": [{"kind": k, "first": a, "last": b} for k, a, b in finds]})
        return pa.array(out, _RESULT)

    return run(text)
