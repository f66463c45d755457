"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation.

A value that passes its kind's check (Luhn, number plan, octets, IBAN remainder, calendar) is numbered
within all values of its format, the number goes through a Feistel network keyed by a secret, walking on
until the result is again a value of the format, and is written as the value was.  So each kind is
permuted: equal values stay equal in all documents, different ones different, checks still pass.

A match that fails its check is tried again without its last characters, digits and capitals being cut at borders of their groups
only; the longest that passes is taken, and the search goes on from its end.

Defined results: a null text stays null; what fails its check at every length is left alone; where two kinds
overlap the one that starts first stands, of equal starts the one named first in KINDS.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from helixframe.llm.shared import per_text

ROUNDS = 8


def permute(x: int, size: int, key: bytes, tweak: bytes, ok: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the numbers below size for which ok holds (x is one of them)."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            mac = hashlib.blake2b(right.to_bytes(width, "big"), digest_size=min(64, width + 8), key=key, person=bytes([r]) + hashlib.blake2b(tweak, digest_size=15).digest())
            left, right = right, (left ^ int.from_bytes(mac.digest(), "big")) & mask
        x = left << half | right
        if x < size and ok(x):
            return x


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), form)


def luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 2
    size = 10**n
    body = lambda x: d[0] + f"{x:0{n}d}"
    new = body(permute(int(d[1:-1]), size, key, b"card%d%s" % (n, d[:1].encode()), lambda x: len({*body(x), str(luhn(body(x)))}) > 1))
    return _refill(text, new + str(luhn(new)))


def phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if text.startswith("+") and not d.startswith("1"):
        n = len(d) - 2  # the first two digits, which hold most of the country code, stay
        if not 9 <= len(d) <= 15:
            return None
        return _refill(text, d[:2] + f"{permute(int(d[2:]), 10**n, key, b'phone' + d[:2].encode() + bytes([n])):0{n}d}")
    if len(d) == 11 and d[0] == "1":
        head, d = "1", d[1:]
    elif len(d) == 10:
        head = ""
    else:
        return None
    plan = lambda x: 2 <= x // 10**9 and 2 <= x // 10**6 % 10
    if plan(int(d)):
        return _refill(text, head + f"{permute(int(d), 10**10, key, b'nanp', plan):010d}")
    if not text.startswith("+"):
        return None
    # written as a number of the plan: such stay among those outside it
    return _refill(text, head + f"{permute(int(d), 10**10, key, b'nanp-outside', lambda x: not plan(x)):010d}")


def _public(x: int) -> bool:
    a, b = x >> 24, x >> 16 & 255
    return 0 < a < 224 and a not in (10, 127) and (a, b) not in ((192, 168), (169, 254)) and not (a == 172 and 16 <= b < 32) and x & 255 not in (0, 255)


def ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = int.from_bytes(bytes(octets), "big")
    if not _public(x):
        return None
    return ".".join(map(str, permute(x, 1 << 32, key, b"ip", _public).to_bytes(4, "big")))


def ssn(text: str, key: bytes) -> str | None:
    ok = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4 > 0
    x = int(_digits(text))
    return _refill(text, f"{permute(x, 10**9, key, b'ssn', ok):09d}") if ok(x) else None


def _mod97(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(body) <= 30 or int(check) != 98 - _mod97(country, body):
        return None
    d = _digits(body)
    new = _refill(body, f"{permute(int(d), 10 ** len(d), key, b'iban' + country.encode() + re.sub(r'[0-9]', '0', body).encode()):0{len(d)}d}") if d else body
    it = iter(f"{country}{98 - _mod97(country, new):02d}{new}")
    return "".join(c if c == " " else next(it) for c in text)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(text: str, key: bytes) -> str | None:
    parts = re.split(r"[-/.]", text)
    sep = re.search(r"[-/.]", text).group()
    year_first = len(parts[0]) == 4
    nums = [int(p) for p in parts]
    year, (month, day) = (nums[0], nums[1:]) if year_first else (nums[2], (nums[1], nums[0]))
    swapped = not year_first and sep == "/" and month > 12  # month/day/year
    if swapped:
        month, day = day, month
    try:
        x = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST <= x <= _LAST:
        return None
    # a day-first date and a month-first one are told apart by a day over 12 only, so such stay such
    kind = b"big" if swapped else b"date"
    big = lambda y: datetime.date.fromordinal(y + _FIRST).day > 12
    new = datetime.date.fromordinal(_FIRST + permute(x - _FIRST, _LAST - _FIRST + 1, key, kind, big if swapped else lambda _: True))
    order = [new.year, new.month, new.day] if year_first else [new.month, new.day, new.year] if swapped else [new.day, new.month, new.year]
    return sep.join(f"{v:0{len(p)}d}" if v < 10 ** len(p) else str(v) for v, p in zip(order, parts, strict=True))


def email(text: str, key: bytes) -> str | None:
    """Letters and digits of the name change for letters of the same case and digits; the domain stays."""
    name, domain = text.rsplit("@", 1)
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in name]
    size, x = 1, 0
    for c, r in zip(name, radix, strict=True):
        size *= r
        x = x * r + (ord(c.lower()) - 97 if r == 26 else int(c) if r == 10 else 0)
    if size == 1:
        return None
    shape = "".join("0" if r == 10 else ("A" if c.isupper() else "a") if r == 26 else c for c, r in zip(name, radix, strict=True))
    x = permute(x, size, key, b"email" + shape.encode() + b"@" + domain.lower().encode())
    out = []
    for c, r in zip(reversed(name), reversed(radix), strict=True):
        x, y = divmod(x, r)
        out.append(c if r == 1 else str(y) if r == 10 else chr((65 if c.isupper() else 97) + y))
    return "".join(reversed(out)) + "@" + domain


# The forms that are looked for, the first named first.
KINDS: dict[str, tuple[re.Pattern, Callable[[str, bytes], str | None]]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), iban),
    "card": (re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"), card),
    "ssn": (re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"), ssn),
    "ip": (re.compile(r"(?<![0-9A-Za-z.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|[.-][0-9A-Za-z])"), ip),
    "date": (re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9])|[./-][0-9])"), date),
    "phone": (re.compile(r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z]|[.-][0-9])"), phone),
}
_ANY = re.compile(r"[0-9@]")
#: Kinds whose values are written in groups, so that what follows a value may look like one group more.
_GROUPED = ("iban", "card", "phone")
_BORDER = re.compile(r"[\x20.-]")
_BARE_PHONE = re.compile(r"[0-9]+\Z")


def _ends(text: str, start: int, end: int, pattern: re.Pattern) -> list[int]:
    """Where a value that the match from start to end begins with may end, the latest first."""
    borders = [b.start() for b in _BORDER.finditer(text, start, end)]
    return [end, *(b for b in reversed(borders) if pattern.fullmatch(text[start:b]))]


def _meets(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of the stretches, in order of their starts, has a place between start and end."""
    k = bisect.bisect_left(taken, (end,))
    return any(b > start for _, b in taken[max(0, k - 20) : k])


def spans(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym), none overlapping."""
    if not _ANY.search(text):
        return []
    found = []
    for place, (kind, (pattern, make)) in enumerate(KINDS.items()):
        at, inside = 0, 0
        taken = sorted((f[0], f[2]) for f in found) if kind == "phone" else []
        while m := pattern.search(text, at):
            at = m.end()
            part = m.start() < inside
            inside = max(inside, m.end())
            for end in _ends(text, m.start(), m.end(), pattern) if kind in _GROUPED else [m.end()]:
                value = text[m.start() : end]
                if kind == "phone" and _BARE_PHONE.match(value):
                    continue  # digits alone do not show a phone number
                if (part or end < m.end()) and _meets(taken, m.start(), end):
                    continue  # no check digit shows that a part of a longer match is a phone number
                new = make(value, key)
                if new is not None:
                    found.append((m.start(), place, end, kind, new))
                    at = end
                    break
            else:
                if kind in _GROUPED and (border := _BORDER.search(text, m.start() + 1, m.end())):
                    at = border.end()
    out, upto = [], 0
    for a, _, b, kind, new in sorted(found):
        if a >= upto:
            out.append((a, b, kind, new))
            upto = b
    return out


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(text, T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("spans", T.StringType())])


def pseudonymize(docs: DataFrame, key: bytes, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` with the new text, the number of values of each kind, and kind:start:end of each in the old text."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key has 16 to 64 bytes")

    def make():
        def work(texts: pa.Array, _):
            new, counts, where = [], {k: [] for k in KINDS}, []
            for t in texts.to_pylist():
                found = spans(t, key) if t else []
                parts, at = [], 0
                for a, b, _, value in found:
                    parts += [t[at:a], value]
                    at = b
                new.append("".join([*parts, t[at:]]) if found else t)
                for k in KINDS:
                    counts[k].append(sum(f[2] == k for f in found))
                where.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
            return [pa.array(new, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(where, pa.string())]

        return work

    return per_text(docs, make, _schema(text), text=text, keep=keep)
