"""Format-preserving pseudonyms for personal data.

Values that pass their own validation (check digits, calendar, octets) are replaced by
a keyed permutation of the values of the same format: a Feistel network over the
format's number space, walked until the result is valid again. The permutation depends
on the key and the kind only, so equal values stay equal in every document, different
values stay different, and nothing needs to be remembered or joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date", "secret")

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w/-])(?:\d{4}(?P<s1>[-/])\d{2}(?P=s1)\d{2}|\d{1,2}(?P<s2>[./-])\d{1,2}(?P=s2)\d{4})(?![\w/-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?![\w-]))",
    re.ASCII,
)
_ANY = re.compile(r"[0-9@]|[0-9a-fA-F]{32}")


class Permuter:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mask(self, tweak: bytes, turn: int, value: int, bits: int) -> int:
        body = turn.to_bytes(1, "big") + tweak + value.to_bytes((bits + 7) // 8 + 1, "big")
        out = b""
        while len(out) * 8 < bits:
            out += hashlib.blake2b(len(out).to_bytes(4, "big") + body, key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _feistel(self, value: int, half: int, tweak: bytes) -> int:
        low = (1 << half) - 1
        left, right = value >> half, value & low
        for turn in range(ROUNDS):
            left, right = right, left ^ self._mask(tweak, turn, right, half)
        return left << half | right

    def permute(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] | None = None) -> int:
        """The image of ``value`` in a keyed permutation of ``range(size)`` (of its valid members)."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        own = f"{tweak}|{size}".encode()
        while True:
            value = self._feistel(value, half, own)
            if value < size and (valid is None or valid(value)):
                return value

    def classes(self, text: str, tweak: str) -> str:
        """Letters stay letters, digits stay digits, and anything else stays itself."""
        spans = [("0", 10) if c.isdigit() else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else None for c in text]
        value, size = 0, 1
        for c, s in zip(text, spans, strict=True):
            if s:
                value, size = value * s[1] + ord(c) - ord(s[0]), size * s[1]
        shape = "".join(s[0] if s else c for c, s in zip(text, spans, strict=True))
        value, out = self.permute(value, size, f"{tweak}|{shape}"), []
        for c, s in zip(reversed(text), reversed(spans), strict=True):
            if s:
                value, digit = divmod(value, s[1])
                c = chr(ord(s[0]) + digit)
            out.append(c)
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _into(text: str, digits: str) -> str:
    """``digits`` laid into the digit places of ``text``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _email(p: Permuter, m: str) -> str | None:
    local, _, domain = m.partition("@")
    return f"{p.classes(local, 'email|' + domain.lower())}@{domain}"


def _card(p: Permuter, m: str) -> str | None:
    digits = re.sub(r"\D", "", m)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2
    body = digits[0] + str(p.permute(int(digits[1:-1]), 10**n, "card|" + digits[0])).zfill(n)
    return _into(m, body + str(luhn(body)))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(p: Permuter, m: str) -> str | None:
    plain = m.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = p.classes(plain[4:], "iban|" + plain[:2])
    check = 98 - _mod97(body + plain[:2] + "00")
    rest = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(rest) for c in m)


def _ssn_valid(value: int) -> bool:
    area, group, serial = value // 10**6, value // 10**4 % 100, value % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(p: Permuter, m: str) -> str | None:
    value = int(m.replace("-", ""))
    return _into(m, str(p.permute(value, 10**9, "ssn", _ssn_valid)).zfill(9)) if _ssn_valid(value) else None


def _phone(p: Permuter, m: str) -> str | None:
    digits = re.sub(r"\D", "", m)
    if not 7 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\+?(\d*)", m)[1]) if m.startswith("+") and re.match(r"\+\d{1,3}[ .(-]", m) else 1 if m.startswith("+") else 0
    n = len(digits) - code
    plan = n == 10 and digits[:code] in ("", "1")  # North American numbers: area and exchange start with 2 to 9
    valid = (lambda v: v // 10**9 >= 2 and v // 10**6 % 10 >= 2) if plan and digits[code] >= "2" and digits[code + 3] >= "2" else None
    return _into(m, digits[:code] + str(p.permute(int(digits[code:]), 10**n, f"phone|{digits[:code] or '1' if plan else digits[:code]}", valid)).zfill(n))


def _ip(p: Permuter, m: str) -> str | None:
    parts = [int(x) for x in m.split(".")]
    if max(parts) > 255:
        return None
    value = p.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def _date(p: Permuter, m: str) -> str | None:
    a, b, c = re.split(r"\D", m)
    orders = ((int(a), int(b), int(c), "ymd"),) if len(a) == 4 else ((int(c), int(a), int(b), "mdy"), (int(c), int(b), int(a), "dmy"))
    for y, month, day, order in orders:
        try:
            at = date(y, month, day).toordinal() - _FIRST
        except ValueError:
            continue
        if not 0 <= at < _DAYS:
            continue
        padded = len(a) == 4 or a.startswith("0") or b.startswith("0") or (len(a) == 2 and len(b) == 2)
        new = date.fromordinal(p.permute(at, _DAYS, "date", None if order != "mdy" and len(a) == 4 else (lambda v: order == "mdy" or date.fromordinal(v + _FIRST).day > 12)) + _FIRST)
        wide = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
        marks = re.findall(r"\D", m)
        return wide[order[0]] + marks[0] + wide[order[1]] + marks[1] + wide[order[2]]
    return None


def _secret(p: Permuter, m: str) -> str | None:
    upper = m != m.lower()
    out = f"{p.permute(int(m, 16), 16 ** len(m), 'secret'):0{len(m)}x}"
    return out.upper() if upper else out


_MAKERS = {"email": _email, "card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "secret": _secret}


def pseudonymise(text: str, p: Permuter) -> tuple[str, dict[str, int]]:
    """The text with validated values replaced, and how many of each kind."""
    counts: dict[str, int] = {}
    if not _ANY.search(text):
        return text, counts

    def put(m: re.Match) -> str:
        kind = next(k for k in KINDS if m[k] is not None)
        new = _MAKERS[kind](p, m[0])
        if new is None:
            return m[0]
        counts[kind] = counts.get(kind, 0) + 1
        return new

    return PATTERN.sub(put, text), counts


def pseudonymise_documents(docs: DataFrame, key: str | bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and a count column ``n_<kind>`` per kind, and ``n_values``.

    A null text stays null with zero counts. Values that fail their validation (a card
    without its check digit, a day that no month has) are left as they are. Columns of
    the input with the counts' names, in whatever case, are replaced. Whole texts are read,
    however long; repeated rows are treated alike. An empty table gives an empty table.
    """
    made = [f"n_{k}" for k in KINDS] + ["n_values"]
    names = [c for c in docs.columns if c.lower() not in made]
    secret = key.encode() if isinstance(key, str) else key
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(secret)
        for b in batches:
            got = [(t, {}) if t is None else pseudonymise(t, p) for t in b.column(place).to_pylist()]
            columns = [b.column(k) if k != place else pa.array([t for t, _ in got], b.schema.types[k]) for k in range(len(names))]
            columns += [pa.array([c.get(k, 0) for _, c in got], pa.int64()) for k in KINDS]
            columns.append(pa.array([sum(c.values()) for _, c in got], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    schema = docs.select(*names)
    for c in made:
        schema = schema.withColumn(c, F.lit(0).cast("bigint"))
    return docs.select(*names).mapInArrow(run, schema.schema)
