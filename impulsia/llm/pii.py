"""Format-preserving pseudonyms for personal data.

Detected values are validated (Luhn, mod 97, calendar, octets, lengths), and each is replaced by its image under a
keyed Feistel permutation of all values of its format: same length, separators and kind, again valid, and equal values
have equal pseudonyms in every document, while without the key none leads back. Cards keep their first digit, phones
their country code, mails their domain, bank accounts their country; check digits are made anew. A permutation walks on
until its image is valid, so it stays one-to-one.

A null text stays null, an empty one empty; texts without personal data come back unchanged, and values that don't
validate are left alone. Other columns pass, whatever their names (a column of a count's name is replaced by the
count); repeated rows are treated each; an empty table gives an empty one.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm.common import prepare, resident

ROUNDS = 8
#: The key of the registered query; production passes its own.
DEMO_KEY = b"impulsia pseudonyms"
#: Dates are permuted among those of these years.
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ["email", "phone", "card", "ip", "iban", "ssn", "date", "secret"]

_MONTHS = [datetime.date(2000, m, 1).strftime("%B") for m in range(1, 13)]
_MONTH = "(?:" + "|".join(_MONTHS) + ")"
#: Other values that may follow a phone number after a space and are no groups of it.
_OTHER = (
    r"(?! (?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])|[0-9]{1,3}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
    r"|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}))"
)


def _tail(had: int) -> str:
    """Digits, each perhaps after a mark, that make 7 to 15 with those had."""
    least = max(1, 7 - had)
    return r"(?:[ .-]?[0-9]){%d}(?:%s[ .-]?[0-9]){0,%d}" % (least, _OTHER, 15 - had - least)


#: Country code and number in any groups, the area code perhaps in brackets.
_ABROAD = r"\+(?:" + "|".join(r"[0-9]{%d}[ .-]?\([0-9]{%d}\)%s" % (c, a, _tail(c + a)) for c in (1, 2, 3) for a in (1, 2, 3, 4, 5)) + "|[0-9]" + _tail(1) + ")(?![0-9])"
_CODE = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})|1(?=[-. ])")
_MAIL = r"(?P<email>(?<![\w.+-])[\w.+-]{0,63}\w@(?:[\w-]+\.)+[A-Za-z]{2,})"
_REST = (
    r"(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<!\w)(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w))"
    r"|(?P<phone>\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|" + _ABROAD + r"|(?<![\w.+)-])(?:1[-. ])?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-]|\.[0-9]))"
    r"|(?P<date>(?<![\w.-])(?:[0-9]{4}(?P<mark>[-/.])[0-9]{1,2}(?P=mark)[0-9]{1,2}|[0-9]{1,2}(?P<cut>[./-])[0-9]{1,2}(?P=cut)[0-9]{4}|[0-9]{1,2} " + _MONTH + r" [0-9]{4}|" + _MONTH + r" [0-9]{1,2}, [0-9]{4})(?:(?=T[0-9]{2}:?[0-9]{2})|(?![\w-]|[.][0-9])))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?!\w))"
)
_WITH_MAIL, _WITHOUT = re.compile(f"{_MAIL}|{_REST}"), re.compile(_REST)
_DIGIT = re.compile("[0-9]")


class Permutation:
    """Keyed permutations of 0 .. size - 1, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _round(self, tweak: bytes, n: int, value: int, size: int) -> int:
        # 16 bytes more than the size: the remainder is as good as even.
        need, out, block = (size.bit_length() + 7) // 8 + 16, b"", 0
        while len(out) < need:
            out += blake2b(b"%s|%d|%d|%d" % (tweak, n, block, value), key=self.key).digest()
            block += 1
        return int.from_bytes(out[:need], "big") % size

    def __call__(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The image of value; valid must hold for value and marks the set that is permuted."""
        if size < 2:
            return value
        left = 1 << ((size - 1).bit_length() + 1) // 2
        right = -(-size // left)
        t = f"{tweak}|{size}".encode()
        while True:
            a, b = divmod(value, right)
            for n in range(0, ROUNDS, 2):
                a = (a + self._round(t, n, b, left)) % left
                b = (b + self._round(t, n + 1, a, right)) % right
            value = a * right + b
            if value < size and valid(value):
                return value


def luhn_digit(payload: str) -> str:
    """The check digit that completes the payload."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _filled(shape: str, digits: str) -> str:
    """shape with its ASCII digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_ALPHABETS += ["".join(c for c in _LATIN if c.islower()), "".join(c for c in _LATIN if not c.islower())]
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}


def permute_text(f: Permutation, s: str, tweak: str) -> str:
    """s with its letters and digits permuted together, each within its alphabet; other characters stay."""
    value, size = 0, 1
    for c in s:
        if c in _PLACE:
            alphabet, i = _PLACE[c]
            value, size = value * len(alphabet) + i, size * len(alphabet)
    shape = "".join(str(_ALPHABETS.index(_PLACE[c][0])) if c in _PLACE else c for c in s)
    value = f(value, size, f"{tweak}|{shape}")
    out = []
    for c in reversed(s):
        if c in _PLACE:
            value, i = divmod(value, len(_PLACE[c][0]))
            c = _PLACE[c][0][i]
        out.append(c)
    return "".join(reversed(out))


def _email(f: Permutation, s: str) -> str | None:
    local, _, domain = s.rpartition("@")
    return f"{permute_text(f, local, 'email')}@{domain}"


def _phone(f: Permutation, s: str) -> str | None:
    code = (_CODE.match(s) or [""])[0]
    own = _digits(s[len(code) :])
    if not 7 <= len(_digits(s)) <= 15:
        return None
    tweak = "phone+1" if code == "1" else "phone" + code
    return code + _filled(s[len(code) :], str(f(int(own), 10 ** len(own), tweak)).zfill(len(own)))


def _card(f: Permutation, s: str) -> str | None:
    d = _digits(s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + str(f(int(d[1:-1]), 10 ** (len(d) - 2), "card" + d[0])).zfill(len(d) - 2)
    return _filled(s, body + luhn_digit(body))


def _ip(f: Permutation, s: str) -> str | None:
    octets = s.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    v = f(int.from_bytes(map(int, octets), "big"), 1 << 32, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _iban(f: Permutation, s: str) -> str | None:
    plain = s.replace(" ", "")

    def number(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x))

    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_text(f, plain[4:], "iban" + plain[:2])
    whole = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(whole) for c in s)


def _ssn_valid(v: int) -> bool:
    area, group, serial = v // 1000000, v // 10000 % 100, v % 10000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(f: Permutation, s: str) -> str | None:
    v = int(_digits(s))
    return _filled(s, f"{f(v, 10**9, 'ssn', _ssn_valid):09d}") if _ssn_valid(v) else None


def _shapes(s: str) -> list[str]:
    """How a date may be written; of two, the first that is a date holds."""
    if s[0].isalpha():
        return ["%B {d}, %Y"]
    if " " in s:
        return ["{d} %B %Y"]
    mark = next(c for c in s if not c.isdigit())
    if s[:4].isdigit():
        return [f"%Y{mark}%m{mark}%d"]
    return [f"%d{mark}%m{mark}%Y", f"%m{mark}%d{mark}%Y"]


def _date(f: Permutation, s: str) -> str | None:
    """Numbers parted by dots, dashes or slashes are day, month, year where that is a date, else month, day, year. Where one of them has one digit, days and months stay below ten or not."""
    numbers = re.findall("[0-9]+", s)
    loose = len(numbers) == 3 and any(len(x) == 1 for x in numbers)
    for shape in _shapes(s):
        try:
            day = datetime.datetime.strptime(s, shape.replace("{d}", "%d")).date().toordinal()
        except ValueError:
            continue
        if not FIRST <= day <= LAST:
            return None
        # The order read is part of the format: a pseudonym of month, day, year must not read as day, month, year.
        fields = dict(zip(re.findall("%(.)", shape), numbers))

        def ok(v: int) -> bool:
            d = datetime.date.fromordinal(FIRST + v)
            same = not loose or all((n > 9) == (int(fields[k]) > 9) for k, n in (("d", d.day), ("m", d.month)))
            return same and (d.day > 12 or not shape.startswith("%m"))

        made = datetime.date.fromordinal(FIRST + f(day - FIRST, LAST - FIRST + 1, "date" + shape, ok))
        if loose:
            return re.sub("%(.)", lambda m: f"{ {'d': made.day, 'm': made.month, 'Y': made.year}[m[1]]:0{len(fields[m[1]])}d}", shape)
        return made.strftime(shape.replace("{d}", str(made.day)))
    return None


def _secret(f: Permutation, s: str) -> str | None:
    v = f(int(s, 16), 16 ** len(s), "secret")
    return format(v, "x" if s == s.lower() else "X").zfill(len(s))


_MAKERS = {"email": _email, "phone": _phone, "card": _card, "ip": _ip, "iban": _iban, "ssn": _ssn, "date": _date, "secret": _secret}


def pseudonymise(text: str, f: Permutation) -> tuple[str, dict[str, int]]:
    """text with pseudonyms, and how many values of each kind were replaced."""
    counts: dict[str, int] = {}
    pattern = _WITH_MAIL if "@" in text else _WITHOUT
    if pattern is _WITHOUT and not _DIGIT.search(text):
        return text, counts

    def one(m: re.Match) -> str:
        kind = next(k for k in KINDS if m.groupdict().get(k))
        made = _MAKERS[kind](f, m[0])
        if made is None:
            return m[0]
        counts[kind] = counts.get(kind, 0) + 1
        return made

    return pattern.sub(one, text), counts


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with pseudonyms in the text and a count n_<kind> for each kind, without a shuffle."""
    prepare(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    kept = docs.drop(*counts)
    schema = kept.select("*", *(F.lit(0).alias(c) for c in counts)).schema
    at = kept.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        f = Permutation(key)
        for batch in batches:
            made = [(None, {}) if t is None else pseudonymise(t, f) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in made], pa.string())
            columns += [pa.array([c.get(k, 0) for _, c in made], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *counts])

    return kept.mapInArrow(replace, schema)
