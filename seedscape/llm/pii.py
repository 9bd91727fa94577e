"""Format-preserving pseudonyms for personal numbers, dates and names of accounts.

A value that is valid in its format is replaced by another valid value of the same format,
by a keyed Feistel permutation of all of them. Equal values get equal pseudonyms in
every document, different values different ones, and whoever holds the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from seedscape.llm.common import map_batches, with_fields

ROUNDS = 10
#: Characters of a secret that are permuted at once.
PIECE = 64


class Feistel:
    """Keyed permutations of 0 .. size - 1, one for each ``tweak``."""

    def __init__(self, key: bytes, backward: bool = False) -> None:
        self.key, self.backward = hashlib.sha256(key).digest(), backward

    def _round(self, tweak: str, size: int, i: int, half: int) -> int:
        message = f"{tweak}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest(), "big")

    def _once(self, value: int, size: int, tweak: str) -> int:
        width = isqrt(size - 1) + 1
        high, low = divmod(value, width)
        for i in reversed(range(ROUNDS)) if self.backward else range(ROUNDS):
            sign = -1 if self.backward else 1
            if i % 2:
                high = (high + sign * self._round(tweak, size, i, low)) % width
            else:
                low = (low + sign * self._round(tweak, size, i, high)) % width
        return high * width + low

    def permute(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda x: True) -> int:
        """The image of a valid value among the valid values, by walking the cycle up to the next of them."""
        while True:
            value = self._once(value, size, tweak)
            if value < size and valid(value):
                return value


def _put(template: str, letters: str, alphabet: Callable[[str], bool]) -> str:
    """``template`` with the characters of an alphabet replaced in turn."""
    fresh = iter(letters)
    return "".join(next(fresh) if alphabet(c) else c for c in template)


def _is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def _digits(text: str) -> str:
    return "".join(filter(_is_digit, text))


def _permuted_digits(digits: str, cipher: Feistel, kind: str, valid: Callable[[str], bool] = lambda s: True) -> str:
    n = len(digits)
    return f"{cipher.permute(int(digits), 10**n, kind, lambda x: valid(f'{x:0{n}}')):0{n}}"


def _mixed(text: str, cipher: Feistel, kind: str) -> str:
    """ASCII digits and letters permuted within their classes; other characters stay."""
    classes = [
        (10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c) for c in text
    ]
    value, size = 0, 1
    for c, (radix, first) in zip(text, classes):
        value, size = value * radix + ord(c) - ord(first), size * radix
    if size == 1:
        return text
    value = cipher.permute(value, size, f"{kind}|{''.join(first for _, first in classes)}")
    out = []
    for radix, first in reversed(classes):
        value, digit = divmod(value, radix)
        out.append(chr(ord(first) + digit))
    return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit that a card number with these leading digits ends in."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _card(text: str, cipher: Feistel) -> str | None:
    digits = _digits(text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = _permuted_digits(digits[:-1], cipher, "card")
    return _put(text, body + luhn_digit(body), _is_digit)


def _phone(text: str, cipher: Feistel) -> str | None:
    country = re.match(r"\+[0-9]{1,3}", text)
    head = country.group() if country else ""
    rest = text[len(head) :]
    digits = _digits(rest)
    if not 7 <= len(digits) <= 12:
        return None
    return head + _put(rest, _permuted_digits(digits, cipher, "phone"), _is_digit)


def _ipv4(text: str, cipher: Feistel) -> str | None:
    octets = text.split(".")
    if any(len(o) > 1 and o[0] == "0" or int(o) > 255 for o in octets):
        return None
    value = cipher.permute(int.from_bytes(map(int, octets), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(text: str, cipher: Feistel) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = _digits(text)
    return _put(text, _permuted_digits(digits, cipher, "ssn", valid), _is_digit) if valid(digits) else None


_FIRST_DAY = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _FIRST_DAY).days


def _date(text: str, cipher: Feistel) -> str | None:
    """Days of 1900 to 2099, year first, or day or month first; day first where both can be meant."""
    parts, mark = re.split(r"([-/.])", text)[::2], re.search(r"[-/.]", text).group()
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        fields = dict(zip(order, map(int, parts)))
        try:
            day = (datetime.date(fields["y"], fields["m"], fields["d"]) - _FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        on = lambda x: _FIRST_DAY + datetime.timedelta(x)
        new = on(cipher.permute(day, _DAYS, f"date {order}", lambda x: order != "mdy" or on(x).day > 12))
        return mark.join({"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}[f] for f in order)
    return None


def _iban(text: str, cipher: Feistel) -> str | None:
    packed = text.replace(" ", "")
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(packed) <= 34 or as_number(packed[4:] + packed[:4]) % 97 != 1:
        return None
    account = _mixed(packed[4:], cipher, "iban" + packed[:2])
    check = 98 - as_number(account + packed[:2] + "00") % 97
    return _put(text, f"{packed[:2]}{check:02}{account}", lambda c: c != " ")


def _email(text: str, cipher: Feistel) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_mixed(local, cipher, 'email')}@{domain}"


def _key(text: str, cipher: Feistel) -> str | None:
    return text[:4] + _mixed(text[4:], cipher, "key")


def _secret(text: str, cipher: Feistel) -> str | None:
    head = re.match(r"""\w+["']?\s*[=:]\s*["']?""", text).group()
    # a piece is as long as a round's digest can mix
    pieces = [text[at : at + PIECE] for at in range(len(head), len(text), PIECE)]
    return head + "".join(_mixed(piece, cipher, f"secret {i}" if i else "secret") for i, piece in enumerate(pieces))


#: Kind, shape, and what replaces a text of that shape, or None if it is not valid. The first shape that fits counts.
KINDS: list[tuple[str, str, Callable[[str, Feistel], str | None]]] = [
    ("email", r"(?<![\wÀ-ԯ.%+-])[A-Za-z0-9À-ԯ._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])", _email),
    ("secret", r"""(?<!\w)(?i:password|passwd|token|secret|api_key|apikey)["']?\s{0,3}[=:]\s{0,3}["']?[0-9A-Za-z_-]{8,}""", _secret),
    ("key", r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)", _key),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)(?!\w)", _iban),
    ("date", r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w/-]|\.[0-9])", _date),
    ("ipv4", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])", _ipv4),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])", _card),
    ("phone", r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])", _phone),
    ("phone", r"(?<![\w.+-])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![\w-])", _phone),
]

# a letter outside of ASCII ends a value, as in text without blanks; only in the names of mail accounts it is a part
_SHAPES = [(kind, re.compile(shape, re.ASCII), replace) for kind, shape, replace in KINDS]
#: What a text has to contain to hold any of the shapes that begin with a digit, a plus or a parenthesis.
_NUMBER = re.compile(r"[0-9](?:[-0-9 ().+/]{6,})|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[A-Z]{2}[0-9]{2}")
_MARKS = {"email": "@", "key": "AKIA"}
_WORDS = ("password", "passwd", "token", "secret", "api_key", "apikey")


def pseudonymized(text: str, cipher: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and where in it the pseudonyms stand: (kind, start, end)."""
    numbers, small = _NUMBER.search(text) is not None, text.lower()
    found: list[tuple[int, int, str, str]] = []  # in order; no two overlap
    for kind, shape, replace in _SHAPES:
        if kind in _MARKS:
            possible = _MARKS[kind] in text
        else:
            possible = any(w in small for w in _WORDS) if kind == "secret" else numbers
        made = []
        if possible:
            for m in shape.finditer(text):
                at = bisect_left(found, (m.end(),))  # those before it begin before this value ends
                if at and found[at - 1][1] > m.start():
                    continue
                new = replace(m.group(), cipher)
                if new is not None:
                    made.append((m.start(), m.end(), kind, new))
            if made:  # matches of one shape do not overlap each other
                found = sorted(found + made)
    if not found:
        return text, []
    out, places, at, length = [], [], 0, 0
    for start, end, kind, new in found:
        out += [text[at:start], new]
        length += start - at
        places.append((kind, length, length + len(new)))
        length += len(new)
        at = end
    return "".join([*out, text[at:]]), places


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", out_col: str = "pii", restore: bool = False) -> DataFrame:
    """Replace the personal values in ``text_col`` and list them in ``out_col``, an array of (kind, start,
    end), in characters of the new text. ``restore`` goes back, with the same key.

    All rows and other columns stay, repeated rows too; a column named ``out_col`` is replaced. A null
    text stays null, with no values; an empty text stays empty. Values that are not valid in their
    format (a card number whose check digit is wrong, 30 February) are left alone. The domain of an
    address and the country code of a number stay. In a format of few values a value may keep its own.
    """
    docs = docs.drop(out_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Feistel(key, backward=restore)
        for batch in batches:
            texts, places = [], []
            for text in batch.column(batch.schema.names.index(text_col)).to_pylist():
                new, found = pseudonymized(text, cipher) if text else (text, [])
                texts.append(new)
                places.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            columns = {text_col: pa.array(texts, pa.string()), out_col: pa.array(places, kind)}
            changed = [columns.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([*changed, columns[out_col]], names=[*batch.schema.names, out_col])

    return map_batches(docs, run, with_fields(docs, (out_col, "array<struct<kind:string,start:int,end:int>>")))
