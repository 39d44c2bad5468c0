"""Operator 10: format-preserving pseudonyms of personal data by a keyed Feistel permutation.

A value that passes its format's check has a rank among all values of the format; a keyed Feistel
network with cycle walking permutes the ranks, and the new rank is written in the same format. Equal
values get equal pseudonyms in all documents, different ones of a format stay different, and the
key's holder can go back. Values that fail their check (a wrong check digit, an octet of 300, a 31st of
April) stay as they are.

Formats: e-mail addresses, card numbers (Luhn), North American and other international telephone
numbers, IPv4 addresses, social security numbers, IBANs (mod 97), calendar dates in numbers, and
secrets: long hexadecimal tokens, access keys, and what follows ``password=`` and the like.

A value has one rank however it is written: a date with the year first or last, day or month first; a
telephone number with other spaces, brackets or without its country's 1; an address or hexadecimal token
in other case. A day stays in its half of the month's days, those that could be a month's number and the
others, so that what is read out of a date written with the year last doesn't change.

Null texts stay null with no values; empty texts stay empty. A text is one row whatever its length, and
null ids are passed on. Repeated rows get equal results. Other columns are passed through where ``keep``
asks for it, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
import warnings
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import blocks, claim, tune

#: The session's setting that holds the key. Without it the key is that of tests and benchmarks, with a warning: anyone can reverse that.
KEY_SETTING, KEY = "spark.tessella.pii.key", b"a key for tests, not for real data"
ROUNDS = 8
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute(rank: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: an alternating Feistel network on a times b >= size, walked until it is in range."""
    if size < 2:
        return rank
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def f(r: int, x: int, m: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d|" % (r, size, x) + tweak, key=key[:64], digest_size=24).digest()) % m

    x = rank
    while True:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * f(r, left, b)) % b
            else:
                left = (left + sign * f(r, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def _luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """Put digits in the places of a value's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _alphabets(text: str) -> list[str]:
    return [_LOWER if c in _LOWER else _UPPER if c in _UPPER else _DIGIT if c in _DIGIT else "" for c in text]


def _chars(text: str, move: Callable[[int, int, bytes], int], kind: bytes, alphabets: list[str] | None = None) -> str:
    """Permute all letters and digits of a text, each within its own kind."""
    alphabets = alphabets or _alphabets(text)
    rank, size = 0, 1
    for c, alphabet in zip(text, alphabets, strict=True):
        if alphabet:
            rank, size = rank * len(alphabet) + alphabet.index(c), size * len(alphabet)
    rank = move(rank, size, kind)
    out = []
    for c, alphabet in zip(reversed(text), reversed(alphabets), strict=True):
        if alphabet:
            rank, k = divmod(rank, len(alphabet))
            c = alphabet[k]
        out.append(c)
    return "".join(reversed(out))


Move = Callable[[int, int, bytes], int]


def _cased(v: str, new: str) -> str:
    """A value of lower-case letters with the capitals where ``v`` has them."""
    return "".join(b.upper() if a in _UPPER else b for a, b in zip(v, new, strict=True))


def _email(v: str, move: Move) -> str | None:
    local, _, domain = v.rpartition("@")
    if not local or local[0] == "." or local[-1] == "." or ".." in v:
        return None
    head, dot, top = domain.rpartition(".")
    own = f"{local}@{head}"
    return _cased(own, _chars(own.lower(), move, b"email" + top.lower().encode())) + dot + top


def _card(v: str, move: Move) -> str | None:
    digits = re.sub(r"\D", "", v)
    if not 13 <= len(digits) <= 19 or _luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    body = digits[:-1]
    new = str(move(int(body), 10 ** len(body), b"card")).zfill(len(body))
    return _fill(v, new + str(_luhn(new)))


#: Fixed values of the international numbering plan: country codes of one and of two digits; the others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _phone(v: str, move: Move) -> str | None:
    digits = re.sub(r"\D", "", v)
    if v.startswith("+") and digits[0] != "1":
        code = next((c for c in CODES if digits.startswith(c)), digits[:3])
        rest = digits[len(code) :]
        if not 6 <= len(rest) <= 12:
            return None
        return _fill(v, code + str(move(int(rest), 10 ** len(rest), b"phone" + code.encode())).zfill(len(rest)))
    lead = digits[:-10]
    own = digits[-10:]
    if len(own) != 10 or lead not in ("", "1"):
        return None
    if own[0] in "01" or own[3] in "01":  # no number of the plan, but written as one with its country code: among such
        if not v.startswith("+"):
            return None
        rank = move(int(own), 10**10, b"odd")
        while str(rank).zfill(10)[0] not in "01" and str(rank).zfill(10)[3] not in "01":
            rank = move(rank, 10**10, b"odd")
        return _fill(v, lead + str(rank).zfill(10))
    rank = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
    rank = move(rank, 800 * 800 * 10_000, b"nanp")
    area, rest = divmod(rank, 800 * 10_000)
    office, line = divmod(rest, 10_000)
    return _fill(v, f"{lead}{area + 200}{office + 200}{line:04d}")


def _ip(v: str, move: Move) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    a, b, c, d = map(int, parts)
    x = move(a << 24 | b << 16 | c << 8 | d, 1 << 32, b"ip")
    return f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"


def _ssn(v: str, move: Move) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank = move(rank, 898 * 99 * 9999, b"ssn")
    area, rest = divmod(rank, 99 * 9999)
    area += 1
    return f"{area + (area >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def _iban(v: str, move: Move) -> str | None:
    flat = v.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _chars(flat[4:], move, b"iban" + flat[:2].encode())
    flat = f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}"
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in v)


_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def _date(v: str, move: Move) -> str | None:
    mark = re.search(r"[-/.]", v)[0]
    parts = v.split(mark)
    if len(parts) != 3:
        return None
    x, y, z = parts
    year_first = len(x) == 4
    # day before month, unless that is no date: then month before day
    orders = [(x, y, z)] if year_first else [(z, y, x), (z, x, y)]
    for k, (yy, mm, dd) in enumerate(orders):
        try:
            day = date(int(yy), int(mm), int(dd)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        # days that could be a month's number are permuted among themselves, and so are the others, in all notations
        d = _walk(day, move, b"date", lambda t: _reading(t) == _reading(day))
        out = (f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}")
        pad = [a if len(b) > 1 else a.lstrip("0") for a, b in zip(out, (yy, mm, dd), strict=True)]
        return mark.join(pad if year_first else [pad[2], pad[1], pad[0]] if k == 0 else [pad[1], pad[2], pad[0]])
    return None


def _reading(day: int) -> bool:
    """Whether a day of the month could be a month."""
    return date.fromordinal(day + _FIRST_DAY).day <= 12


def _walk(day: int, move: Move, kind: bytes, fits: Callable[[int], bool]) -> date:
    t = move(day, _DAYS, kind)
    while not fits(t):
        t = move(t, _DAYS, kind)
    return date.fromordinal(t + _FIRST_DAY)


def _is_hex(v: str) -> bool:
    return bool(re.search(r"[0-9]", v) and re.search(r"[a-fA-F]", v))


def _hex(v: str, move: Move) -> str | None:
    if not _is_hex(v):
        return None
    if v != v.lower() and v != v.upper():
        return _chars(v, move, b"token")
    new = v.lower()
    while not _is_hex(new := _chars(new, move, b"hex", ["0123456789abcdef"] * len(v))):
        pass
    return new if v == v.lower() else new.upper()


def _access_key(v: str, move: Move) -> str | None:
    return v[:4] + _chars(v[4:], move, b"access", [_UPPER + _DIGIT] * (len(v) - 4))


def _secret(v: str, move: Move) -> str | None:
    return _chars(v, move, b"secret")


#: Kinds in order of precedence where two begin at one place.
KINDS: dict[str, tuple[str, Callable[[str, Move], str | None]]] = {
    "secret": (r"(?<=password=)[^\s\"'&;,]{4,}|(?<=passwd=)[^\s\"'&;,]{4,}|(?<=pwd=)[^\s\"'&;,]{4,}|(?<=api_key=)[^\s\"'&;,]{4,}|(?<=secret=)[^\s\"'&;,]{4,}|(?<=token=)[^\s\"'&;,]{4,}", _secret),
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])", _iban),
    "access": (r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])", _access_key),
    "hex": (r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,128})(?![A-Za-z0-9])", _hex),
    "phone": (r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w+.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", _phone),
    "card": (r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
    "ssn": (r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    "ip": (r"(?<![\w.-])(?<!ersion )(?<!elease )(?<!ection )(?<!hapter )(?<!build )(?<!Build )\d{1,3}(?:\.\d{1,3}){3}(?![\w-])(?!\.\d)", _ip),
    "date": (r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})(?![\w/-])(?!\.\d)", _date),
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()), re.ASCII)
_MAY = re.compile(r"[@=0-9]|A[KS]IA")


class Pseudonymiser:
    """Replaces values of all kinds, or writes the first ones back (``back``)."""

    def __init__(self, key: bytes = KEY, back: bool = False):
        def move(rank: int, size: int, tweak: bytes) -> int:
            return permute(rank, size, key, tweak, back)

        self.one = lru_cache(1 << 14)(lambda kind, value: KINDS[kind][1](value, move))

    def apply(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The new text, and start, end and kind of each value in the text before. A value keeps its length, but for IPv4 octets and short days."""
        if not _MAY.search(text):
            return text, []
        out, spans, at, pos = [], [], 0, 0
        while m := _PATTERN.search(text, pos):
            new = self.one(m.lastgroup, m[0])
            if new is None:  # it failed the check of this kind; another kind may fit here
                found = next(((k, n) for k in list(KINDS)[list(KINDS).index(m.lastgroup) + 1 :] if (o := _EACH[k].match(text, m.start())) and (n := (o.end(), self.one(k, o[0])))[1] is not None), None)
                if not found:
                    pos = max(m.start() + 1, m.start() + len(re.match(r"\w*", m[0])[0]))
                    continue
                kind, (end, new) = found
            else:
                kind, end = m.lastgroup, m.end()
            out += [text[at : m.start()], new]
            spans.append((m.start(), end, kind))
            at = pos = end
        return "".join(out) + text[at:], spans


_EACH = {k: re.compile(p, re.ASCII) for k, (p, _) in KINDS.items()}
_MAKERS: dict[bytes, Pseudonymiser] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else that of tests."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the key of tests", stacklevel=2)
    return named.encode() if named else KEY


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: doc_id, the text with pseudonyms, n_values, and kinds (their counts by kind, in order of kind); with ``keep`` the input's columns, the text replaced."""
    tune(df.sparkSession)
    if keep:
        source, at, schema = df, df.columns.index(text_col), df.schema
    else:
        source, at = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), 1
        schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, text string, n_values long, kinds string"
    name = source.columns[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii", _MAKERS.clear)
        maker = _MAKERS.setdefault(key, Pseudonymiser(key))
        for block in blocks(batches, name):
            texts, counts, kinds = [], [], []
            for t in block.column(at).to_pylist():
                new, spans = maker.apply(t) if t else (t, [])
                texts.append(new)
                counts.append(len(spans))
                names = [k for _, _, k in spans]
                kinds.append(",".join(f"{k}:{names.count(k)}" for k in sorted(set(names))))
            if keep:
                columns = [pa.array(texts, pa.string()) if i == at else block.column(i) for i in range(block.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=block.schema.names)
            else:
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_values", "kinds"])

    return source.mapInArrow(run, schema)
