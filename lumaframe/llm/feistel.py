"""PII: format-preserving Feistel pseudonyms.

Validated values (e-mail addresses, IPv4 addresses, IBANs, social security numbers, dates, phone and card numbers) are replaced by
a keyed permutation within their own format, so that equal values get equal pseudonyms in every document, pseudonyms pass
the same validation, and the holder of the key can undo them. Texts keep their length, except for addresses of other numbers of digits. A date keeps its order and the
width of its parts; so equal dates in one form are linked.

Edge cases: null texts stay null; empty texts and texts without a value stay as they are; rows are handled one by one, so repeated rows,
null ids and other columns do no harm (a column named like one that is added makes that one's name end in underscores); numbers of 13 to 19 digits that fail the card checksum are no card numbers and stay.
A match that is not valid as its kind is tried with shorter ends, then as the other kinds, and the search goes on one character later.
"""

import calendar
import datetime
import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import unused

ROUNDS = 8
#: For tests and examples. A real run passes its own secret key.
EXAMPLE_KEY = b"example key, not a secret"
#: Dates are permuted within these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

VALUE = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9]))"
)
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
#: The pattern of each kind alone, with a group of its name.
ALONE = dict(zip(KINDS, map(re.compile, re.split(r"\|(?=\(\?P<)", VALUE.pattern))))
#: Length of an IBAN by country (ISO 13616).
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
    "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
#: Digits in the groups that card numbers are written in, beside a single group.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3))


class Permutation:
    """Keyed permutations of [0, size): an alternating Feistel network over a * b >= size, walked until it falls within size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, size: int) -> int:
        data = b"%b|%d|%d" % (tweak, i, half)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=size.bit_length() // 8 + 9).digest()) % size

    def __call__(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        sign = -1 if back else 1
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left, b)) % b
                else:
                    left = (left + sign * self._round(tweak, i, right, a)) % a
            x = left * b + right
            if x < size:
                return x


def luhn(digits: str) -> int:
    """The check digit that completes the digits."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def is_card(text: str) -> bool:
    digits = re.sub("[ -]", "", text)
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1])


def _groups(text: str, s: int) -> list[tuple[int, int]]:
    """The groups of digits from s on with one blank or hyphen between them, to 40 digits: any number from a place in the first 19 ends within these."""
    out, total = [], 0
    while total < 40 and (m := re.compile("[0-9]+").match(text, s)):
        out.append(m.span())
        total += m.end() - s
        s = m.end() + 1
        if text[m.end() : s] not in (" ", "-"):
            break
    return out


def _card_ends(text: str, s: int, e: int) -> tuple[int, int]:
    """The part of the number at s to e, or of the digits behind it, that is to be replaced first. A card number written as one is ranks over longer numbers around
    it; then come the longest beginning that passes the checksum and the whole number."""
    groups = _groups(text, s)
    for i, (a, _) in enumerate(groups):
        if a >= e:
            break
        for n in (5, 4, 3, 1):
            part = groups[i : i + n]
            if len(part) == n and (n == 1 or tuple(y - x for x, y in part) in CARD_GROUPS) and is_card(text[a : part[-1][1]]):
                if a == s:
                    return s, part[-1][1]
                before = ALONE["card"].match(text, s, a)
                if not before:
                    return a, part[-1][1]
                e = before.end()
                break
    return s, next((y for _, y in reversed(groups) if y <= e and is_card(text[s:y])), e)


def spans(text: str, m: re.Match):
    """kind, start and end of what a match of VALUE may be, the likeliest first."""
    s = m.start()
    for kind in KINDS[KINDS.index(m.lastgroup) :]:
        one = m if kind == m.lastgroup else ALONE[kind].match(text, s)
        if not one:
            continue
        if kind == "iban":
            ends = [i for i in range(one.end(), s, -1) if text[i - 1] != " " and not text[i : i + 1].isalnum() and i - s - text.count(" ", s, i) >= 15]
            yield from ((kind, s, e) for e in sorted(ends, key=lambda e: e - s - text.count(" ", s, e) != IBAN_LENGTH.get(text[s : s + 2])))
        elif kind == "card":
            yield kind, *_card_ends(text, s, one.end())
        else:
            yield kind, s, one.end()


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _fill(shape: str, digits: str) -> str:
    """The digits put where the shape has digits."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _mixed(text: str, p: Permutation, tweak: bytes, back: bool) -> str:
    """Letters to letters of the same case, digits to digits, other characters as they are."""
    number, size, radices = 0, 1, []
    for c in text:
        r = 26 if c.isascii() and c.isalpha() else 10 if "0" <= c <= "9" else 1
        radices.append(r)
        if r > 1:
            number, size = number * r + (int(c) if r == 10 else ord(c.lower()) - 97), size * r
    number, out = p(number, size, tweak + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text))).encode(), back), []
    for c, r in zip(reversed(text), reversed(radices)):
        number, d = divmod(number, r)
        out.append(c if r == 1 else str(d) if r == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def _date(text: str, p: Permutation, back: bool) -> str | None:
    parts = re.split(r"([-./])", text)
    iso = len(parts[0]) == 4
    y, other = (int(parts[0]), (int(parts[2]), int(parts[4]))) if iso else (int(parts[4]), (int(parts[0]), int(parts[2])))
    day_first = not iso and other[0] <= 31 and 1 <= other[1] <= 12
    month, day = other if iso or not day_first else (other[1], other[0])
    if not (1900 <= y <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(y, month)[1]):
        return None
    n = datetime.date(y, month, day).toordinal() - FIRST_DAY
    while True:  # walked on until it can be written as this one is
        n = p(n, LAST_DAY - FIRST_DAY + 1, b"date", back)
        new = datetime.date.fromordinal(FIRST_DAY + n)
        if iso:
            return new.isoformat()
        first, second = (new.day, new.month) if day_first else (new.month, new.day)
        if (day_first or new.day > 12) and first < 10 ** len(parts[0]) and second < 10 ** len(parts[2]):  # month first: it must not read as day first
            return f"{first:0{len(parts[0])}d}{parts[1]}{second:0{len(parts[2])}d}{parts[3]}{new.year}"


def pseudonym(kind: str, text: str, p: Permutation, back: bool = False) -> str | None:
    """The pseudonym of a value in its own format; None if it is not valid as its kind."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "email":
        local, _, host = text.rpartition("@")
        return f"{_mixed(local, p, b'email@' + host.lower().encode(), back)}@{host}"
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        n = p(int.from_bytes(bytes(octets)), 1 << 32, b"ip", back)
        return ".".join(map(str, n.to_bytes(4)))
    if kind == "date":
        return _date(text, p, back)
    if kind == "ssn":
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        n = (areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        n, serial = divmod(p(n, len(areas) * 99 * 9999, b"ssn", back), 9999)
        area, group = divmod(n, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "iban":
        solid = text.replace(" ", "")
        if iban_rest(solid) != 1:
            return None
        body = _mixed(solid[4:], p, b"iban" + solid[:2].encode(), back)
        fresh = f"{solid[:2]}{98 - iban_rest(solid[:2] + '00' + body):02d}{body}"
        it = iter(fresh)
        return "".join(" " if c == " " else next(it) for c in text)
    if kind == "phone":
        keep = len(digits) - min(10, max(7, len(digits) - 1)) if text[0] == "+" else 0
        tail = digits[keep:]
        return _fill(text, digits[:keep] + f"{p(int(tail), 10 ** len(tail), b'phone%d' % len(tail), back):0{len(tail)}d}")
    size = len(digits) - 1
    if luhn(digits[:-1]) == int(digits[-1]):
        body = f"{p(int(digits[:-1]), 10**size, b'card%d' % size, back):0{size}d}"
        return _fill(text, body + str(luhn(body)))
    return None


def replaced(text: str, p: Permutation, back: bool = False) -> tuple[str, dict[str, int]]:
    counts: dict[str, int] = {}

    @lru_cache(4096)
    def cached(kind: str, value: str) -> str | None:
        return pseudonym(kind, value, p, back)

    out, at, pos = [], 0, 0
    while m := VALUE.search(text, pos):
        pos = m.start() + 1
        for kind, s, e in spans(text, m):
            new = cached(kind, text[s:e])
            if new is not None:
                counts[kind] = counts.get(kind, 0) + 1
                out += [text[at:s], new]
                at = pos = e
                break
    return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, text: str = "text", back: bool = False) -> DataFrame:
    """docs with the values in the text replaced (or restored), and a column _n_<kind> with the number of values of each kind."""
    schema = docs.select(F.col("*"), *(F.lit(0).cast("long").alias(unused(docs, f"_n_{k}")) for k in KINDS)).schema
    quick, at = re.compile("[0-9@]"), docs.columns.index(text)

    def run(parts):
        p = Permutation(key)
        for batch in parts:
            out, counts = batch.column(at).to_pylist(), {k: [0] * batch.num_rows for k in KINDS}
            for i, t in enumerate(out):
                if t and quick.search(t):
                    out[i], found = replaced(t, p, back)
                    for k, n in found.items():
                        counts[k][i] = n
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[k], pa.int64()) for k in KINDS)], schema.names)

    return docs.mapInArrow(run, schema)
