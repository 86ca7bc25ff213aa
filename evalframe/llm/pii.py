"""PII: format-preserving pseudonyms from keyed Feistel permutations.

A value that is found and validated is permuted within its format by a keyed
Feistel network: digits stay digits, a valid card number or IBAN stays valid, a
date stays a date. Each format's permutation is a bijection, so equal values get
equal pseudonyms in all documents and different values different ones.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The key of the registered query. A real job passes its own secret.
TEST_KEY = b"not a secret: key of the test query"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Pseudonyms that a task remembers.
REMEMBERED = 200_000
#: Characters of an IBAN by country, from the IBAN registry.
IBAN_LENGTHS = {code: int(n) for n, codes in (
    ("15", "NO"), ("16", "BE"), ("18", "DK FO FI GL NL SD"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU MN XK"), ("21", "CH HR LI LV"), ("22", "BG BH CR DE GB GE IE ME RS VA"), ("23", "AE GI IL IQ OM SO TL"),
    ("24", "AD CZ ES MD PK RO SA SE SK TN VG"), ("25", "LY PT ST"), ("26", "IS TR"), ("27", "BI DJ FR GR IT MC MR SM"), ("28", "AL AZ BY CY DO GT HN HU LB NI PL SV"), ("29", "BR EG PS QA UA"), ("30", "JO KW MU YE"), ("31", "MT SC"), ("32", "LC"), ("33", "RU"),
) for code in codes.split()}

#: Digits after the country's code, least and most; of codes not named, the whole number has 8 to 15.
PLANS = {
    "1": (10, 10), "7": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "39": (6, 12), "41": (9, 9), "43": (4, 13), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (6, 12),
    "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "61": (9, 9), "81": (9, 10), "86": (10, 11), "91": (10, 10), "351": (9, 9), "353": (7, 9), "358": (5, 12),
}
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


#: Characters that are permuted among each other; the accented ones are those of Latin-1 that have both cases.
ACCENTED = "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ACCENTED, ACCENTED.upper())
KIND_OF = {c: letters[0] for letters in ALPHABETS for c in letters}


class Feistel:
    """Keyed permutations of numbers and digit strings."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, value: int, modulus: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{i}|{value}|{modulus}".encode(), key=self.key, digest_size=24)
        return int.from_bytes(h.digest(), "big") % modulus

    def digits(self, value: list[int], radix: int, tweak: str) -> list[int]:
        """Permute the strings of this length over this radix (alternating halves that may differ in length)."""
        n = len(value)
        if n == 0:
            return []
        if n == 1:
            return [(value[0] + self._round(tweak, 0, 0, radix)) % radix]
        number = lambda part: sum(d * radix**k for k, d in enumerate(part))
        u = n // 2
        a, b = number(value[:u]), number(value[u:])
        sizes = (radix**u, radix ** (n - u))
        for i in range(ROUNDS):
            if i % 2 == 0:
                a = (a + self._round(tweak, i, b, sizes[0])) % sizes[0]
            else:
                b = (b + self._round(tweak, i, a, sizes[1])) % sizes[1]
        return [a // radix**k % radix for k in range(u)] + [b // radix**k % radix for k in range(n - u)]

    def below(self, value: int, size: int, tweak: str) -> int:
        """Permute the numbers below ``size``: walk the cycle of the next power of two until one is below."""
        bits = max(2, (size - 1).bit_length())
        while True:
            d = self.digits([value >> k & 1 for k in range(bits)], 2, tweak)
            value = sum(x << k for k, x in enumerate(d))
            if value < size:
                return value

    def text(self, value: str, tweak: str) -> str:
        """Permute characters among those of their alphabet (digits, letters of one case, accented letters of one case); the rest stays."""
        shape = "".join(KIND_OF.get(c, c) for c in value)
        out = list(value)
        for letters in ALPHABETS:
            at = [k for k, c in enumerate(shape) if c == letters[0]]
            new = self.digits([letters.index(value[k]) for k in at], len(letters), f"{tweak}|{letters[0]}|{shape}")
            for k, d in zip(at, new, strict=True):
                out[k] = letters[d]
        return "".join(out)

    def caseless(self, value: str, tweak: str) -> str:
        """The same of the text in lower case, in the case that each of its characters was written in."""
        low = "".join(c.lower() if c.lower() in KIND_OF else c for c in value)
        new = self.text(low, tweak)
        return "".join(b.upper() if a != c else b for a, c, b in zip(value, low, new, strict=True))


def luhn_sum(digits: list[int]) -> int:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))


def _refill(shape: str, digits: list[int]) -> str:
    """The shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(str(next(new)) if c.isdigit() else c for c in shape)


def _card(value: str, f: Feistel) -> str | None:
    digits = [int(c) for c in value if c.isdigit()]
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or not any(digits):
        return None
    body = f.digits(digits[:-1], 10, f"card{len(digits)}")
    return _refill(value, [*body, -luhn_sum([*body, 0]) % 10])


def _iban_check(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _iban(value: str, f: Feistel) -> str | None:
    code = value.replace(" ", "")
    if not 15 <= len(code) <= 34 or _iban_check(code) != 1:
        return None
    body = code[:2] + "00" + f.text(code[4:], f"iban{code[:2]}")
    new = iter(f"{code[:2]}{98 - _iban_check(body):02d}{body[4:]}")
    return "".join(c if c == " " else next(new) for c in value)


def _iban_ends(value: str) -> list[int]:
    """Where an IBAN at the start of the match can end: after the length of its country, else after any of the match's groups."""
    places = [k + 1 for k, c in enumerate(value) if c != " "]
    n = IBAN_LENGTHS.get(value[:2])
    if n is None:
        return [len(value), *[k for k in range(len(value) - 1, 0, -1) if value[k] == " "]]
    fixed = [places[n - 1]] if n <= len(places) and value[places[n - 1] :][:1] in ("", " ") else []
    return [*fixed, *[len(value)][: len(value) not in fixed]]


def _ip(value: str, f: Feistel) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if any(x > 255 for x in parts):
        return None
    number = f.below(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, number.to_bytes(4, "big")))


TEN = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", re.ASCII)


def _phone_ends(value: str) -> list[int]:
    """Where a phone number at the start of the match can end: after any of its groups."""
    return [len(value), *([] if TEN.fullmatch(value) else [k for k in range(len(value) - 1, 0, -1) if value[k] in " .-"])]


def _phone(value: str, f: Feistel) -> str | None:
    digits = [int(c) for c in value if c.isdigit()]
    if TEN.fullmatch(value):
        kept = len(digits) - 10  # the country's code stays
    else:
        number = "".join(map(str, digits))
        kept = 1 if number[0] in "17" else 2 if number[:2] in TWO else 3
        least, most = PLANS.get(number[:kept], (8 - kept, 15 - kept))
        if not least <= len(digits) - kept <= most:
            return None
    # Three, three and four digits without a country's code are the same number as with the code 1.
    return _refill(value, digits[:kept] + f.digits(digits[kept:], 10, f"phone{digits[:kept] or [1]}"))


def _ssn(value: str, f: Feistel) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    number = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    number, last = divmod(f.below(number, 898 * 99 * 9999, "ssn"), 9999)
    first, middle = divmod(number, 99)
    return f"{areas[first]:03d}-{middle + 1:02d}-{last + 1:04d}"


def _day(parts: list[str], order: tuple[int, int, int]) -> datetime.date | None:
    try:
        day = datetime.date(*(int(parts[k]) for k in order))
    except ValueError:
        return None
    return day if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


def _class_of(day: datetime.date) -> tuple[bool, bool, bool]:
    """What a date's pseudonym must share with it, so that it can be written in whatever shape the date is: months and days of one digit, and days that are no month."""
    return day.month < 10, day.day < 10, day.day > 12


def _date(value: str, f: Feistel) -> str | None:
    """Another date in the same order and widths: equal dates get equal pseudonyms in all orders and widths. What is no date day first is tried month first."""
    parts, separators = re.split(r"[-/.]", value), re.findall(r"[-/.]", value)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]  # places of year, month and day
    order, day = next(((o, d) for o in orders if (d := _day(parts, o))), (orders[0], None))
    if day is None:
        return None
    kind, new = _class_of(day), day
    while True:  # along the cycle of all dates to the next one of the class
        new = datetime.date.fromordinal(FIRST_DAY + f.below(new.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        if _class_of(new) == kind:
            break
    out = [""] * 3
    for k, x in zip(order, (new.year, new.month, new.day), strict=True):
        out[k] = f"{x:0{len(parts[k])}d}"
    return "".join(x + s for x, s in zip(out, [*separators, ""], strict=True))


def _email(value: str, f: Feistel) -> str | None:
    name, _, domain = value.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{f.caseless(name, 'name')}@{f.caseless(host, 'host')}.{top}"


#: Letters beyond ASCII that a name may hold, as a class of a pattern: Latin, Greek, Cyrillic and those after them, Han and kana.
LETTERS = "\u00c0-\u024f\u0370-\u1fff\u3040-\u9fff\uac00-\ud7a3"
#: Kind, pattern and pseudonym of what is looked for; where matches meet, the earlier kind has the text.
KINDS: tuple[tuple[str, str, Callable[[str, Feistel], str | None]], ...] = (
    ("email", rf"(?<![\w.+%{LETTERS}-])[A-Za-z0-9_.+%{LETTERS}-]{{1,64}}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.){{1,8}}[A-Za-z]{{2,24}}(?![\w-])", _email),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", _iban),
    ("card", r"(?<![\d.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5})(?![\d-])", _card),
    ("ip", r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\d)", _ip),
    ("date", r"(?<![\d./-])(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![./-]?\d)", _date),
    ("ssn", r"(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-])", _ssn),
    ("phone", rf"(?<![\d+])(?:{TEN.pattern}(?![\d-])|(?<!\w)\+[1-9][0-9]{{0,2}}(?:[ .-]?\([0-9]{{1,5}}\))?(?:[ .-]?[0-9]){{4,14}}(?!\d))", _phone),
)


#: Kinds whose pattern can go past the value, with the ends to try in turn. What fails at all of them is looked at again from its next character.
ENDS: dict[str, Callable[[str], list[int]]] = {"iban": _iban_ends, "phone": _phone_ends}


class Masker:
    """Finds and replaces the KINDS in texts."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.kinds = [(kind, re.compile(pattern, re.ASCII), change) for kind, pattern, change in KINDS]
        self.known: dict[tuple[str, str], str | None] = {}

    def pseudonym(self, kind: str, value: str, change: Callable[[str, Feistel], str | None]) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, value] = change(value, self.feistel)
        return self.known[kind, value]

    def mask(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        """The text with pseudonyms, and the (start, end, kind, pseudonym) of each in the original."""
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray(0)
        for kind, pattern, change in self.kinds:
            if (kind == "email" and "@" not in text) or (kind == "iban" and not text):
                continue
            ends, at = ENDS.get(kind), 0
            while m := pattern.search(text, at):
                start, at = m.start(), m.start() + 1 if ends else m.end()
                for size in ends(m[0]) if ends else (len(m[0]),):
                    if any(taken[start : start + size]):
                        continue
                    new = self.pseudonym(kind, m[0][:size], change)
                    if new is not None:
                        at = start + size
                        found.append((start, at, kind, new))
                        taken = taken or bytearray(len(text))
                        taken[start:at] = b"\1" * size
                        break
        if not found:
            return text, found
        found.sort()
        parts, at = [], 0
        for start, end, _, new in found:
            parts += [text[at:start], new]
            at = end
        return "".join([*parts, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_spans: bool = False) -> DataFrame:
    """Replace validated personal values in every whole text.

    Returns per input row the id, the text with pseudonyms, the columns in
    ``carry``, ``n_found``, ``kinds`` (those found, sorted and comma-joined) and
    with ``keep_spans`` ``spans`` (start, end, kind, pseudonym). Numbers that
    fail their check (Luhn, IBAN, octets over 255, impossible dates, phone
    numbers of a wrong length) stay. Phone numbers without a leading + are only
    found as three, three and four digits with separators. A
    null text stays null, an empty one empty; null ids are kept; repeated rows
    come out repeated. Other columns are not looked at.
    """
    chosen = docs.select(id_col, F.col(text_col).cast("string").alias(text_col), *[c for c in carry if c not in (id_col, text_col)])
    names = chosen.columns
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("pseudonym", pa.string())])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields) + ", n_found long, kinds string"
    schema += ", spans array<struct<start:long,end:long,kind:string,pseudonym:string>>" * keep_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(key)
        for batch in batches:
            texts, n, kinds, spans = [], [], [], []
            for text in batch.column(1).to_pylist():
                new, found = masker.mask(text) if text else (text, [])
                texts.append(new)
                n.append(len(found))
                kinds.append(",".join(sorted({x[2] for x in found})))
                if keep_spans:
                    spans.append([dict(zip(("start", "end", "kind", "pseudonym"), x, strict=True)) for x in found])
            columns = [batch.column(0), pa.array(texts, pa.string()), *[batch.column(k) for k in range(2, len(names))], pa.array(n, pa.int64()), pa.array(kinds, pa.string())]
            if keep_spans:
                columns.append(pa.array(spans, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_found", "kinds", *["spans"] * keep_spans])

    return chosen.mapInArrow(run, schema)
