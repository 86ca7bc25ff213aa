from __future__ import annotations

import datetime
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from evalframe.llm import common, pii

F = pii.Feistel(b"key")


@pytest.mark.parametrize(("radix", "n"), [(10, 1), (10, 2), (10, 3), (26, 2), (2, 9)])
def test_digit_strings_are_permuted(radix, n):
    every = [[v // radix**k % radix for k in range(n)] for v in range(radix**n)]
    assert sorted(F.digits(x, radix, "t") for x in every) == sorted(every)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 1000])
def test_numbers_are_permuted(size):
    assert sorted(F.below(v, size, "t") for v in range(size)) == list(range(size))


@settings(max_examples=100, deadline=None)
@given(s.integers(0, 10**15 - 1))
def test_cards_stay_valid(body):
    digits = [int(c) for c in f"{body:015d}"]
    card = f"{body:015d}{-pii.luhn_sum([*digits, 0]) % 10}"
    new = pii._card(card, F)
    if body:
        assert len(new) == 16 and pii.luhn_sum([int(c) for c in new]) % 10 == 0
    assert pii._card(card[:-1] + str((int(card[-1]) + 1) % 10), F) is None


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("mail jo.doe7@mail3.example.com now", "email"), ("IBAN DE89 3704 0044 0532 0130 00.", "iban"), ("GB82WEST12345698765432", "iban"), ("card 4111 1111 1111 1111,", "card"), ("5500005555555559", "card"),
        ("host 10.0.255.3 up", "ip"), ("born 1984-02-29.", "date"), ("am 31.12.1999", "date"), ("ssn 123-45-6789", "ssn"), ("call +1 (017) 555-7713", "phone"), ("(212) 555-0199 or", "phone"),
    ],
)
def test_found_and_replaced_within_the_format(text, kind):
    new, found = pii.Masker(b"key").mask(text)
    assert [f[2] for f in found] == [kind] and new != text
    shape = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", x)))
    if kind != "ip":
        assert shape(new) == shape(text)
    again, refound = pii.Masker(b"key").mask(new)
    assert [f[2] for f in refound] == [kind]  # still valid
    assert pii.Masker(b"other").mask(text)[0] != new == pii.Masker(b"key").mask(text)[0]


@pytest.mark.parametrize("text", ["card 4111111111111112", "DE88370400440532013000", "300.1.1.1", "2023-02-30", "000-12-3456", "a@b", "1.2.3", "version 1.2.3.4.5", ""])
def test_invalid_values_stay(text):
    assert pii.Masker(b"key").mask(text) == (text, [])


@pytest.mark.parametrize(
    ("text", "ibans"),
    [
        ("ES9121000418450200051332 A nombre", ["ES9121000418450200051332"]), ("ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", ["ES91 2100 0418 4502 0005 1332"]), ("AT611904300234573201 USD", ["AT611904300234573201"]),
        ("BE68539007547034 EUR 12", ["BE68539007547034"]), ("PL61109010140000071219812874 I paid", ["PL61109010140000071219812874"]), ("BE68539007547034 ES91 2100 0418 4502 0005 1332 A", ["BE68539007547034", "ES91 2100 0418 4502 0005 1332"]),
        ("AB13 BE68 5390 0754 7034 OK", ["BE68 5390 0754 7034"]), ("BE68539007547034 JO@example.org", ["BE68539007547034"]), ("ES9121000418450200051333 A nombre", []),
    ],
)
def test_ibans_end_before_tokens_that_follow(text, ibans):
    new, found = pii.Masker(b"key").mask(text)
    assert [text[a:b] for a, b, kind, _ in found if kind == "iban"] == ibans
    assert not any(x in new for x in ibans)
    alone = [pii.Masker(b"key").mask(x)[0] for x in ibans]
    assert [x[3] for x in found if x[2] == "iban"] == alone  # equal values stay linked, whatever follows


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("call 555 123 4567 now", "555 123 4567"), ("call +15551234567.", "+15551234567"), ("tel +33 1 23 45 67 89, Paris", "+33 1 23 45 67 89"), ("+49 30 1234567", "+49 30 1234567"), ("+34 612 345 678 o", "+34 612 345 678"),
        ("+33 1 23 45 67 89 12 people", "+33 1 23 45 67 89"), ("+44 (20) 7946 0958", "+44 (20) 7946 0958"),
        ("on 12/25/1990 at", "12/25/1990"), ("1/5/1990", "1/5/1990"), ("5.12.2001,", "5.12.2001"), ("1990/12/25", "1990/12/25"), ("31-12-1999", "31-12-1999"), ("7/31/2004", "7/31/2004"),
    ],
)
def test_more_shapes_of_phones_and_dates(text, value):
    new, found = pii.Masker(b"key").mask(text)
    assert [(text[a:b], k) for a, b, k, _ in found] == [(value, "date" if re.search(r"(?<!\d)(19|20)\d\d(?!\d)", value) else "phone")]
    assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text) and value not in new
    _, again = pii.Masker(b"key").mask(new)
    assert [x[:3] for x in again] == [x[:3] for x in found]  # still valid, in the same place


@pytest.mark.parametrize("text", ["13/13/1990", "0/5/1990", "31.2.2001", "+33 1 23 45", "+1.2345678", "a+15551234567", "+1 555 123 456"])
def test_other_numbers_are_no_phones_or_dates(text):
    assert pii.Masker(b"key").mask(text) == (text, [])


def test_dates_of_one_format_are_permuted():
    days = [f"{m}/{d}/{y}" for y in (1990, 2003) for m in range(1, 10) for d in range(13, 29)] + [f"{d:02d}/{m:02d}/1990" for m in range(1, 13) for d in range(1, 29)] + [f"{d}/{m}/1990" for m in range(1, 10) for d in range(1, 10)]
    new = [pii._date(x, F) for x in days]
    assert len(set(new)) == len(days) and [len(x) for x in new] == [len(x) for x in days]


def test_equal_values_stay_linked_and_different_ones_apart(spark, middle):
    docs = common.read(spark, middle, "documents")
    old = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    links, values = {}, {}
    rows = pii.pseudonymise(docs, b"key", keep_spans=True).collect()
    for r in rows:
        for x in r.spans:
            value = old[r.doc_id][x.start : x.end]
            assert links.setdefault((x.kind, value), x.pseudonym) == x.pseudonym
            assert values.setdefault((x.kind, x.pseudonym), value) == value
        assert r.n_found == len(r.spans) and (r.text == old[r.doc_id]) == (not r.spans)
    assert {k for k, _ in links} >= {"email", "ip", "card", "phone"}


@settings(max_examples=200, deadline=None)
@given(s.dates(min_value=datetime.date(1900, 1, 1), max_value=datetime.date(2099, 12, 31)))
def test_a_date_is_linked_in_all_shapes(day):
    d, m, y = day.day, day.month, day.year
    shapes = [f"{y}-{m:02d}-{d:02d}", f"{y}/{m}/{d}", f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}"] + ([f"{m:02d}/{d:02d}/{y}", f"{m}-{d}-{y}"] if d > 12 else [])
    new = [pii._date(x, F) for x in shapes]
    seen = {pii._day(re.split("[-/.]", x), o) for x, o in zip(new, [(0, 1, 2)] * 2 + [(2, 1, 0)] * 2 + [(2, 0, 1)] * 2, strict=False)}
    assert len(seen) == 1 and None not in seen
    assert [re.sub("[0-9]", "0", x) for x in new] == [re.sub("[0-9]", "0", x) for x in shapes]
    assert day not in seen or pii._class_of(day) == pii._class_of(seen.pop())


def test_dates_of_a_class_are_permuted():
    days = [datetime.date(y, m, d) for y in range(1900, 2100) for m in (10, 11, 12) for d in (10, 11, 12)]
    new = {pii._date(x.isoformat(), F) for x in days}
    assert new == {x.isoformat() for x in days}


@pytest.mark.parametrize("shapes", [
    ("+1 (212) 555-0199", "(212) 555-0199", "212.555.0199", "+12125550199", "+1-212-555-0199"), ("+49 30 1234567", "+49301234567", "+49 (30) 123-4567"), ("4111 1111 1111 1111", "4111111111111111", "4111.1111.1111.1111", "4111-1111-1111-1111"),
])
def test_numbers_are_linked_in_all_shapes(shapes):
    new = [pii.Masker(b"key").mask(f"x {value} y")[0] for value in shapes]
    digits = {re.sub("[^0-9]", "", x)[-10:] for x in new}
    assert len(digits) == 1 and digits != {re.sub("[^0-9]", "", shapes[0])[-10:]}


@pytest.mark.parametrize(("one", "other"), [("Jo.Doe@Example.com", "jo.doe@example.com"), ("JÖRG@example.de", "jörg@EXAMPLE.de")])
def test_addresses_are_linked_in_either_case(one, other):
    a, b = (pii.Masker(b"key").mask(x)[0] for x in (one, other))
    assert a.lower() == b.lower() != other and [c.isupper() for c in a] == [c.isupper() for c in one]


def test_whole_names_are_replaced():
    new, found = pii.Masker(b"key").mask("mail jörg.müller@example.de, Жанна7@example.org now")
    assert [x[:3] for x in found] == [(5, 27, "email"), (29, 47, "email")]
    assert re.fullmatch(r"mail [a-z][à-þ][a-z]{2}\.[a-z][à-þ][a-z]{4}@[a-z]{7}\.de, Жанна[0-9]@[a-z]{7}\.org now", new) and "jörg" not in new


SCAN = {
    "email": r"[^\s@<>()\[\]{},;:\"'|/\\=*#!?&$^~`]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", "ip": r"(?:\d+\.)+\d+", "card": r"\d[\d .-]{11,22}\d",
}


def test_by_a_scanner_of_its_own(spark, middle):
    """Every address, card and IPv4 number that a plain scan of the whole table finds is replaced, by one pseudonym for each canonical value."""
    docs = common.read(spark, middle, "documents")
    old = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: {(x.start, x.end): x for x in r.spans} for r in pii.pseudonymise(docs, b"key", keep_spans=True).collect()}
    links, n = {}, Counter()
    for i, text in old.items():
        for m in re.finditer(SCAN["email"], text):
            at, value = m.span(), m[0].lower()
            own = next((x for (a, b), x in found[i].items() if a >= at[0] and b == at[1] and x.kind == "email"), None)
            assert own is not None, m[0]
            links.setdefault(("email", text[own.start : own.end].lower()), set()).add(own.pseudonym.lower())
            n["email"] += 1
        for m in re.finditer(rf"(?<![\d.]){SCAN['ip']}(?![\d.]*\d)", text):
            parts = m[0].split(".")
            if len(parts) == 4 and all(len(p) <= 3 and int(p) < 256 for p in parts):
                assert m.span() in found[i], m[0]
                links.setdefault(("ip", m[0]), set()).add(found[i][m.span()].pseudonym)
                n["ip"] += 1
        for m in re.finditer(r"(?<![\d.+-])\d{4}(?:[ .-]?\d{4}){3}(?![\d-])", text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0 and len({c for c in m[0] if not c.isdigit()}) <= 1 and m[0].count(m[0][4]) in (3, *range(4, 17)) and any(digits):
                assert any(a <= m.start() and b >= m.end() for a, b in found[i]), m[0]
                n["card"] += 1
    assert all(len(v) == 1 for v in links.values()) and n["email"] > 5 and n["ip"] > 0
