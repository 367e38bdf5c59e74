import datetime
import ipaddress
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from playframe.llm import pii

KEY = b"test key"
CARD, IBAN = "4111111111111111", "BE68539007547034"


@pytest.mark.parametrize(
    ("before", "value", "after", "kind"),
    [
        ("", CARD, " 12/27", "card"),
        ("card ", CARD, " 12 27 123", "card"),
        ("", "4111 1111 1111 1111", " 123", "card"),
        ("", "4111-1111-1111-1111", "-123 paid", "card"),
        ("item 12 ", "4111 1111 1111 1111", "", "card"),
        ("12 3 ", "4111 1111 1111 1111", " 12/27 123", "card"),
        ("2 x 7 ", "3782 822463 10005", " 1234 08/29", "card"),
        ("AB12 ", "4111 1111 1111 1111", " 12/27", "card"),
        ("", CARD, " 12a@x.org", "card"),
        ("", IBAN, " USA", "iban"),
        ("to ", "BE68 5390 0754 7034", " BANK", "iban"),
        ("", "BE68 5390 0754 7034", " EUR 250", "iban"),
        ("AB12 ", "DE89 3704 0044 0532 0130 00", " COBADEFF", "iban"),
        ("", "GB82 WEST 1234 5698 7654 32", " GBP", "iban"),
        ("", "555-123-4567", " 4111-1112", "phone"),
        ("12 ", "123-45-6789", " 4111 1112", "ssn"),
    ],
)
def test_values_beside_other_groups(before, value, after, kind):
    text = before + value + after
    new, spans = pii.pseudonymised(text, KEY)
    found = [s for s in spans if s[0] != "email"]
    assert found == [(kind, len(before), len(before) + len(value))]
    assert new.startswith(before + pii.pseudonym(kind, value, KEY)) and value not in new


def test_cards_among_random_groups():
    rng = random.Random(5)
    for _ in range(500):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = body + pii.luhn_digit(body)
        shown = rng.choice([card, " ".join(card[i : i + 4] for i in range(0, 16, 4))])
        before, after = ("".join(rng.choice(["", "7 ", "12 ", "123 ", "no. "]) for _ in range(2)) for _ in range(2))
        text = f"{before}{shown} {after}".strip()
        new, spans = pii.pseudonymised(text, KEY)
        cards = [text[a:b] for kind, a, b in spans if kind == "card"]
        assert any(shown in c for c in cards) and shown not in new


def test_long_rows_of_numbers_end():
    text = " ".join(str(i % 97) for i in range(20_000))
    new, _ = pii.pseudonymised(text, KEY)
    assert len(new) == len(text)


def new_of(text):
    return pii.pseudonymised(text, b"k")[0]


@pytest.mark.parametrize("text", ["31/12/1899", "2020/02/29", "29 February 2020", "February 29 2020", "4111 1111 1111 1111 12/25", "4111 1111 1111 1111 123", "BE68 5390 0754 7034 EUR 500", "2001:db8::8a2e:370:7334", "FE80:0000:0000:0000:0202:B3FF:FE1E:8329", "::1"])
def test_values_that_used_to_stay(text):
    assert new_of(f"see {text}, please") != f"see {text}, please"


def test_spellings_stay_linked():
    digits = lambda t: "".join(c for c in t if c.isdigit())
    assert digits(new_of("+10175557713")) == digits(new_of("+1 (017) 555-7713"))
    dates = [new_of(t) for t in ("2020-02-29", "2020/02/29", "29 February 2020", "February 29, 2020")]
    assert len({datetime.date.fromisoformat(dates[0]), datetime.date.fromisoformat(dates[1].replace("/", "-")), *(datetime.datetime.strptime(t.replace(",", ""), f).date() for t, f in zip(dates[2:], ("%d %B %Y", "%B %d %Y")))}) == 1
    assert ipaddress.ip_address(new_of("2001:db8:0:0:0:0:0:1")) == ipaddress.ip_address(new_of("2001:DB8::1"))


def test_long_keys_count_whole():
    assert pii.permute(5, 10**6, b"k" * 64 + b"a", "t") != pii.permute(5, 10**6, b"k" * 64 + b"b", "t")


@given(st.integers(1, datetime.date.max.toordinal()))
def test_any_date_has_one_pseudonym(day):
    text = datetime.date.fromordinal(day).isoformat()
    new = datetime.date.fromisoformat(pii.pseudonym("date", text, b"k"))
    assert (1900 <= new.year <= 2099) == (1900 <= int(text[:4]) <= 2099)


SPELLINGS = {
    "date": [
        "Jan 5, 2020", "5th January 2020", "5 January, 2020", "january 5, 2020", "JANUARY 5, 2020", "5 Januar 2020", "3. März 2021", "05-01-2020", "2020.01.05", "1/5/20", "20200105", "1er janvier 2020",
        "5 de enero de 2020", "Sept. 3, 2020", "3 févr. 2020", "22nd of June 1999",
    ],
    "card": ["4111.1111.1111.1111", "4111  1111  1111  1111", "4111\n1111\n1111\n1111"],
    "iban": ["BE68-5390-0754-7034", "be68539007547034", "de89 3704 0044 0532 0130 00"],
    "phone": ["555 123 4567", "07911 123456"],
    "ssn": ["123 45 6789"],
    "email": ["josé@example.com", "user@münchen.de"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, own in SPELLINGS.items() for v in own])
def test_usual_spellings_are_found(kind, value):
    new, spans = pii.pseudonymised(f"see {value}, please", KEY)
    assert spans == [(kind, 4, 4 + len(value))] and value not in new
    shape = lambda t: "".join("9" if c.isdigit() else c for c in t if not c.isalpha())
    if kind not in ("email", "date"):
        assert shape(new) == shape(f"see {value}, please")


def test_all_spellings_of_a_date_get_one_day():
    new = [new_of(t) for t in ("2020-01-05", "2020/01/05", "2020.01.05", "05-01-2020", "5.1.2020", "1/5/2020", "1/5/20", "20200105", "Jan 5, 2020", "5th January 2020", "5 JANUAR 2020", "5 de enero de 2020")]
    day = datetime.date.fromisoformat(new[0])
    d, m, y = day.day, day.month, day.year
    names = {k: v[m - 1] for k, v in pii.MONTHS.items()}
    suffix = "th" if 10 < d < 14 else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")
    assert new == [
        f"{day}", f"{day}".replace("-", "/"), f"{day}".replace("-", "."), f"{d:02d}-{m:02d}-{y}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{m}/{d}/{y % 100:02d}", f"{day}".replace("-", ""),
        f"{names['en short']} {d}, {y}", f"{d}{suffix} {names['en']} {y}", f"{d} {names['de'].upper()} {y}", f"{d} de {names['es']} de {y}",
    ]


def test_dates_are_permuted_within_their_era():
    rng = random.Random(8)
    for low, high in ((1970, 2069), (1900, 1969), (2070, 2099), (1, 1899), (2100, 9999)):
        for _ in range(60):
            day = datetime.date(rng.randint(low, high), rng.randint(1, 12), rng.randint(1, 28))
            new = datetime.date.fromisoformat(pii.pseudonym("date", day.isoformat(), KEY)).year
            era = lambda y: 0 if 1970 <= y <= 2069 else 1 if 1900 <= y <= 2099 else 2
            assert era(new) == era(day.year)
    first = datetime.date(1900, 1, 1).toordinal()
    seen = {pii._shifted_day(first + i, lambda v, n: pii.permute(v, n, KEY, "date")) for i in range(0, 73049, 7)}
    assert len(seen) == len(range(0, 73049, 7))


@pytest.mark.parametrize("domain", [2, 3, 10, 26, 52, 100, 1000])
def test_small_domains_have_no_fixed_points(domain):
    for k in range(20):
        key = bytes([k]) * 8
        table = [pii.permute(v, domain, key, "t") for v in range(domain)]
        assert sorted(table) == list(range(domain)) and all(v != w for v, w in enumerate(table))
        assert all(pii.permute(w, domain, key, "t", back=True) == v for v, w in enumerate(table))


@pytest.mark.parametrize("text", ["12.345.678.901.234.567", "1\n2\n3\n4\n5\n6\n7\n8\n9\n1\n2\n3\n4", "in20 this that", "5 Marching 2020", "99999999", "31/31/20", "version 1.2.3", "000 00 0000"])
def test_what_is_no_value_stays(text):
    assert new_of(f"see {text}, please") == f"see {text}, please"


def plainly(text):
    """The scan by its definition: from left to right, at each place the kinds in order; the first valid value is taken, and nothing begins inside it or inside the first group of a match that failed."""
    import regex

    spans, at = [], 0
    emails = {m.start(): m.end() for m in pii.EMAIL.finditer(text)}
    stop = lambda i: min((a for a in emails if a >= i), default=len(text))
    while at < len(text):
        if at in emails:
            spans.append(("email", at, emails[at]))
            at = emails[at]
            continue
        end, took, failed = stop(at), None, False
        for kind, pattern in pii.PATTERNS.items():
            m = regex.compile(pattern).match(text, at, end)
            if not m:
                continue
            z = m.end()
            if kind in pii.ENDS:
                z = pii.ENDS[kind](text, at, z if kind == "iban" else end)
            if z and pii.pseudonym(kind, text[at:z], KEY) is not None:
                took = (kind, at, z)
                break
            failed = True
        if took:
            spans.append(took)
            at = took[2]
        else:
            at = pii.GROUP.match(text, at).end() if failed else at + 1
    return spans


def test_whole_texts_equal_a_plain_scan():
    rng = random.Random(12)
    parts = [*(v for own in SPELLINGS.values() for v in own), CARD, IBAN, "10.0.0.1", "::1", "2001:db8::1", "+44 20 7946 0958", "(555) 123-4567", "555-123-4567", "123-45-6789", "2020-02-30", "4111111111111112", "word", "12", "7", "USA", "May", "x1"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", ", ", "\n", " - ", "; ", "/", "."]) for _ in range(rng.randint(1, 14)))
        assert pii.pseudonymised(text, KEY)[1] == plainly(text), text
