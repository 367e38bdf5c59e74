"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation.

A value is validated, turned into a number of the domain of all values of its
format, permuted within that domain and written back in the same format. The
permutation depends on the key and the kind only, so equal values get equal
pseudonyms in every document and different values get different ones.

What is found: e-mail addresses (the part before the @; hosts stay in clear text),
payment cards (Luhn), IBANs (mod 97), US social security numbers, IPv4 and IPv6
addresses, telephone numbers and calendar dates of the years 1 to 9999. Spellings of
one value stay linked: separators, zeros, letter case, the language and the form of a
date don't enter the permutation. What fails its check, such as 16 digits without a right Luhn digit, is left as it stands. A card
or an IBAN is also found among further digits or capital words beside it, at any
separator: an expiry date, a CVV, a quantity, a currency or a bank code.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices, worker_state

ROUNDS = 8
#: Domains up to this size are permuted by a table without fixed points.
SMALL = 1024
#: Dates get pseudonyms among those of their era: the years that two digits stand for, the other years from 1900 to 2099, and all the rest.
ERAS = [(datetime.date(1970, 1, 1).toordinal(), datetime.date(2069, 12, 31).toordinal()), (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()), (1, datetime.date.max.toordinal())]
#: Names of the months in the corpus's languages, and the short forms in use (by their first letters where none is given).
MONTH_NAMES = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "en short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "en other": "Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec",
    "de short": "Jan Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez",
    "fr short": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es short": "ene feb mar abr may jun jul ago sep oct nov dic",
}
MONTHS = {k: v.split() for k, v in MONTH_NAMES.items()}
#: Of a name that several languages have, the first list counts.
MONTH_OF = {name.lower(): (k, i) for k, names in reversed(MONTHS.items()) for i, name in enumerate(names)}
MEMO_VALUES = 100_000

EMAIL = re.compile(r"(?<![\w.+%-])[^\W_][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
_MONTH = "|".join(sorted(MONTH_OF, key=len, reverse=True))
#: Ways to write a date; day, month and year are replaced where they stand.
DATES = [
    r"(?P<y>[0-9]{4})(?P<s>[-/.])(?P<m>[0-9]{2})(?P=s)(?P<d>[0-9]{2})",
    r"(?P<a>[0-9]{1,2})(?P<s>[-/.])(?P<b>[0-9]{1,2})(?P=s)(?P<y>[0-9]{4})",
    r"(?P<a>[0-9]{1,2})(?P<s>/)(?P<b>[0-9]{1,2})/(?P<y>[0-9]{2})",
    r"(?P<y>(?:19|20)[0-9]{2})(?P<m>[0-9]{2})(?P<d>[0-9]{2})",
    rf"(?P<name>{_MONTH})\.?\ +(?P<d>[0-9]{{1,2}})(?P<th>st|nd|rd|th)?,?\ +(?P<y>[0-9]{{4}})",
    rf"(?P<d>[0-9]{{1,2}})(?P<th>st|nd|rd|th|er)?\.?\ +(?:of\ +|de\ +)?(?P<name>{_MONTH})\.?,?\ +(?:de\ +|del\ +)?(?P<y>[0-9]{{4}})",
]
DATE_FORMS = [re.compile(p, re.IGNORECASE) for p in DATES]
_UNNAMED = [re.sub(r"\(\?P<[a-z]+>", "(?:", p).replace("(?:[-/.])", "[-/.]").replace("(?P=s)", "[-/.]") for p in DATES]
#: Groups of digits set off by spaces alone are a telephone or social security number only where no further group is beside them.
PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?:[ -]?[a-z0-9]{4}){2,7}(?:[ -]?[a-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:]|\.[0-9])",
    "date": rf"(?<![0-9/.-])(?:{'|'.join(_UNNAMED[:4])})(?![0-9/-]|\.[0-9])|(?<!\w)(?i:{_UNNAMED[4]}|{_UNNAMED[5]})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9-])(?<![0-9][ -])[0-9]{3}[ ][0-9]{2}[ ][0-9]{4}(?![0-9-]|[ ][0-9])",
    "card": r"(?<![0-9])[0-9](?:(?:[.-]|\s{1,2})?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![0-9][ -])(?:[0-9]{3}[ ][0-9]{3}[ ][0-9]{4}|0[0-9]{2,4}[ ][0-9]{6,7})(?![ -][0-9]))(?![0-9A-Za-z])",
}
NUMBER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: For what begins where the pattern of an earlier kind has failed its check.
LATER = {k: re.compile("|".join(f"(?P<{n}>{PATTERNS[n]})" for n in list(PATTERNS)[i + 1 :])) for i, k in enumerate(PATTERNS) if k != "phone"}
GROUP = re.compile("[^A-Za-z0-9]*[A-Za-z0-9]+")
DIGITS = re.compile("[0-9]+")
#: What may stand between the groups of a card; only one space or hyphen in groups of any length, the others in usual layouts.
BETWEEN, PLAIN = re.compile(r"[.-]|\s{1,2}"), (" ", "-")
#: International calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Digits of the groups in which cards are printed; one group is usual too.
LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 3), (6, 13)}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DJ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}


def permute(value: int, domain: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. domain - 1 (``back``: its inverse): a balanced Feistel network, walked until it falls into the domain.

    In a large domain a value is its own pseudonym once in its size; a small one is
    permuted without such values.
    """
    if domain < 2:
        return value
    if domain <= SMALL:
        table = _small_table(domain, key, tweak)
        return table.index(value) if back else table[value]
    return _walked(value, domain, key, tweak, back)


@lru_cache(maxsize=256)
def _small_table(domain: int, key: bytes, tweak: str) -> tuple[int, ...]:
    """The network's permutation with its fixed points passed round among themselves; a single one changes places with its neighbour."""
    table = [_walked(v, domain, key, tweak, False) for v in range(domain)]
    fixed = [v for v in range(domain) if table[v] == v]
    if len(fixed) == 1:
        other = (fixed[0] + 1) % domain
        table[fixed[0]], table[other] = table[other], table[fixed[0]]
    for v, w in zip(fixed, fixed[1:] + fixed[:1], strict=True) if len(fixed) > 1 else ():
        table[v] = w
    return tuple(table)


def _walked(value: int, domain: int, key: bytes, tweak: str, back: bool) -> int:
    if len(key) > 64:
        key = hashlib.blake2b(key).digest()
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8

    def mix(i: int, x: int) -> int:
        state = hashlib.blake2b(f"{tweak}:{domain}:{i}:".encode() + x.to_bytes(size, "big"), key=key, digest_size=min(64, size)).digest()
        return int.from_bytes(state, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ mix(i, left), left) if back else (right, left ^ mix(i, right))
        value = left << half | right
        if value < domain:
            return value


Shift = Callable[[int, int], int]


def _characters(text: str, shift: Shift) -> str:
    """ASCII digits stay digits and letters stay letters of their case; everything else stands."""
    sets = [next((s for s in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in s), "") for c in text]
    value, domain = 0, 1
    for c, s in zip(text, sets, strict=True):
        if s:
            value, domain = value * len(s) + s.index(c), domain * len(s)
    value = shift(value, domain)
    out = []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            value, i = divmod(value, len(s))
            c = s[i]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _refilled(pattern: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``pattern``."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def _card_ends(text: str, start: int, end: int) -> tuple[list[tuple[bool, int, int]], int]:
    """Valid cards from ``start`` on that end with a group of digits before ``end``: (is it a usual layout, digits, end); and the start of the second group."""
    found, digits, layout, at, plain = [], "", [], start, True
    second = 0
    while m := DIGITS.match(text, at, end):
        digits, at = digits + m.group(), m.end()
        layout.append(at - m.start())
        if len(digits) > 19:
            break
        usual = len(layout) == 1 or tuple(layout) in LAYOUTS
        if len(digits) >= 13 and (plain or usual) and luhn_digit(digits[:-1]) == digits[-1]:
            found.append((usual, len(digits), at))
        between = BETWEEN.match(text, at, end)
        if not between:
            break
        plain, at = plain and between.group() in PLAIN, between.end()
        second = second or at
    return found, second or at


def _card_end(text: str, start: int, end: int) -> int | None:
    """The end of the card from ``start`` on; none if none is valid or one that begins inside it is more likely: of a usual layout, then longer."""
    own, at = _card_ends(text, start, end)
    if not own:
        return None
    best = max(own)
    while at < best[2]:
        others, next_at = _card_ends(text, at, end)
        if any(o[:2] > best[:2] for o in others):
            return None
        at = next_at
    return best[2]


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The end of the IBAN in a match: by its country's length, else the last group's end at which it is valid; in small letters only by its country's length."""
    size, plain, ends = IBAN_LENGTHS.get(text[start : start + 2].upper()), "", []
    small = text[start].islower()
    for at in range(start, end):
        plain += text[at].strip(" -").upper()
        whole = (at + 1 == end or text[at + 1] in " -") and text[at] not in " -" and 15 <= len(plain) <= 34 and (not small or len(plain) == size)
        if whole and _iban_check(plain[:2], plain[4:]) == plain[2:4]:
            ends.append((len(plain) == size, at + 1))
    return max(ends, default=(False, None))[1]


#: Where a match can be longer than the value in it.
ENDS = {"card": _card_end, "iban": _iban_end}


def _email(text: str, shift: Shift) -> str:
    local, _, host = text.rpartition("@")
    return f"{_characters(local, shift)}@{host}"


def _card(text: str, shift: Shift) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = _characters(digits[:-1], shift)
    return _refilled(text, body + luhn_digit(body))


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(text: str, shift: Shift) -> str | None:
    plain = text.replace(" ", "").replace("-", "").upper()
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = _characters(plain[4:], shift)
    left = iter(plain[:2] + _iban_check(plain[:2], account) + account)
    new = "".join(c if c in " -" else next(left) for c in text)
    return new.lower() if text[0].islower() else new


def _ssn(text: str, shift: Shift) -> str | None:
    sign = text[3]
    area, group, serial = map(int, text.split(sign))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value, serial = divmod(shift(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}{sign}{group + 1:02d}{sign}{serial + 1:04d}"


def _ipv4(text: str, shift: Shift) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    value = shift(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ipv6(text: str, shift: Shift) -> str | None:
    """Written out in full or shortened, and in capitals, as the given one is."""
    try:
        value = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    new = ipaddress.IPv6Address(shift(int(value), 1 << 128))
    written = new.compressed if "::" in text or any(len(x) < 4 for x in text.split(":")) else new.exploded
    return written.upper() if any(c.isupper() for c in text) else written


def _calling_code(digits: str) -> int:
    """How many digits of an international number are its country's."""
    if digits[0] in "17":
        return 1
    return 2 if digits[:2] in TWO_DIGIT_CODES else 3


def _phone(text: str, shift: Shift) -> str:
    """The country code stands, the other digits are permuted, whatever separates them."""
    digits = re.sub("[^0-9]", "", text)
    code = _calling_code(digits) if text[0] == "+" else 0
    return _refilled(text, digits[:code] + _characters(digits[code:], shift))


def _shifted_day(day: int, shift: Shift) -> int:
    """The pseudonym of a day among the days of its era: those of an earlier era, which it encloses, are passed over."""
    inner: tuple[int, int] | None = None
    for low, high in ERAS:
        if low <= day <= high:
            hole = inner[1] - inner[0] + 1 if inner else 0
            new = low + shift(day - low - (hole if inner and day > inner[1] else 0), high - low + 1 - hole)
            return new + hole if inner and new >= inner[0] else new
        inner = (low, high)
    raise ValueError(day)


def _ordinal(day: int) -> str:
    return "th" if 10 < day % 100 < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _like(word: str, model: str) -> str:
    return word.upper() if model.isupper() else word.lower() if model.islower() else word.capitalize()


def _date(text: str, shift: Shift) -> str | None:
    """Order, separators, zeros, language and case as written. With slashes the month comes first where it can, else the day; two digits of a year stand for 1970 to 2069."""
    m = next(filter(None, (form.fullmatch(text) for form in DATE_FORMS)), None)
    if m is None:
        return None
    part = m.groupdict()
    year = int(part["y"]) + (0 if len(part["y"]) == 4 else 2000 if int(part["y"]) < 70 else 1900)
    days, months = ("d", "m") if part.get("d") else ("b", "a") if part["s"] == "/" and int(part["a"]) <= 12 else ("a", "b")
    names, month = MONTH_OF[part["name"].lower()] if part.get("name") else (None, int(part[months]) - 1)
    try:
        day = datetime.date(year, month + 1, int(part[days])).toordinal()
    except ValueError:
        return None
    new = datetime.date.fromordinal(_shifted_day(day, shift))
    zeros = any(len(part[k]) == 2 and part[k][0] == "0" for k in (days, months) if part.get(k)) or (names is None and all(len(part[k]) == 2 for k in (days, months)))
    number = (lambda n: f"{n:02d}") if zeros else str
    put = {"y": f"{new.year:04d}"[-len(part["y"]) :], days: number(new.day)}
    if names is None:
        put[months] = number(new.month)
    else:
        put["name"] = _like(MONTHS[names][new.month - 1], part["name"])
        if part.get("th"):
            put["th"] = "er" * (new.day == 1) if part["th"].lower() == "er" else _like(_ordinal(new.day), part["th"])
    out, at = [], 0
    for k in sorted(put, key=m.start):
        out += [text[at : m.start(k)], put[k]]
        at = m.end(k)
    return "".join(out) + text[at:]


KINDS: dict[str, Callable[[str, Shift], str | None]] = {"email": _email, "iban": _iban, "ipv4": _ipv4, "ipv6": _ipv6, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym; null if it isn't a valid value of its kind."""
    return KINDS[kind](value, lambda v, domain: permute(v, domain, key, kind))


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and what was found: kind and range of characters in the given text.

    Where a match fails its check, other ends of it and the kinds that come later are
    tried; then the search goes on behind its first group of characters.
    """
    memo = worker_state("pii").setdefault("pseudonyms", {})
    if len(memo) > MEMO_VALUES:
        memo.clear()
    out, spans, done = [], [], 0

    def put(kind: str, a: int, b: int) -> bool:
        nonlocal done
        value = text[a:b]
        if (key, kind, value) not in memo:
            memo[key, kind, value] = pseudonym(kind, value, key)
        new = memo[key, kind, value]
        if new is not None:
            out.extend((text[done:a], new))
            spans.append((kind, a, b))
            done = b
        return new is not None

    def numbers(at: int, end: int) -> None:
        m = NUMBER.search(text, at, end)
        while m:
            a, b = m.span()
            kind = m.lastgroup
            stop = ENDS[kind](text, a, b if kind == "iban" else end) if kind in ENDS else b
            if stop and put(kind, a, stop):
                m = NUMBER.search(text, stop, end)
            else:
                m = kind in LATER and LATER[kind].match(text, a, end) or NUMBER.search(text, GROUP.match(text, a).end(), end)

    at = 0
    for m in EMAIL.finditer(text) if "@" in text else ():
        numbers(at, m.start())
        put("email", *m.span())
        at = m.end()
    numbers(at, len(text))
    return "".join(out) + text[done:], spans


DIGIT_OR_AT = re.compile("[0-9@]|::")
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("first_char", pa.int64()), ("end_char", pa.int64())]))


def pseudonymise(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of ``df`` with pseudonyms in ``text``, and ``pii_found``: kind and character range in the original of each value.

    ``key`` is a secret of any length: who has it can undo the pseudonyms. A column
    ``pii_found`` is replaced. Null texts stay null, with nothing found. Impossible dates and numbers that fail their check stand as
    they are. Every row is treated alike, so repeated rows stay equal. An empty table
    gives no rows.
    """
    keep = [c for c in df.columns if c != "pii_found"]
    at = keep.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, found = [], []
            for t in b.column(at).to_pylist():
                new, spans = pseudonymised(t, key) if t and DIGIT_OR_AT.search(t) else (t, [])
                texts.append(new)
                found.append([{"kind": k, "first_char": a, "end_char": z} for k, a, z in spans])
            columns = [*b.columns, pa.array(found, FOUND)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    placed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    added = StructType.fromDDL(f"c{len(keep)} array<struct<kind: string, first_char: long, end_char: long>>")
    return placed.mapInArrow(task, StructType([*placed.schema.fields, *added.fields])).toDF(*keep, "pii_found")
