"""Format-preserving pseudonyms: validated personal numbers, dates and addresses permuted by a keyed Feistel network.

A pseudonym has the format of what it replaces, check digits and calendar included, and equal values
get equal pseudonyms in every document, so links between documents survive. The same key turns them
back. Work is per row: nothing is looked up or exchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import name, text_of

ROUNDS = 8
KINDS = ("email", "card", "iban", "ip", "date", "ssn", "phone")


class Feistel:
    """Keyed permutations of the numbers below ``size``, one for each ``tweak``."""

    def __init__(self, key: bytes):
        self.key = key

    def _mask(self, tweak: str, nth: int, half: int, bits: int) -> int:
        data = f"{tweak}|{nth}|{half}".encode()
        out = b""
        while len(out) * 8 < bits:
            out += hmac.new(self.key, data + bytes([len(out) & 255]), hashlib.sha256).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _once(self, value: int, bits: int, tweak: str, back: bool) -> int:
        low = bits // 2
        high = bits - low
        # Halves of unequal width swap roles each round, so any number of bits will do.
        a, b = value >> low, value & ((1 << low) - 1)
        if not back:
            for nth in range(ROUNDS):
                if nth % 2 == 0:
                    a ^= self._mask(tweak, nth, b, high)
                else:
                    b ^= self._mask(tweak, nth, a, low)
        else:
            for nth in reversed(range(ROUNDS)):
                if nth % 2 == 0:
                    a ^= self._mask(tweak, nth, b, high)
                else:
                    b ^= self._mask(tweak, nth, a, low)
        return a << low | b

    def permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """Walk the cycle of the wider permutation until it is below ``size`` again."""
        if size < 2:
            return value
        bits = max(2, (size - 1).bit_length())
        while True:
            value = self._once(value, bits, tweak, back)
            if value < size:
                return value

    def digits(self, text: str, tweak: str, back: bool = False) -> str:
        """A string of as many digits."""
        return str(self.permute(int(text), 10 ** len(text), f"{tweak}{len(text)}", back)).zfill(len(text)) if text else text


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` pass when appended."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    """The two check digits of an IBAN."""
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, fill: str, what: str) -> str:
    """Put ``fill`` into the characters of ``shape`` that match ``what``, in order."""
    left = iter(fill)
    return re.sub(what, lambda _: next(left), shape)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return None
    if luhn_digit(digits[:-1]) == digits[-1]:
        body = f.digits(digits[:-1], "card", back)
        return _refill(text, body + luhn_digit(body), r"\d")
    # Long digit strings that fail the check are still account-like; all their digits change.
    return _refill(text, _unchecked(f, digits, back), r"\d")


def _unchecked(f: Feistel, digits: str, back: bool) -> str:
    """Permute the numbers that fail the check among themselves, so that decoding knows them."""
    while True:
        digits = f.digits(digits, "number", back)
        if luhn_digit(digits[:-1]) != digits[-1] and len(set(digits)) > 1:
            return digits


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    bare = re.sub(r"\s", "", text)
    country, check, rest = bare[:2], bare[2:4], bare[4:]
    if not 15 <= len(bare) <= 34 or iban_digits(country, rest) != check:
        return None
    numbers = f.digits(re.sub(r"\D", "", rest), "iban" + re.sub(r"\d", "0", rest), back)
    rest = _refill(rest, numbers, r"\d")
    return _refill(text, country + iban_digits(country, rest) + rest, r"\S")


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts) or text != ".".join(map(str, parts)):
        return None
    value = f.permute(int.from_bytes(bytes(parts), "big"), 2**32, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ip6(f: Feistel, text: str, back: bool) -> str | None:
    """Hex digits change by their place, groups and letter case stay, so each notation links only with itself.

    Clock times and words are no addresses: fewer than eight groups need a digit, and without ``::`` also
    a letter or a longer group.
    """

    def shape(t: str) -> str | None:
        groups = t.split(":")
        if not 3 <= len(groups) <= 8 + ("::" in t) or not re.search("[0-9]", t) or t.count("::") > 1 or ":::" in t:
            return None
        if "::" not in t and ("" in groups or not re.search("[A-Fa-f]|[0-9]{3}", t)):
            return None
        return "mixed" if re.search("[A-F]", t) and re.search("[a-f]", t) else "upper" if re.search("[A-F]", t) else "lower"

    kind = shape(text)
    if kind is None:
        return None
    letters = {"lower": "0123456789abcdef", "upper": "0123456789ABCDEF", "mixed": "0123456789abcdefABCDEF"}[kind]
    digits = text.replace(":", "")
    tweak, size, value = "ip6" + kind + re.sub("[^:]", "0", text), len(letters) ** len(digits), 0
    for c in digits:
        value = value * len(letters) + letters.index(c)
    while True:
        value = f.permute(value, size, tweak, back)
        rest, out = value, []
        for _ in digits:
            rest, r = divmod(rest, len(letters))
            out.append(letters[r])
        new = _refill(text, "".join(reversed(out)), "[^:]")
        if shape(new) == kind:
            return new


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
# Two-digit years stand for 1969 to 2068; days without a year for those of a leap year.
_FIRST_SHORT, _LAST_SHORT = datetime.date(1969, 1, 1).toordinal(), datetime.date(2068, 12, 31).toordinal()
_FIRST_BARE, _LAST_BARE = datetime.date(2000, 1, 1).toordinal(), datetime.date(2000, 12, 31).toordinal()


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """Days from 1900 to 2099 permute among themselves; a format keeps its order, separators and widths."""
    parts = re.split(r"[-/. ]", text)
    marks = re.findall(r"[-/. ]", text)
    if marks[0] != marks[1]:
        return None
    order = ("y", "m", "d") if len(parts[0]) == 4 else ("d", "m", "y") if marks[0] == "." else ("m", "d", "y")
    got = dict(zip(order, parts))
    short = len(got["y"]) == 2
    if len(got["y"]) != 4 and not short:
        return None
    first, last = (_FIRST_SHORT, _LAST_SHORT) if short else (_FIRST, _LAST)

    def read(got: dict[str, str]) -> datetime.date:
        year = int(got["y"])
        return datetime.date(year + (2000 if year < 69 else 1900) * short, int(got["m"]), int(got["d"]))

    try:
        day = read(got)
    except ValueError:
        if order != ("m", "d", "y"):
            return None
        order = ("d", "m", "y")
        got = dict(zip(order, parts))
        try:
            day = read(got)
        except ValueError:
            return None
    widths = [len(p) for p in parts]
    tweak = "date" + "".join(order) + "".join(map(str, widths))

    def shown(day: datetime.date) -> str | None:
        values = {"y": day.year % 100 if short else day.year, "m": day.month, "d": day.day}
        # A format with one-digit parts stands for days whose parts have as many digits.
        texts = [str(values[k]).zfill(w) for k, w in zip(order, widths)]
        if any(len(t) != w for t, w in zip(texts, widths)) or (order == ("d", "m", "y") and marks[0] != "." and day.day <= 12):
            return None
        return marks[0].join(texts)

    return _other_day(f, day, first, last, tweak, shown, back)


def _other_day(f: Feistel, day: datetime.date, first: int, last: int, tweak: str, shown: Callable[[datetime.date], str | None], back: bool) -> str | None:
    number = day.toordinal() - first
    if not 0 <= number <= last - first:
        return None
    while True:
        number = f.permute(number, last - first + 1, tweak, back)
        out = shown(datetime.date.fromordinal(number + first))
        if out is not None:
            return out


# ---- fixed values ---------------------------------------------------------------------------------
_MONTHS = "january february march april may june july august september october november december".split()
# ---------------------------------------------------------------------------------------------------
_MONTH = "(?i:" + "|".join(rf"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + ")"
_NAMED = re.compile(rf"(?P<m>{_MONTH})(?P<x>\.?\s+)(?P<d>[0-9]{{1,2}})(?P<s>(?i:st|nd|rd|th))?(?:(?P<z>,?\s+)(?P<y>[0-9]{{4}})(?![0-9]))?"
                    rf"|(?P<d2>[0-9]{{1,2}})(?P<s2>(?i:st|nd|rd|th))?(?P<x2>\.?\s+(?:of\s+)?)(?P<m2>{_MONTH})(?P<z2>\.?,?\s+)(?P<y2>[0-9]{{4}})")


def _named_date(f: Feistel, text: str, back: bool) -> str | None:
    """Dates with a month's name: its length and case, the width of the day, its ending and the order stay."""
    m = _NAMED.fullmatch(text)
    if m is None:
        return None
    front = m["m"] is not None
    month, day, end, x, z, year = (m[k if front else k + "2"] for k in "mdsxzy")
    cases = {str.upper: "u", str.lower: "l", str.title: "t"}
    case = next((c for c in cases if c(month) == month), None)
    if case is None or (end and end not in (end.lower(), end.upper())):
        return None

    def ending(n: int) -> str:
        return "th" if 10 < n < 14 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")

    whole = len(month) > 3
    number = next(i for i, n in enumerate(_MONTHS, 1) if n[:3] == month[:3].lower())
    try:
        at = datetime.date(int(year) if year else 2000, number, int(day))
    except ValueError:
        return None
    right = bool(end) and end.lower() == ending(at.day)

    def shown(at: datetime.date) -> str | None:
        named, numbered = _MONTHS[at.month - 1], str(at.day).zfill(len(day))
        # A wrong ending stays, at days for which it is wrong too; "May" counts as a short name.
        if (whole and len(named) == 3) or len(numbered) != len(day) or (end and not right and end.lower() == ending(at.day)):
            return None
        named = case(named if whole else named[:3])
        tail = (ending(at.day) if end.islower() else ending(at.day).upper()) if right else end or ""
        return f"{named}{x}{numbered}{tail}" + (f"{z}{at.year}" if year else "") if front else f"{numbered}{tail}{x}{named}{z}{at.year}"

    tweak = "|".join(("named", "front" if front else "back", cases[case], str(whole), str(len(day)), str(right), end if end and not right else ""))
    return _other_day(f, at, *((_FIRST, _LAST) if year else (_FIRST_BARE, _LAST_BARE)), tweak + "|" + str(bool(year)), shown, back)


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    digits = re.sub(r"\D", "", text)
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    areas = 898
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    place = f.permute(place, areas * 99 * 9999, "ssn", back)
    area, rest = divmod(place, 99 * 9999)
    group, serial = divmod(rest, 9999)
    area += 1 + (area >= 665)
    return _refill(text, f"{area:03d}{group + 1:02d}{serial + 1:04d}", r"\d")


# ---- fixed values: country codes of two digits; 1 and 7 have one, the others three ------------------
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# ---------------------------------------------------------------------------------------------------


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """The country code after a plus stays; of the rest all digits change.

    With a plus 8 to 15 digits in all, after a bracket at least 7, with separators 9 to 12 and without
    any 10 to 12. A pseudonym is never one that a kind before this would take.
    """
    lead = re.match(r"\+\d{1,3}(?=[\s().-])", text) or re.match(r"\+(?:[17]|\d\d)", text)
    head = lead[0] if lead else ""
    if len(head) == 3 and text[3:4].isdigit() and head[1:] not in _TWO:
        head = text[:4]
    digits = re.sub(r"\D", "", text[len(head):])
    least, most = (7, 15 - len(head) + 1) if head else (7, 14) if "(" in text else (9 if len(digits) < len(text) else 10, 12)
    if not least <= len(digits) <= most:
        return None
    # One dot alone is a decimal point, unless it stands where numbers are grouped.
    if re.fullmatch(r"\d+\.\d+", text) and not re.fullmatch(r"\d{3}\.\d{7}|\d{6}\.\d{4}", text):
        return None
    while True:
        digits = f.digits(digits, "phone" + head, back)
        new = head + _refill(text[len(head):], digits, r"\d")
        if not any(change(f, m[0], back) is not None for kind, pattern, change in _RULES if kind not in ("phone", "card" if head else "") for m in pattern.finditer(new)):
            return new


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """Letters stay letters and digits digits, each by its place; the domain's last label stays."""
    user, _, host = text.rpartition("@")
    host, _, top = host.rpartition(".")

    def part(s: str, tweak: str) -> str:
        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
        value, size = 0, 1
        for c, k in zip(s, shape):
            base, first = {"a": (26, "a"), "A": (26, "A"), "0": (10, "0")}.get(k, (1, c))
            value, size = value * base + ord(c) - ord(first) if base > 1 else value, size * base
        value, out = f.permute(value, size, tweak + shape, back), []
        for c, k in zip(reversed(s), reversed(shape)):
            base, first = {"a": (26, "a"), "A": (26, "A"), "0": (10, "0")}.get(k, (1, c))
            if base > 1:
                value, r = divmod(value, base)
                out.append(chr(ord(first) + r))
            else:
                out.append(c)
        return "".join(reversed(out))

    return part(user, "user") + "@" + part(host, "host") + "." + top


# Kinds in order of precedence; a number that one kind refuses is offered to the next that matches there.
_RULES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), _ip),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){2,7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)"), _ip6),
    ("date", re.compile(r"(?<![\d./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{4} \d{2} \d{2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,2}/\d{1,2}/\d{2}|\d\d([.-])\d\d\1\d\d)(?![\d]|[./-]\d)"), _date),
    ("date", re.compile(rf"(?<!\w)(?:{re.sub('[?]P<[a-z0-9]+>', '?:', _NAMED.pattern)})(?!\w)"), _named_date),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)|(?<![\w.+-])\d{3}[ .-]?\d{2}[ .-]?\d{4}(?!\w|[.-]\d)"), _ssn),
    # Before cards, because numbers with a plus may be as long.
    ("phone", re.compile(r"(?<![\w.+-])\+\d{1,15}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{1,12}){0,6}(?!\w|[.-]\d)"), _phone),
    ("card", re.compile(r"(?<![\w.])(?:\d(?:[ -]?\d){12,18}|\d{4}(?:\.\d{4}){3})(?![\w]|\.\d)"), _card),
    ("phone", re.compile(r"(?<![\w./+-])(?<!\d:)(?:\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d{2,8}(?:[ .-]\d{2,8}){0,4}(?![\w]|[.-]\d)"), _phone),
)
_ANY = re.compile(r"@|\d")


def spans(f: Feistel, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, pseudonym)`` of all values, without overlaps."""
    if not _ANY.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern, change in _RULES:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if any(a < m.end() and m.start() < b for a, b, _, _ in taken):
                continue
            found, new = m[0], change(f, m[0], back)
            # A number may follow a phone number after a blank.
            while new is None and kind == "phone" and " " in found:
                found = found[:found.rindex(" ")].rstrip()
                new = change(f, found, back)
            if new is not None:
                taken.append((m.start(), m.start() + len(found), kind, new))
    return sorted(taken)


def rewrite(f: Feistel, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
    found, out, at = spans(f, text, back), [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, text, n_spans, spans``.

    ``text`` has every value replaced; ``spans`` lists kind:start:end in the input, code points, ends
    exclusive. Card numbers and IBANs keep valid check digits, dates stay dates, addresses stay
    addresses. Values that fail their check are not of that kind; a long number with a wrong check digit
    still changes. Dates may have two-digit years or month names, IPs four or six as version, phones
    and SSNs separators or none. With ``back`` the same key restores the input. Null text stays null without spans;
    empty texts stay empty; repeated rows give equal results; other columns are ignored.
    """
    rows = docs.select(name(id_col).alias("doc_id"), name(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    secret = key.encode()

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(secret)
        for batch in batches:
            texts, counts, lists = [], [], []
            for t in batch.column(1):
                text = t.as_py()
                new, found = (None, []) if text is None else rewrite(f, text, back)
                texts.append(new)
                counts.append(len(found))
                lists.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(lists, pa.string())],
                                             names=["doc_id", "text", "n_spans", "spans"])

    return rows.mapInArrow(change, f"doc_id {id_type}, text string, n_spans long, spans string")
