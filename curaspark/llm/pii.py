"""Personal data to format-preserving pseudonyms, with DataFrame expressions only.

Found and validated: payment card numbers (13 to 19 digits, Luhn sum), social security numbers (area, group and
serial in range), phone numbers (7 to 15 digits), IPv4 addresses (octets to 255), dates (in the calendar, years
1900 to 2099) and mail addresses. Each is permuted within its format by a Feistel network keyed with ``key``, so
equal values get equal pseudonyms in all documents, different values different ones, and ``restore=True`` with
the same key gives the values back. Separators, country codes, mail domains and the date layout stay; a card's
check digit is computed anew. What does not pass its check (a number with a wrong Luhn sum) is left alone.

Every network alternates between two halves, each in its own modulus, so no cycle walking is needed: digits are
cut in the middle, addresses into two 16-bit halves, the 73,049 days of the years 1900 to 2099 into 17 x 4,297.
Slashed dates are month/day/year, or day/month/year where the day is past 12; those walk on in the same days until
the day is past 12 again. Slashed and dotted dates come out, and back, with two-digit days and months.
Phone numbers are permuted as digits after the country code, so a number's ways of writing stay linked; which digits
are the code follows from the list of codes, not from separators.

A round adds SHA-2 of the other half under a key that the driver derives from ``key``; plans show the derived key only.

Defined results: null text stays null, empty text stays empty; values are found in the whole text, however
long; rows that repeat each give a row; an empty table gives an empty result; other columns are kept, but for one
called private_kinds, which the result replaces.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import let

ROUNDS = 6
# The formats, as Java regular expressions; at one place the first that fits counts.
MAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9])[A-Za-z0-9.-]*[A-Za-z0-9]"
ADDRESS = r"(?<![\w.])\d{1,3}+\.\d{1,3}+\.\d{1,3}+\.\d{1,3}+(?!\w|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[./-]\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+(])(?:\+\d{7,15}+|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
CARD = r"(?<![\w.+-])(?:\d{13,19}+|\d{4}([ -])\d{4}(?:[ -]\d{4}){1,2}[ -]\d{1,4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
# Country calling codes of one and two digits; all others have three.
COUNTRY_CODES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Steps of a day-first date at most; each ends the walk in three of five cases.
WALK = 64
FIRST_YEAR, YEARS, DAYS, DAY_HALVES = 1900, 200, 73_049, (17, 4_297)
PATTERN = "|".join([MAIL, ADDRESS, DATE, SOCIAL, PHONE, CARD.replace("([ -])", "[ -]")])


def derived(key: str, purpose: str) -> str:
    """The key of one format, from which the caller's key cannot be told."""
    return hmac.new(key.encode(), purpose.encode(), hashlib.sha256).hexdigest()


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of SHA-2 under the key."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def in_rounds(left: Column, right: Column, turn: Callable[[Column, Column, Column, bool], Column], restore: bool) -> Column:
    """struct<left, right> after the rounds; turn(half, other half, round, whether it is the left half) gives a half's new value."""
    rounds = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if restore else range(ROUNDS))])
    pair = lambda x, y: F.struct(x.alias("left"), y.alias("right"))

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, pair(turn(s["left"], s["right"], r, True), s["right"])).otherwise(pair(s["left"], turn(s["right"], s["left"], r, False)))

    return F.aggregate(rounds, pair(left, right), step)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, restore: bool) -> Column:
    """A keyed permutation of the pairs (left below a, right below b), as struct<left, right>."""

    def turn(half: Column, other: Column, r: Column, is_left: bool) -> Column:
        m = (a if is_left else b).cast("long")
        by = F.pmod(keyed(key, r, other), m)
        return F.pmod(half - by if restore else half + by, m)

    return in_rounds(left.cast("long"), right.cast("long"), turn, restore)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def permute_digits(digits: Column, key: str, restore: bool) -> Column:
    """Strings of up to 36 digits to such strings of the same length."""
    power = lambda k: F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), k + 1)
    number = lambda s: F.when(s == "", F.lit(0)).otherwise(s).cast("long")
    padded = lambda x, k: F.when(k > 0, F.lpad(x.cast("string"), k, "0")).otherwise(F.lit(""))

    def permuted(d: Column) -> Column:
        h, rest = F.floor(F.length(d) / 2).cast("int"), F.ceil(F.length(d) / 2).cast("int")
        halves = feistel(number(F.substr(d, F.lit(1), h)), number(F.substr(d, h + 1)), power(h), power(rest), key, restore)
        return let(halves, lambda s: F.concat(padded(s["left"], h), padded(s["right"], rest)))

    return let(digits, permuted)


def refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by others."""

    def filled(new: Column) -> Column:
        before = lambda i: F.length(digits_of(F.substr(value, F.lit(1), i + 1)))
        return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substr(new, before(i), F.lit(1))).otherwise(c)), "")

    return let(digits, filled)


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Counted from the right; first_doubled: as if a check digit followed."""

    def worth(c: Column, i: Column) -> Column:
        twice = 2 * c.cast("int") - F.when(c > "4", 9).otherwise(0)
        return F.when(i % 2 == (0 if first_doubled else 1), twice).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda s, x: s + x)


def card(value: Column, key: str, restore: bool) -> Column:
    def of_digits(d: Column) -> Column:
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), derived(key, "card"), restore)
        check = lambda b: F.pmod(-luhn_sum(b, True), F.lit(10)).cast("string")
        new = let(body, lambda b: F.concat(b, check(b)))
        return F.when(F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0), refill(value, new))

    return let(digits_of(value), of_digits)


def social(value: Column, key: str, restore: bool) -> Column:
    def of_parts(p: Column) -> Column:
        # Areas 1 to 899 without 666 are numbered 0 to 897, groups 0 to 98, serials 0 to 9998.
        area = F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)
        moved = feistel(area * 99 + p[1] - 1, p[2] - 1, F.lit(898 * 99), F.lit(9_999), derived(key, "social"), restore)
        area_of = lambda s: F.floor(s["left"] / 99) + 1
        new = lambda s: F.format_string("%03d-%02d-%04d", F.when(area_of(s) > 665, area_of(s) + 1).otherwise(area_of(s)), s["left"] % 99 + 1, s["right"] + 1)
        return F.when(p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0), let(moved, new))

    return let(F.transform(F.split(value, "-"), lambda x: x.cast("long")), of_parts)


def phone(value: Column, key: str, restore: bool) -> Column:
    def of_digits(d: Column) -> Column:
        code = F.when(~value.startswith("+"), 0).when(d.rlike(COUNTRY_CODES), F.length(F.regexp_extract(d, COUNTRY_CODES, 0))).otherwise(3)
        new = let(code, lambda n: F.concat(F.substr(d, F.lit(1), n), permute_digits(F.substr(d, n + 1), derived(key, "phone"), restore)))
        return F.when(F.length(d).between(7, 15), refill(value, new))

    return let(digits_of(value), of_digits)


def address(value: Column, key: str, restore: bool) -> Column:
    def of_octets(o: Column) -> Column:
        moved = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), derived(key, "address"), restore)
        parts = lambda s: [F.floor(s["left"] / 256), s["left"] % 256, F.floor(s["right"] / 256), s["right"] % 256]
        new = let(moved, lambda s: F.concat_ws(".", *[x.cast("string") for x in parts(s)]))
        # Octets with leading zeros have no pseudonym of their format.
        return F.when((F.array_max(o) <= 255) & (F.array_join(o.cast("array<string>"), ".") == value), new)

    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), of_octets)


def date(value: Column, key: str, restore: bool) -> Column:
    first = F.make_date(F.lit(FIRST_YEAR), F.lit(1), F.lit(1))
    in_range = lambda x: F.year(x).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    halves = DAY_HALVES

    def moved(day: Column, purpose: str) -> Column:
        n = F.datediff(day, first)
        pair = feistel(F.floor(n / halves[1]), n % halves[1], F.lit(halves[0]), F.lit(halves[1]), derived(key, purpose), restore)
        return let(pair, lambda s: F.date_add(first, (s["left"] * halves[1] + s["right"]).cast("int")))

    def month_first(day: Column) -> Column:
        written = lambda d, layout: F.date_format(d, layout)
        layouts = lambda d: F.when(value.contains("-"), written(d, "yyyy-MM-dd")).when(value.contains("/"), written(d, "MM/dd/yyyy")).otherwise(written(d, "dd.MM.yyyy"))
        return let(moved(day, "date"), layouts)

    def day_first(day: Column) -> Column:
        on = lambda d, _: F.when(F.dayofmonth(d) > 12, d).otherwise(moved(d, "day first"))
        return F.date_format(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(day, "day first"), on), "dd/MM/yyyy")

    def of_parts(p: Column) -> Column:
        make = lambda y, m, d: F.try_to_date(F.concat_ws("-", p[y], F.lpad(p[m], 2, "0"), F.lpad(p[d], 2, "0")), "yyyy-MM-dd")
        day = F.when(value.contains("-"), make(0, 1, 2)).when(value.contains("/"), make(2, 0, 1)).otherwise(make(2, 1, 0))
        swapped = F.when(value.contains("/"), make(2, 1, 0))
        return let(day, lambda d: F.when(d.isNotNull(), F.when(in_range(d), month_first(d))).otherwise(let(swapped, lambda x: F.when(in_range(x), day_first(x)))))

    return let(F.split(value, "[-/.]"), of_parts)


def mail(value: Column, key: str, restore: bool) -> Column:
    """Letters and digits before the @ turn within their class, each half by a hash of the other half and the domain."""

    def of_parts(parts: Column) -> Column:
        name, domain = parts[0], parts[1]

        def turn(half: Column, other: Column, r: Column, is_left: bool) -> Column:
            def turned(digest: Column) -> Column:
                def one(c: Column, i: Column) -> Column:
                    by = F.conv(F.substr(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                    at = F.ascii(c) - by if restore else F.ascii(c) + by
                    within = lambda low, m: F.char(low + F.pmod(at - low, F.lit(m)))
                    return F.when(c.rlike("[0-9]"), within(48, 10)).when(c.rlike("[a-z]"), within(97, 26)).when(c.rlike("[A-Z]"), within(65, 26)).otherwise(c)

                return F.array_join(F.transform(F.split(half, ""), one), "")

            return let(F.sha2(F.concat_ws(":", F.lit(derived(key, "mail")), r.cast("string"), other, domain), 512), turned)

        h = F.floor(F.length(name) / 2).cast("int")
        moved = in_rounds(F.substr(name, F.lit(1), h), F.substr(name, h + 1), turn, restore)
        return let(moved, lambda s: F.concat(s["left"], s["right"], F.lit("@"), domain))

    return let(F.split(value, "@", 2), of_parts)


#: Kind, whole-match pattern, pseudonym (null where the value fails its check).
KINDS: list[tuple[str, str, Callable[[Column, str, bool], Column]]] = [
    ("mail", "@", mail),
    ("address", r"^\d+\.\d+\.\d+\.\d+$", address),
    ("date", r"^\d{4}-\d\d-\d\d$|^\d{1,2}([/.])\d{1,2}\1\d{4}$", date),
    ("social", r"^\d{3}-\d{2}-\d{4}$", social),
    ("phone", rf"^(?:{PHONE})$", phone),
    ("card", r"", card),
]


def pseudonymise(docs: DataFrame, *, text="text", key: str, restore: bool = False) -> DataFrame:
    """All columns, with the text's personal data exchanged, and private_kinds: the kinds found, in order."""

    def named(name: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.when(v.isNotNull(), name).alias("kind"), v.alias("value"))

    def one(value: Column) -> Column:
        new = F.lit(None).cast("struct<kind:string,value:string>")
        for name, shape, make in reversed(KINDS):
            new = F.when(value.rlike(shape), let(make(value, key, restore), named(name))).otherwise(new)
        return let(new, lambda n: F.struct(n["kind"].alias("kind"), F.coalesce(n["value"], value).alias("value")))

    held = docs.withColumn("__pii_found", F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), one))
    values = F.concat(F.transform("__pii_found", lambda f: f["value"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), values, lambda gap, v: F.concat(gap, v)), "")
    kinds = F.array_compact(F.transform("__pii_found", lambda f: f["kind"]))
    none = F.array().cast("array<string>")
    return held.withColumns({text: joined, "private_kinds": F.coalesce(kinds, none)}).drop("__pii_found")
