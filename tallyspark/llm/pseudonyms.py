"""Format-preserving Feistel pseudonyms for personal data. Everything here is a Spark SQL expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import columns_free_of

ROUNDS = 8
#: Private-use characters: around a found value, between the kinds it may have, and before an escaped one of the three.
MARK, BETWEEN, ESCAPE = "\ue000", "\ue001", "\ue002"
#: How a text's own such characters are written meanwhile.
KEPT = {ESCAPE: f"{ESCAPE}e", MARK: f"{ESCAPE}m", BETWEEN: f"{ESCAPE}b"}
#: Days of a whole Gregorian cycle, 1700-01-01 to 2099-12-31, as a product of two near-equal factors.
FIRST_DAY, DAY_LOW, DAY_HIGH = "1700-01-01", 189, 773

#: Fixed patterns, most specific first. All are tried at each place of a text, in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,24}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?<=[=:\"' ])(?<=(?:password|passwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"',;]{6,}",
    "iban": r"\b(?:VALID)\b",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9/-])(?!\.[0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "card": r"(?<![0-9.-])(?:VALID)(?![0-9]|\.[0-9])",
}
#: Where a number of several lengths may begin, with the longest run and what follows it; VALID above stands for a text's own valid ones.
RUNS = {
    "iban": r"\b(?=([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?[0-9A-Za-z_]?))",
    "card": r"(?<![0-9.-])(?=([0-9](?:[ -]?[0-9]){12,18}(?:[.]?[0-9])?))",
}
#: The number of such a length at the begin of a run.
LENGTHS = {
    "iban": [rf"^([A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}})\b" for n in range(34, 14, -1)],
    "card": [rf"^([0-9](?:[ -]?[0-9]){{{n - 1}}})(?![0-9]|\.[0-9])" for n in range(19, 12, -1)],
}
#: Characters of a country's IBAN.
IBAN_SIZES = {
    k[:2]: int(k[2:])
    for k in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
        "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


def _digest(key: str, *parts: Column) -> Column:
    """A keyed number below 2^60 of what the parts say."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(low: Column, high: Column, low_size: Column, high_size: Column, key: str, tweak: Column) -> tuple[Column, Column]:
    """A keyed permutation of the pairs (low, high) with low < low_size, high < high_size: each half in turn is moved by a digest of the other."""
    state = F.struct(low.alias("low"), high.alias("high"))
    for i in range(ROUNDS):
        state = _let(state, _round(i, low_size, high_size, key, tweak))
    return state["low"], state["high"]


def _round(i: int, low_size: Column, high_size: Column, key: str, tweak: Column) -> Callable[[Column], Column]:
    """One round as a function of the state alone; even rounds move the low half, odd ones the high half."""

    def move(s: Column) -> Column:
        own, other, size = ("low", "high", low_size) if i % 2 == 0 else ("high", "low", high_size)
        moved = F.pmod(s[own] + F.pmod(_digest(key, tweak, F.lit(i), s[other]), size), size).alias(own)
        return F.struct(moved, s[other].alias(other))

    return move


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the digit strings of one length (up to 34); leading zeros count. One digit is moved by a keyed amount."""

    def body(d: Column) -> Column:
        n = F.length(d)
        cut = F.floor(n / 2).cast("int")
        rest = (n - cut).cast("int")
        head, tail = F.substring(d, F.lit(1), cut), F.substring(d, cut + 1, rest)
        low_size, high_size = F.pow(F.lit(10.0), rest).cast("long"), F.pow(F.lit(10.0), cut).cast("long")
        both = F.concat_ws("|", tweak, n)
        low, high = feistel(tail.cast("long"), F.coalesce(F.nullif(head, F.lit("")).cast("long"), F.lit(0).cast("long")), low_size, high_size, key, both)
        return F.concat(F.when(cut > 0, F.lpad(high.cast("string"), cut, "0")).otherwise(""), F.lpad(low.cast("string"), rest, "0"))

    return _let(digits, body)


def refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in turn; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(done: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (F.length(c) == 1)
        out = F.concat(done["out"], F.when(is_digit, F.substring(digits, done["used"] + 1, F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (done["used"] + is_digit.cast("int")).alias("used"))

    return F.aggregate(F.split(shape, ""), start, step, lambda x: x["out"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, odd: int) -> Column:
    """The Luhn sum; every second digit, beginning with the last but `odd`, counts double."""
    marks = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(F.pmod(i, F.lit(2)) == odd, _let(c.cast("int") * 2, lambda x: x - F.when(x > 9, 9).otherwise(0))).otherwise(c.cast("int")))
    return F.aggregate(marks, F.lit(0), lambda a, b: a + b)


def mod97(text: Column) -> Column:
    """A digit string modulo 97, digit by digit."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))


def _iban_numbers(moved: Column) -> Column:
    return F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def card(value: Column, key: str) -> Column:
    """A Luhn-valid number as another of its length and spacing; its first digit stays, the check digit is made anew."""

    def body(d: Column) -> Column:
        inner = permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, F.concat(F.lit("card"), F.substring(d, 1, 1)))
        return _let(F.concat(F.substring(d, 1, 1), inner), lambda new: refill(value, F.concat(new, F.pmod(10 - F.pmod(luhn_sum(new, 0), F.lit(10)), F.lit(10)).cast("string"))))

    return _let(digits_of(value), body)


def iban(value: Column, key: str) -> Column:
    """A valid account number as another of its country, letters and spacing; the check digits are made anew."""

    def body(v: Column) -> Column:
        country, account = F.substring(v, 1, 2), F.substr(v, F.lit(5))
        digits = permute_digits(digits_of(account), key, F.concat(F.lit("iban"), country, F.regexp_replace(account, "[0-9]", "0")))
        new = refill(account, digits)
        return _let(new, lambda a: _let(F.lpad((98 - mod97(_iban_numbers(F.concat(a, country, F.lit("00"))))).cast("string"), 2, "0"), lambda check: refill(value, F.concat(check, digits_of(a)))))

    return _let(F.replace(value, F.lit(" "), F.lit("")), body)


def date_parts(value: Column) -> Column:
    """The date that a written one names, or null: year first, or day before month, or month before day where only that is valid."""
    year_first = F.regexp_extract(value, r"^([0-9]{4})[-/]", 1) != ""
    d = digits_of(value)
    iso = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    day_first = F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2))
    month_first = F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 1, 2), F.substring(d, 3, 2))
    day = lambda text: F.try_to_date(text, "yyyy-MM-dd")
    read = lambda text, name: F.struct(day(text).alias("day"), F.lit(name).alias("order"))
    return F.when(year_first, read(iso, "ymd")).when(day(day_first).isNotNull(), read(day_first, "dmy")).otherwise(read(month_first, "mdy"))


def date(value: Column, key: str) -> Column:
    """A calendar date of 1700 to 2099 as another, written in the same way.

    Month before day is read only where the day is over 12, so such a date is
    moved on until that holds again; else two written dates could share one.
    """

    def body(p: Column) -> Column:
        def move(n: Column) -> Column:
            low, high = feistel(F.pmod(n, F.lit(DAY_LOW)), F.floor(n / DAY_LOW), F.lit(DAY_LOW), F.lit(DAY_HIGH), key, F.lit("date"))
            return (high * DAY_LOW + low).cast("long")

        day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        once = move(F.date_diff(p["day"], F.lit(FIRST_DAY).cast("date")).cast("long"))
        late = lambda n: (p["order"] != "mdy") | (F.dayofmonth(day(n)) > 12)
        # Two of five dates have an early day; a walk of 64 steps ends but for one in 10^25.
        n = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda m, _: F.when(late(m), m).otherwise(move(m)))
        forms = {"ymd": "yyyyMMdd", "dmy": "ddMMyyyy", "mdy": "MMddyyyy"}
        wide = _let(day(n), lambda new: F.coalesce(*[F.when(p["order"] == k, F.date_format(new, f)) for k, f in forms.items()]))
        return refill(value, wide)

    return _let(date_parts(value), body)


def ipv4(value: Column, key: str) -> Column:
    """An address as another: two bytes moved by the other two, in turn."""

    def body(p: Column) -> Column:
        n = lambda i: F.element_at(p, i).cast("long")
        low, high = feistel(n(3) * 256 + n(4), n(1) * 256 + n(2), F.lit(65536), F.lit(65536), key, F.lit("ipv4"))
        return F.concat_ws(".", F.floor(high / 256), F.pmod(high, F.lit(256)), F.floor(low / 256), F.pmod(low, F.lit(256)))

    return _let(F.split(value, r"\."), body)


def ssn(value: Column, key: str) -> Column:
    """A number as another that can have been issued: area 001 to 899 without 666, group and serial not all zeros."""

    def body(d: Column) -> Column:
        area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        rank = (area - 1 - (area > 666).cast("long")) * 99 + group - 1
        low, high = feistel(serial - 1, rank, F.lit(9999), F.lit(898 * 99), key, F.lit("ssn"))
        new_area = F.floor(high / 99) + 1
        new_area = new_area + (new_area > 665).cast("long")
        parts = ((new_area, 3), (F.pmod(high, F.lit(99)) + 1, 2), (low + 1, 4))
        return F.concat(*[F.lpad(x.cast("long").cast("string"), n, "0") for x, n in parts])

    return refill(value, _let(digits_of(value), body))


def phone(value: Column, key: str) -> Column:
    """A number as another with its country code and punctuation."""
    code = digits_of(F.regexp_extract(value, r"^(\+[0-9]{1,3})(?=[ .(-])", 1))
    return refill(value, F.concat(code, permute_digits(F.substr(digits_of(value), F.length(code) + 1), key, F.concat(F.lit("phone"), code))))


def token(value: Column, key: str, kind: str) -> Column:
    """A value without an arithmetic format: characters drawn from a keyed digest, each of the class it replaces."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256)

    def swap(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(F.sha2(F.concat_ws("|", digest, i), 256), 1, 8), 16, 10).cast("long")
        pick = lambda letters: F.substring(F.lit(letters), (F.pmod(n, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def email(value: Column, key: str) -> Column:
    """An address with both parts before its last dot replaced, so equal hosts stay equal."""
    local, host, top = (F.regexp_extract(value, r"^(.*)@(.*)(\.[^.]*)$", i) for i in (1, 2, 3))
    return F.concat(token(local, key, "mailbox"), F.lit("@"), token(host, key, "host"), top)


def secret(value: Column, key: str) -> Column:
    return F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), token(F.substr(value, F.lit(5)), key, "secret"))).otherwise(token(value, key, "secret"))


def _valid(kind: str, value: Column) -> Column:
    """Whether what a pattern found is what it looks like."""
    d = digits_of(value)
    if kind == "card":
        return (F.pmod(luhn_sum(d, 1), F.lit(10)) == 0) & ~d.rlike("^0+$")
    if kind == "iban":
        v = F.replace(value, F.lit(" "), F.lit(""))
        digits = F.length(digits_of(F.substr(v, F.lit(5))))
        return (mod97(_iban_numbers(F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4)))) == 1) & (F.length(v) >= 15) & digits.between(1, 30)
    if kind == "date":
        day = date_parts(value)["day"]
        return F.coalesce(day.between("1700-01-01", "2099-12-31"), F.lit(False))
    if kind == "ipv4":
        return F.forall(F.split(value, r"\."), lambda p: (p.cast("int") <= 255) & ((F.length(p) == 1) | ~p.startswith("0")))
    if kind == "ssn":
        return ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    if kind == "phone":
        return F.length(d).between(7, 15)
    return F.lit(True)


def _valid_of_run(kind: str, text: Column) -> Column:
    """The valid numbers of a text, longest first: at each place one of the country's own length, else the longest valid one."""

    def best(run: Column) -> Column:
        all_ = F.filter(F.array(*[F.regexp_extract(run, p, 1) for p in LENGTHS[kind]]), lambda v: (v != "") & _valid(kind, v))
        if kind == "card":
            return F.get(all_, F.lit(0))
        sizes = F.create_map(*[F.lit(x) for pair in IBAN_SIZES.items() for x in pair])
        own = F.filter(all_, lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))) == F.try_element_at(sizes, F.substring(v, 1, 2)))
        return F.coalesce(F.get(own, F.lit(0)), F.get(all_, F.lit(0)))

    found = F.filter(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(RUNS[kind]), F.lit(1))), best), lambda v: v.isNotNull())
    by_length = F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(found), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))), lambda x: x["v"])
    return F.when(text.rlike(RUNS[kind]), F.coalesce(F.nullif(F.array_join(by_length, "|"), F.lit("")), F.lit("(?!)"))).otherwise("(?!)")


_SWAPS = {"email": email, "secret": secret, "iban": iban, "date": date, "ipv4": ipv4, "ssn": ssn, "phone": phone, "card": card}


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces personal data in a text column; adds pii (array of kind, value, pseudonym in order of place).

    Numbers and dates are validated (Luhn, modulo 97, calendar, ranges); what
    fails stays as it is. A valid one becomes another valid one of its format
    by a Feistel network keyed with `key`: a permutation, so equal values keep
    equal pseudonyms in all documents and different ones differ. What has no
    arithmetic (mail addresses, access keys, passwords) gets keyed characters
    of the same classes. Null texts stay null with a null list, other texts
    without findings stay as they are, repeated rows are treated alike, an
    existing pii column is kept and the new one gets an underscore.

    A card or account number may be followed by digits or letters of something
    else, so each length that ends a group is tried at each place where one
    may begin, and a text's expression holds its own valid numbers. One
    regular expression finds all kinds in one pass over the whole text;
    the text is then split at the marks it leaves, and every second part is
    looked at. No shuffle.
    """
    found, parts = columns_free_of(docs, "pii", "_parts")
    raw = safe = F.col(text).cast("string")
    for own, kept in KEPT.items():
        safe = F.replace(safe, F.lit(own), F.lit(kept))
    safe = F.when(raw.rlike(f"[{MARK}{BETWEEN}{ESCAPE}]"), safe).otherwise(raw)
    every, pieces = "|".join(f"({p})" for p in PATTERNS.values()), []
    for kind in RUNS:
        before, every = every.split("VALID", 1)
        pieces += [F.lit(before), _valid_of_run(kind, safe)]
    every = F.concat(*pieces, F.lit(every))
    marked = F.regexp_replace(safe, every, F.lit(MARK + BETWEEN.join(f"${i + 1}" for i in range(len(PATTERNS))) + MARK))

    def plain(c: Column) -> Column:
        back = c
        for own, kept in reversed(KEPT.items()):
            back = F.replace(back, F.lit(kept), F.lit(own))
        return F.when(c.contains(ESCAPE), back).otherwise(c)

    def look(value: Column, group: Column) -> Column:
        """kind (null where the value is not valid), value and pseudonym of what a group of the pattern found."""
        kind, new = F.lit(None).cast("string"), value
        for i, name in enumerate(PATTERNS):
            fits = F.when(group == i + 1, _valid(name, value)).otherwise(False)
            kind = F.when(fits, F.lit(name)).otherwise(kind)
            new = F.when(fits, _SWAPS[name](value, key)).otherwise(new)
        return F.struct(kind.alias("kind"), value.alias("value"), new.alias("pseudonym"))

    def part(c: Column, i: Column) -> Column:
        groups = F.split(c, BETWEEN)
        hit = look(F.array_join(groups, ""), F.array_position(F.transform(groups, lambda g: g != ""), F.lit(True)))
        none = F.struct(F.lit(None).cast("string").alias("kind"), c.alias("value"), plain(c).alias("pseudonym"))
        return F.when(F.pmod(i, F.lit(2)) == 1, hit).otherwise(none)

    split = docs.withColumn(parts, F.transform(F.split(marked, MARK), part))
    hits = F.filter(parts, lambda p: p["kind"].isNotNull())
    return split.withColumns({found: hits, text: F.array_join(F.transform(parts, lambda p: p["pseudonym"]), "")}).drop(parts)
