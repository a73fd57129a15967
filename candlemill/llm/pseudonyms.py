"""PII: format-preserving pseudonyms, in DataFrame operations only.

Values that pass validation are permuted within their format by a keyed Feistel network: a card number becomes
another valid card number, a date another date, and equal values become equal ones in every document, so records
stay linked, and different ones different ones. The key is a literal of the query: plans and event logs that show it are to be kept as
closely as the key itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WALK = 24
# Dates from 1900-01-01 to 2099-12-31. The halves of the network need a product, which is a little more.
DAYS, DAY_HALVES = 73_049, (340, 215)


def _fours(sep: str) -> str:
    """Four or more groups of four digits, and a last one of three, short of a year-first date or a number that goes on."""
    four, date = "[0-9]{4}(?![0-9])", r"[0-9]{4}[/\-][0-9]{2}[/\-][0-9]{2}(?![0-9])"
    return rf"[0-9]{{4}}(?:{sep}{four}){{3}}(?:{sep}(?!{date}){four})*+(?:{sep}[0-9]{{3}}(?![0-9]|[./\-][0-9]))?"


# How cards are written. Other groupings are taken too, but never into a card in one of these forms, a date or an address.
_CARD = "|".join(["[0-9]{13,19}(?![0-9])", *(x for sep in (" ", r"\-") for x in (
    _fours(sep), rf"[0-9]{{4}}{sep}[0-9]{{6}}{sep}[0-9]{{4,5}}(?![0-9])"))])
_LOCAL = r"[\p{L}0-9._%+\-]"
KINDS = {  # in this order, where two could match
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.)++[A-Za-z]{{2,}}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![0-9A-Za-z])",
    "date": r"(?<![0-9./\-])(?:(?:19|20)[0-9]{2}([/\-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9/\-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": rf"(?<![0-9])(?:{_CARD}|[0-9](?:(?![ \-](?:{_CARD}|[0-9]{{1,4}}[./][0-9]))[ \-]?[0-9]){{12,18}}(?![0-9]))",
}
DATE_FORMS = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{4}/": "yyyy/MM/dd", r"^[0-9]{2}\.": "dd.MM.yyyy"}
LETTERS = [(48, 57), (97, 122), (65, 90), (0xE0, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE)]
HEX_LETTERS = [(48, 57), (97, 102), (65, 70)]


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used (lambdas would repeat it)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: str) -> Column:
    """struct(l, r): a permutation of the pairs below (left_size, right_size). Odd and even rounds add a keyed hash of
    one half to the other."""
    def step(state, i):
        even = i % 2 == 0
        half = F.when(even, state["r"]).otherwise(state["l"])
        size = F.when(even, left_size).otherwise(right_size)
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), left_size.cast("string"), right_size.cast("string"), i.cast("string"), half.cast("string")), 256)
        add = _number(F.substring(digest, 1, 15)) % size
        return F.struct(
            F.when(even, (state["l"] + add) % size).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise((state["r"] + add) % size).alias("r"))

    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 36 digits to another of the same length."""
    def halves(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        out = feistel(F.substring(d, F.lit(1), h), F.substring(d, h + 1, n - h), _pow10(h), _pow10(n - h), key, tweak)
        return let(out, lambda x: F.concat(F.lpad(x["l"].cast("string"), h, "0"), F.lpad(x["r"].cast("string"), n - h, "0")))

    return let(digits, halves)


def _shift(char: Column, by: Column, ranges: list[tuple[int, int]]) -> Column:
    code, out = F.ascii(char), char
    for low, high in ranges:
        out = F.when(code.between(low, high), F.char(F.lit(low) + (code - low + by) % (high - low + 1))).otherwise(out)
    return out


def permute_letters(text: Column, key: str, tweak: str, ranges=LETTERS) -> Column:
    """A string to another with the same kind of character in each place; what is in no range stays."""
    n = F.length(text)
    h = F.floor(n / 2).cast("int")

    def moved(x: Column, digest: Column) -> Column:
        one = lambda i: _shift(
            F.substring(x, i, F.lit(1)), _number(F.substring(digest, (i - 1) % 32 * 2 + 1, F.lit(2))).cast("int"), ranges)
        return F.when(F.length(x) == 0, x).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), ""))

    def step(state, i):
        even = i % 2 == 0
        half = F.when(even, state["r"]).otherwise(state["l"])
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), n.cast("string"), i.cast("string"), half), 256)
        changed = let(digest, lambda d: moved(F.when(even, state["l"]).otherwise(state["r"]), d))
        return F.struct(F.when(even, changed).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(changed).alias("r"))

    begin = F.struct(F.substring(text, F.lit(1), h).alias("l"), F.substring(text, h + 1, n - h).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)
    return let(out, lambda x: F.concat(x["l"], x["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits``, one after the other."""
    def one(i):
        char = F.substring(text, i, F.lit(1))
        return F.when(char.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(text, F.lit(1), i))), F.lit(1))).otherwise(char)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10, the last digit being the check digit: 0 if it is right."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _card(m: Column, key: str) -> Column:
    def permuted(digits: Column, written: Column) -> Column:
        body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        whole = let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return let(whole, lambda w: _refill(written, w))

    def parts(groups: Column) -> Column:
        """Each four groups that are a card, from the left; groups beside them stay."""
        sep = F.substring(m, 5, 1)

        def step(state, i):
            four = F.slice(groups, i + 1, F.lit(4))
            joined = F.array_join(four, "")
            card = (F.length(joined) == 16) & (luhn_sum(joined) == 0)
            now = F.when(card, permuted(joined, F.concat(*(x for k in range(4) for x in ((sep,) if k else ()) + (F.get(four, F.lit(k)),))))).otherwise(F.get(groups, i))
            return F.when(state["wait"] > 0, F.struct(state["out"].alias("out"), (state["wait"] - 1).alias("wait"))).otherwise(
                F.struct(F.concat(state["out"], sep, now).alias("out"), F.when(card, 3).otherwise(0).alias("wait")))

        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("wait"))
        return F.substring(F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), begin, step, lambda x: x["out"]), F.lit(2), F.length(m))

    def checked(digits: Column) -> Column:
        valid = F.length(digits).between(13, 19) & (luhn_sum(digits) == 0)
        return F.when(valid, permuted(digits, m)).otherwise(m)

    fours = m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3,}(?:[ -][0-9]{3})?$")
    found = F.when(fours, let(F.split(m, "[ -]"), parts)).otherwise(m)
    return let(found, lambda x: F.when(x != m, x).otherwise(let(_digits(m), checked)))


def _phone(m: Column, key: str) -> Column:
    def permuted(digits: Column) -> Column:  # a country code stays
        own = permute_digits(F.substring(digits, F.length(digits) - 9, F.lit(10)), key, "phone")
        return let(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), own), lambda d: _refill(m, d))

    return let(_digits(m), permuted)


def walk(start: Column, again: Callable[[Column], Column], right: Callable[[Column], Column]) -> Column:
    """A permutation of more values than there are right ones, taken until it comes to a right one: that permutes these
    among themselves. Where at least 85 in 100 are right, ``WALK`` steps fall short once in 10^19 values."""
    step = lambda x, i: F.when((i > 0) & right(x), x).otherwise(again(x))
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), start, step)


def _ssn(m: Column, key: str) -> Column:
    def real(d: Column) -> Column:
        area = F.substring(d, 1, 3)
        return ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")

    moved = lambda d: let(walk(d, lambda x: permute_digits(x, key, "ssn"), real), lambda x: _refill(m, x))
    return let(_digits(m), lambda d: F.when(real(d), moved(d)).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    def permuted(octets: Column) -> Column:
        half = lambda i: F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1))
        out = feistel(half(0), half(2), _lit(65536), _lit(65536), key, "ip")
        text = let(out, lambda x: F.concat_ws(".", *(
            (F.floor(x[side] / 256) if high else x[side] % 256).cast("string") for side in ("l", "r") for high in (True, False))))
        return F.when(F.array_max(octets) <= 255, text).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), permuted)


def _date(m: Column, key: str) -> Column:
    """Dates that can be read in one way are permuted by their day, alike in every form with points or the year first.
    With slashes, a date that can be read both ways becomes another such, whichever was meant, and one that can
    be read in one way another that can only be read so: results say which class they came from, so no two dates meet."""
    first, (a, b) = F.to_date(F.lit("1900-01-01")), DAY_HALVES
    form = F.lit(None).cast("string")
    for start, name in DATE_FORMS.items():
        form = F.when(m.rlike(start), F.lit(name)).otherwise(form)
    pair = lambda d: F.struct(F.floor(d / b).alias("l"), (d % b).alias("r"))
    number = lambda x: x["l"] * b + x["r"]
    moved = lambda d: walk(pair(d), lambda x: feistel(x["l"], x["r"], _lit(a), _lit(b), key, "date"), lambda x: number(x) < DAYS)
    day = lambda f: F.datediff(F.try_to_timestamp(m, f).cast("date"), first).cast("long")
    other = let(form, lambda f: let(day(f), lambda d: F.when(
        d.between(0, DAYS - 1), F.call_function("date_format", let(moved(d), lambda x: F.date_add(first, number(x).cast("int"))), f)).otherwise(m)))
    part = lambda at, n: F.substring(m, at, n).cast("long")
    slashed = m.rlike("^[0-9]{2}/[0-9]{2}/")
    pieces = F.when(slashed, F.struct(part(1, 2).alias("x"), part(4, 2).alias("y"), (part(7, 4) - 1900).alias("year")))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    written = lambda x, y, year: F.concat(two(x), F.lit("/"), two(y), F.lit("/"), (year + 1900).cast("string"))

    def either(p: Column) -> Column:
        out = feistel((p["x"] - 1) * 12 + p["y"] - 1, p["year"], _lit(144), _lit(200), key, "date either way")
        return let(out, lambda o: written(F.floor(o["l"] / 12) + 1, o["l"] % 12 + 1, o["r"]))

    def there(o: Column) -> Column:
        """Whether a month has the day (13 to 31) that a pair stands for."""
        day, month, year = F.floor(o["l"] / 12) + 13, o["l"] % 12 + 1, o["r"] + 1900
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        return day <= F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)

    def one_way(p: Column) -> Column:
        day_first = p["x"] > 12
        day, month = F.greatest(p["x"], p["y"]), F.least(p["x"], p["y"])
        begin = F.struct(((day - 13) * 12 + month - 1).alias("l"), p["year"].alias("r"))
        out = walk(begin, lambda o: feistel(o["l"], o["r"], _lit(228), _lit(200), key, "date one way"), there)
        told = lambda o: (F.floor(o["l"] / 12) + 13, o["l"] % 12 + 1)
        moved = let(out, lambda o: F.when(day_first, written(*told(o), o["r"])).otherwise(written(*reversed(told(o)), o["r"])))
        return F.when(month.between(1, 12) & day.between(13, 31) & there(begin), moved).otherwise(m)

    both = lambda p: p["x"].between(1, 12) & p["y"].between(1, 12)
    return F.when(slashed, let(pieces, lambda p: F.when(both(p), either(p)).otherwise(one_way(p)))).otherwise(other)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_letters(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    return permute_letters(m, key, "secret", HEX_LETTERS)


PERMUTE: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "date": _date, "phone": _phone, "ip": _ip, "ssn": _ssn, "card": _card}


def pattern() -> str:
    """All kinds as alternatives; the back references of each count within it."""
    out, groups = [], 0
    for source in KINDS.values():
        own = source.count(r"([/")
        for i in range(own, 0, -1):
            source = source.replace(f"\\{i}", f"\\{i + groups}")
        out.append(source)
        groups += own
    return "|".join(out)


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match; a match that fails validation comes back as it is."""
    result = match
    for kind in reversed(list(KINDS)):
        result = F.when(match.rlike(f"^(?:{KINDS[kind]})$"), PERMUTE[kind](match, key)).otherwise(result)
    return result


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and n_pseudonyms, how many values were replaced.

    E-mail names, cards (Luhn), phone numbers, social security numbers, IPv4 addresses, dates and long hexadecimal
    secrets are replaced; look-alikes that fail validation stay. A null text stays null, with 0. Other columns
    come through; a column n_pseudonyms is replaced. Rows stay where they are. An empty table gives an empty result.
    """
    everything = pattern()
    own = "_found"
    while own in docs.columns:
        own += "_"
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(everything), F.lit(0))
    gaps = F.split(text, everything, -1)
    # texts with neither digits nor @ hold nothing to replace
    old = F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn(own, F.transform(old, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    there, new = F.size(own) > 0, F.col(own)["new"]
    whole = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(
        F.sequence(F.lit(1), F.size(own)), lambda i: F.concat(F.element_at(new, i), F.element_at(gaps, i + 1))), ""))
    changed = F.size(F.filter(own, lambda x: x["old"] != x["new"]))
    return (
        marked.withColumn("n_pseudonyms", F.coalesce(F.when(there, changed), F.lit(0)).cast("int"))
        .withColumn("text", F.when(there, whole).otherwise(text)).drop(own)
    )
