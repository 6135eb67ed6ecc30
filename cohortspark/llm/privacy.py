"""Format-preserving pseudonyms for personal data, in Spark's own functions.

Numbers, dates, addresses and keys are found by one pattern, validated, and permuted inside
their format by a keyed Feistel network: the symbols of a value (digits, letters, octets, or
the parts of a number whose range is restricted) are split in two halves, and each round adds
a keyed hash of one half to the other, symbol by symbol, modulo each symbol's own range. That
is a permutation of the format, so a value gets the same pseudonym in every document and two
values never share one. Check digits are computed anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind and pattern, tried in this order at each place
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{8,}+",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
}
ANY = "|".join(PATTERNS.values())
#: digits with single spaces or hyphens, 13 or more: cards are looked for in what the patterns leave
RUN = r"(?<!\d)(?=\d(?:[ -]?\d){12})\d++(?:[ -]\d++)*+"
_GROUPED = r"^(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1){2,3}\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})$"  # how cards are written
#: fixed values: telephone country codes of one and two digits; all others have three
_COUNTRY = r"^\+(?:1|7|20|27|3[0-4]|36|39|4[01]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-5]|98|\d{1,3})"
_CHUNK = 256  # symbols of one network: its cost grows with their square
HINT = "[0-9@=:]|AKIA"  # every pattern needs one of these: most texts have none and are passed by quickly

_EPOCH, _A, _B = "1900-01-01", 17, 4297  # 17 * 4297 days: 1900-01-01 to 2099-12-31


def _longs(*values: Column) -> Column:
    return F.array(*[v.cast("long") for v in values])


def _limits(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in the plan once, and is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, ranges: Column, key: str, kind: str | Column, rounds: int = ROUNDS) -> Column:
    """Permute an array of symbols, each below its own range."""
    def shifted(half: Column, other: Column, sizes: Column, round_: Column) -> Column:
        base = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), F.array_join(other.cast("array<string>"), ","))
        place = F.transform(half, lambda v, j: F.struct(v.alias("v"), j.alias("j")))
        noise = lambda b, j: F.conv(F.substring(F.sha2(F.concat_ws("#", b, j.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
        return let(base, lambda b: F.zip_with(place, sizes, lambda a, n: F.pmod(a["v"] + noise(b, a["j"]), n)))

    def step(s: Column, i: Column) -> Column:  # the half that was added is added to next
        return F.struct(shifted(s["r"], s["l"], s["nr"], i).alias("l"), s["l"].alias("r"), s["nr"].alias("nl"), s["nl"].alias("nr"))

    def network(x: Column) -> Column:
        half = F.floor(F.size(x["v"]) / 2).cast("int")
        lo = lambda c: F.slice(x[c], F.lit(1), half)
        hi = lambda c: F.slice(x[c], half + 1, F.size(x["v"]))
        start = F.struct(lo("v").alias("l"), hi("v").alias("r"), lo("n").alias("nl"), hi("n").alias("nr"))
        first, last = ("l", "r") if rounds % 2 == 0 else ("r", "l")
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: F.concat(s[first], s[last]))

    return let(F.struct(values.alias("v"), ranges.alias("n")), network)


def permuted_text(text: Column, key: str, kind: str | Column) -> Column:
    """Permute the ASCII letters and digits of a string, each within its own alphabet."""
    def base(code: Column) -> Column:
        return (F.when(code.between(48, 57), 48).when(code.between(65, 90), 65).when(code.between(97, 122), 97).otherwise(code))

    def size(code: Column) -> Column:
        return F.when(code.between(48, 57), 10).when(code.between(65, 90) | code.between(97, 122), 26).otherwise(1).cast("long")

    def moved(chars: Column) -> Column:
        values = F.transform(chars, lambda c: (F.ascii(c) - base(F.ascii(c))).cast("long"))
        new = feistel(values, F.transform(chars, lambda c: size(F.ascii(c))), key, kind)
        return F.array_join(F.zip_with(chars, new, lambda c, v: F.when(size(F.ascii(c)) == 1, c).otherwise(F.char(base(F.ascii(c)) + v))), "")

    return let(text, lambda t: F.when(F.length(t) > 0, let(F.split(t, ""), moved)).otherwise(t))


def spelled(text: Column, key: str, kind: str | Column) -> Column:
    """Permute letters and digits without what stands between them: spellings of one value stay linked."""
    other = "[^A-Za-z0-9]"

    def poured(t: Column, w: Column) -> Column:
        place = lambda j: F.length(F.regexp_replace(F.substring(t, F.lit(1), j + 1), other, ""))
        return F.array_join(F.transform(F.split(t, ""), lambda c, j: F.when(c.rlike(other), c).otherwise(F.substring(w, place(j), F.lit(1)))), "")

    return let(text, lambda t: let(permuted_text(F.regexp_replace(t, other, ""), key, kind), lambda w: poured(t, w)))


def _cased(text: Column, lower: Column) -> Column:
    """The capitals of ``text`` at the same places of ``lower``."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(lower, ""), lambda c, n: F.when(F.ascii(c).between(65, 90), F.upper(n)).otherwise(n)), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(payload: Column) -> Column:
    """The check digit of a string of digits."""
    weighed = F.transform(F.split(F.reverse(payload), ""), lambda c, j: F.when(j % 2 == 1, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.pmod(10 - F.aggregate(weighed, F.lit(0), lambda acc, v: acc + v) % 10, F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals (A is 10) by 97."""
    code = lambda c: F.ascii(c)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(code(c) < 58, (acc * 10 + code(c) - 48) % 97).otherwise((acc * 100 + code(c) - 55) % 97))


def _card(m: Column, key: str) -> Column:
    body = spelled(F.substring(m, F.lit(2), F.length(m) - 2), key, "card")
    return let(body, lambda w: F.concat(F.substring(m, 1, 1), w, luhn(F.concat(F.substring(m, 1, 1), _digits(w)))))


def _run_cards(run: Column, key: str) -> Column:
    """(text, n): a run of groups of digits with the cards in it permuted, and their number.

    A card is 13 to 19 digits of whole groups with a right check digit. At the beginning of the
    run and behind a card its grouping is free, elsewhere it must be grouped as cards are. The
    longest one from the leftmost place is taken.
    """
    bare = lambda w: F.regexp_replace(w, "^[ -]", "")

    def card(w: Column) -> Column:
        return let(_digits(w), lambda digits: (
            F.when(~F.length(digits).between(13, 19) | ~digits.rlike("[1-9]"), False)
            .otherwise(F.substring(digits, -1, 1) == luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)))))

    def permuted(groups: Column) -> Column:
        text = lambda at, n: F.array_join(F.slice(groups, at, n), "")

        def places(i: Column) -> Column:
            sizes = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1)), lambda n: card(text(i, n)))
            return F.struct(i.alias("at"), F.transform(sizes, lambda n: F.struct(n.alias("n"), bare(text(i, n)).rlike(_GROUPED).alias("grouped"))).alias("cards"))

        def step(state: Column, x: Column) -> Column:
            some = F.filter(x["cards"], lambda c: (x["at"] == state["next"]) | c["grouped"])
            n = F.when(x["at"] >= state["next"], F.array_max(F.transform(some, lambda c: c["n"])))
            return let(n, lambda n: F.struct(
                F.coalesce(x["at"] + n, state["next"]).alias("next"),
                F.when(n.isNotNull(), F.concat(state["taken"], F.array(F.struct(state["next"].alias("prev"), x["at"].alias("at"), n.alias("n")))))
                .otherwise(state["taken"]).alias("taken")))

        def moved(c: Column) -> Column:
            return F.concat(text(c["prev"], c["at"] - c["prev"]), let(text(c["at"], c["n"]), lambda w: F.concat(
                F.regexp_extract(w, "^[ -]?", 0), let(bare(w), lambda m: _card(m, key)))))

        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<prev:int,at:int,n:int>>").alias("taken"))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.size(groups)), places), start, step, lambda s: F.struct(
            F.concat(F.array_join(F.transform(s["taken"], moved), ""), text(s["next"], F.size(groups))).alias("text"), F.size(s["taken"]).alias("n")))

    return let(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0)), permuted)


def _cards(text: Column, key: str) -> Column:
    """(text, n): a text with its cards permuted, and their number."""
    pieces = F.zip_with(F.split(text, RUN), F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: _run_cards(r, key)), lambda rest, r: F.struct(
        F.concat(rest, F.coalesce(r["text"], F.lit(""))).alias("text"), F.coalesce(r["n"], F.lit(0)).alias("n")))
    joined = lambda x: F.struct(F.array_join(F.transform(x, lambda p: p["text"]), "").alias("text"),
                                F.aggregate(x, F.lit(0), lambda acc, p: acc + p["n"]).alias("n"))
    return F.when(text.rlike(RUN), let(pieces, joined)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def _iban(m: Column, key: str) -> Column:
    """The longest beginning of whole groups that is valid; what follows it stays."""
    def valid(part: Column) -> Column:
        return let(F.regexp_replace(part, " ", ""), lambda whole: F.when(
            F.length(whole).between(15, 34), mod97(F.concat(F.substring(whole, F.lit(5), F.length(whole)), F.substring(whole, 1, 4))) == 1).otherwise(False))

    def moved(part: Column) -> Column:
        check = lambda body: 98 - mod97(F.concat(F.regexp_replace(body, " ", ""), F.substring(part, 1, 2), F.lit("00")))
        return let(spelled(F.substring(part, F.lit(5), F.length(part)), key, "iban"), lambda body: F.concat(
            F.substring(part, 1, 2), F.lpad(check(body).cast("string"), 2, "0"), body, F.substring(m, F.length(part) + 1, F.length(m))))

    def longest(groups: Column) -> Column:
        first = lambda n: F.array_join(F.slice(groups, F.lit(1), n), " ")
        best = F.array_max(F.filter(F.sequence(F.lit(1), F.size(groups)), lambda n: valid(first(n))))
        return let(best, lambda n: F.when(n.isNotNull(), let(first(n), moved)))

    return F.coalesce(let(F.split(m, " "), longest), m)


def _date(m: Column, key: str) -> Column:
    """Day-first and year-first dates move through the whole range; month-first ones within what stays month-first."""
    day_first = F.coalesce(*[F.try_to_date(m, p) for p in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")])
    month_first = F.coalesce(*[F.try_to_date(m, p) for p in ("MM.dd.yyyy", "MM/dd/yyyy")])  # only what is no day-first date: its day is over 12

    def permuted(x: Column) -> Column:
        n = F.datediff(x["d"], F.lit(_EPOCH).cast("date"))
        year, month = F.year(x["e"]), F.month(x["e"]) - 1
        early = F.dayofmonth(x["e"]) <= 28
        leap = (F.month(x["e"]) == 2) & ~early  # 49 leap years from 1904 to 2096
        by_day = x["d"].isNotNull()
        values = (F.when(by_day, _longs(F.floor(n / _B), n % _B)).when(leap, _longs(F.floor((year - 1904) / 28), (year - 1904) / 4 % 7))
                  .when(early, _longs(year - 1900, month)).otherwise(_longs(F.floor((year - 1900) / 20), (year - 1900) % 20)))
        limits = F.when(by_day, _limits(_A, _B)).when(leap, _limits(7, 7)).when(early, _limits(200, 12)).otherwise(_limits(10, 20))

        def written(s: Column) -> Column:
            day = F.date_add(F.lit(_EPOCH).cast("date"), (s[0] * _B + s[1]).cast("int"))
            named = F.concat(F.lpad((F.when(early, s[1]).otherwise(month) + 1).cast("string"), 2, "0"), F.substring(m, 3, 4),
                             (F.when(early, s[0]).otherwise(s[0] * 20 + s[1]) + 1900).cast("string"))
            return (F.when(by_day, F.when(m.rlike("^[0-9]{4}"), F.date_format(day, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(day, "dd/MM/yyyy"))
                           .otherwise(F.date_format(day, "dd.MM.yyyy")))
                    .when(leap, F.concat(F.substring(m, 1, 6), ((s[0] * 7 + s[1]) * 4 + 1904).cast("string"))).otherwise(named))

        inside = F.when(by_day, n.between(0, _A * _B - 1)).otherwise(x["e"].isNotNull() & year.between(1900, 2099))
        return F.when(inside, let(feistel(values, limits, key, "date"), written)).otherwise(m)

    return let(F.struct(day_first.alias("d"), month_first.alias("e")), permuted)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    moved = feistel(_longs(area - 1 - (area > 666).cast("int"), group - 1, serial - 1), _limits(898, 99, 9999), key, "ssn")
    new = lambda s: s[0] + 1 + (s[0] >= 665).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(moved, lambda s: F.concat_ws("-", F.lpad(new(s).cast("string"), 3, "0"), F.lpad((s[1] + 1).cast("string"), 2, "0"),
                                                          F.lpad((s[2] + 1).cast("string"), 4, "0")))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    return F.when(F.length(_digits(m)).between(7, 15), let(F.regexp_extract(m, _COUNTRY, 0), lambda country: F.concat(
        country, spelled(F.substring(m, F.length(country) + 1, F.length(m)), key, "phone")))).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    """Each octet keeps its number of digits."""
    low = lambda o: F.when(F.length(o) == 3, 100).when(F.length(o) == 2, 10).otherwise(0).cast("long")

    def moved(octets: Column) -> Column:
        size = F.transform(octets, lambda o: F.when(F.length(o) == 3, 156).when(F.length(o) == 2, 90).otherwise(10).cast("long"))
        new = feistel(F.transform(octets, lambda o: o.cast("long") - low(o)), size, key, "ip")
        return F.array_join(F.zip_with(octets, new, lambda o, v: (v + low(o)).cast("string")), ".")

    return let(F.split(m, r"\."), moved)


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def moved(top: Column) -> Column:
        name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
        parts = F.array(*[F.struct(x.alias("text"), F.lit(kind).alias("kind")) for x, kind in ((local, "local"), (name, "domain"))])
        folded = F.transform(parts, lambda x: _cased(x["text"], _after(F.lower(x["text"]), "^", key, x["kind"])))
        return F.concat(F.array_join(folded, "@"), F.lit("."), top)

    return let(F.substring_index(domain, ".", -1), moved)


def _after(m: Column, prefix: str, key: str, kind: str | Column) -> Column:
    """``m`` permuted behind its prefix, in equal chunks if it is long."""
    def moved(kept: Column) -> Column:
        n = F.length(m) - F.length(kept)
        chunks = F.ceil(n / _CHUNK).cast("int")
        at = lambda i: F.floor(i * n.cast("long") / chunks).cast("int")
        part = lambda i: F.substring(m, F.length(kept) + at(i) + 1, at(i + 1) - at(i))
        named = lambda i: F.when(i == 0, F.lit(kind)).otherwise(F.concat(F.lit(kind), i.cast("string")))
        return F.concat(kept, F.array_join(F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: permuted_text(part(i), key, named(i))), ""))

    return let(F.regexp_extract(m, prefix, 0), moved)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that does not validate stays as it is."""
    made = {
        "email": _email(m, key), "secret": _after(m, r"^[^=:]*[=:]\s{0,3}[\"']?", key, "secret"), "key": _after(m, "^AKIA", key, "key"),
        "iban": _iban(m, key), "date": _date(m, key), "ssn": _ssn(m, key), "phone": _phone(m, key), "ip": _ip(m, key),
    }
    out = m
    for kind, pattern in list(PATTERNS.items())[::-1]:
        out = F.when(m.rlike(f"^(?:{pattern})$"), made[kind]).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; all rows and columns stay.

    Found are e-mail addresses (name and domain apart, the top level stays), passwords and
    tokens after their keyword, access keys, IBAN and payment card numbers with right check
    digits, valid dates from 1900 to 2099, valid social security numbers, telephone numbers
    of 7 to 15 digits (the country code stays) and IPv4 addresses. Cards, IBANs and telephone
    numbers are linked however they are spaced, e-mail addresses in capitals or not. IPv6
    addresses and bare ten-digit numbers are not looked for. The rest of the text is
    unchanged, a null text stays null. ``count_col`` adds the number of values replaced.
    Whoever holds ``key`` can reverse the permutation.
    """
    text = F.col(text_col).cast("string")
    cards = text.rlike(RUN)
    has = text.rlike(HINT) & (text.rlike(ANY) | cards)
    names = ["found", "parts", "pieces"]  # columns of their own: each is computed once
    while set(names) & set(docs.columns):
        names = [f"{n}_" for n in names]
    found, parts, pieces = names
    rows = docs.withColumns({found: F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), parts: F.when(has, F.split(text, ANY))})
    own = lambda t, n: F.struct(t.alias("text"), F.lit(n).alias("n"))
    value = lambda m: let(pseudonym(m, key), lambda p: F.when(p != m, own(p, 1)).otherwise(own(m, 0)))
    between = F.transform(parts, lambda p: own(p, 0))
    rows = rows.withColumn(pieces, F.flatten(F.zip_with(between, F.transform(found, value), lambda a, b: F.filter(F.array(a, b), lambda x: x.isNotNull()))))
    # cards: in what lies between the values, and in values that did not validate
    rows = rows.withColumn(pieces, F.when(cards, F.transform(pieces, lambda x: F.when(x["n"] == 1, x).otherwise(_cards(x["text"], key)))).otherwise(F.col(pieces)))
    joined = F.array_join(F.transform(pieces, lambda x: x["text"]), "")
    out = {text_col: F.when(F.col(found).isNotNull(), joined).otherwise(text)}
    if count_col:
        changed = F.aggregate(pieces, F.lit(0), lambda acc, x: acc + x["n"])
        out[count_col] = F.when(F.col(found).isNotNull(), changed).otherwise(0).cast("long")
    return rows.withColumns(out).drop(*names)
