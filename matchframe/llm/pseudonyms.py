"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

A value that passes its format's check (Luhn digit, calendar, number plan, octet range) is written as a pair (L, R) in
Z_a x Z_b and permuted by a keyed Feistel network whose rounds add a SHA-256 value of one half to the other, modulo a or
b in turn. That is a bijection of the format: equal values get equal pseudonyms in all documents, different values get
different ones, and a pseudonym passes the same check. Numbers that fail their check stay as they are. Mail addresses
have no such format; their local part becomes a keyed digest, which links equal addresses too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "matchframe"
#: Month names (English, their short forms, German, French, Spanish), and country codes but +1.
MONTHS = """january february march april may june july august september october november december
jan feb mar apr may jun jul aug sep oct nov dec
januar februar märz april mai juni juli august september oktober november dezember
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre""".split()
_MONTH = "(?iu:" + "|".join(sorted(set(MONTHS), key=lambda w: (-len(w), w))) + r")\b\.?"
_DAY, _YEAR, _END = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:19|20)[0-9]{2}", "(?![0-9A-Za-z]|[./-][0-9])"
COUNTRY = "(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
KINDS = ("email", "ip", "phone", "ssn", "date", "card")
#: What a candidate of each kind looks like, tried in this order at every place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z.-])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
    rf"|(?<![0-9A-Za-z.+-])\+{COUNTRY}[ .-]?(?:\(0\)[ .-]?)?\(?[0-9]{{1,13}}\)?(?:[ ./-]\(?[0-9]{{1,13}}\)?){{0,6}}(?![0-9A-Za-z]|[.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12][0-9]|3[01])(?![0-9A-Za-z]|[./-][0-9])"
    rf"|(?<![0-9A-Za-z./-]){_DAY}(?<two>[-/.]){_DAY}\k<two>{_YEAR}{_END}"
    rf"|(?<![0-9A-Za-z./-]){_DAY}(?:st|nd|rd|th|er|\.)?(?: of| de)? {_MONTH},?(?: de| del)? {_YEAR}{_END}"
    rf"|(?<![0-9A-Za-z])(?<!\p{{L}}){_MONTH} {_DAY}(?:st|nd|rd|th)?,? {_YEAR}{_END}",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{2,7}){2,4})(?![0-9A-Za-z]|[ .-][0-9])",
}
#: Every candidate has an "@", three digits in a row, a country code or the start of a dotted quad; other texts are passed by.
HINT = r"@|[0-9]{3}|\+[2-9]|[0-9]\.[0-9]{1,3}\."
_GROUP = {k: p.replace(r"([-/.])", r"(?<mark>[-/.])").replace(r"\2", r"\k<mark>") for k, p in PATTERNS.items()}
ANY = "|".join(_GROUP[k] for k in KINDS)


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """The permuted pair as a struct (l, r) of longs, l below a and r below b."""
    def number(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def round_(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, (l + number(i, r)) % a).otherwise(l).alias("l"), F.when(even, r).otherwise((r + number(i, l)) % b).alias("r")
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    def one(i: Column) -> Column:
        c = m.substr(i, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), digits.substr(F.length(_digits(m.substr(F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum of a digit string; the digits at even or odd distance from the right are doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when((n - i) % 2 == doubled_from_right, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    nl = F.floor((n - 2) / 2).cast("int")
    nr = n - 2 - nl
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    first = d.substr(F.lit(1), F.lit(1))
    pair = feistel(d.substr(F.lit(2), nl), d.substr(nl + 2, nr), power(nl), power(nr), F.concat(F.lit("card"), n.cast("string"), first), key)
    body = F.concat(first, F.lpad(pair["l"].cast("string"), nl, F.lit("0")), F.lpad(pair["r"].cast("string"), nr, F.lit("0")))
    last = ((F.lit(10) - _luhn_sum(body, 0) % 10) % 10).cast("string")
    return _refill(m, F.concat(body, last))


def _national(m: Column) -> Column:
    """Digits of an international number after its country code and a "(0)"."""
    return _digits(F.regexp_replace(m, rf"^\+{COUNTRY}[ .-]?(?:\(0\))?", ""))


def _abroad(m: Column, key: str) -> Column:
    d, all_ = _national(m), _digits(m)
    n = F.length(d)
    nl = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    code = all_.substr(F.lit(1), F.length(all_) - n)
    tweak = F.concat(F.lit("abroad"), F.regexp_extract(m, rf"^\+({COUNTRY})", 1), F.lit("/"), n.cast("string"))
    pair = feistel(d.substr(F.lit(1), nl), d.substr(nl + 1, n - nl), power(nl), power(n - nl), tweak, key)
    return _refill(m, F.concat(code, F.lpad(pair["l"].cast("string"), nl, F.lit("0")), F.lpad(pair["r"].cast("string"), n - nl, F.lit("0"))))


def _phone(m: Column, key: str) -> Column:
    return F.when(m.rlike("^\\+[2-9]"), _abroad(m, key)).otherwise(_home(m, key))


def _home(m: Column, key: str) -> Column:
    d = _digits(m)
    ten = d.substr(F.length(d) - 9, F.lit(10))
    part = lambda at, n: ten.substr(F.lit(at), F.lit(n)).cast("long")
    pair = feistel((part(1, 3) - 200) * 800 + part(4, 3) - 200, part(7, 4), F.lit(640000), F.lit(10000), F.lit("phone"), key)
    l = pair["l"]
    new = F.concat((F.floor(l / 800) + 200).cast("string"), (l % 800 + 200).cast("string"), _pad(pair["r"], 4))
    return _refill(m, F.concat(d.substr(F.lit(1), F.length(d) - 10), new))


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    area = d.substr(F.lit(1), F.lit(3)).cast("long")
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    right = (d.substr(F.lit(4), F.lit(2)).cast("long") - 1) * 9999 + d.substr(F.lit(6), F.lit(4)).cast("long") - 1
    pair = feistel(left, right, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
    l, r = pair["l"], pair["r"]
    return _refill(m, F.concat(_pad(l + 1 + F.when(l >= 665, 1).otherwise(0), 3), _pad(F.floor(r / 9999) + 1, 2), _pad(r % 9999 + 1, 4)))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, "[.]")
    octet = lambda i: o[i].cast("long")
    pair = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    l, r = pair["l"], pair["r"]
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(l / 256), l % 256, F.floor(r / 256), r % 256)])


#: Dates of 1900-2099 are 17 x 4297 days.
_DAY_0, _DATE_A, _DATE_B = "1900-01-01", 17, 4297


_NUMERIC = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"
#: Steps in which a day is permuted until it is one of its kind; all but one in 10^25 values need fewer.
WALK = 64


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat(year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyyMMdd")).cast("date")


def _named(m: Column) -> tuple[Column, Column]:
    """The month's name as written, and its place in MONTHS from 0."""
    name = F.regexp_replace(F.regexp_extract(m, _MONTH, 0), "[.]", "")
    return name, F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)) - 1


def _readings(m: Column) -> tuple[Column, Column]:
    """A date of two fields and a year as its mark has it (day first with dots, else month first), and the other way."""
    a, b, year = (F.regexp_extract(m, _NUMERIC, k) for k in (1, 2, 3))
    dots = F.instr(m, ".") > 0
    return _made(year, F.when(dots, b).otherwise(a), F.when(dots, a).otherwise(b)), _made(year, F.when(dots, a).otherwise(b), F.when(dots, b).otherwise(a))


def _day(m: Column) -> Column:
    usual, other = _readings(m)
    by_name = _made(F.regexp_extract(m, "[0-9]{4}", 0), (_named(m)[1] % 12 + 1).cast("string"), F.regexp_extract(m, "(?<![0-9])[0-9]{1,2}(?![0-9])", 0))
    iso = F.try_to_timestamp(_digits(m), F.lit("yyyyMMdd")).cast("date")
    return F.when(m.rlike("^[0-9]{4}"), iso).when(m.rlike(_NUMERIC), F.coalesce(usual, other)).otherwise(by_name)


def _moved(day: Column, key: str) -> Column:
    n = F.datediff(day, F.lit(_DAY_0).cast("date"))
    pair = feistel(F.floor(n / _DATE_B), n % _DATE_B, F.lit(_DATE_A), F.lit(_DATE_B), F.lit("date"), key)
    return F.date_add(F.lit(_DAY_0).cast("date"), (pair["l"] * _DATE_B + pair["r"]).cast("int"))


def _date(m: Column, key: str) -> Column:
    """The permuted day in the layout of ``m``.

    A date that only the other reading makes valid has a day above 12; it is permuted on until its day is above 12 again,
    so that its pseudonym is read the same way and differs from all others.
    """
    plain = _refill(m, F.date_format(_moved(_day(m), key), "yyyyMMdd"))
    return F.when(m.rlike("^[0-9]{4}"), plain).when(m.rlike(_NUMERIC), _two_fields(m, key)).otherwise(_with_name(m, key))


def _two_fields(m: Column, key: str) -> Column:
    usual, other = _readings(m)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _moved(other, key), lambda acc, i: F.when(F.dayofmonth(acc) > 12, acc).otherwise(_moved(acc, key)))
    new = F.when(usual.isNotNull(), _moved(usual, key)).otherwise(walked)
    bare = m.rlike("^[0-9][-/.]|[-/.][0-9][-/.]")
    part = lambda k: F.when(bare, F.date_format(new, k)).otherwise(F.date_format(new, k * 2))
    mark = F.regexp_extract(m, "[-/.]", 0)
    day_first = (mark == ".") == usual.isNotNull()
    return F.concat(F.when(day_first, part("d")).otherwise(part("M")), mark, F.when(day_first, part("M")).otherwise(part("d")), mark, F.date_format(new, "yyyy"))


def _with_name(m: Column, key: str) -> Column:
    new = _moved(_day(m), key)
    name, at = _named(m)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), (at - at % 12 + F.month(new)).cast("int"))
    month = F.when(name == F.upper(name), F.upper(month)).when(name == F.lower(name), month).otherwise(F.initcap(month))
    day = F.when(m.rlike("(?<![0-9])0[0-9](?![0-9])"), F.date_format(new, "dd")).otherwise(F.date_format(new, "d"))
    n = F.dayofmonth(new)
    ending = F.when(n.isin(1, 21, 31), "st").when(n.isin(2, 22), "nd").when(n.isin(3, 23), "rd").otherwise("th")
    out = F.regexp_replace(F.regexp_replace(m, F.lit("[0-9]{4}"), F.date_format(new, "yyyy")), F.lit("(?<![0-9])[0-9]{1,2}(?![0-9])"), day)
    out = F.regexp_replace(F.regexp_replace(out, F.lit("(?<=[0-9])(?:st|nd|rd|th)"), ending), F.lit("(?<=[0-9])er"), F.when(n == 1, "er").otherwise(""))
    return F.regexp_replace(out, F.lit(_MONTH.removesuffix(r"\.?")), month)


def _email(m: Column, key: str) -> Column:
    name, place = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(name), F.lower(place)), 256), 1, 16), F.lit("@"), place)


_MAKE = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def kind_of(m: Column) -> Column:
    """Kind of a matched value, null where it fails its check."""
    d = _digits(m)
    valid = {"card": F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0), "date": _day(m).isNotNull(), "phone": ~m.rlike("^\\+[2-9]") | (F.length(_national(m)) >= 5) & (F.length(_digits(m)) <= 15)}
    out = F.when(F.instr(m, "@") > 0, F.lit("email"))
    for k in KINDS[1:]:
        full = f"^(?:{_GROUP[k]})$"
        out = out.when(m.rlike(full), F.when(valid[k], F.lit(k)) if k in valid else F.lit(k))
    return out


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every validated value of the text replaced, and n_email, n_ip, n_phone, n_ssn, n_date, n_card (long).

    One row per input row; null and empty texts stay as they are with counts of 0. Columns of the counts' names are
    replaced. Equal values have equal pseudonyms under one ``key``, whatever row they stand in.
    """
    counts = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if c not in counts]
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    parts = F.split(F.col(text), ANY, -1)
    out = docs.select(*kept, F.when(F.col(text).rlike(HINT), F.struct(found.alias("m"), parts.alias("p"))).alias("_found"))

    def replaced(m: Column) -> Column:
        kind = kind_of(m)
        new = F.when(kind.isNull(), m)
        for k in KINDS:
            new = new.when(kind == k, _MAKE[k](m, key))
        return F.struct(kind.alias("kind"), new.alias("new"))

    out = out.withColumn("_new", F.transform(F.col("_found.m"), replaced))
    woven = F.flatten(F.zip_with(F.col("_found.p"), F.col("_new.new"), lambda p, m: F.array(p, F.coalesce(m, F.lit("")))))
    rebuilt = F.when(F.col("_new").isNull(), F.col(text)).otherwise(F.array_join(woven, ""))
    number = lambda k: F.coalesce(F.size(F.filter(F.col("_new.kind"), lambda x: x == k)), F.lit(0)).cast("long")
    return out.select(*[rebuilt.alias(c) if c == text else F.col(c) for c in kept], *[F.when(F.col("_new").isNull(), F.lit(0).cast("long")).otherwise(number(k)).alias(f"n_{k}") for k in KINDS])
