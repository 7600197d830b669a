"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each value's format.

DataFrame functions only; nothing is shuffled or joined, since a pseudonym depends on the key and the value alone, which is
also what keeps equal values linked across documents. A value is validated, numbered within its format's domain of a * b
members, permuted by alternating rounds L += f(R) mod a, R += f(L) mod b (f is SHA-256 of key, format, round and half), and
written back with its separators:

- card numbers of 13 to 19 digits in one run, or 13, 14, 15, 16 or 19 in the usual groups (4-3-3-3, 4-6-4, 4-6-5, 4-4-4-4,
  4-4-4-4-3), with a right Luhn digit: the digits before it are permuted, and it is computed anew
- telephone numbers: ten national digits, the first from 2 to 9 where it was so; a country code stays. A run of ten digits from 2 or more counts as one,
  and so do 8 to 15 digits in groups after + and a country code, whose digits are permuted by their number
- US social security numbers, among those that can be given out
- IPv4 addresses, over all 2 ** 32
- dates from 1900 to 2099 (year first, or day or month first with four year digits, or with an English month's name), over these 73,049 days
- e-mail addresses, in lower case: runs of up to 12 ASCII letters and digits each; the top-level domain stays, and so do other letters
- quoted hexadecimal secrets of 20 digits or more: runs of up to 12
- account numbers (IBAN, in one run or groups of four) whose check digits are right: runs of digits after them, whose check
  digits are computed anew; country and letters stay
- IPv6 addresses, in full or with one gap: the digits of each group
- hardware addresses (six pairs of hexadecimal digits with colons or hyphens): their 12 digits
- access keys with a known prefix (AKIA, ASIA, gh?_, xox?-, sk- with a word after it or not, eyJ of a signed token), which stays: runs of up to 6
  letters and digits after it

An unquoted run of 20 hexadecimal digits or more in the shape of an account number, but with wrong check digits, is taken for a secret. Other
unquoted hexadecimal runs are no values: they are checksums more often than secrets.

What only looks like a value but fails its check stays as it is. A null text stays null. Repeated rows give repeated results;
``n_values`` counts the values replaced and replaces a column of that name, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.session import fresh

ROUNDS = 8
DAYS = (17, 4297)  # 17 * 4297 days from 1900-01-01 to 2099-12-31

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9./\-])(?:[12][0-9]{3}(?<d1>[-/.])[0-9]{1,2}\k<d1>[0-9]{1,2}|[0-9]{1,2}(?<d2>[-/.])[0-9]{1,2}\k<d2>[12][0-9]{3})(?![0-9]|[./\-][0-9])"
# Fixed values
MONTHS = "January February March April May June July August September October November December".split()
MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "May" else m for m in MONTHS) + r")(?![A-Za-z])\.?"
NAMED = r"(?<![A-Za-z0-9])(?:" + MONTH + r" [0-9]{1,2}(?:st|nd|rd|th)?,? [12][0-9]{3}|[0-9]{1,2}(?:st|nd|rd|th)? " + MONTH + r",? [12][0-9]{3})(?![0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|\+[0-9]{11,13}(?![0-9])"
ABROAD = r"\+[0-9]{1,3}(?:[ .\-][0-9]{2,4}){2,5}(?![0-9])"
BARE = r"(?<![0-9A-Za-z.,/_#:\-])[2-9][0-9]{9}(?![0-9A-Za-z_]|[.,/:\-][0-9])"
MAC = r"(?<![0-9A-Fa-f:\-])[0-9A-Fa-f]{2}(?<m1>[:\-])(?:[0-9A-Fa-f]{2}\k<m1>){4}[0-9A-Fa-f]{2}(?![0-9A-Fa-f]|[:\-][0-9A-Fa-f])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<c1>[ \-])[0-9]{4}\k<c1>[0-9]{4}\k<c1>[0-9]{4}(?:\k<c1>[0-9]{3})?|[0-9]{4}(?<c2>[ \-])[0-9]{6}\k<c2>[0-9]{4,5}|[0-9]{4}(?<c3>[ \-])[0-9]{3}\k<c3>[0-9]{3}\k<c3>[0-9]{3})(?![0-9])"
SECRET = r'(?<=")[0-9a-fA-F]{20,}+(?=")'
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])"
PREFIX = r"(?:A[KS]IA|gh[oprsu]_|xox[abpr]-|sk-(?:[a-z]{2,8}-)?|eyJ)"
TOKEN = r"(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36,}+|xox[abpr]-[A-Za-z0-9\-]{10,}+|sk-(?:(?=[A-Za-z_\-]*+[0-9])[A-Za-z0-9_\-]{20,}+|[A-Za-z0-9]{20,}+)|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+)(?![A-Za-z0-9_])"
ANY = "|".join([TOKEN, EMAIL, IP, DATE, NAMED, SSN, PHONE, ABROAD, BARE, CARD, SECRET, IBAN, MAC, IPV6])
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _power(base: int, k: Column) -> Column:
    most = {10: 9, 16: 6, 36: 6, 62: 5}[base]
    return F.element_at(F.array(*(F.lit(base**i).cast("long") for i in range(most + 1))), k.cast("int") + 1)


def feistel(x: Column, a: Column, b: Column, tweak: str, key: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 to a * b - 1, for long columns."""

    def half(i: Column, other: Column, m: Column) -> Column:
        text = F.concat_ws("|", key, F.lit(tweak), i.cast("string"), other.cast("string"), m.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long"), m)

    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + half(i, s["r"], a), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + half(i, s["l"], b), b).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["l"] * b + s["r"])


def rebuild(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with change() of each match in its place."""
    gaps = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def _runs(text: Column, base: int, tweak: str, key: Column) -> Column:
    """Each run of up to 12 characters permuted as a number of that base."""

    def run(s: Column) -> Column:
        n = F.length(s)
        low = F.ceil(n / 2)
        y = feistel(F.conv(s, base, 10).cast("long"), _power(base, n - low), _power(base, low), tweak, key)
        return F.lpad(F.lower(F.conv(y.cast("string"), 10, base)), n, F.lit("0"))

    return rebuild(text, "[0-9]{1,12}" if base == 10 else "[0-9a-z]{1,12}", run)


def _mixed(text: Column, tweak: str, key: Column) -> Column:
    """Each run of up to 6 characters of ALPHABET permuted as a number of base 62."""

    def run(s: Column) -> Column:
        n = F.length(s)
        low = F.ceil(n / 2)
        x = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda v, c: v * 62 + F.position(c, F.lit(ALPHABET)) - 1)
        y = feistel(x, _power(62, n - low), _power(62, low), tweak, key)
        digit = lambda v, i: F.pmod(F.call_function("div", v, _power(62, i)), F.lit(62)).cast("int")
        letters = F.transform(F.array(y), lambda v: F.transform(F.sequence(n - 1, F.lit(0)), lambda i: F.substring(F.lit(ALPHABET), digit(v, i) + 1, F.lit(1))))
        return F.array_join(F.get(letters, F.lit(0)), "")

    return rebuild(text, "[0-9A-Za-z]{1,6}", run)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _decimal(d: Column, n: Column, tweak: str, key: Column) -> Column:
    """n digits permuted among themselves, up to 18."""
    low = F.ceil(n / 2)
    return F.lpad(feistel(d.cast("long"), _power(10, n - low), _power(10, low), tweak, key).cast("string"), n, F.lit("0"))


def _refill(s: Column, digits: Column) -> Column:
    """s with its digits replaced in order."""
    chars = F.split(s, "")
    fold = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.between("0", "9") & (F.length(c) == 1), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"],
    )
    return fold


def _luhn_sum(d: Column) -> Column:
    """Luhn's sum of digits that still lack their check digit."""
    back = F.split(F.reverse(d), "")
    return F.aggregate(F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda s, x: s + x)


def _check_digit(d: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn_sum(d), F.lit(10)), F.lit(10)).cast("string")


def _card(s: Column, key: Column) -> Column:
    d = _digits(s)
    body = F.left(d, F.length(d) - 1)
    new = _decimal(body, F.length(body), "card", key)
    return F.when(_check_digit(body) == F.right(d, F.lit(1)), _refill(s, F.concat(new, _check_digit(new)))).otherwise(s)


def _mod97(s: Column) -> Column:
    """The remainder by 97 of capitals and digits read as a number, letters as 10 to 35."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda v, c: F.pmod(F.when(c.between("0", "9"), v * 10 + c.cast("long")).otherwise(v * 100 + F.ascii(c) - 55), F.lit(97)))


def _is_iban(s: Column) -> Column:
    c = F.replace(s, F.lit(" "), F.lit(""))
    shape = s.rlike("^(?:" + IBAN + ")$") & F.length(c).between(15, 34)
    return shape & (_mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.left(c, F.lit(4)))) == 1)


def _iban(s: Column, key: Column) -> Column:
    c = F.replace(s, F.lit(" "), F.lit(""))
    country, new = F.left(c, F.lit(2)), _runs(F.substring(c, F.lit(5), F.length(c)), 10, "iban", key)
    flat = F.concat(country, F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)
    return F.when(F.contains(s, F.lit(" ")), F.regexp_replace(flat, "(.{4})(?=.)", "$1 ")).otherwise(flat)


def _ipv6(s: Column, key: Column) -> Column:
    groups = F.size(F.filter(F.split(s, ":"), lambda g: g != ""))
    return F.when(F.contains(s, F.lit("::")) & (groups > 7), s).otherwise(_runs(F.lower(s), 16, "ipv6", key))


def _token(s: Column, key: Column) -> Column:
    head = F.regexp_extract(s, "^" + PREFIX, 0)
    rest = F.substring(s, F.length(head) + 1, F.length(s))
    upper = F.upper(_runs(F.lower(rest), 36, "token", key))
    return F.concat(head, F.when(s.rlike("^A[KS]IA"), upper).otherwise(_mixed(rest, "token", key)))


def _phone(s: Column, key: Column) -> Column:
    d = _digits(s)
    country, own = F.left(d, F.length(d) - 10), F.right(d, F.lit(10))
    x = own.cast("long")
    lead = F.when(own >= "2", F.lit(2_000_000_000)).otherwise(0).cast("long")
    a = F.when(own >= "2", F.lit(80_000)).otherwise(20_000).cast("long")
    new = F.lpad((feistel(x - lead, a, F.lit(100_000).cast("long"), "phone", key) + lead).cast("string"), 10, "0")
    return _refill(s, F.concat(country, new))


def _ssn(s: Column, key: Column) -> Column:
    d = _digits(s)
    area, group, serial = F.left(d, F.lit(3)).cast("long"), F.substring(d, 4, 2).cast("long"), F.right(d, F.lit(4)).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas
    y = feistel((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), "ssn", key)
    new_place = F.call_function("div", y, F.lit(99 * 9999)) + 1
    new_area = new_place + F.when(new_place >= 666, 1).otherwise(0)
    new = F.concat(F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.pmod(F.call_function("div", y, F.lit(9999)), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(y, F.lit(9999)) + 1).cast("string"), 4, "0"))
    return F.when(valid, _refill(s, new)).otherwise(s)


def _ip(s: Column, key: Column) -> Column:
    parts = F.transform(F.split(s, r"\."), lambda p: p.cast("long"))
    x = F.aggregate(parts, F.lit(0).cast("long"), lambda v, p: v * 256 + p)
    y = feistel(x, F.lit(65536).cast("long"), F.lit(65536).cast("long"), "ip", key)
    octets = [F.pmod(F.shiftright(y, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]
    return F.when(F.forall(parts, lambda p: p <= 255), F.concat_ws(".", *octets)).otherwise(s)


def _other_day(year: Column, month: Column, day: Column, key: Column) -> tuple[Column, Column]:
    """Whether a date is one of the domain's, and the date that it becomes."""
    may = year.between(1900, 2099) & month.between(1, 12) & day.between(1, 31)
    begin = F.make_date(F.when(may, year).otherwise(2000), F.when(may, month).otherwise(1), F.lit(1))
    valid = may & (day <= F.dayofmonth(F.last_day(begin)))
    x = F.datediff(begin, F.lit("1900-01-01").cast("date")) + F.when(valid, day).otherwise(1) - 1
    return valid, F.date_add(F.lit("1900-01-01").cast("date"), feistel(x.cast("long"), F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), "date", key).cast("int"))


def _date(s: Column, key: Column) -> Column:
    p = F.transform(F.split(s, "[-/.]"), lambda x: x.cast("int"))
    gap = F.regexp_extract(s, "[-/.]", 0)
    at = lambda k: F.get(p, F.lit(k))
    first = F.length(F.get(F.split(s, "[-/.]"), F.lit(0))) == 4
    year = F.when(first, at(0)).otherwise(at(2))
    # day first, unless only month first can be right
    month = F.when(first | (at(1) <= 12), at(1)).otherwise(at(0))
    day = F.when(first, at(2)).when(at(1) <= 12, at(0)).otherwise(at(1))
    valid, new = _other_day(year, month, day, key)
    y, m, d = F.year(new).cast("string"), F.lpad(F.month(new).cast("string"), 2, "0"), F.lpad(F.dayofmonth(new).cast("string"), 2, "0")
    out = F.when(first, F.concat_ws("~", y, m, d)).when(at(1) <= 12, F.concat_ws("~", d, m, y)).otherwise(F.concat_ws("~", m, d, y))
    return F.when(valid, F.replace(out, F.lit("~"), gap)).otherwise(s)


def _named_date(s: Column, key: Column) -> Column:
    """A date with a month's name: the new one in the same order, its name as short or long as before, without the ending of the day."""
    name, day = F.regexp_extract(s, "[A-Z][a-z]+", 0), F.regexp_extract(s, "(?<![0-9])[0-9]{1,2}(?![0-9])", 0)
    names = F.array(*(F.lit(m[:3]) for m in MONTHS))
    valid, new = _other_day(F.right(s, F.lit(4)).cast("int"), F.array_position(names, F.left(name, F.lit(3))).cast("int"), day.cast("int"), key)
    whole = F.element_at(F.array(*(F.lit(m) for m in MONTHS)), F.month(new))
    month = F.when(F.length(name) > 3, whole).otherwise(F.left(whole, F.lit(3)))
    d = F.dayofmonth(new).cast("string")
    comma = F.when(F.contains(s, F.lit(",")), ", ").otherwise(" ")
    return F.when(valid, F.concat(F.when(s.rlike("^[0-9]"), F.concat(d, F.lit(" "), month)).otherwise(F.concat(month, F.lit(" "), d)), comma, F.year(new).cast("string"))).otherwise(s)


def _abroad(s: Column, key: Column) -> Column:
    """A telephone number in groups after a country code, which stays."""
    d, country = _digits(s), F.length(F.regexp_extract(s, "[0-9]+", 0))
    own = F.substring(d, country + 1, F.length(d))
    return F.when(F.length(d).between(8, 15), _refill(s, F.concat(F.left(d, country), _decimal(own, F.length(own), "abroad", key)))).otherwise(s)


def _mac(s: Column, key: Column) -> Column:
    flat = _runs(F.lower(F.regexp_replace(s, "[:-]", "")), 16, "mac", key)
    return F.regexp_replace(flat, "(..)(?=.)", F.concat(F.lit("$1"), F.substring(s, 3, 1)))


def _email(s: Column, key: Column) -> Column:
    low = F.lower(s)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.left(domain, F.length(domain) - F.length(top) - 1)
    return F.concat(_runs(local, 36, "local", key), F.lit("@"), _runs(rest, 36, "domain", key), F.lit("."), top)


def pseudonym(s: Column, key: Column) -> Column:
    """The pseudonym of one match of ANY, or the match itself where it isn't valid."""
    whole = lambda pattern: s.rlike("^(?:" + pattern + ")$")
    secret = (F.length(s) >= 20) & whole("[0-9a-fA-F]+")
    return (
        F.when(F.contains(s, F.lit("@")), _email(s, key))
        .when(whole(TOKEN), _token(s, key))
        .when(whole(MAC), _mac(s, key))
        .when(F.contains(s, F.lit(":")), _ipv6(s, key))
        .when(_is_iban(s), _iban(s, key))
        .when(whole(IP), _ip(s, key))
        .when(whole(DATE), _date(s, key))
        .when(whole(NAMED), _named_date(s, key))
        .when(whole(SSN), _ssn(s, key))
        .when(whole(PHONE) | whole(BARE), _phone(s, key))
        .when(whole(ABROAD), _abroad(s, key))
        .when(secret, _runs(F.lower(s), 16, "secret", key))
        # what has an account number's shape and a wrong check may still hold a card number
        .when(s.rlike("^[A-Z]"), rebuild(s, CARD, lambda m: _card(m, key)))
        .otherwise(_card(s, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with pseudonyms in text, and n_values."""
    secret = F.lit(key)
    t = F.col(text)
    # a text without digits, @, ::, pairs of letters, a key's prefix or a quoted secret of letters has no value, and is not searched
    may = t.rlike(r"[0-9]|@|::|(?:[A-Fa-f]{2}[:\-]){5}|" + PREFIX + "|" + SECRET)
    old, new = fresh(docs, "pii_found"), fresh(docs, "pii_new")
    given = docs.withColumn(old, F.when(may, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    some = F.size(old) > 0
    given = given.withColumn(new, F.when(some, F.transform(old, lambda m: pseudonym(m, secret))))
    joined = F.array_join(F.flatten(F.zip_with(F.split(t, ANY, -1), new, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("long")
    given = given.withColumn(text, F.when(some, joined).otherwise(t)).withColumn("n_values", F.when(some, changed).otherwise(F.lit(0).cast("long")))
    return given.drop(old, new)
