"""PII: format-preserving Feistel pseudonyms, by DataFrame expressions alone.

Candidates are found by one pattern; numbers and dates are validated (Luhn, mod 97, calendar, octets) and only valid
ones are replaced. A value's letters and digits are the symbols of a Feistel network: in each round one half is
shifted, symbol by symbol within its class (digit, lower, upper), by a keyed digest of the other half. So a pseudonym
has the format of its value, the mapping is a permutation under the key, and equal values stay linked across documents.
Where not every string of a format is valid, the network is applied again until a valid one comes up, which permutes the
valid ones among themselves.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session setting that holds the secret key, and how often at most a network is applied again.
KEY_SETTING, WALK = "spark.chronoledger.pii.key", 64
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Characters of an IBAN after its check digits, by country: in printed groups only the length tells where it ends.
_IBAN = {
    11: "NO", 12: "BE", 14: "DK|FI|FK|FO|GL|NL|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|MN|XK", 17: "CH|HR|LI|LV",
    18: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 19: "AE|GI|IL|IQ|OM|SO|TL", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "LY|PT|ST",
    22: "DZ|IS|TR", 23: "BI|DJ|FR|GR|IT|MC|MR|SM", 24: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 25: "BR|EG|PS|QA|UA",
    26: "JO|KW|MU|YE", 27: "MT|SC", 28: "LC", 29: "RU",
}
_GROUPED = "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, c in _IBAN.items())
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}",
    "secret": r"(?<=(?:token|TOKEN|Token|secret|SECRET|Secret|password|PASSWORD|Password|api_key|API_KEY|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/-]{16,}",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{_GROUPED})(?![A-Za-z0-9])",
}
# A card's candidate is the whole run of digit groups, up to where another kind of value begins.
_OTHER = "|".join(PATTERNS[kind] for kind in ("date", "phone", "ssn"))
PATTERNS["card"] = rf"(?<!\d)\d(?:(?:[ -](?!{_OTHER}))?\d){{12,}}+"
#: Numbers of digits of a card, likeliest first.
CARD_DIGITS = (16, 15, 19, 14, 13, 18, 17)
#: Dates of these days (from 1900-01-01 on, 256 x 256 of them) are permuted among themselves.
FIRST_DAY, DAYS = "1900-01-01", 65536


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, round_: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), round_.cast("string"), other).cast("binary"), 256)


def _number(digest: Column, at: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, at, F.lit(digits)), 16, 10).cast("long")


def _shifted(half: Column, digest: Column) -> Column:
    """Each symbol moved within its class by two hexadecimal digits of the digest."""

    def one(c: Column, i: Column, digest: Column) -> Column:
        by, code = _number(digest, F.pmod(i, F.lit(32)) * 2 + 1, 2), F.ascii(c)
        move = lambda base, n: F.char(F.lit(base) + F.pmod(code - base + by, F.lit(n)))
        return F.when(code.between(48, 57), move(48, 10)).when(code.between(97, 122), move(97, 26)).when(code.between(65, 90), move(65, 26)).otherwise(c)

    chars = F.regexp_extract_all(half, F.lit("(?s)."), F.lit(0))
    return _let(digest, lambda d: F.array_join(F.transform(chars, lambda c, i: one(c, i, d)), ""))


def feistel(symbols: Column, key: str) -> Column:
    """A keyed permutation of strings that keeps each position's class. An odd length has unequal halves."""
    middle = F.floor(F.length(symbols) / 2).cast("int")
    start = F.struct(F.substring(symbols, F.lit(1), middle).alias("l"), F.substring(symbols, middle + 1, F.length(symbols)).alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), _shifted(s["l"], _digest(key, i, s["r"])).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _feistel_number(left: Column, right: Column, modulus: int, key: str, finish) -> Column:
    """A keyed permutation of pairs of numbers below ``modulus``."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + _number(_digest(key, i, s["r"].cast("string")), F.lit(1), 12), F.lit(modulus)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, finish)


def _walk(start: Column, move, ok) -> Column:
    """``move`` applied to a valid value until the result is ``ok`` again: a permutation of the valid values."""
    zero = F.struct(start.alias("v"), F.lit(False).alias("done"))
    again = lambda s: _let(move(s["v"]), lambda v: F.struct(v.alias("v"), ok(v).alias("done")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), zero, lambda s, _: F.when(s["done"], s).otherwise(again(s)), lambda s: s["v"])


def _symbols(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def _fill(value: Column, symbols: Column) -> Column:
    """``value`` with its letters and digits replaced, in order, by ``symbols``."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    place = lambda i: F.length(_symbols(F.substring(value, F.lit(1), i + 1)))
    one = lambda s, c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(s, place(i), F.lit(1))).otherwise(c)
    return _let(symbols, lambda s: F.array_join(F.transform(chars, lambda c, i: one(s, c, i)), ""))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose check digit is its last."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0))

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * (F.pmod(i, F.lit(2)) + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(each, one), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0), step)


def _card(v: Column, key: str) -> Column:
    d = _symbols(v)
    body = F.concat(F.substring(d, F.lit(1), F.lit(1)), feistel(F.substring(d, F.lit(2), F.length(d) - 2), key))
    checked = lambda b: F.concat(b, F.pmod(F.lit(10) - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return _fill(v, _let(body, checked))


def _result(text: Column, n: Column) -> Column:
    return F.struct(text.alias("text"), n.cast("int").alias("n"))


def _cards(v: Column, key: str) -> Column:
    """A run of digit groups with the cards in it replaced, and their number.

    Every 13 to 19 digits from the begin of a group to the end of one that pass Luhn are taken for a card: the first
    of them and, of those that begin alike, the one of the likeliest length. Groups that only others cover which
    overlap with it are replaced too, so that no digit of a valid number stays.
    """
    groups = F.regexp_extract_all(v, F.lit(r"[ -]?\d+"), F.lit(0))
    part = lambda g, i, j: F.array_join(F.slice(g, i, j - i + 1), "")
    rank = lambda d: F.array_position(F.lit(list(CARD_DIGITS)), F.length(d))
    # By group: the cards that begin there, as (rank of the length, last group).
    ranked = lambda d: F.when(rank(d) > 0, F.when(_luhn_sum(d) % 10 == 0, rank(d)))
    ends = lambda g, i: F.transform(F.sequence(i, F.least(i + 18, F.size(g))), lambda j: F.struct(_let(_symbols(part(g, i, j)), ranked).alias("rank"), j.alias("end")))
    valid = lambda g: F.transform(g, lambda _, i: F.filter(ends(g, i + 1), lambda e: e["rank"].isNotNull()))

    def scanned(g: Column, cards: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            here, one = F.get(cards, i - 1), F.get(g, i - 1)
            best, free = F.array_min(here)["end"], i > s["until"]
            cover = F.greatest(s["cover"], F.array_max(F.transform(here, lambda e: e["end"])))
            made = (
                F.when(~free, F.lit(""))
                .when(best.isNotNull(), _card(part(g, i, best), key))
                .when(i <= s["cover"], _fill(one, feistel(_symbols(one), key)))
                .otherwise(one)
            )
            new = free & best.isNotNull()
            return F.struct(
                F.concat(s["text"], made).alias("text"), (s["n"] + F.when(new, 1).otherwise(0)).alias("n"),
                F.when(new, best).otherwise(s["until"]).alias("until"), cover.alias("cover"),
            )

        zero = F.lit(0).cast("int")
        start = F.struct(F.lit("").alias("text"), zero.alias("n"), zero.alias("until"), zero.alias("cover"))
        return F.aggregate(F.sequence(F.lit(1), F.size(g)), start, step, lambda s: _result(s["text"], s["n"]))

    return _let(groups, lambda g: _let(valid(g), lambda cards: scanned(g, cards)))


def _iban(v: Column, key: str) -> Column:
    """A valid IBAN replaced; of an invalid one the cards among its digits."""
    plain = _symbols(v)
    runs = F.regexp_extract_all(v, F.lit(r"\d(?:[ -]?\d)*+|\D+"), F.lit(0))
    each = F.transform(runs, lambda r: F.when(F.length(_symbols(r)) >= 13, F.when(r.rlike(r"^\d"), _cards(r, key + "card"))).otherwise(_result(r, F.lit(0))))
    each = F.zip_with(runs, each, lambda r, x: F.coalesce(x, _result(r, F.lit(0))))
    other = F.aggregate(each, _result(F.lit(""), F.lit(0)), lambda a, x: _result(F.concat(a["text"], x["text"]), a["n"] + x["n"]))
    return F.when(_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1, _result(_fill(v, _account(plain, key + "iban")), F.lit(1))).otherwise(other)


def _account(v: Column, key: str) -> Column:
    country, account = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v))
    check = lambda new: F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return _let(feistel(account, key), lambda new: F.concat(country, check(new), new))


def _email(v: Column, key: str) -> Column:
    local, domain, top = (F.regexp_extract(v, r"^([^@]+)@(.+)\.([^.]+)$", i) for i in (1, 2, 3))
    return F.concat(_fill(local, feistel(_symbols(local), key)), F.lit("@"), _fill(domain, feistel(_symbols(domain), key + "@")), F.lit("."), top)


def _ssn(v: Column, key: str) -> Column:
    """A social security or taxpayer number that can have been given out (``PATTERNS`` finds no other) becomes another."""
    return _fill(v, _walk(_symbols(v), lambda x: feistel(x, key), lambda x: x.rlike(r"^(?!000|666)\d{3}(?!00)\d{2}(?!0000)\d{4}$")))


def _phone(v: Column, key: str) -> Column:
    """The country stays; the format is all that tells a phone number."""
    country = F.regexp_extract(v, r"^(\+\d{1,3}[ .-]?)(?=[(\d])", 1)
    rest = F.substring(v, F.length(country) + 1, F.length(v))
    return F.concat(country, _fill(rest, feistel(_symbols(rest), key)))


def _ip(v: Column, key: str) -> Column:
    o = [F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).cast("int") for i in (1, 2, 3, 4)]
    split = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _feistel_number(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, key, lambda s: F.concat_ws(".", *split(s["l"]), *split(s["r"])))


def _date(v: Column, key: str) -> Column:
    """A day becomes another day in the same form.

    With slashes, day before month is read where both would do. What only reads as month before day has a day after
    the 12th, and so has its pseudonym: the two readings never give the same text.
    """
    found = F.lit(None).cast("string")
    for form in ("MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"):
        shape = "^" + form.replace("MM", r"\d{2}").replace("dd", r"\d{2}").replace("yyyy", r"\d{4}").replace(".", r"\.") + "$"
        day = F.datediff(F.try_to_timestamp(F.when(v.rlike(shape), v), F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        found = F.when(day.between(0, DAYS - 1), F.concat_ws("|", day.cast("string"), F.lit(form))).otherwise(found)
    date = lambda day: F.date_add(F.lit(FIRST_DAY).cast("date"), day)
    move = lambda day: _feistel_number(F.floor(day / 256), day % 256, 256, key, lambda s: (s["l"] * 256 + s["r"]).cast("int"))

    def moved(f: Column) -> Column:
        day, form = F.split_part(f, F.lit("|"), F.lit(1)).cast("int"), F.split_part(f, F.lit("|"), F.lit(2))
        new = _walk(day, move, lambda d: (form != "MM/dd/yyyy") | (F.dayofmonth(date(d)) > 12))
        return _let(date(new), lambda d: F.replace(F.replace(F.replace(form, F.lit("yyyy"), F.date_format(d, "yyyy")), F.lit("MM"), F.date_format(d, "MM")), F.lit("dd"), F.date_format(d, "dd")))

    return _let(found, lambda f: F.when(f.isNotNull(), moved(f)).otherwise(v))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate (the candidate itself where it is not valid) and the number of values replaced."""
    is_ = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    counted = lambda new: _let(new, lambda x: _result(x, F.when(x != value, 1).otherwise(0)))
    generic = _fill(value, feistel(_symbols(value), key + "secret"))
    return (
        F.when(value.contains("@"), counted(_email(value, key + "email")))
        .when(is_("ip"), counted(_ip(value, key + "ip")))
        .when(is_("date"), counted(_date(value, key + "date")))
        .when(is_("phone"), counted(_phone(value, key + "phone")))
        .when(is_("ssn"), counted(_ssn(value, key + "ssn")))
        .when(is_("card"), _cards(value, key + "card"))
        .when(is_("iban"), _iban(value, key))
        .otherwise(counted(generic))
    )


def pseudonymised(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text`` replaced by pseudonyms under ``key``; all other columns as they are.

    Replaced are e-mail addresses, IPv4 addresses (no leading zeros), phone numbers of ten digits
    (by their format), social security and taxpayer numbers that can have been given out, card numbers that pass
    Luhn (their check digit is set anew, their first digit kept; anywhere in a run of digit groups), IBANs that pass
    mod 97 (in one piece or, of the countries in ``_IBAN``, with single spaces), calendar dates from 1900-01-01 to
    2079-06-05 and secrets given as token, secret, password or api key. Candidates that fail their check
    stay. Null and empty texts stay; repeated rows get equal results; an empty table stays empty. ``count`` names a
    new column with the number of values replaced.
    """
    every = "|".join(PATTERNS.values())
    # Most texts hold neither a digit nor an @: they are passed on untouched.
    some = F.col("text").rlike(r"[0-9@]|(?i:token|secret|password|api_?key)\s{0,2}[=:]")
    order = docs.columns
    taken = {c.lower() for c in order}
    found, made = (next(n for i in range(len(order) + 1) if (n := f"{name}{i}") not in taken) for name in ("pii_found", "pii_made"))
    out = docs.withColumn(found, F.when(some, F.regexp_extract_all("text", F.lit(every), F.lit(0))))
    out = out.withColumn(made, F.when(F.size(found) > 0, F.transform(found, lambda v: pseudonym(v, key))))
    gaps = F.split("text", every, -1)
    text = F.array_join(F.zip_with(gaps, F.concat(F.col(made)["text"], F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    out = out.withColumn("text", F.when(F.col(made).isNotNull(), text).otherwise(F.col("text")))
    extra = []
    if count:
        changed = F.aggregate(F.col(made)["n"], F.lit(0), lambda a, n: a + n)
        extra = [F.when(F.col(made).isNotNull(), changed).otherwise(0).cast("long").alias(count)]
    return out.select(*[F.col(f"`{c}`") for c in order], *extra)


def secret_key(spark: SparkSession) -> str:
    """The key of ``KEY_SETTING``. Unset it is a public word, so that runs agree, and pseudonyms can be undone by anyone."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms under the public key protect nobody", stacklevel=2)
    return found or "public"


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, text with pseudonyms, n_values replaced."""
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), secret_key(spark), "n_values")
