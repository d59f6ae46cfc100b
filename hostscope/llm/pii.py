"""Personal data to format-preserving pseudonyms, in DataFrame functions only.

Candidates are found by one pattern and validated (Luhn sum, octets, calendar,
reserved blocks).  Of a run of digit groups every span of groups that can be a card
is tried, so a number beside a card does not hide it; the pattern of a text holds
the spans that pass, and of two that overlap the first, then the longer one is taken.  A valid value is replaced by a keyed permutation of its own
format: a Feistel network over two mixed-radix halves, whose round function is
SHA-256 of the key, the kind, the round and the other half.  A permutation maps
equal values to equal pseudonyms and different values to different ones, so
records stay linked across documents while the values go.

    cards      13 to 19 digits with a valid Luhn sum: the digits between the first
               and the last are permuted, the check digit is recomputed
    phones     ten digits, with separators or a leading +1: permuted, layout kept
    IPv4       four octets: the 32 bits are permuted
    SSN        ddd-dd-dddd outside reserved blocks: permuted among the valid ones
    dates      yyyy-mm-dd, and dd/mm/yyyy or mm/dd/yyyy where it is a date, from
               1800 to 2199 (one Gregorian cycle): the day is permuted in the cycle,
               that of mm/dd/yyyy among the days that dd/mm/yyyy cannot mean
    e-mail     not a number: replaced by a keyed hash at example.invalid

What does not validate stays as it is.  A text's matches are replaced one by one
between its unmatched pieces; whole texts are processed and no row is shuffled.

Who knows the key can undo the pseudonyms, so there is no default: callers pass
one, jobs that of the setting ``KEY_SETTING``.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KEY_SETTING = "spark.hostscope.pii.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = (r"(?<![0-9A-Za-z+-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"
         r"|(?<![0-9A-Za-z+])\+1[0-9]{10}(?![0-9A-Za-z])")
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
#: Tried in this order at every place of a text.
KINDS = {"email": EMAIL, "date": DATE, "ssn": SSN, "ipv4": IPV4, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
NOT_CARD = "|".join(f"(?:{p})" for k, p in KINDS.items() if k != "card")
#: Every span of whole digit groups with so many digits, overlapping ones too.
CARD_SPANS = [rf"(?<![0-9A-Za-z])(?=([0-9](?:[ -]?[0-9]){{{n - 1}}})(?![0-9A-Za-z]))" for n in range(19, 12, -1)]
#: Without an @ or a run of digits there is nothing to find.
HINT = r"@|[0-9]{2}|[0-9][.)]"

CYCLE_START, CYCLE_DAYS = "1800-01-01", 146_097  # 400 Gregorian years; 146,097 = 189 * 773
LATE_DAYS, CYCLE_MONTHS = 88_497, 4_800  # of these after the 12th of a month: 88,497 = 9 * 9,833


def session_key(spark: SparkSession) -> str:
    """The key of ``KEY_SETTING``; where it is unset, a random one for this session,
    so that values stay linked within it and nobody can undo them."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def _round(key: str, kind: str, i: Column, half: Column) -> Column:
    """52 bits of SHA-256 as a long."""
    text = F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1 (both at most 10 ** 9)."""

    def step(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["a"] + _round(key, kind, i, acc["b"])) % left).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise((acc["b"] + _round(key, kind, i, acc["a"])) % right).alias("b"),
        )

    value = value.cast("long")
    # long division: a double quotient would round above 2 ** 53
    start = F.struct(F.call_function("div", value, right).cast("long").alias("a"), (value % right).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda z: z["a"] * right + z["b"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column, odd_doubled: bool) -> Column:
    """Luhn sum; digits are counted from the right, every second one doubled."""
    reversed_ = F.split(F.reverse(digits), "")
    first = 0 if odd_doubled else 1
    return F.aggregate(
        F.transform(reversed_, lambda d, i: F.when(
            i % 2 == first, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
        ).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d)


def _laid_out(original: Column, digits: Column) -> Column:
    """``digits`` put, in order, where the digits of ``original`` stand."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.split(original, ""), start,
        lambda acc, c: F.when(
            c.rlike("^[0-9]$"),
            F.struct((acc["at"] + 1).alias("at"), F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out")),
        ).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out"))),
        lambda acc: acc["out"])


def _card(x: Column, key: str) -> Column:
    digits = _digits(x)
    n = F.length(digits)
    inner = F.substr(digits, F.lit(2), n - 2)
    low = F.floor((n - 2) / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    new = F.lpad(feistel(inner, power(n - 2 - low), power(low), key, "card").cast("string"), n - 2, "0")
    head = F.concat(F.substr(digits, F.lit(1), F.lit(1)), new)
    check = F.pmod(-_luhn_sum(head, True), F.lit(10)).cast("string")
    return F.when(_luhn_sum(digits, False) % 10 == 0, _laid_out(x, F.concat(head, check))).otherwise(x)


def _phone(x: Column, key: str) -> Column:
    digits = _digits(x)
    number = F.substr(digits, F.length(digits) - 9, F.lit(10))
    new = F.lpad(feistel(number, F.lit(100_000), F.lit(100_000), key, "phone").cast("string"), 10, "0")
    return _laid_out(x, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), new))


def _ipv4(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    valid = F.forall(octets, lambda o: o <= 255)
    new = feistel(F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o), F.lit(65_536), F.lit(65_536), key, "ipv4")
    parts = [F.shiftright(new, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(valid, F.concat_ws(".", *parts)).otherwise(x)


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.split(x, "-")[i].cast("long") for i in range(3))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    rank = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + (group - 1)) * 9_999 + (serial - 1)
    new = feistel(rank, F.lit(898), F.lit(99 * 9_999), key, "ssn")
    a = F.call_function("div", new, F.lit(99 * 9_999)) + 1
    rest = new % (99 * 9_999)
    out = F.concat_ws(
        "-", F.lpad(F.when(a >= 666, a + 1).otherwise(a).cast("string"), 3, "0"),
        F.lpad((F.call_function("div", rest, F.lit(9_999)) + 1).cast("string"), 2, "0"),
        F.lpad((rest % 9_999 + 1).cast("string"), 4, "0"))
    return F.when(valid, out).otherwise(x)


def _date(x: Column, key: str) -> Column:
    first = F.to_date(F.lit(CYCLE_START))

    def moved(fmt: str) -> Column:
        day = F.datediff(F.try_to_timestamp(x, F.lit(fmt)).cast("date"), first)
        new = feistel(day, F.lit(189), F.lit(773), key, "date")
        return F.when((day >= 0) & (day < CYCLE_DAYS), F.date_format(F.date_add(first, new.cast("int")), fmt))

    def moved_late() -> Column:
        """A date that is only mm/dd/yyyy, as its day is after the 12th: permuted
        among such days, so the result cannot be read as, or meet, a dd/mm/yyyy."""
        date = F.try_to_timestamp(x, F.lit("MM/dd/yyyy")).cast("date")
        day = F.datediff(date, first)
        month = (F.year(date) - 1800) * 12 + F.month(date) - 1
        # 12 days of this month and of every month before are left out
        new = feistel(day - 12 * (month + 1), F.lit(9), F.lit(9_833), key, "late date")
        start = lambda m: F.datediff(F.add_months(first, m), first)
        guess = F.floor(new * CYCLE_MONTHS / LATE_DAYS).cast("int")
        # months differ by 3 days: the right one is beside the guess
        found = F.array_max(F.filter(F.sequence(guess - 2, guess + 2), lambda m: start(m) - 12 * m <= new))
        return F.when((day >= 0) & (day < CYCLE_DAYS) & (F.dayofmonth(date) > 12), F.date_format(
            F.date_add(first, (new + 12 * (found + 1)).cast("int")), "MM/dd/yyyy"))

    return F.coalesce(
        F.when(F.substr(x, F.lit(5), F.lit(1)) == "-", moved("yyyy-MM-dd"))
        .otherwise(F.coalesce(moved("dd/MM/yyyy"), moved_late())), x)


def _email(x: Column, key: str) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(x)), 256), 1, 12),
                    F.lit("@example.invalid"))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate; the candidate itself where it is not valid."""
    whole = lambda p: value.rlike(rf"\A(?:{p})\z")
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(whole(DATE), _date(value, key)).when(whole(SSN), _ssn(value, key))
        .when(whole(IPV4), _ipv4(value, key)).when(whole(PHONE), _phone(value, key))
        .otherwise(_card(value, key)))


def _pattern(text: Column) -> Column:
    """The pattern of a text's values: all kinds, and its spans with a Luhn sum of 0."""
    spans = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CARD_SPANS])
    cards = F.filter(F.array_distinct(spans), lambda x: _luhn_sum(_digits(x), False) % 10 == 0)
    cards = F.when(text.rlike(CARD), cards)
    return F.when(F.size(cards) > 0, F.concat(
        F.lit(NOT_CARD + "|(?<![0-9A-Za-z])(?:"), F.array_join(cards, "|"), F.lit(")(?![0-9A-Za-z])"))).otherwise(F.lit(NOT_CARD))


def _replaced(text: Column, key: str) -> Column:
    """struct(text, n, kinds of values changed) of a text with a hint in it."""
    pattern = _pattern(text)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    rest = F.split(text, pattern, -1)
    new = F.transform(found, lambda m: pseudonym(m, key))
    return F.struct(
        F.concat(rest[0], F.array_join(F.zip_with(new, F.slice(rest, 2, F.greatest(F.size(found), F.lit(1))),
                                                  lambda a, b: F.concat(a, b)), "")).alias("text"),
        F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda d: d)).alias("n"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced under ``key``, which
    must not be empty; ``count_col``, if given, gets the number of values replaced.

    Null texts stay null with count 0; a text without personal data is returned
    as it is; very long texts and very many values in one text are fine; repeated
    rows get equal results; other columns are kept (one called like ``count_col``
    is replaced).  An empty table gives an empty result.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col)
    some = text.rlike(HINT) & text.rlike(ANY)
    out = docs.withColumn("__pii", F.when(some, _replaced(text, key)))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.col("__pii.n"), F.lit(0)))
    return out.withColumn(text_col, F.coalesce(F.col("__pii.text"), text)).drop("__pii")
