"""Personal data as format-preserving pseudonyms: keyed Feistel permutations, so equal values stay equal across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the 400 years from 1800 on, after which the calendar repeats: 189 * 773.
DAYS_A, DAYS_B, FIRST_YEAR, FIRST_DAY = 189, 773, 1800, "1800-01-01"
#: Those of them from the 13th of a month on, 221 a year and one more in a leap year: 9 * 9833. Only these read month first.
LATE_A, LATE_B, LATE_DAY = 9, 9833, 13

#: Patterns by kind. Runs of word characters, dots or signs around a match rule it out, so no part of a longer number is one.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\w)|(?<![\w+])\+[1-9](?:[ .()-]{0,2}\d){7,14}(?!\w)",
    "date": r"(?<![\w.-])(?:(?:18|19|20|21)\d{2}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2(?:18|19|20|21)\d{2})(?:(?![\w-])|(?=T\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
KINDS = tuple(PATTERNS)
#: All in one; only dates have groups, so their back references keep their numbers.
_ANY = "|".join(PATTERNS.values())


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(key: str, kind: str, k: int, value: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}/{kind}/{k}/"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(14)), 16, 10).cast("long"), modulus)


def _round(a: Column, b: Column, key: str, kind: str, k: int, sign: int):
    if k % 2 == 0:
        return lambda p: F.struct(F.pmod(p["l"] + sign * _step(key, kind, k, p["r"], a), a).alias("l"), p["r"].alias("r"))
    return lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + sign * _step(key, kind, k, p["l"], b), b).alias("r"))


def feistel(value: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of 0 .. a * b - 1: rounds add a hash of one half to the other, modulo its own size. back: its inverse."""
    pair = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        pair = _let(pair, _round(a, b, key, kind, k, -1 if back else 1))
    return _let(pair, lambda p: p["l"] * b + p["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """Digits as other digits of the same number; up to 18 of them."""
    n = F.length(digits)
    high = F.ceil(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), _ten(high), _ten(n - high), key, kind, back).cast("string"), n, "0")


def into_format(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, one by one, by the given ones."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    step = lambda s, c: F.when(c.between("0", "9"), F.struct((s["k"] + 1).alias("k"), F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"))).otherwise(F.struct(s["k"].alias("k"), F.concat(s["out"], c).alias("out")))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The checksum of card numbers: every second digit from the right, the last one left out, counts twice, less 9 above 9."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(each, lambda c, k: F.when(k % 2 == 0, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))), F.lit(0), lambda s, x: s + x)


def _card(text: Column, key: str, back: bool) -> Column:
    """First digit kept, the others permuted, the last one made to fit the checksum."""
    d = _digits(text)
    inner = permuted_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", back)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), inner)
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    return into_format(text, F.concat(body, check.cast("string")))


def _day(text: Column) -> Column:
    """The date of either order of its numbers, null if the calendar has none: year first, else day before month, else month before day."""
    t = F.regexp_replace(text, "[/.]", "-")
    year_first = F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date")
    other = lambda f: F.try_to_timestamp(t, F.lit(f)).cast("date")
    return F.when(t.rlike(r"^\d{4}"), year_first).otherwise(F.coalesce(other("dd-MM-yyyy"), other("MM-dd-yyyy")))


def _leap_years(year: Column) -> Column:
    """Leap years from FIRST_YEAR up to year, which is left out."""
    before = lambda y: F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
    return before(year - 1) - before(F.lit(FIRST_YEAR - 1))


def late_rank(day: Column) -> Column:
    """How many days from the 13th of a month on come before day, itself one, in the 400 years."""
    months = (F.year(day) - FIRST_YEAR) * 12 + F.month(day)
    return (F.datediff(day, F.lit(FIRST_DAY).cast("date")) - (LATE_DAY - 1) * months).cast("long")


def late_day(rank: Column) -> Column:
    """The day of a late_rank."""
    before = lambda y: (LATE_B * LATE_A // 400) * (y - FIRST_YEAR) + _leap_years(y)
    guess = F.floor(rank * 400 / (LATE_A * LATE_B)) + FIRST_YEAR
    year = lambda y: F.when(before(y) > rank, y - 1).when(before(y + 1) <= rank, y + 1).otherwise(y)

    def within(y: Column) -> Column:
        starts = [F.lit(0)]
        for month in range(1, 12):
            starts.append(starts[-1] + F.day(F.last_day(F.make_date(y.cast("int"), F.lit(month), F.lit(1)))) - (LATE_DAY - 1))
        k = rank - before(y)
        return _let(F.filter(F.array(*starts), lambda s: s <= k), lambda s: F.make_date(y.cast("int"), F.size(s), (k - F.element_at(s, -1) + LATE_DAY).cast("int")))

    return _let(_let(guess, year), within)


def _date(text: Column, key: str, back: bool) -> Column:
    """Another day in the same notation: year first and day first share a permutation of all days of the 400 years; month first has one of those days that can't be read day first."""
    t = F.regexp_replace(text, "[/.]", "-")
    first = F.lit(FIRST_DAY).cast("date")
    long = lambda n: F.lit(n).cast("long")
    any_day = _let(feistel(F.datediff(_day(text), first).cast("long"), long(DAYS_A), long(DAYS_B), key, "date", back), lambda n: F.date_add(first, n.cast("int")))
    late = _let(feistel(late_rank(_day(text)), long(LATE_A), long(LATE_B), key, "date-month-first", back), late_day)
    written = (
        F.when(t.rlike(r"^\d{4}"), F.date_format(any_day, "yyyyMMdd"))
        .when(F.try_to_timestamp(t, F.lit("dd-MM-yyyy")).isNotNull(), F.date_format(any_day, "ddMMyyyy"))
        .otherwise(F.date_format(late, "MMddyyyy"))
    )
    return into_format(text, written)


def _phone(text: Column, key: str, back: bool) -> Column:
    """North American numbers move among all with area and exchange codes from 200 on, others in their last six digits; country codes stay."""
    d = _digits(text)
    n = F.length(d)
    half = F.lit(80_000).cast("long")
    part = lambda at, size: F.substr(d, at, F.lit(size)).cast("long")
    value = ((part(n - 9, 3) - 200) * 800 + part(n - 6, 3) - 200) * 10_000 + part(n - 3, 4)
    spelled = lambda v: F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(v / 10_000), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(v, F.lit(10_000)).cast("string"), 4, "0"))
    whole = F.concat(F.substr(d, F.lit(1), n - 10), _let(feistel(value, half, half, key, "phone", back), spelled))
    rest = F.concat(F.substr(d, F.lit(1), n - 6), permuted_digits(F.substr(d, n - 5, F.lit(6)), key, "phone", back))
    american = ((n == 10) | ((n == 11) & d.startswith("1"))) & F.substr(d, n - 9, F.lit(1)).between("2", "9") & F.substr(d, n - 6, F.lit(1)).between("2", "9")
    return into_format(text, F.when(american, whole).otherwise(rest))


def _ip(text: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("long"))
    whole = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    half = F.lit(65536).cast("long")
    return _let(feistel(whole, half, half, key, "ip", back), lambda v: F.concat_ws(".", *(F.pmod(F.floor(v / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0))))


def _email(text: Column, key: str, back: bool) -> Column:
    """Not a number: the name becomes a keyed hash under a reserved domain, without a way back."""
    return F.concat(F.lit("u"), F.substr(F.sha2(F.concat(F.lit(f"{key}/email/"), F.lower(text)), 256), F.lit(1), F.lit(12)), F.lit("@mail.invalid"))


def kind_of(match: Column) -> Column:
    """Index into KINDS of a match that its kind's checks accept, else null: numbers have checksums or ranges, dates a calendar."""
    d = _digits(match)
    is_a = lambda k: match.rlike(f"^(?:{PATTERNS[k]})$")
    octets = F.forall(F.split(match, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    ssn = ~F.substr(d, F.lit(1), F.lit(3)).isin("000", "666") & ~d.startswith("9") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6), F.lit(4)) != "0000")
    return (
        F.when(match.contains("@"), 0)
        .when(is_a("date") & _day(match).isNotNull(), 2)
        .when(is_a("ssn") & ssn, 3)
        .when(is_a("ip") & octets, 4)
        .when(is_a("card") & (luhn_sum(d) % 10 == 0), 5)
        .when(is_a("phone"), 1)
    )


def shorter_card(match: Column) -> Column:
    """(before, value) of the longest run of whole digit groups, the first of equals, that is a card number in a match which is none; null without one."""
    groups = F.split(match, r"(?<=[ -])")
    said = lambda g, at, n: F.array_join(F.slice(g, at, n), "")
    runs = lambda g: F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: F.transform(F.sequence(F.lit(1), F.size(g) - i + 1), lambda n: F.struct((-i).alias("at"), said(g, F.lit(1), i - 1).alias("before"), F.regexp_replace(said(g, i, n), "[ -]$", "").alias("value")))))
    sized = F.transform(_let(groups, runs), lambda x: F.struct(F.length(_digits(x["value"])).alias("n"), x["at"].alias("at"), x["before"].alias("before"), x["value"].alias("value")))
    return F.array_max(F.filter(sized, lambda x: F.when(x["n"].between(13, 19), luhn_sum(_digits(x["value"])) % 10 == 0).otherwise(F.lit(False))))


def pseudonym(match: Column, kind: Column, key: str, back: bool = False) -> Column:
    ssn = into_format(match, permuted_digits(_digits(match), key, "ssn", back))
    forms = (_email(match, key, back), _phone(match, key, back), _date(match, key, back), ssn, _ip(match, key, back), _card(match, key, back))
    out = match
    for k, form in enumerate(forms):
        out = F.when(kind == k, form).otherwise(out)
    return out


_FOUND = "array<struct<kind:int,start:bigint,end:bigint,value:string,pseudonym:string>>"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, found) for each row: the whole text with each valid item replaced, and the items.

    found has kind (index into KINDS), start and end in code points of the input, value and pseudonym. Equal values
    have equal pseudonyms under one key, whatever the document; different values of one notation have different ones
    (but for e-mail addresses, which are hashed to 48 bits). What only looks like an item stays as it is. A null text
    stays null and has none, an empty table gives none; ids may be null, equal rows give equal rows, other columns are
    not read. Nothing is shuffled. Who has the key can undo all but e-mail addresses: pseudonym(..., back=True).
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    none = F.array().cast(_FOUND)
    has = F.col("text").rlike("[0-9@]") & F.col("text").rlike(_ANY)
    slim = slim.withColumn("gap", F.when(has, F.split("text", _ANY, -1))).withColumn("m", F.when(has, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))))
    slim = slim.withColumn("m", F.transform("m", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind"))))
    slim = slim.withColumn("m", F.transform("m", lambda m: F.struct(m["value"].alias("whole"), m["kind"].alias("kind"), F.when(m["kind"].isNull() & m["value"].rlike(f"^(?:{PATTERNS['card']})$"), shorter_card(m["value"])).alias("card"))))
    slim = slim.withColumn("m", F.transform("m", lambda m: F.struct(F.coalesce(m["card"]["before"], F.lit("")).alias("before"), F.coalesce(m["card"]["value"], m["whole"]).alias("value"), F.when(m["card"].isNotNull(), KINDS.index("card")).otherwise(m["kind"]).alias("kind"), m["whole"].alias("whole"))))
    after = lambda m: F.substr(m["whole"], F.length(m["before"]) + F.length(m["value"]) + 1, F.length(m["whole"]))
    slim = slim.withColumn("m", F.transform("m", lambda m: F.struct(m["before"].alias("before"), m["value"].alias("value"), m["kind"].alias("kind"), after(m).alias("after"), F.when(m["kind"].isNull(), m["value"]).otherwise(pseudonym(m["value"], m["kind"], key)).alias("pseudonym"))))
    text = F.when(F.col("gap").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.zip_with("gap", "m", lambda g, m: F.array(g, *(F.coalesce(m[k], F.lit("")) for k in ("before", "pseudonym", "after"))))), ""))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def step(s, x):
        begin = s["at"] + F.length(x["gap"]) + F.length(x["m"]["before"])
        end = begin + F.length(x["m"]["value"])
        item = F.array(F.struct(x["m"]["kind"].cast("int").alias("kind"), begin.alias("start"), end.alias("end"), x["m"]["value"].alias("value"), x["m"]["pseudonym"].alias("pseudonym"))).cast(_FOUND)
        return F.struct((end + F.length(x["m"]["after"])).alias("at"), F.when(x["m"]["kind"].isNotNull(), F.concat(s["found"], item)).otherwise(s["found"]).alias("found"))

    found = F.when(F.col("gap").isNull(), none).otherwise(F.aggregate(F.arrays_zip("gap", "m"), start, step, lambda s: s["found"]))
    return slim.select("doc_id", text.alias("text"), found.alias("found"))

