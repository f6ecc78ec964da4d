"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import DUMMY_DATE, DUMMY_DATETIME, GATED

BILLION = 10**9


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def hashed_uid(value: Column, salt: Column) -> Column:
    """2.25. and the first 128 bits of SHA-256 of salt|value, in decimal."""
    made = lambda step, rest: let(step, lambda x: made(F.struct(*(of(x).alias(name) for name, of in rest[0].items())), rest[1:]) if rest else x["uid"])
    return made(F.struct(uid_digest(value, salt).alias("digest")), uid_steps())


def with_hashed_uid(df: DataFrame, value: Column, salt: Column, where: Column) -> DataFrame:
    """df with `uid`, the hashed_uid of a value where it is wanted (else null); its steps are columns, so that none is worked out twice."""
    out = df.withColumn("digest", F.when(where, uid_digest(value, salt)))
    last = ["digest"]
    for columns in uid_steps():
        out, last = out.select(*(c for c in out.columns if c not in last), *(made({c: F.col(c) for c in last}).alias(name) for name, made in columns.items())), list(columns)
    return out


def uid_digest(value: Column, salt: Column) -> Column:
    return F.sha2(F.concat(salt, F.lit("|"), value), 256)


def uid_steps() -> list[dict]:
    """From a digest to its first 128 bits in decimal.

    The number is four words of 32 bits, and 2**96, 2**64 and 2**32 are their
    digits in base 10**9.  The sums of what the words give to each such place
    fit a long, those carried from the place below included.
    """
    word = lambda k: lambda x: F.conv(F.substring(x["digest"], 8 * k + 1, 8), 16, 10).cast("long")
    place = lambda k, n: 2 ** (32 * k) // BILLION**n % (BILLION if n < 3 else BILLION**2)
    sum_of = lambda x, n: x["w3"] * F.lit(place(3, n)) + x["w2"] * F.lit(place(2, n)) + x["w1"] * F.lit(place(1, n))
    over, rest = lambda c: F.call_function("div", c, F.lit(BILLION).cast("long")), lambda c: c % F.lit(BILLION).cast("long")
    same = lambda *names: {n: lambda x, n=n: x[n] for n in names}

    def text(x) -> Column:
        digits = F.concat(x["p3"].cast("string"), F.lpad(x["p2"].cast("string"), 9, "0"), F.lpad(x["low"].cast("string"), 18, "0"))
        bare = F.when(x["p3"] != 0, digits).when(x["p3"] == 0, F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))
        return F.concat(F.lit("2.25."), bare)

    return [
        {"w3": word(0), "w2": word(1), "w1": word(2), "w0": word(3)},
        {**same("w3", "w2", "w1"), "p0": lambda x: sum_of(x, 0) + x["w0"]},
        {**same("w3", "w2", "w1", "p0"), "p1": lambda x: sum_of(x, 1) + over(x["p0"])},
        {**same("w3", "w2", "w1"), "low": lambda x: rest(x["p1"]) * F.lit(BILLION).cast("long") + rest(x["p0"]), "p2": lambda x: sum_of(x, 2) + over(x["p1"])},
        {"low": lambda x: x["low"], "p2": lambda x: rest(x["p2"]), "p3": lambda x: sum_of(x, 3) + over(x["p2"])},
        {"uid": text},
    ]


def safe_name(text: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.when(cleaned == "", "unnamed").otherwise(cleaned)


def norm_desc(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def number_text(value: Column) -> Column:
    """A number in six significant digits without trailing zeros; with an exponent below 0.0001 and from a million on."""
    number = value.cast("double")
    shown = F.format_string("%.5e", F.abs(number))
    digits = F.concat(F.substring(shown, 1, 1), F.substring(shown, 3, 5))
    power = F.substring_index(shown, "e", -1).try_cast("int")
    trimmed = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, F.lit(6)), F.lit("0"))
    spelt = F.concat(trimmed(F.substring(shown, 1, 7)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    plain = F.when((power < -4) | (power >= 6), spelt).when(power < 0, trimmed(small)).otherwise(trimmed(large))
    odd = F.when(F.isnan(number), "nan").when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf")).when(number == 0, "0")
    return F.when(number.isNotNull(), F.coalesce(odd, F.concat(F.when(number < 0, "-").otherwise(""), plain)))


def whole_text(text: Column) -> Column:
    """The whole part of a number in a text, of up to 38 digits, as text; null if there is none."""
    number = text.try_cast("double")
    return (number - number % 1).try_cast("decimal(38,0)").cast("string")


def shift_days(salt: Column, study_id: Column) -> Column:
    """A study's secret offset, 1 to 3650 days."""
    digest = F.sha2(F.concat(salt, F.lit("|dateshift|"), study_id), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 3650 + 1).cast("int")


def parsed_date(text: Column) -> Column:
    """The date that a text begins with, as eight digits; null if they are none. A cast, which takes a fraction of a pattern's time."""
    head = F.substring(F.trim(text), 1, 8)
    dashed = F.concat(F.substring(head, 1, 4), F.lit("-"), F.substring(head, 5, 2), F.lit("-"), F.substring(head, 7, 2))
    return F.when(head.rlike("^[0-9]{8}$"), dashed.try_cast("date"))


def written_date(date: Column) -> Column:
    """A date as eight digits; those before the year 1, which a cast may write with a sign, are left to the pattern."""
    return F.when(date >= F.lit("0001-01-01").cast("date"), F.replace(date.cast("string"), F.lit("-"), F.lit(""))).otherwise(F.date_format(date, "yyyyMMdd"))


def shift_da(value: Column, days: Column, fallback: str = DUMMY_DATE) -> Column:
    return F.coalesce(written_date(F.date_sub(parsed_date(value), days)), F.lit(fallback))


def shift_dt(value: Column, days: Column, fallback: str = DUMMY_DATETIME) -> Column:
    moved = written_date(F.date_sub(parsed_date(value), days))
    return F.coalesce(F.concat(moved, F.substring(F.trim(value), 9, 64)), F.lit(fallback))


def age_text(age: Column) -> Column:
    return F.upper(F.trim(F.coalesce(age, F.lit(""))))


def is_age(text: Column) -> Column:
    return text.rlike("^[0-9]{3}.$")


def seen_on(study: Column, series: Column) -> Column:
    return F.coalesce(F.nullif(study, F.lit("")), series)


def years_of(text: Column, born: Column, seen: Column) -> Column:
    """Years from an `age_text`, or else from dates of birth and study."""
    n, unit = F.substring(text, 1, 3).try_cast("int"), F.substring(text, 4, 1)
    years = F.year(seen) - F.year(born) - F.when(F.month(seen) * 100 + F.dayofmonth(seen) < F.month(born) * 100 + F.dayofmonth(born), 1).otherwise(0)
    stated = F.when(unit == "Y", n).when(unit == "M", F.floor(n / 12)).when(unit == "W", F.floor(n / 52)).when(unit == "D", F.floor(n / 365))
    return F.when(is_age(text), stated).otherwise(F.when((years >= 0) & (years < 130), years)).cast("int")


def age_years(age: Column, birth: Column, study: Column, series: Column) -> Column:
    """Years from an age string (years, months, weeks, days), or else from birth and study dates."""
    return years_of(age_text(age), parsed_date(birth), parsed_date(seen_on(study, series)))


def with_age_bucket(df: DataFrame, age: Column, birth: Column, study: Column, series: Column) -> DataFrame:
    """df with `bucket`, the age_bucket of its age_years; its steps are columns, so that none is worked out twice, and dates only where there is no age."""
    out = df.withColumn("said", age_text(age))
    out = out.withColumns({"birthday": F.when(~is_age(F.col("said")), parsed_date(birth)), "visit": F.when(~is_age(F.col("said")), parsed_date(seen_on(study, series)))})
    out = out.withColumn("years", years_of(F.col("said"), F.col("birthday"), F.col("visit"))).drop("said", "birthday", "visit")
    return out.withColumn("bucket", age_bucket(F.col("years"))).drop("years")


def age_bucket(years: Column) -> Column:
    return F.when(years.isNotNull(), F.concat(F.lpad(F.least(years - years % 5, F.lit(120)).cast("string"), 3, "0"), F.lit("Y")))


def nhs_valid(digits: Column) -> Column:
    """Whether ten digits end in their modulus-11 check digit."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda t, k: t + F.substr(digits, k, F.lit(1)).cast("int") * (11 - k))
    check = (11 - total % 11) % 11
    return digits.rlike("^[0-9]{10}$") & (check != 10) & (check == F.substring(digits, 10, 1).cast("int"))


def natural_key(text: Column) -> Column:
    """A key under which numbers inside names sort by value, whatever their length: a number is the count of its digits and then these."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(x)), "")


def gated_description(text: Column) -> Column:
    """Lower case, with gated acquisitions' names rewritten so that they don't look like snapshots."""
    return F.regexp_replace(F.lower(text), GATED, "ge_gated_cta")


def remap_path(path: Column, old: str, new: str) -> Column:
    """Move a path from one root to another; only at a separator."""
    old, new = old.rstrip("/\\"), new.rstrip("/\\")
    rest = F.ltrim(F.substring(path, len(old) + 1, 10**6), F.lit("/\\"))
    inside = path.startswith(old + "/") | path.startswith(old + "\\")
    return F.when(path == old, new + "/").when(inside, F.concat(F.lit(new + "/"), rest)).otherwise(path)


def file_name(study_id: Column, series: Column, instance: Column, counter: Column) -> Column:
    """ID_S001_I00001.dcm, or with a running number where there is no instance number."""
    return name_in(safe_name(study_id), F.coalesce(whole_text(series), F.lit("0")), whole_text(instance), counter)


def name_in(safe: Column, sno: Column, ino: Column, counter: Column) -> Column:
    """`file_name` where the ID is a safe name and the numbers are whole texts already."""
    return F.when(ino.isNotNull(), F.concat(safe, F.lit("_S"), padded(sno, 3), F.lit("_I"), padded(ino, 5), F.lit(".dcm"))).otherwise(F.concat(safe, F.lit("_"), padded(counter.cast("string"), 6), F.lit(".dcm")))


def padded(text: Column, width: int) -> Column:
    """A whole number's text with zeros to a width, after its sign."""
    digits = F.ltrim(text, F.lit("-"))
    room = F.greatest(F.length(digits), F.lit(width) - F.length(text) + F.length(digits))
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.lpad(digits, room, F.lit("0")))


def nice_date(text: Column) -> Column:
    return F.coalesce(F.date_format(parsed_date(text), "d MMM yyyy"), text)


def nice(value: Column, kind: Column) -> Column:
    """A header value as a person would read it; kind is name, date, sex, age or text."""
    v = F.trim(F.coalesce(value, F.lit("")))
    sex = F.when(F.upper(v) == "M", "male").when(F.upper(v) == "F", "female").when(F.upper(v) == "O", "other").otherwise(v)
    unit = F.substring(F.upper(v), 4, 1)
    word = F.when(unit == "Y", " years").when(unit == "M", " months").when(unit == "W", " weeks").when(unit == "D", " days").otherwise("")
    age = F.when(v.rlike("^[0-9]{3}.$"), F.concat(F.substring(v, 1, 3).try_cast("int").cast("string"), word)).otherwise(v)
    name = F.trim(F.regexp_replace(F.replace(v, F.lit("^"), F.lit(" ")), r"\s+", " "))
    return F.when(v == "", "").when(kind == "name", name).when(kind == "date", nice_date(v)).when(kind == "sex", sex).when(kind == "age", age).otherwise(v)


def redact_paths(text: Column) -> Column:
    """Home folders in log text, without the user's name."""
    return F.regexp_replace(F.regexp_replace(text, r"(/Users/|/home/)[^/\s]+", "$1<user>"), r"(?i)([A-Z]:\\Users\\)[^\\\s]+", "$1<user>")


def split_needles(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def profile_slug(name: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "-")), F.lit("-"))


def display_value(vr: Column, value: Column) -> Column:
    """A value as a comparison shows it, at most 80 characters."""
    return F.when(F.length(value) <= 80, value).otherwise(F.concat(F.substring(value, 1, 77), F.lit("...")))


def eta_text(elapsed: Column, fraction: Column) -> Column:
    left = elapsed * (1 - fraction) / fraction
    minutes = F.rint(left / 60).cast("long")
    known = (elapsed >= 8) & (fraction >= 0.03) & (fraction < 1)
    short = F.concat(F.lit("about "), F.greatest(F.lit(1), minutes).cast("string"), F.lit(" min left"))
    long = F.concat(F.lit("about "), F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min left"))
    return F.when(~known, "").when(left < 50, "under a minute left").when(minutes < 90, short).otherwise(long)
