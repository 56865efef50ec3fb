"""Cells of a change log from their text form, as expressions that refuse instead of guessing.

``decoded`` gives the value of a legal text and null for any other; ``decode`` names
the first cell of a row that isn't null and can't be decoded.  Infinite dates and
timestamps, numbers with white space around them, digits beyond a scale and values
outside a type's range are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scalars import DAY_MICROS

#: Finite dates of the source, as days since 1970, and finite timestamps, as microseconds since 1970.
FIRST_DAY, LAST_DAY = 10_957 - 2_451_545, 10_957 + 2_145_031_949
FIRST_MICROS, LAST_MICROS = -210_866_803_200_000_000 + 946_684_800_000_000, 9_223_371_331_200_000_000
#: The kinds, with the Spark types they become.
KINDS = {
    "bool": "boolean", "int2": "int", "int4": "int", "int8": "bigint", "float4": "double", "float8": "double", "text": "string", "bytea": "binary",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "uuid": "string",
}
DATE = r"^([0-9]{4,7})-([0-9]{2})-([0-9]{2})( BC)?$"
STAMP = r"^([0-9]{4,7}-[0-9]{2}-[0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?"
OFFSET = r"([+-][0-9]{2}(?::[0-9]{2}(?::[0-9]{2})?)?)"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of a match as a number; null where it doesn't match or is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("bigint")


def days_of(text: Column) -> Column:
    """Days since 1970 of a date of any year, ``BC`` included; null for other text and for days that don't exist."""

    def days(d: Column) -> Column:
        year, month, day = F.when(d["era"] != "", 1 - d["year"]).otherwise(d["year"]), d["month"], d["day"]
        # Years count from March, so that the leap day is the last of its year.
        shifted = year - (month <= 2).cast("long")
        cycle = F.floor(shifted / 400)
        of_cycle = shifted - cycle * 400
        of_year = F.floor((153 * ((month + 9) % 12) + 2) / 5) + day - 1
        found = cycle * 146_097 + of_cycle * 365 + F.floor(of_cycle / 4) - F.floor(of_cycle / 100) + of_year - 719_468
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        longest = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when(d["year"].between(1, 5_900_000) & month.between(1, 12) & day.between(1, longest), found)

    names = F.struct(*[part(text, DATE, i).alias(n) for i, n in enumerate(("year", "month", "day"), 1)], F.regexp_extract(text, DATE, 4).alias("era"))
    return bound(bound(names, days), lambda d: F.when((d >= FIRST_DAY) & (d < LAST_DAY), d))


def offset_seconds(text: Column) -> Column:
    """Seconds of an offset such as ``+02``, ``-03:30`` or ``+00:19:32``; null beyond 15 hours and for other text."""
    pieces = F.split(F.substring(text, 2, 8), ":")
    hours, minutes, seconds = pieces[0].try_cast("bigint"), F.coalesce(F.get(pieces, 1).try_cast("bigint"), F.lit(0)), F.coalesce(F.get(pieces, 2).try_cast("bigint"), F.lit(0))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(text.rlike(f"^{OFFSET}$") & (hours <= 15) & (minutes <= 59) & (seconds <= 59), sign * (hours * 3600 + minutes * 60 + seconds))


def micros_of(text: Column, zoned: bool) -> Column:
    """Microseconds since 1970 of a timestamp, with an offset if ``zoned``; null for other text."""
    pattern = STAMP + (OFFSET if zoned else "()") + "( BC)?$"

    def micros(p: Column) -> Column:
        # Days of the farthest years times microseconds leave 64 bits.
        found = p["days"].cast("decimal(38,0)") * DAY_MICROS + ((p["hour"] * 3600 + p["minute"] * 60 + p["second"] - p["shift"]) * 1_000_000 + p["fraction"]).cast("decimal(38,0)")
        return F.when((p["hour"] <= 23) & (p["minute"] <= 59) & (p["second"] <= 59), found)

    pieces = F.struct(
        days_of(F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 7))).alias("days"), *[part(text, pattern, i).alias(n) for i, n in ((2, "hour"), (3, "minute"), (4, "second"))],
        F.rpad(F.regexp_extract(text, pattern, 5), 6, "0").try_cast("bigint").alias("fraction"), (offset_seconds(F.regexp_extract(text, pattern, 6)) if zoned else F.lit(0)).alias("shift"),
    )
    return bound(bound(pieces, micros), lambda m: F.when((m >= FIRST_MICROS) & (m < LAST_MICROS), m.cast("bigint")))


def naive(micros: Column) -> Column:
    """A timestamp without a zone, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(micros).cast("timestamp_ntz"))


def decoded(kind: str, text: Column) -> Column:
    """The value of a cell of this kind; ``numeric(p,s)`` besides :data:`KINDS`."""
    whole, real = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    if kind == "text":
        return text
    if kind == "bool":
        return F.when(text == "t", True).when(text == "f", False)
    if kind in ("int2", "int4", "int8"):
        number = F.when(text.rlike(whole), text.try_cast(KINDS[kind]))
        return F.when(number.between(-32_768, 32_767), number) if kind == "int2" else number
    if kind in ("float4", "float8"):
        named = text.isin("NaN", "Infinity", "-Infinity")
        number = F.when(named | text.rlike(real), text.try_cast("float" if kind == "float4" else "double")).cast("double")
        # A finite text beyond the type's range isn't infinity.
        return F.when(named | (F.abs(number) < F.lit(float("inf"))), number)
    if kind == "bytea":
        return F.when(text.rlike(r"^\\x([0-9a-fA-F]{2})*$"), F.unhex(F.substr(text, F.lit(3))))
    if kind == "date":
        return F.date_from_unix_date(days_of(text).cast("int"))
    if kind == "timestamptz":
        return F.timestamp_micros(micros_of(text, True))
    if kind == "timestamp":
        return naive(micros_of(text, False))
    if kind == "uuid":
        plain = F.lower(F.regexp_replace(text, r"^\{(.*)\}$|^urn:uuid:", "$1"))
        shape = "[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}"
        canonical = F.regexp_replace(F.regexp_replace(plain, "-", ""), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return F.when(plain.rlike(f"^{shape}$") & F.length(plain).isin(32, 36), canonical)
    if kind.startswith("numeric("):
        scale = int(kind[:-1].split(",")[1])
        return F.when(text.rlike(rf"^[+-]?[0-9]+(\.[0-9]{{0,{scale}}}0*)?$"), text.try_cast(kind.replace("numeric", "decimal")))
    raise ValueError(f"unknown kind {kind}")


def decode(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as values, with ``fault``: the first column whose text isn't null and can't be decoded; such a row keeps no cell."""
    values = rows.withColumns({f"_{c}": decoded(kind, F.col(c)) for c, kind in kinds.items()})
    wrong = [F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), F.lit(c)) for c in kinds]
    found = values.withColumn("fault", F.coalesce(*wrong, F.lit(None).cast("string")))
    return found.withColumns({c: F.when(F.col("fault").isNull(), F.col(f"_{c}")) for c in kinds}).drop(*[f"_{c}" for c in kinds])
