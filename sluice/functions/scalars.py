"""Scalar functions over columns: log positions, times, dates, type modifiers, keys, fingerprints.

All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def lsn_text(lsn: Column) -> Column:
    """A log position as ``HI/LO`` in upper-case hexadecimal."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def lsn_value(text: Column) -> Column:
    """The inverse of :func:`lsn_text`."""
    part = F.split(text, "/")
    return F.shiftleft(F.conv(part[0], 16, 10).cast("long"), 32) + F.conv(part[1], 16, 10).cast("long")


def time_text(micros: Column) -> Column:
    """Microseconds of a day, 24:00:00 included, as ``HH:MM:SS.ffffff``; others raise."""
    legal = micros.between(0, DAY_MICROS)
    text = F.format_string(
        "%02d:%02d:%02d.%06d", F.floor(micros / 3_600_000_000), F.floor(micros / 60_000_000) % 60, F.floor(micros / 1_000_000) % 60, micros % 1_000_000
    )
    return F.when(micros.isNull() | legal, text).otherwise(F.raise_error(F.lit("time outside 00:00:00..24:00:00")))


def date_text(days: Column) -> Column:
    """Days since 1970 as a proleptic Gregorian date of any year; years outside 0..9999 carry a sign."""
    # The calendar repeats after 146,097 days, 400 years: Spark's own dates name the day in a cycle it can express.
    since = days.cast("long") - F.datediff(F.lit("2000-01-01").cast("date"), F.lit("1970-01-01").cast("date"))
    cycle = F.floor(since / 146_097)
    day_of = F.date_add(F.lit("2000-01-01").cast("date"), (since - cycle * 146_097).cast("int"))
    year, month, day = F.year(day_of) + cycle * 400, F.month(day_of), F.day(day_of)
    plain = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(0, 9999), plain).otherwise(F.format_string("%+05d-%02d-%02d", year, month, day))


def timestamp_text(micros: Column, zone: str = "") -> Column:
    """Microseconds since 1970 as ISO text; before 1970 the time of day stays positive."""
    days = F.floor(micros / DAY_MICROS)
    return F.concat(date_text(days), F.lit("T"), time_text(micros - days * DAY_MICROS), F.lit(zone))


def numeric_type(modifier: Column) -> Column:
    """The column type of a numeric with this type modifier: ``decimal(p,s)`` or ``string``."""
    packed = modifier - 4
    precision = F.shiftright(packed, 16).bitwiseAND(F.lit(0xFFFF))
    scale = packed.bitwiseAND(F.lit(0x7FF)).bitwiseXOR(F.lit(1024)) - 1024
    fits = (modifier >= 4) & precision.between(1, 38) & (scale >= 0) & (scale <= precision)
    return F.when(fits, F.format_string("decimal(%d,%d)", precision, scale)).otherwise("string")


def numeric_text(value: Column) -> Column:
    """Numeric text without needless zeros: ``1.50`` is ``1.5``, ``-0.0`` is ``0``; NaN and infinities stay."""
    text = F.regexp_replace(F.trim(value), r"^\+", "")
    text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"^(-?)0+(?=[0-9])", "$1"), r"^(-?)\.", "$10.")
    return F.when(text.isin("-0", "", "-"), "0").otherwise(text)


def uuid_text(value: Column) -> Column:
    """A uuid in its canonical lower-case form; other text raises."""
    plain = F.lower(F.regexp_replace(value, r"^\{(.*)\}$|^urn:uuid:", "$1"))
    digits = F.regexp_replace(plain, "-", "")
    canonical = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    legal = digits.rlike("^[0-9a-f]{32}$") & plain.isin(digits, canonical)
    return F.when(value.isNull() | legal, canonical).otherwise(F.raise_error(F.lit("not a uuid")))


def vector_json(vector: Column, most: int = 16_000) -> Column:
    """A vector as a JSON array, each float promoted to double; empty, too long or non-finite ones raise."""
    size = F.size(vector)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    text = F.to_json(vector.cast("array<double>"))
    return F.when(vector.isNull(), F.lit(None)).when(size.between(1, most) & finite, text).otherwise(F.raise_error(F.lit("vector elements must be finite and 1 to 16000")))


def array_json(array: Column, element: str) -> Column:
    """An array as JSON text: nulls kept, bytes in base64, dates and timestamps as ISO text."""
    shown = {"binary": F.base64, "date": lambda x: date_text(F.datediff(x, F.lit("1970-01-01").cast("date"))), "timestamp_ntz": lambda x: timestamp_text(F.unix_micros(x.cast("timestamp")))}
    made = F.transform(array, shown[element]) if element in shown else array
    return F.to_json(made, {"ignoreNullFields": "false"})


def framed(column: Column) -> Column:
    """Length and text of a value, so that neighbouring values can't run into each other; null is its own frame."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def key_text(*keys: Column) -> Column:
    """The canonical identity of a key."""
    return F.concat(F.lit("1|"), *[framed(k) for k in keys])


def fingerprint(*columns: Column) -> Column:
    """A digest of a row that nulls appended at its end don't change, so it survives added columns."""
    frames = F.concat_ws("|", *[framed(c) for c in columns])
    return F.sha2(F.regexp_replace(frames, r"(^|\|)~(\|~)*$", ""), 256)


def epoch_id(source: Column, table: Column, first: Column, last: Column) -> Column:
    """The deterministic id of an epoch: equal for the same source, table and range of log positions."""
    return F.sha2(F.concat_ws("|", framed(source), framed(table), framed(first), framed(last)), 256)


def widened_xid(xid: Column, now: Column) -> Column:
    """A 32-bit transaction id in the 64-bit space of ``now``: the newest value that isn't after it."""
    guess = now.bitwiseAND(F.lit(-1 << 32).cast("long")) + xid
    return F.when(guess > now, guess - (1 << 32)).otherwise(guess)


def file_level(path: Column, summary_level: Column, operation: Column) -> Column:
    """The level of a data file from its name, else from its snapshot's summary; unknown writers start at 1."""
    named = F.regexp_extract(path, r"(?:^|/)sluice-l([012])-[A-Za-z0-9_-]+-data-[0-9]{6,}\.parquet$", 1)
    said = F.regexp_extract(summary_level, "^L([012])$", 1)
    return F.coalesce(F.when(named != "", named.cast("int")), F.when(said != "", said.cast("int")), F.when(operation == "ingest", 0), F.lit(1))


def log_health(retained: Column, journal: Column, safe: Column, lost: Column, soft: int, hard: int, quota: int) -> Column:
    """The health of a source by retained log, journal size and the room that is left (null: unlimited)."""
    budget = retained.cast("decimal(38,0)") + safe.cast("decimal(38,0)")
    risk = (retained >= hard) | (journal >= quota) | F.coalesce((safe == 0) | (safe * 10 <= budget), F.lit(False))
    warning = (retained >= soft) | (journal >= quota * 4 // 5) | F.coalesce(safe * 4 <= budget, F.lit(False))
    return F.when(lost, "slot_lost").when(risk, "at_risk").when(warning, "warning").otherwise("healthy")
