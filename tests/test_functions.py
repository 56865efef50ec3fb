import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.functions import decode, scalars, texts


def value(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_times(spark):
    assert value(spark, scalars.time_text(F.col("m")), m=86_400_000_000) == "24:00:00.000000"
    assert value(spark, scalars.time_text(F.col("m")), m=3_723_000_004) == "01:02:03.000004"
    with pytest.raises(Exception, match="outside"):
        value(spark, scalars.time_text(F.col("m")), m=-1)


def test_dates_far_away(spark):
    days = [0, -719_528, -719_529, 2_932_896, 2_932_897, 19_000, -1]
    got = [r.x for r in spark.createDataFrame([(d,) for d in days], "d long").select(scalars.date_text(F.col("d")).alias("x")).collect()]
    assert got[:5] == ["1970-01-01", "0000-01-01", "-0001-12-31", "9999-12-31", "+10000-01-01"]
    assert got[5:] == [(datetime.date(1970, 1, 1) + datetime.timedelta(d)).isoformat() for d in days[5:]]


@pytest.mark.parametrize("text, plain", [("1.50", "1.5"), ("-0.0", "0"), ("0010", "10"), (".5", "0.5"), ("NaN", "NaN"), ("100", "100"), ("1.", "1")])
def test_numbers(spark, text, plain):
    assert value(spark, scalars.numeric_text(F.col("t")), t=text) == plain
    if text != "NaN":
        assert texts.normalized_number(text) == plain


def test_numbers_of_any_precision():
    long = "1" * 60 + ".10"
    assert texts.normalized_number(long) == "1" * 60 + ".1" and texts.normalized_number("1E+3") == "1000" and texts.normalized_number(None) is None
    assert Decimal(texts.normalized_number("-1e-5")) == Decimal("-0.00001")


def test_json():
    assert texts.normalized_json(' {"b": 1.50, "a": [null, 12345678901234567890123], "b": "é"} ') == '{"a":[null,12345678901234567890123],"b":"é"}'
    assert texts.normalized_json(None) is None and texts.normalized_json("null") == "null"


def test_uuids(spark):
    assert value(spark, scalars.uuid_text(F.col("u")), u="A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11") == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    with pytest.raises(Exception, match="uuid"):
        value(spark, scalars.uuid_text(F.col("u")), u="xyz")


def test_vectors_must_be_finite(spark):
    df = spark.createDataFrame([([1.5, float("nan")],)], "v array<float>")
    with pytest.raises(Exception, match="finite"):
        df.select(scalars.vector_json(F.col("v"))).collect()


def test_fingerprints_and_keys_frame_values(spark):
    df = spark.createDataFrame([("a", "bc", None), ("ab", "c", None)], "x string, y string, z string")
    a, b = [r.f for r in df.select(scalars.fingerprint(F.col("x"), F.col("y"), F.col("z")).alias("f")).collect()]
    assert a != b
    short = df.select(scalars.fingerprint(F.col("x"), F.col("y")).alias("f")).first().f
    assert short == a


def test_lsn_round_trip(spark):
    assert value(spark, scalars.lsn_text(F.col("n")), n=(22 << 32) + 0xB374D848) == "16/B374D848"
    assert value(spark, scalars.lsn_value(F.col("t")), t="FFFFFFFF/FFFFFFFF") == -1


CELLS = {
    "bool": {"t": True, "f": False, "true": None, "": None},
    "int2": {"-32768": -32768, "32768": None, " 1": None, "+5": 5},
    "int4": {"2147483647": 2147483647, "2147483648": None, "1.0": None},
    "int8": {"9223372036854775807": 9223372036854775807, "9223372036854775808": None},
    "float4": {"0.5": 0.5, "1e39": None},
    "float8": {"-Infinity": float("-inf"), "inf": None, "1e999": None, ".5": 0.5},
    "bytea": {"\\x00fF": b"\x00\xff", "\\x0": None, "00": None},
    "date": {"2020-02-29": "2020-02-29", "1900-02-29": None, "infinity": None, "0044-03-15 BC": "-0043-03-15", "2020-13-01": None},
    "timestamp": {"2020-01-01 23:59:59.5": "2020-01-01 23:59:59.5", "2020-01-01 24:00:00": None, "-infinity": None},
    "timestamptz": {"2020-01-01 10:00:00.5+02": "2020-01-01 08:00:00.5", "2020-01-01 00:00:00-03:30": "2020-01-01 03:30:00", "2020-01-01 00:00:00": None, "2020-01-01 00:00:00+16": None},
    "uuid": {"{A0EEBC999C0B4EF8BB6D6BB9BD380A11}": "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "a0eebc99": None},
    "numeric(10,2)": {"1.500": Decimal("1.50"), "1.505": None, "123456789.00": None, "1e5": None, "NaN": None},
}


@pytest.mark.parametrize("kind", sorted(CELLS))
def test_cells_are_decoded_or_refused(spark, kind):
    shown = "string" if kind in ("date", "timestamp", "timestamptz") else None
    value = decode.decoded(kind, F.col("t"))
    rows = spark.createDataFrame([(t,) for t in (*CELLS[kind], None)], "t string").select("t", (value.cast(shown) if shown else value).alias("v")).collect()
    assert {r.t: r.v for r in rows} == {**CELLS[kind], None: None}


def test_rows_with_a_fault_keep_no_cell(spark):
    rows = spark.createDataFrame([("1", "2020-01-01"), ("x", "2020-01-01"), (None, "never"), (None, None)], "a string, b string")
    got = [(r.a, r.b and str(r.b), r.fault) for r in decode.decode(rows, {"a": "int4", "b": "date"}).collect()]
    assert got == [(1, "2020-01-01", None), (None, None, "a"), (None, None, "b"), (None, None, None)]
