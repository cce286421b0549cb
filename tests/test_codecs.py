from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.functions import codecs as C


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "digits", "scale", "hexed"),
    [("123456.78", 9, 2, "012345678C"), ("-1.50", 5, 2, "00150D"), ("0", 4, 0, "00000C"), ("-0.001", 5, 2, "00000C"), ("1234567.89", 5, 2, "56789C")],
)
def test_packed(spark, value, digits, scale, hexed):
    data = C.encode_packed(F.lit(Decimal(value)), digits, scale)
    assert one(spark, F.hex(data)) == hexed
    if value not in ("-0.001", "1234567.89"):
        assert one(spark, C.decode_packed(data, digits, scale)) == Decimal(value)


def test_packed_sign_and_empty(spark):
    assert one(spark, C.decode_packed(F.unhex(F.lit("00123B")), 5)) == 123
    assert one(spark, C.decode_packed(F.unhex(F.lit("00123F")), 5)) == 123
    assert one(spark, C.decode_packed(F.unhex(F.lit("")), 5)) == 0


@pytest.mark.parametrize(("value", "size", "hexed"), [(-2, 2, "FFFE"), (258, 2, "0102"), (65536 + 7, 2, "0007"), (-1, 8, "FFFFFFFFFFFFFFFF")])
def test_binary(spark, value, size, hexed):
    data = C.encode_binary(F.lit(value), size)
    assert one(spark, F.hex(data)) == hexed
    if value != 65536 + 7:
        assert one(spark, C.decode_binary(data, size)) == value


def test_binary_unsigned_and_scaled(spark):
    assert one(spark, C.decode_binary(F.unhex(F.lit("FFFE")), 2, signed=False)) == 65534
    assert one(spark, C.decode_binary(F.unhex(F.lit("FFFE")), 2, scale=1)) == Decimal("-0.2")


@pytest.mark.parametrize("value", [0.0, 1.0, -2.5, 123.456, 1e-3, -1e10])
def test_floats(spark, value):
    import struct

    assert one(spark, C.decode_float(F.unhex(F.lit(struct.pack(">d", value).hex())), 8)) == value
    assert one(spark, C.decode_float(F.unhex(F.lit(struct.pack(">f", value).hex())), 4)) == struct.unpack(">f", struct.pack(">f", value))[0]


@pytest.mark.parametrize(("value", "digits", "signed", "hexed"), [(-123, 3, True, "F1F2D3"), (123, 3, True, "F1F2C3"), (12345, 5, False, "F1F2F3F4F5")])
def test_zoned(spark, value, digits, signed, hexed):
    data = C.encode_zoned(F.lit(value).cast("decimal(9,0)"), digits, 0, signed)
    assert one(spark, F.hex(data)) == hexed
    assert one(spark, C.decode_zoned(data, digits, 0, signed)) == value


def test_zoned_ascii(spark):
    assert one(spark, C.decode_zoned(F.unhex(F.lit("313233")), 3)) == 123


def test_overpunch(spark):
    assert one(spark, C.decode_overpunch(F.lit("12L"), 3)) == -123
    assert one(spark, C.decode_overpunch(F.lit("12M"), 3)) == -124
    assert one(spark, C.decode_overpunch(F.lit("12C"), 3)) == 123
    assert one(spark, C.decode_overpunch(F.lit("}23"), 3, leading=True)) == -23


@pytest.mark.parametrize("page", [range(256)])
def test_ebcdic_round_trip(spark, page):
    text = "".join(map(chr, range(1, 256)))
    assert one(spark, C.decode_ebcdic(C.encode_ebcdic(F.lit(text)), trim=False)) == text
    assert one(spark, F.hex(C.encode_ebcdic(F.lit("A1[^"), 6))) == "C1F1AD5F4040"


@pytest.mark.parametrize(
    ("value", "picture", "text"),
    [
        ("1234.50", "ZZ,ZZ9.99", " 1,234.50"), ("0", "ZZZ9", "   0"), ("7", "ZZZZ", "   7"), ("-12.3", "---9.99", " -12.30"), ("12.3", "---9.99", "  12.30"), ("1234.5", "$$,$$9.99", "$1,234.50"),
        ("5", "$$,$$9.99", "    $5.00"), ("-5", "**9.99CR", "**5.00CR"), ("5", "**9.99CR", "**5.00  "), ("-5", "999.99-", "005.00-"), ("20240131", "9999/99/99", "2024/01/31"), ("42", "+ZZ9", "+ 42"),
    ],
)
def test_edited(spark, value, picture, text):
    assert one(spark, C.edited(F.lit(Decimal(value)), picture)) == text


def test_blank_when_zero(spark):
    assert one(spark, C.edited(F.lit(Decimal("0")), "ZZ9.99", blank_when_zero=True)) == "      "
