"""Byte codecs of mainframe records as Column expressions. Everything here stays in generated JVM code.

Packed decimals (COMP-3), big-endian binaries (COMP), zoned digits, overpunched text, EBCDIC text and edited
numerics. Encoders keep the low-order digits of a value that is too large for its picture.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bytes whose characters differ between code pages 1047 and 037, as byte: code point in 1047.
DIFFERENT = {0x15: 0x0A, 0x25: 0x85, 0x5F: 0x5E, 0xAD: 0x5B, 0xB0: 0xAC, 0xBA: 0xDD, 0xBB: 0xA8, 0xBD: 0x5D}
EBCDIC_1047 = "".join(chr(DIFFERENT.get(b, ord(bytes([b]).decode("cp037")))) for b in range(256))
LATIN_1 = "".join(map(chr, range(256)))
#: The characters of Latin-1 whose low half is a digit, zone by zone.
ZONED = "".join(chr(16 * z + k) for z in range(16) for k in range(10))
#: Overpunched last characters of +0..+9 and -0..-9.
PLUS, MINUS = "{ABCDEFGHI", "}JKLMNOPQR"


def _zeros(text: Column, width: int) -> Column:
    """The last ``width`` characters, zero-padded on the left."""
    return F.right(F.concat(F.lit("0" * width), text), F.lit(width))


def _scaled(digits: Column, precision: int, scale: int, negative: Column | None = None) -> Column:
    """A string of digits as decimal(precision, scale). Every argument is used once, so nothing is worked out twice."""
    precision = max(precision, scale, 1)
    sign = [F.when(negative, "-").otherwise("")] if negative is not None else []
    text = _zeros(digits, precision)
    body = [F.overlay(text, F.lit("."), F.lit(precision - scale + 1), F.lit(0))] if scale else [text]
    return F.concat(*sign, *body).cast(f"decimal({precision},{scale})")


def _digits(value: Column, scale: int, width: int, exact: bool = False) -> Column:
    """The low-order ``width`` digits of |value| * 10^scale, zero-padded; fractions beyond the scale are truncated.

    exact: the value is a decimal of just this scale, so there is nothing to cut.
    """
    size = F.abs(value) if exact else F.floor(F.abs(value), F.lit(scale)).cast(f"decimal(38,{scale})")
    if scale < 7:
        text = size.cast("string")
        return _zeros(F.replace(text, F.lit("."), F.lit("")) if scale else text, width)
    whole = max(width - scale, 0)  # a leading one keeps small numbers out of scientific notation
    one = F.lit("1" + "0" * whole).cast(f"decimal({whole + 1},0)")
    return F.right(F.replace(((size % one).cast(f"decimal({whole + scale + 1},{scale})") + one).cast("string"), F.lit("."), F.lit("")), F.lit(width))


def _is_negative(value: Column, scale: int, exact: bool = False) -> Column:
    """Whether the value is below zero after truncation to the scale."""
    return (value if exact else F.ceil(value, F.lit(scale))) < 0


def _unscaled(value: Column, scale: int, exact: bool = False) -> Column:
    """The value times 10^scale as a long, truncated toward zero."""
    if not scale:
        return value.cast("long")
    digits = _digits(value, scale, 18, exact).cast("long")
    return F.when(value < 0, -digits).otherwise(digits)


def packed_length(digits: int) -> int:
    return digits // 2 + 1


def decode_packed(data: Column, digits: int, scale: int = 0) -> Column:
    """COMP-3: two digits a byte, the sign in the last half-byte; only D is negative; no bytes are zero."""
    text = F.hex(data)
    return _scaled(F.substr(text, F.lit(-digits - 1), F.lit(digits)), digits, scale, F.endswith(text, F.lit("D")))


def encode_packed(value: Column, digits: int, scale: int = 0, exact: bool = False) -> Column:
    """COMP-3 bytes; the sign is C or D; fractions beyond the scale are truncated."""
    width = packed_length(digits) * 2 - 1
    sign = F.when(_is_negative(value, scale, exact), "D").otherwise("C")
    return F.unhex(F.concat(_zeros(_digits(value, scale, digits, exact), width), sign))


def decode_binary(data: Column, size: int, signed: bool = True, scale: int = 0, digits: int = 18) -> Column:
    """Big-endian integer of 1 to 8 bytes."""
    text = _zeros(F.hex(data), 2 * size)
    if size == 8 and not signed:
        number = F.conv(text, 16, 10).cast("decimal(20,0)")
    else:  # at the left end of eight bytes, then shifted back
        shift = F.shiftright if signed else F.shiftrightunsigned
        number = shift(F.conv(F.rpad(text, 16, "0"), 16, -10).cast("long"), 64 - 8 * size)
    if not scale:
        return number.cast("long")
    return _scaled(F.replace(number.cast("string"), F.lit("-"), F.lit("")), max(digits, 19), scale, number < 0).cast(f"decimal({digits},{scale})")


def encode_binary(value: Column, size: int, scale: int = 0, exact: bool = False) -> Column:
    """Big-endian bytes; a value that is too large wraps."""
    return F.unhex(F.right(F.lpad(F.hex(_unscaled(value, scale, exact)), 16, "0"), F.lit(2 * size)))


def decode_float(data: Column, size: int) -> Column:
    """IEEE 754 big-endian single (4 bytes) or double (8 bytes), from its bits; null for infinities and NaN. Sign and
    exponent come from the first hexadecimal digits and the fraction from the others, so no part is computed from all bits
    and the generated code stays small."""
    text = _zeros(F.hex(data), 2 * size)
    part = lambda at, n: F.conv(F.substr(text, F.lit(at), F.lit(n)), 16, 10).cast("long")
    head, bias, top, scale = (F.shiftright(part(1, 3), 3), 127, 255, 2.0**-23) if size == 4 else (part(1, 3), 1023, 2047, 2.0**-52)
    fraction = (part(3, 6).bitwiseAND(F.lit(2**23 - 1)) if size == 4 else part(4, 13)).cast("double")
    exponent = head.bitwiseAND(F.lit(top))
    power = F.pow(F.lit(2.0), (exponent - bias).cast("double")) * F.when(head > top, -1.0).otherwise(1.0)
    whole = F.when(exponent == 0, fraction * (2 * scale)).otherwise(fraction * scale + 1)
    return F.when(exponent != top, whole * power).cast("float" if size == 4 else "double")


def decode_zoned(data: Column, digits: int, scale: int = 0, signed: bool = True) -> Column:
    """A digit a byte in the low half; a last zone of D is negative if signed. ASCII and EBCDIC digits alike."""
    body = F.right(F.translate(F.decode(data, "ISO-8859-1"), ZONED, "0123456789" * 16), F.lit(digits))
    negative = F.startswith(F.hex(F.substr(data, F.lit(-1), F.lit(1))), F.lit("D")) if signed else None
    return _scaled(body, digits, scale, negative)


def encode_zoned(value: Column, digits: int, scale: int = 0, signed: bool = True, zone: int = 0xF, exact: bool = False) -> Column:
    """Digits in ``zone`` (F: EBCDIC, 3: ASCII); the last zone is C or D if signed, else as the others."""
    in_zone = lambda text, z: text if z == 3 else F.translate(text, "0123456789", "".join(chr(16 * z + k) for k in range(10)))
    text = _digits(value, scale, digits, exact)
    if not signed:
        return F.encode(in_zone(text, zone), "ISO-8859-1")
    last = F.right(text, F.lit(1))
    sign = F.when(_is_negative(value, scale, exact), in_zone(last, 0xD)).otherwise(in_zone(last, 0xC))
    return F.encode(F.concat(in_zone(F.left(text, F.lit(digits - 1)), zone), sign), "ISO-8859-1")


def decode_overpunch(text: Column, digits: int, scale: int = 0, leading: bool = False) -> Column:
    """Digits whose last (or first) character also carries the sign; plain digits are positive."""
    mark = F.left(text, F.lit(1)) if leading else F.right(text, F.lit(1))
    rest = F.substr(text, F.lit(2)) if leading else F.left(text, F.length(text) - 1)
    digit = F.translate(mark, PLUS + MINUS, "01234567890123456789")
    return _scaled(F.concat(digit, rest) if leading else F.concat(rest, digit), digits, scale, F.instr(F.lit(MINUS), mark) > 0)


def encode_overpunch(value: Column, digits: int, scale: int = 0, leading: bool = False) -> Column:
    text = _digits(value, scale, digits)
    digit = F.left(text, F.lit(1)) if leading else F.right(text, F.lit(1))
    rest = F.substr(text, F.lit(2)) if leading else F.left(text, F.lit(digits - 1))
    mark = F.when(value < 0, F.translate(digit, "0123456789", MINUS)).otherwise(F.translate(digit, "0123456789", PLUS))
    return F.concat(mark, rest) if leading else F.concat(rest, mark)


def decode_separate_sign(text: Column, digits: int, scale: int = 0, leading: bool = True) -> Column:
    """A sign character of its own before or after the digits."""
    mark = F.left(text, F.lit(1)) if leading else F.right(text, F.lit(1))
    body = F.substr(text, F.lit(2)) if leading else F.left(text, F.length(text) - 1)
    return _scaled(body, digits, scale, mark == "-")


def encode_separate_sign(value: Column, digits: int, scale: int = 0, leading: bool = True) -> Column:
    mark, text = F.when(value < 0, "-").otherwise("+"), _digits(value, scale, digits)
    return F.concat(mark, text) if leading else F.concat(text, mark)


def decode_ebcdic(data: Column, trim: bool = True) -> Column:
    """Text of code page 1047; by default without blanks on either side."""
    text = F.translate(F.decode(data, "ISO-8859-1"), LATIN_1[1:], EBCDIC_1047[1:])
    return F.trim(text) if trim else text


def encode_ebcdic(text: Column, size: int | None = None) -> Column:
    """Bytes of code page 1047, blank-padded or cut to ``size``; characters outside Latin-1 become question marks."""
    text = fixed_string(text, size) if size is not None else text
    return F.encode(F.translate(text, EBCDIC_1047[1:], LATIN_1[1:]), "ISO-8859-1")


def fixed_string(text: Column, size: int) -> Column:
    return F.rpad(text, size, " ")


def decode_text(data: Column, trim: bool = True) -> Column:
    text = F.decode(data, "ISO-8859-1")
    return F.trim(text) if trim else text


def edited(value: Column, picture: str, blank_when_zero: bool = False) -> Column:
    """Report formatting by an edited picture: 9 Z * $ + - , . B 0 / CR DB, with n repeats as Z(4).

    The floating forms of $, + and - are runs of two or more. Suppression reaches up to the first significant digit
    or the point.
    """
    import re

    body = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), picture.upper())
    suffix = next((s for s in ("CR", "DB") if body.endswith(s)), "")
    body = body[: len(body) - len(suffix)]
    tail = body[-1] if body and body[-1] in "+-" and body.count(body[-1]) == 1 else ""
    body = body[: len(body) - len(tail)]
    floating = next((c for c in "$+-" if body.count(c) > 1), "")
    lead = body[0] if body and body[0] in "$+-" and not floating else ""
    body = body[len(lead) :]
    whole, _, fraction = body.partition(".")
    digit = lambda c: c in "9Z*" or c == floating and c != ""
    n_whole, n_fraction = sum(map(digit, whole)) - bool(floating), sum(map(digit, fraction))
    negative = value < 0
    sign_of = {"+": F.when(negative, "-").otherwise("+"), "-": F.when(negative, "-").otherwise(" "), "$": F.lit("$")}
    filler = "*" if "*" in whole else " "

    def shown(text: Column) -> Column:
        """What stands for the digits ``text``, between a leading and a trailing sign."""
        left: list[Column] = []
        at, opened, skip = 0, False, bool(floating)
        for c in whole:
            if digit(c) and skip:  # the first of a floating run holds no digit
                left.append(F.lit(" "))
                skip = False
                continue
            at, opened = at + digit(c), opened or c == "9"
            one = F.substr(text, F.lit(at), F.lit(1)) if digit(c) else F.lit({"B": " "}.get(c, c))
            hidden = F.lit(filler) if digit(c) or c in ",0/B" else one
            left.append(one if opened else F.when(F.left(text, F.lit(at)) != "0" * at, one).otherwise(hidden))
        out = F.concat(*left) if left else F.lit("")
        if floating:  # the sign stands just before the first character shown
            out = F.lpad(F.concat(sign_of[floating], F.ltrim(out)), len(left), " ")
        right = [F.lit(".")] if "." in body else []
        for c in fraction:
            at += digit(c)
            right.append(F.substr(text, F.lit(at), F.lit(1)) if digit(c) else F.lit({"B": " "}.get(c, c)))
        return F.concat(out, *right)

    # as a lambda's variable the digits are worked out once, however many places look at them
    parts = [sign_of[lead]] if lead else []
    parts.append(F.element_at(F.transform(F.array(_digits(value, n_fraction, n_whole + n_fraction)), shown), 1))
    if tail:
        parts.append(sign_of[tail])
    if suffix:
        parts.append(F.when(negative, suffix).otherwise("  "))
    out = F.concat(*parts)
    size = len(lead) + len(whole) + len(fraction) + ("." in body) + len(tail) + len(suffix)
    return blank_zero(out, value, size) if blank_when_zero else out


def blank_zero(text: Column, value: Column, size: int) -> Column:
    """BLANK WHEN ZERO."""
    return F.when(value == 0, F.lit(" " * size)).otherwise(text)


def justified_right(text: Column, size: int) -> Column:
    """JUSTIFIED RIGHT: cut on the left, or blank-padded on the left."""
    return F.lpad(F.right(text, F.lit(size)), size, " ")
