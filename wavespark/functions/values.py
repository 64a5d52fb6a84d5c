"""Values of signals as columns: parsing by radix, bits, and texts in every display radix.

A value is a struct ``num`` (integers of 64 bits), ``wide`` (binary digits of larger ones) and ``txt`` (upper-case digits
with X, Z or ?); exactly one of them is not null. All functions are built-in expressions but ``real_text``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radix: digits allowed, bits a digit (0: decimal), longest text that surely fits 63 bits.
RADIX = {"HEX": ("0-9A-F", 4, 15), "BINARY": ("01", 1, 62), "OCTAL": ("0-7", 3, 20), "UNSIGNED": ("0-9", 0, 18), "SIGNED": ("0-9", 0, 18)}
#: Digits of a decimal that becomes binary digits; longer ones keep their own.
WIDEST_DECIMAL = 36
ALIASES = {"BIN": "BINARY", "OCT": "OCTAL", "DEC": "UNSIGNED", "DECIMAL": "UNSIGNED"}


def radix_of(name: str) -> str:
    name = ALIASES.get(name.upper(), name.upper())
    if name not in RADIX:
        raise ValueError(f"unknown radix {name}")
    return name


def parse_value(text: Column, radix: str) -> Column:
    """The value of a cell; null where it isn't one (the loaders report those)."""
    radix = radix_of(radix)
    digits, bits, most = RADIX[radix]
    t = F.upper(F.regexp_replace(F.trim(text), "_", ""))
    if bits in (1, 4):
        t = F.regexp_replace(t, "^0X" if bits == 4 else "^0B", "")
    sign = F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    known, unknown = t.rlike(f"^[+-]?[{digits}]+$"), t.rlike("^[XZ?]+$" if bits == 0 else f"^[{digits}XZ?]+$")
    t = F.when(known, F.concat(sign if bits == 0 else F.lit(""), F.regexp_replace(t, "^[+-]", ""))).otherwise(t)
    short = F.length(F.regexp_replace(t, "^-", "")) <= most
    none_long, none_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    num = t.cast("long") if bits == 0 else F.conv(t, 1 << bits, 10).cast("long")
    wide = none_text
    if bits:
        each = F.transform(F.split(t, ""), lambda d: F.lpad(F.conv(d, 1 << bits, 2), bits, "0"))
        joined = F.regexp_replace(F.array_join(each, ""), "^0+(?=.)", "")
        num = F.when(short, num).otherwise(F.when(F.length(joined) <= 63, F.conv(joined, 2, 10).cast("long")))
        num = F.when(sign == "-", -num).otherwise(num)
        wide = F.when(known & ~short & (F.length(joined) > 63), F.concat(sign, joined))
    else:
        # Longer decimals become numbers or binary digits too, so that a value has one form whatever its radix.
        n = F.regexp_replace(t, "^-", "").try_cast("decimal(38,0)")
        half = F.lit(1 << 62).cast("decimal(38,0)")
        high = F.floor(n / half).cast("decimal(38,0)")
        high = F.when(high * half > n, high - 1).otherwise(high)  # the quotient is rounded
        digits = F.concat(F.bin(high.cast("long")), F.lpad(F.bin((n - high * half).cast("long")), 62, "0"))
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        fits = known & ~short & (F.length(F.regexp_replace(t, "^-?0*", "")) <= WIDEST_DECIMAL)
        num = F.when(short, num).otherwise(F.when(fits, t.try_cast("long")))
        wide = F.when(fits & t.try_cast("long").isNull(), F.concat(sign, digits)).otherwise(F.when(known & ~short & ~fits, t))
    return F.struct(F.when(known, num).otherwise(none_long).alias("num"), F.when(known, wide).otherwise(none_text).alias("wide"), F.when(~known & unknown, t).otherwise(none_text).alias("txt"))


def value_key(value: Column) -> Column:
    """Equality of values as one string; X and XX are different texts."""
    return F.coalesce(F.concat(F.lit("i:"), value["num"].cast("string")), F.concat(F.lit("w:"), value["wide"]), F.concat(F.lit("t:"), value["txt"]))


def mask(width: int) -> int:
    return (1 << width) - 1


def binary_text(num: Column, width: int) -> Column:
    """Two's complement digits, zero-padded; widths up to 62."""
    return F.lpad(F.bin(num.bitwiseAND(F.lit(mask(width)))), width, "0")


def expand_text(txt: Column, radix: str, width: int) -> Column:
    """Binary digits of a text with X, Z, ?: each stands for all bits of its digit; only an all-letter text is extended
    by its letter, others by 0."""
    bits = RADIX[radix_of(radix)][1] or 1
    each = F.transform(F.split(txt, ""), lambda d: F.when(d.isin("X", "Z", "?"), F.repeat(d, bits)).otherwise(F.lpad(F.conv(d, 1 << bits, 2), bits, "0")))
    pad = F.when(txt.rlike(r"^(X+|Z+|\?+)$"), F.substring(txt, 1, 1)).otherwise(F.lit("0"))
    digits = F.array_join(each, "")
    return F.right(F.concat(F.repeat(pad, F.greatest(F.lit(0), F.lit(width) - F.length(digits))), digits), F.lit(width))


def digits_of(num: Column, txt: Column, radix: str, width: int) -> Column:
    """The binary digits of a value, as many as the signal is wide: of numbers, of wide ones (whose text is binary digits
    already), and of texts with X, Z or ?."""
    plain = F.lpad(F.bin(num), width, "0") if width > 62 else binary_text(num, width)
    number = F.when(num < 0, F.lpad(F.bin(num), width, "1")).otherwise(plain) if width > 62 else plain
    wide = F.right(F.lpad(txt, F.greatest(F.lit(width), F.length(txt)), F.lit("0")), F.lit(width))
    return F.coalesce(number, F.when(txt.rlike("^[01]+$") & (F.length(txt) > 63), wide), expand_text(txt, radix, width))


def bit_of(digits: Column, offset: int | Column) -> Column:
    """One of such digits, by its distance from the lowest."""
    return F.substring(digits, F.length(digits) - offset, F.lit(1))


def labels(signal: Column, width: int, offset: Column) -> Column:
    """The number that a bus gives a bit: by the range at the end of its name, which may rise or fall, or else its place."""
    left, right = (F.try_element_at(F.regexp_extract_all(signal, F.lit(r"(\d+)(?=\s*:\s*\d+\]$|\]$)"), 1), F.lit(i)).cast("int") for i in (1, 2))
    ranged = signal.rlike(r"\[\d+\s*:\s*\d+\]$")
    return F.when(ranged & (left < right), right - offset).when(ranged, right + offset).otherwise(offset)


def bit(num: Column, offset: int | Column) -> Column:
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.getbit(num, offset.cast("int")).cast("long")


def level(num: Column) -> Column:
    """0, 1, or -1 for anything else."""
    return F.coalesce(F.when(num.isin(0, 1), num), F.lit(-1)).cast("int")


def select_bits(num: Column, offsets: Sequence[int]) -> Column:
    """Bits in the given order, most significant first: an ordered concatenation."""
    out = F.lit(0).cast("long")
    for o in offsets:
        out = out * 2 + bit(num, o)
    return out


def offsets_of(text: str, width: int, as_set: bool = False) -> list[int]:
    """``7,5,2-0`` or ``7:4`` as bit offsets; as_set: distinct, falling."""
    out: list[int] = []
    for part in text.replace(",", " ").split():
        ends = [int(x) for x in part.replace(":", "-").split("-")]
        if len(ends) > 2 or any(not 0 <= e < width for e in ends):
            raise ValueError(f"bit range {part} is outside 0..{width - 1}")
        a, b = ends[0], ends[-1]
        out += range(a, b - 1, -1) if a >= b else range(a, b + 1)
    if as_set:
        return sorted(set(out), reverse=True)
    if len(set(out)) < len(out):
        raise ValueError("a bit is selected twice")
    return out


def reverse_bits(num: Column, width: int) -> Column:
    return F.conv(F.reverse(binary_text(num, width)), 2, 10).cast("long")


def signed(num: Column, width: int) -> Column:
    """Two's complement reading of the low bits."""
    low = num.bitwiseAND(F.lit(mask(width)))
    return F.when(low >= 1 << (width - 1), low - F.lit(1 << width)).otherwise(low)


def sign_magnitude(num: Column, width: int) -> Column:
    low, size = num.bitwiseAND(F.lit(mask(width))), num.bitwiseAND(F.lit(mask(width - 1)))
    return F.when(low >= 1 << (width - 1), -size).otherwise(size)


def format_value(num: Column, radix: str, width: int) -> Column:
    """The text of an integer in a display radix."""
    low = num.bitwiseAND(F.lit(mask(width)))
    if radix == "HEX":
        return F.lpad(F.hex(low), -(-width // 4), "0")
    if radix == "BINARY":
        return binary_text(num, width)
    if radix == "OCTAL":
        return F.lpad(F.conv(low.cast("string"), 10, 8), -(-width // 3), "0")
    if radix == "ASCII":
        return ascii_text(low, width)
    return {"UNSIGNED": low, "SIGNED": signed(num, width), "SIGNED_MAGNITUDE": sign_magnitude(num, width)}[radix].cast("string")


def ascii_text(low: Column, width: int) -> Column:
    r"""Bytes, highest first: printable ones as they are, a backslash doubled, others as \xNN."""
    out = []
    for k in range(-(-width // 8) - 1, -1, -1):
        b = F.shiftrightunsigned(low, 8 * k).bitwiseAND(F.lit(255))
        plain = F.when(b == 92, F.lit("\\\\")).otherwise(F.char(b))
        out.append(F.when(b.between(32, 126), plain).otherwise(F.concat(F.lit("\\x"), F.lpad(F.hex(b), 2, "0"))))
    return F.concat(*out)


def fixed_point(num: Column, width: int, fraction: int, is_signed: bool = True) -> Column:
    return (signed(num, width) if is_signed else num.bitwiseAND(F.lit(mask(width)))) / F.lit(float(1 << fraction))


def real_text(num: Column, width: int) -> Column:
    """An IEEE-754 number of 32 or 64 bits with nine significant digits. Spark has no such cast, so batches go to pandas."""
    if width not in (32, 64):
        return F.lit("<Real: 32/64 bit>")
    kind, whole = ("float32", "uint32") if width == 32 else ("float64", "uint64")

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        known = x.notna()
        out = pd.Series([None] * len(x), dtype=object)
        reals = (x[known].astype("int64") & (mask(32) if width == 32 else -1)).to_numpy().astype(whole).view(kind)
        out[known.to_numpy()] = ["%.9g" % v for v in reals]
        return out

    return run(num)
