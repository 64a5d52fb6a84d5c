"""How values are shown and read back: what a user types becomes the value of a signal, by the radix it is shown in.

A ``Shown`` says the radix, the width, whether bits are reversed, and how reals are laid out. Texts are read on the driver, as they are
typed; values are shown by column expressions.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v

BASES = {"HEX": 16, "BINARY": 2, "OCTAL": 8, "UNSIGNED": 10, "SIGNED": 10, "SIGNED_MAGNITUDE": 10}
#: Letters of values that are unknown in part, by the base of their digits.
UNKNOWN = {2: "01XZ?", 8: "01234567XZ?", 10: "XZ?", 16: "0123456789ABCDEFXZ?"}


@dataclass(frozen=True)
class Shown:
    """radix: one of ``BASES``, ``ASCII`` or ``REAL``. fraction: bits behind the point of reals that aren't IEEE numbers (None: they are); signed_real: of such
    reals. source: the radix of the capture's own values."""

    width: int
    radix: str = "HEX"
    reverse: bool = False
    fraction: int | None = None
    signed_real: bool = True
    source: str = "HEX"

    def name(self, signal: str) -> str:
        """The signal's name; a range at its end is turned with its bits."""
        return re.sub(r"\[(\d+)\s*:\s*(\d+)\]$", r"[\2:\1]", signal) if self.reverse else signal

    def text(self, num: Column) -> Column:
        """The values as they are shown."""
        low = v.reverse_bits(num, self.width) if self.reverse else num
        if self.radix != "REAL":
            return v.format_value(low, self.radix, self.width)
        return v.real_text(low, self.width) if self.fraction is None else nine_digits(v.fixed_point(low, self.width, self.fraction, self.signed_real))

    def read(self, text: str) -> int | str:
        """The value that is shown by a text: an integer of the signal, or, where digits are unknown, their pattern as binary digits of the
        signal's own order. What no value can be is an error."""
        got = self._pattern(text)
        if isinstance(got, str):
            return got[::-1] if self.reverse else got
        if self.reverse:
            got = int(f"{got:0{self.width}b}"[::-1], 2)
        return got - (1 << self.width) if self.source == "SIGNED" and got >> (self.width - 1) & 1 else got

    def _pattern(self, text: str) -> int | str:
        if self.radix == "ASCII":
            return read_ascii(text, self.width)
        low = text.strip().replace("_", "").lower()
        marked = next((b for m, b in (("0x", 16), ("0b", 2), ("0o", 8)) if low.startswith(m)), None)
        if self.radix == "REAL" and marked is None:
            return read_real(text, self.width, self.fraction, self.signed_real)
        base, digits = marked or BASES.get(self.radix, 10), (low[2:] if marked else low).upper()
        if any(c in "XZ?" for c in digits):
            if set(digits) - set(UNKNOWN[base]):
                raise ValueError(f"{text!r} is no value")
            each = {2: 1, 8: 3, 16: 4, 10: 1}[base]
            bits = "".join(f"{int(c, 16):0{each}b}" if c not in "XZ?" else c * each for c in digits)
            return bits.rjust(self.width, bits[0] if bits[0] in "XZ" else "0")[-self.width :]
        number = int(digits, base)
        if self.radix == "SIGNED_MAGNITUDE" and marked is None:
            if abs(number) >= 1 << (self.width - 1):
                raise ValueError(f"{text!r} doesn't fit {self.width} bits")
            return abs(number) | ((1 << (self.width - 1)) if low.startswith("-") else 0)
        if not -(1 << (self.width - 1)) <= number < 1 << self.width:
            raise ValueError(f"{text!r} doesn't fit {self.width} bits")
        return number & v.mask(self.width)


def nine_digits(number: Column) -> Column:
    """A number with nine significant digits, as ``real_text`` has them."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda n: None if pd.isna(n) else f"{n:.9g}")

    return run(number.cast("double"))


def read_ascii(text: str, width: int) -> int:
    r"""Bytes, highest first, of characters up to 127, ``\\`` and ``\xNN`` (another backslash is itself); quotes around the whole are taken off."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1]
    parts = re.findall(r"(?s)\\\\|\\x[0-9A-Fa-f]{2}|(?!\\x..)[\x00-\x7f]", text)
    if "".join(parts) != text:
        raise ValueError(f"{text!r} is no text of bytes")
    data = bytes(92 if p == "\\\\" else int(p[2:], 16) if len(p) == 4 else ord(p) for p in parts)
    if len(data) > -(-width // 8) or int.from_bytes(data, "big") >> width:
        raise ValueError(f"{text!r} doesn't fit {width} bits")
    return int.from_bytes(data, "big")


def read_real(text: str, width: int, fraction: int | None, is_signed: bool = True) -> int:
    """The bits of a real: IEEE-754 in 32 or 64, or fixed point, which must hold the number exactly."""
    number = float(text)
    if fraction is None:
        if width not in (32, 64):
            raise ValueError("an IEEE number has 32 or 64 bits")
        try:
            return int.from_bytes(struct.pack(">f" if width == 32 else ">d", number), "big")
        except OverflowError:
            raise ValueError(f"{text} is beyond {width} bits") from None
    scaled = number * (1 << fraction)
    low, high = (-(1 << (width - 1)), 1 << (width - 1)) if is_signed else (0, 1 << width)
    if not math.isfinite(scaled) or scaled != round(scaled) or not low <= scaled < high:
        raise ValueError(f"{text} is no number of {width} bits, {fraction} of them behind the point")
    return int(scaled) & v.mask(width)
