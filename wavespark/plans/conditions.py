"""Conditions over signals, built as columns: two-valued, with selections, previous values and radix-aware literals.

    ready & (data[7:4] == "hF") & ~previous(ready)

is written ``(S("ready").true & S("data", 8).bits("7:4").eq("hF") & ~S("ready").previous.true)``; a condition is a Spark
Column over the as-of values of its signals plus the set of what it reads. There is no text parser: Python is the
language of conditions, and Catalyst their compiler.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bit_of, digits_of, mask, offsets_of, select_bits, sign_magnitude, signed
from ..operators.joins import as_of

BASES = {"h": 16, "b": 2, "d": 10, "0x": 16, "0b": 2, "0o": 8}


SIGNED = ("SIGNED", "SIGNED_MAGNITUDE")


def literal(value: int | str, radix: str = "HEX", width: int | None = None) -> int:
    """``hFF``, ``b01``, ``d-3``, ``0x1F`` say their base; other texts are read in the signal's display radix.

    A number is a value of the signal. Digits of a base that is a power of two are a pattern of its bits instead, so on
    a signed byte ``hFF`` is -1. What no value of the signal can be is an error.
    """
    pattern = False
    if isinstance(value, str):
        low = value.strip().lower().replace("_", "")
        for mark in ("0x", "0b", "0o", "d", "h", "b", ""):
            try:
                base = BASES[mark] if mark else {"HEX": 16, "BINARY": 2, "OCTAL": 8}.get(radix, 10)
                n = int(low.removeprefix(mark), base) if low.startswith(mark) else None
            except ValueError:
                continue
            if n is not None:
                pattern = base != 10 and n >= 0
                break
        else:
            raise ValueError(f"{value!r} is no number")
    else:
        n = value
    if width is None:
        return n
    has_sign = radix in SIGNED
    low_end = 0 if pattern or not has_sign else -(1 << (width - 1))
    high_end = 1 << (width - 1) if has_sign and not pattern else 1 << width
    if not low_end <= n < high_end:
        raise ValueError(f"{value} doesn't fit {width} bits")
    if has_sign and pattern and n >> (width - 1):
        return n - (1 << width) if radix == "SIGNED" else -(n & mask(width - 1))
    return n


@dataclass(frozen=True)
class Condition:
    column: Column
    reads: frozenset[tuple[str, bool]]

    def __and__(self, other: Condition) -> Condition:
        return Condition(self.column & other.column, self.reads | other.reads)

    def __or__(self, other: Condition) -> Condition:
        return Condition(self.column | other.column, self.reads | other.reads)

    def __invert__(self) -> Condition:
        return Condition(~self.column, self.reads)

    @property
    def signals(self) -> list[str]:
        return sorted({n for n, _ in self.reads})

    def on(self, points: DataFrame, runs: DataFrame, keys: Sequence[str] = ("capture_id",), size: int | None = None) -> DataFrame:
        """points (``at``, ``previous_at``) with ``holds``: never null, and false at the first point if anything before
        it is read. Only the signals that are read are joined, each once."""
        out = points
        for name, before in sorted(self.reads):
            mine = runs.where(F.col("signal") == name).drop("signal")
            place = "previous_at" if before else "at"
            out = as_of(out, mine, place, ["num", "txt"], keys, size=size).withColumnsRenamed({"num": _column(name, before, "num"), "txt": _column(name, before, "txt")}).drop("run_start")
        holds = self.column
        if any(before for _, before in self.reads):
            holds = holds & F.col("previous_at").isNotNull()
        return out.withColumn("holds", F.coalesce(holds, F.lit(False))).drop(*[_column(n, b, v) for n, b in self.reads for v in ("num", "txt")])


def _column(name: str, before: bool, value: str) -> str:
    return f"_{'was' if before else 'is'}_{''.join(c if c.isalnum() else '_' for c in name)}_{value}"


@dataclass(frozen=True)
class S:
    """A signal in a condition. The display radix says how literals are read and whether the value has a sign, and
    ``source`` in which radix the signal's texts with X or Z are written."""

    name: str
    width: int = 1
    radix: str = "HEX"
    before: bool = False
    offsets: tuple[int, ...] = ()
    source: str = "BINARY"

    @property
    def previous(self) -> S:
        return replace(self, before=True)

    def bits(self, text: str) -> S:
        """An ordered selection of bits; a selection has no sign."""
        return replace(self, offsets=tuple(offsets_of(text, self.width)), radix="UNSIGNED" if self.radix in SIGNED else self.radix)

    def _raw(self, part: str) -> Column:
        return F.col(_column(self.name, self.before, part))

    def _picked(self) -> Column:
        """The digits of a selection from a value that is a text: one with X or Z, or a wide one."""
        digits = digits_of(F.lit(None).cast("long"), self._raw("txt"), self.source, self.width)
        return F.concat(*[bit_of(digits, o) for o in self.offsets])

    @property
    def num(self) -> Column:
        raw = self._raw("num")
        if self.offsets:
            picked = self._picked()
            return F.coalesce(select_bits(raw, self.offsets), F.when(picked.rlike("^[01]{1,63}$"), F.conv(picked, 2, 10).cast("long")))
        if self.radix == "SIGNED":
            return signed(raw, self.width)
        return sign_magnitude(raw, self.width) if self.radix == "SIGNED_MAGNITUDE" else raw.bitwiseAND(F.lit(mask(self.width)))

    @property
    def txt(self) -> Column:
        if not self.offsets:
            return self._raw("txt")
        picked = self._picked()
        return F.when(~picked.rlike("^[01]{1,63}$"), picked)

    @property
    def _reads(self) -> frozenset[tuple[str, bool]]:
        return frozenset([(self.name, self.before)])

    def _compare(self, other: S | int | str, of, unknown: bool) -> Condition:
        """of: the comparison of two numbers; unknown: what a comparison with an X or Z is."""
        if isinstance(other, S):
            return Condition(F.coalesce(of(self.num, other.num), F.lit(unknown)), self._reads | other._reads)
        return Condition(F.coalesce(of(self.num, F.lit(literal(other, self.radix, len(self.offsets) or self.width))), F.lit(unknown)), self._reads)

    @property
    def true(self) -> Condition:
        """Not 0; a value with X or Z is false."""
        return Condition(F.coalesce(self.num != 0, F.lit(False)), self._reads)

    def eq(self, other: S | int | str) -> Condition:
        if isinstance(other, S):  # equal as values: numbers by number, texts by text
            return Condition(self.num.eqNullSafe(other.num) & self.txt.eqNullSafe(other.txt), self._reads | other._reads)
        if isinstance(other, str) and any(c in "XxZz?" for c in other):
            return Condition(F.coalesce(self.txt == other.upper(), F.lit(False)), self._reads)
        return self._compare(other, lambda a, b: a == b, False)

    def ne(self, other: S | int | str) -> Condition:
        return ~self.eq(other)

    def lt(self, other: S | int | str) -> Condition:
        return self._compare(other, lambda a, b: a < b, False)

    def le(self, other: S | int | str) -> Condition:
        return self._compare(other, lambda a, b: a <= b, False)

    def gt(self, other: S | int | str) -> Condition:
        return self._compare(other, lambda a, b: a > b, False)

    def ge(self, other: S | int | str) -> Condition:
        return self._compare(other, lambda a, b: a >= b, False)


def all_of(*conditions: Condition) -> Condition:
    return reduce(lambda a, b: a & b, conditions)
