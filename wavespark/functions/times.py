"""The time axis: units, rulers, texts of times and frequencies, positions between samples."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of ten of a second and of a hertz, by unit.
SECONDS = {"fs": -15, "ps": -12, "ns": -9, "us": -6, "ms": -3, "s": 0}
HERTZ = {"hz": 0, "khz": 3, "mhz": 6, "ghz": 9}


def quantity(text: str) -> tuple[Decimal, str]:
    """The number that a text begins with, and what follows it; either point or comma stands before decimals."""
    text = text.strip()
    end = next((i for i, c in enumerate(text) if c not in "0123456789.,"), len(text))
    try:
        return Decimal(text[:end].replace(",", ".")), text[end:].strip()
    except InvalidOperation:
        raise ValueError(f"{text!r} doesn't begin with a number") from None


def unit_seconds(text: str) -> float:
    """The length of a tick that a time scale names, such as ``1ns`` or ``10 ps``."""
    number, unit = quantity(text)
    if unit not in SECONDS or number != int(number):
        raise ValueError(f"not a time scale: {text!r}")
    return float(number.scaleb(SECONDS[unit]))


def clock_ns(text: str) -> float:
    """The period in ns of a clock that is given by its frequency or its period; a bare number is a period in ns."""
    number, unit = quantity(text)
    unit = unit.lower().replace("µ", "u") or "ns"
    if number <= 0 or unit not in SECONDS | HERTZ:
        raise ValueError(f"not a clock: {text!r}")
    if unit in HERTZ:
        return float(Decimal(10**9) / number.scaleb(HERTZ[unit]))
    return float(number.scaleb(SECONDS[unit] + 9))


def nice_step(ideal: Column) -> Column:
    """The least 1, 2 or 5 times a power of ten that isn't below; 1 where nothing positive is asked for."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(ideal)))
    part = ideal / power - F.lit(1e-12)
    step = F.when(part <= 1, power).when(part <= 2, 2 * power).when(part <= 5, 5 * power).otherwise(10 * power)
    return F.when(ideal > 0, step).otherwise(F.lit(1.0))


def ruler(lo: Column | int, hi: Column | int, step: Column | int) -> Column:
    """Marks of a ruler in [lo, hi], multiples of the step, as an array."""
    lo, hi, step = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi, step))
    first = F.ceil(lo / step).cast("long") * step
    return F.when(first <= hi, F.sequence(first.cast("long"), hi.cast("long"), step.cast("long"))).otherwise(F.array().cast("array<long>"))


def grouped(number: Column, decimals: int = 0) -> Column:
    """Digits in threes; zeros at the end of the decimals are dropped, and so is the sign of what rounds to 0."""
    text = F.format_number(number, decimals)
    text = F.regexp_replace(text, r"\.?0+$", "") if decimals else text
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def seconds_text(seconds: Column, resolution: float = 1e-12, least: float = 1e-9) -> Column:
    """A time in the coarsest unit that isn't above the resolution (or ``least``), with the decimals the resolution has."""
    finest = max(resolution, least) * (1 + 1e-9)
    unit = max((u for u in SECONDS if 10.0 ** SECONDS[u] <= finest), key=SECONDS.get, default="fs")
    decimals = next(d for d in range(7) if d == 6 or 10.0 ** (SECONDS[unit] - d) <= resolution * (1 + 1e-9))
    return F.concat(grouped(seconds / F.lit(10.0 ** SECONDS[unit]), decimals), F.lit(f" {unit}"))


def ruler_text(seconds: Column, step: float) -> Column:
    """The label of a mark: the unit follows the step."""
    return seconds_text(seconds, step, 1e-15)


def six_digits(number: Column) -> Column:
    """A number with six significant digits of its exact binary value, without zeros at the end; Spark's own formats round the
    shortest decimal instead, so batches go to pandas."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.6g}")

    return run(number)


def frequency_text(hertz: Column) -> Column:
    """GHz, MHz, kHz or Hz with six significant digits."""
    number, unit = hertz.cast("double"), F.lit("Hz")
    for key, name in (("khz", "kHz"), ("mhz", "MHz"), ("ghz", "GHz")):
        size = 10.0 ** HERTZ[key]
        number, unit = F.when(hertz >= size, hertz / F.lit(size)).otherwise(number), F.when(hertz >= size, F.lit(name)).otherwise(unit)
    return F.concat(six_digits(number), F.lit(" "), unit)


def between(tick: Column, low: Column, high: Column, sample: Column) -> Column:
    """A position between two samples by time; integers are subtracted before they become doubles. Past the last sample
    (``high`` is null) a sample is a tick long; before the first (``low`` is null) there is no position."""
    return sample + F.when(high > low, (tick - low).cast("double") / (high - low).cast("double")).otherwise((tick - low).cast("double"))


def time_at(sample: Column, low: Column, high: Column) -> Column:
    """Ticks at a position, as an exact decimal: ``low`` and ``high`` are the times of the sample it lies at or after and of
    the next one. Past the last sample (``high`` is null) a sample is a tick long."""
    part = (sample.cast("decimal(28,9)") - F.floor(sample)).cast("decimal(10,9)")
    width = F.coalesce(high - low, F.lit(1)).cast("decimal(19,0)")
    return low.cast("decimal(19,0)") + part * width


def sample_time(sample: Column, period_ns: float) -> Column:
    """Nanoseconds of a sample of a capture without times, by the period of its clock."""
    return sample * F.lit(float(period_ns))
