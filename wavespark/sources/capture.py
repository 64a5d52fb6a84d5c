"""One way in for captures of any kind: the file's suffix says which reader takes it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import csvfile, vcdfile


@dataclass(frozen=True)
class Capture:
    """``runs`` (capture_id, signal, start, end, num, txt), ``signals`` (signal, position, width, radix), ``times`` (capture_id, sample, tick; None where rows have no
    time), ``count`` of samples, and the reader's ``kind``."""

    kind: str
    runs: DataFrame
    signals: DataFrame
    times: DataFrame | None

    @property
    def count(self) -> int:
        """Number of samples."""
        return self.runs.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]

    def of(self, names: Sequence[str]) -> Capture:
        """The named signals alone; an unknown name is an error."""
        known = {r.signal for r in self.signals.collect()}  # a row for each signal
        missing = [n for n in names if n not in known]
        if missing:
            raise ValueError(f"no signals {', '.join(missing)}")
        keep = F.col("signal").isin(list(names))
        return Capture(self.kind, self.runs.where(keep), self.signals.where(keep), self.times)


def _csv(spark: SparkSession, path: str, capture_id: int) -> Capture:
    runs, columns = csvfile.read_csv_capture(spark, path, capture_id)
    rows = [(c.name, i, c.width, c.radix) for i, c in enumerate(c for c in columns if not c.meta)]
    return Capture("csv", runs, spark.createDataFrame(rows, "signal string, position int, width int, radix string"), None)


def _vcd(spark: SparkSession, path: str, capture_id: int) -> Capture:
    runs, times, _, variables = vcdfile.read_vcd(spark, path, capture_id)
    rows = [(n, i, w, "BINARY") for i, (n, _, w) in enumerate(variables)]
    return Capture("vcd", runs, spark.createDataFrame(rows, "signal string, position int, width int, radix string"), times.select(F.lit(capture_id).cast("long").alias("capture_id"), "sample", "tick"))


#: Readers by suffix.
READERS = {".csv": _csv, ".vcd": _vcd}


def open_capture(spark: SparkSession, path: str, signals: Sequence[str] | None = None, capture_id: int = 0, kind: str | None = None) -> Capture:
    """A capture of the reader that the suffix names (a folder of parts may have one too), or ``kind``."""
    end = f".{kind}" if kind else next((s for s in READERS if path.rstrip("/").lower().endswith(s)), None)
    if end not in READERS:
        raise ValueError(f"{path}: captures are files of {', '.join(READERS)}")
    found = READERS[end](spark, path, capture_id)
    return found if signals is None else found.of(signals)
