"""Fill-in-the-middle: texts are cut at two units and their parts put in another order between marks.

A pandas UDF over Arrow batches walks each whole text once: ``finditer`` of the regex library gives the units, whose end
offsets stand in an array of four bytes each; the two cuts are two look-ups there, and the parts two slices. All choices
come from a SHA-256 of the seed and the document's id, so reruns and retried tasks agree, and there is no exchange.

Defined cases: a null text is empty; an empty text, one that holds a mark and one that its draw leaves alone are ``plain``,
with null parts; a null id draws as the text ``null``; rows that repeat are treated alike; text outside all units stays
with the part it stands in; added columns replace columns of their name; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: One unit for each code point.
CODE_POINT = r"(?s:.)"
#: Units that one match spans at most: what the regex library holds of a text at a time.
RUN = 256
ADDED = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("output", "output_sha256", "restored_sha256")]
)


@lru_cache(maxsize=8)
def _runs(unit: str) -> regex.Pattern:
    """Runs of neighbouring units, each of which is a capture of the first group, taken as a search for it would take it."""
    return regex.compile(f"((?>{unit})){{1,{RUN}}}+")


def unit_ends(text: str, unit: str = CODE_POINT) -> array:
    """Where the units of a text end, in order."""
    ends = array("I")
    for run in _runs(unit).finditer(text):
        ends.extend(run.ends(1))
    return ends


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a digest of the seed and the key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut(text: str, key: str, seed: str = "1", unit: str = CODE_POINT, marks: tuple[str, str, str] = MARKS, changed: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form (``plain``, ``psm``, ``spm``), code points of prefix and middle, and the output."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= changed or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that an output of ``cut`` was made of."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (s, p) if form == "spm" else (p, s)
    head, middle = output.split(m)
    one, two = head.removeprefix(first).split(second)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(
    docs: DataFrame, text: str = "text", id_: str = "doc_id", seed: str = "1", unit: str = CODE_POINT, marks: tuple[str, str, str] = MARKS, changed: int = 90, spm: int = 20, keep_output: bool = True
) -> DataFrame:
    """Adds ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``, ``output_sha256`` and ``restored_sha256`` (of the
    text rebuilt from the output and its form).

    ``unit`` is a pattern of the regex library that doesn't match the empty text. Of 100 documents ``changed`` are cut, and of
    100 of those ``spm`` have the suffix first. Without ``keep_output`` outputs don't leave the Python workers (null).
    """
    for x in marks:
        if not x or any(y.startswith(x[k:]) for y in marks for k in range(1, len(x))) or any(x in y for y in marks if y is not x):
            raise ValueError("a mark must not begin with the end of another, nor hold one: outputs could not be read back")

    @F.pandas_udf(ADDED)
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for key, t in zip(ids, texts, strict=True):
                t = t or ""
                n, form, a, b, out = cut(t, "null" if key is None else key, seed, unit, marks, changed, spm)
                hashes = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (out, restore(out, form, marks))]
                rows.append((n, form, a, b, out if keep_output else None, *hashes))
            frame = pd.DataFrame(rows, columns=ADDED.names)
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    rest = docs.drop(*ADDED.names)
    made = rest.withColumn("_fim", told(F.col(f"`{id_}`").cast("string"), F.col(f"`{text}`")))
    return made.select(*[F.col(f"`{c}`") for c in rest.columns], "_fim.*")
