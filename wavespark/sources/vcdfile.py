"""Simulator change dumps (VCD): each distinct time is a sample, each variable a signal in binary.

The text is a stream of words, whatever lines they stand on: ``#`` and a time, a scalar change, or a vector change whose
identifier is the next word. What a word is depends on the words before it, yet no task reads the stream: sections such
as comments are told by carrying the last opening or closing keyword forward, and of words that take the next one with
them, which may look like such words themselves, by their place in a row of them.

Words that are no change, vectors without an identifier and times that fall are errors, which name the first such word.
Identifiers that are spelt like a keyword (``$`` and two letters or more) are not supported; no simulator writes them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.axis import BUCKET, fill_forward, neighbour, number_rows
from ..operators.runs import KEYS, merge_seams
from .files import lines, numbered, settled, write_in_order

MOST_HEADER = 2_000_000
#: Words of one line are numbered below this.
MOST_WORDS = 1 << 24
KEYWORD = r"^\$[a-zA-Z_]{2,}$"
#: Keywords whose sections hold changes.
DUMPS = ("$dumpvars", "$dumpall", "$dumpon", "$dumpoff", "$end")


def header(text: list[str]) -> tuple[list[tuple[str, str, int]], str]:
    """(name, identifier, width) of each variable in order, and the time scale."""
    scope: list[str] = []
    variables: list[tuple[str, str, int]] = []
    scale = "1 ns"
    for m in re.finditer(r"\$(\w+)\s+(.*?)\s*\$end", " ".join(text), re.S):
        words = m[2].split()
        if m[1] == "scope":
            scope.append(words[-1].lstrip("\\"))
        elif m[1] == "upscope":
            scope = scope[:-1]
        elif m[1] == "timescale":
            scale = m[2]
        elif m[1] == "var" and words[0] not in ("real", "realtime", "string"):
            variables.append(("/".join([*scope, words[3].lstrip("\\") + "".join(words[4:])]), words[2], int(words[1])))
    if not variables:
        raise ValueError("no variable is declared")
    return variables, scale


def changes_of(body: DataFrame, size: int = BUCKET) -> DataFrame:
    """body: ``row``, ``value``. Changes ``(n, tick, ident, raw)`` in order, and marks of time (``ident`` null)."""
    words = body.select("row", F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("k", "token"))
    words = settled(words.select((F.col("row") * MOST_WORDS + F.col("k")).alias("pos"), "token"), "vcd-words")
    keyword = F.col("token").rlike(KEYWORD)
    opened = F.when(keyword & (F.col("token") == "$end"), 0).when(keyword & ~F.col("token").isin(*DUMPS), 1)
    told = fill_forward(words.withColumn("opened", opened), [F.col("pos")], "pos", ["opened"], size=size * MOST_WORDS)
    plain = number_rows(told.where(~keyword & (F.coalesce("opened", F.lit(0)) == 0)).select("pos", "token"), "pos", name="n", size=size * MOST_WORDS)
    plain = settled(plain.select("n", "token"), "vcd-plain")
    # Words that take the next one along alternate with what they take, from the last word on that is none of them.
    takes = F.lower(F.substring("token", 1, 1)).isin("b", "r", "s")
    placed = fill_forward(plain.withColumn("takes", takes).withColumn("other", F.when(~takes, F.col("n"))), [F.col("n")], "n", ["other"], size=size)
    placed = placed.select("n", "token", (F.col("takes") & ((F.col("n") - F.coalesce("other", F.lit(-1).cast("long"))) % 2 == 1)).alias("taking"))
    met = neighbour(placed, "n", ["token", "taking"], (), size).withColumn("taker", F.when(F.col("_prior.taking"), F.col("_prior.token"))).drop("_prior")
    # A taker at the very end takes nothing.
    end = placed.agg(F.max_by(F.struct("n", "token", "taking"), "n").alias("e")).where("e.taking").select((F.col("e.n") + 1).alias("n"), F.lit(None).cast("string").alias("token"), F.lit(False).alias("taking"), F.col("e.token").alias("taker"))
    met = met.unionByName(end)
    first = F.substring("token", 1, 1)
    kind = (
        F.when(F.col("taker").isNotNull() & F.col("token").isNull(), "bad")
        .when(F.col("taker").isNotNull(), F.when(~F.lower(F.substring("taker", 1, 1)).eqNullSafe("b"), "ignored").when(F.col("taker").rlike("^[bB][01xXzZ]+$"), "vector").otherwise("bad"))
        .when(F.col("taking"), "taker")
        .when(F.col("token").rlike(r"^#\d{1,18}$|^#[0-8]\d{18}$|^#9[01]\d{17}$"), "time")
        .when(first.isin(*"01xXzZ") & (F.length("token") > 1), "scalar")
        .otherwise("bad")
    )
    kinds = met.withColumn("kind", kind).where("kind NOT IN ('taker', 'ignored')")
    tick = F.when(F.col("kind") == "time", F.substring("token", 2, 20).cast("long"))
    ident = F.when(F.col("kind") == "vector", F.col("token")).when(F.col("kind") == "scalar", F.expr("substring(token, 2)"))
    raw = F.when(F.col("kind") == "vector", F.expr("substring(taker, 2)")).when(F.col("kind") == "scalar", first)
    out = kinds.select("n", "kind", F.coalesce("token", "taker").alias("token"), tick.alias("tick"), ident.alias("ident"), F.upper(raw).alias("raw"))
    return fill_forward(out.withColumn("own", F.col("tick")), [F.col("n")], "n", ["tick"], size=size).withColumn("tick", F.coalesce("tick", F.lit(0).cast("long")))


def _check(timed: DataFrame, size: int) -> None:
    """Raises for the first word that is no change, and for a time below the one before it."""
    bad = timed.where("kind = 'bad'").agg(F.min(F.struct("n", "token"))).first()[0]
    if bad is not None:
        raise ValueError(f"word {bad['n']} after the definitions is no change: {bad['token'][:80]}")
    # Changes before the first time are at time 0.
    marks = timed.where("own IS NOT NULL OR n = 0").select("n", "tick")
    marks = number_rows(marks, "n", name="j", size=size)
    fallen = marks.join(marks.select((F.col("j") + 1).alias("j"), F.col("tick").alias("was")), "j").where("tick < was").agg(F.min(F.struct("n", "tick"))).first()[0]
    if fallen is not None:
        raise ValueError(f"time {fallen['tick']} is below the one before it")


def read_vcd_capture(spark: SparkSession, path: str, capture_id: int = 0, size: int = BUCKET) -> tuple[DataFrame, DataFrame, str]:
    """Runs, times (``sample``, ``tick``) and the time scale, of a file or of a folder of parts (``read_vcd``)."""
    return read_vcd(spark, path, capture_id, size)[:3]


def read_vcd(spark: SparkSession, path: str, capture_id: int = 0, size: int = BUCKET) -> tuple[DataFrame, DataFrame, str, list[tuple[str, str, int]]]:
    """Runs, times (``sample``, ``tick``), the time scale, and the variables (name, identifier, width).

    Changes before the first time belong to time 0; the last change of a variable at a time counts; variables that are
    not dumped at the first time start as x. A time without changes is a sample all the same. size: words and samples in a
    bucket.
    """
    text = numbered(lines(spark, path), "row")
    end = text.where(F.col("value").contains("$enddefinitions")).agg(F.min("row")).first()[0]
    if end is None or end > MOST_HEADER:
        raise ValueError("the definitions don't end")
    head = [r.value for r in text.where(F.col("row") <= end).orderBy("row").select("value").collect()]
    variables, scale = header(head)
    rest = re.split(r"\$enddefinitions\s*(?:\$end)?", head[-1], maxsplit=1)[1]
    body = text.where(F.col("row") >= end).select("row", F.when(F.col("row") == end, F.lit(rest)).otherwise(F.col("value")).alias("value"))
    body = body.where(~((F.col("row") == end + 1) & F.trim("value").eqNullSafe("$end")))
    timed = settled(changes_of(body, size), "vcd-changes")
    _check(timed, size)
    times = settled(number_rows(timed.select("tick").distinct(), "tick", size=size).select("sample", "tick"), "vcd-times")
    last = timed.where("ident IS NOT NULL").groupBy("tick", "ident").agg(F.max_by("raw", "n").alias("raw"))
    # One row per variable of the header, whose size is checked above.
    names = spark.createDataFrame(variables, "signal string, ident string, width int")
    told = last.join(times, "tick").join(names, "ident").select("signal", "width", F.col("sample").alias("start"), "raw")
    first = names.select("signal", "width", F.lit(0).cast("long").alias("start"), F.lit("X").alias("raw")).join(told.where("start = 0").select("signal"), "signal", "left_anti")
    every = settled(told.unionByName(first), "vcd-runs")
    padded = padded_digits(F.col("raw"), F.col("width"))
    digits = F.regexp_replace(padded, "^0+(?=.)", "")
    known = padded.rlike("^[01]+$")
    num = F.when(known & (F.length(digits) <= 63), F.conv(digits, 2, 10).cast("long"))
    count = times.agg((F.max("sample") + 1).alias("count"))
    ended = neighbour(every.withColumn("capture_id", F.lit(capture_id).cast("long")), "start", ["start"], KEYS, size, "_next", after=True)
    runs = ended.crossJoin(F.broadcast(count)).select(
        "capture_id", "signal", "start", F.coalesce("_next.start", "count").alias("end"), num.alias("num"), F.when(num.isNull(), F.when(known, digits).otherwise(padded)).alias("txt")
    )
    return merge_seams(runs, size), times, scale, variables


def padded_digits(raw: Column, width: Column) -> Column:
    """A shorter value that begins with x or z is filled up with that letter."""
    letter = F.substring(raw, 1, 1)
    return F.when(letter.isin("X", "Z"), F.concat(F.repeat(letter, F.greatest(F.lit(0), width - F.length(raw))), raw)).otherwise(raw)


def write_vcd_capture(changes: DataFrame, widths: dict[str, int], path: str, scale: str = "1ns") -> None:
    """changes: ``tick``, ``signal``, ``num`` (null: x). A folder of parts in the order of time, written side by side."""
    spark = changes.sparkSession
    ids = {n: chr(33 + i) for i, n in enumerate(widths)}
    head = [f"$timescale {scale} $end", "$scope module top $end", *[f"$var wire {w} {ids[n]} {n} $end" for n, w in widths.items()], "$upscope $end", "$enddefinitions $end"]
    code = F.create_map(*[F.lit(x) for p in ids.items() for x in p])[F.col("signal")]
    wide = F.create_map(*[F.lit(x) for p in widths.items() for x in p])[F.col("signal")]
    value = F.when(wide == 1, F.concat(F.coalesce(F.col("num").cast("string"), F.lit("x")), code)).otherwise(F.concat(F.lit("b"), F.coalesce(F.bin("num"), F.lit("x")), F.lit(" "), code))
    rows = changes.select("tick", F.lit(1).alias("k"), F.col("signal").alias("s"), value.alias("value"))
    marks = changes.select("tick").distinct().select("tick", F.lit(0).alias("k"), F.lit("").alias("s"), F.format_string("#%d", "tick").alias("value"))
    heads = spark.createDataFrame([(-1, i, "", h) for i, h in enumerate(head)], "tick long, k int, s string, value string")
    write_in_order(heads.unionByName(marks).unionByName(rows), ["tick", "k", "s"], path)
