"""Mixing sources to target weights.

Tokens are summed per source, every source gets a target from its weight (never above ``max_rate`` times its size; what
is cut off is shared again among the others by weight), and the repetition rate target / size tells how often each
document is taken: floor(rate) times, plus once more if a number drawn from a hash of the seed and its id falls below
the fraction. The draw needs no state: reruns and retried tasks agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows that repeat an id are
separate documents with the same draw (a null id draws as the text ``null``); a source without tokens has rate 0; an
empty table gives an empty table. Other columns pass through untouched; the added columns replace columns of their name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: 13 hex digits of a digest, as a fraction of 1.
_DIGITS, _SCALE = 13, float(16**13)


def draw(seed: str, id_: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, _DIGITS), 16, 10).cast("long") / F.lit(_SCALE)


def ranked(scratch: Scratch, keys: DataFrame, key: str) -> DataFrame:
    """Adds ``place`` (from 0) by code point, null last, without one task that sees all keys.

    The keys are dealt by range and numbered within each range; the driver sees one count per range.
    """
    null = F.col(key).isNull()
    dealt = scratch.write(keys.repartitionByRange(null, F.col(key)).withColumn("range", F.spark_partition_id()))
    counts = dict(dealt.groupBy("range").count().collect())
    order = sorted(counts)
    before = {p: sum(counts[q] for q in order[:i]) for i, p in enumerate(order)}
    offset = F.lit(0).cast("long")
    if before:
        offset = F.create_map(*[F.lit(x).cast(t) for p, n in before.items() for x, t in ((p, "int"), (n, "long"))])[F.col("range")]
    inside = Window.partitionBy("range").orderBy(null, F.col(key))
    return dealt.withColumn("place", offset + F.row_number().over(inside) - 1).drop("range")


def source_targets(
    spark: SparkSession, docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, share: float = 1.0
) -> DataFrame:
    """One row per source: ``mix_source``, ``source_size``, ``weight``, ``target``.

    Targets share ``share`` of all tokens by weight. Sources above ``max_rate`` times their size stop there; each round
    shares the rest among those not stopped, until none is above: two sums a round reach the driver.
    """
    scratch = Scratch(spark, "mix")
    sums = docs.select(F.col(f"`{source}`").alias("mix_source"), word_count(F.col(f"`{text}`")).alias("n")).groupBy("mix_source").agg(F.sum("n").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = scratch.write(ranked(scratch, sums, "mix_source").withColumn("weight", turn).drop("place"))
    cap = F.col("source_size") * F.lit(int(max_rate))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    whole = total if share == 1.0 else int(total * share)
    stopped, known, rest, weight = F.lit(False), -1, whole, 1
    while True:
        n, used, weight = rows.agg(F.count_if(stopped), F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        if n == known or not weight:
            break
        known, rest = n, max(0, whole - used)
        fair = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight))
        stopped = fair > cap
    target = F.when(stopped, cap.cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight or 1)))
    return rows.withColumn("target", target)


def mix(
    spark: SparkSession, docs: DataFrame, text: str = "text", source: str = "source", id_: str = "doc_id", weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, share: float = 1.0, seed: str = "mix-1"
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (0 and more)."""
    targets = source_targets(spark, docs, text, source, weights, max_rate, share)
    kept = docs.drop("size", "source_size", "target", "rate", "copies", "mix_source", "weight").withColumn("size", word_count(F.col(f"`{text}`")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    more = (draw(seed, F.col(f"`{id_}`")) < F.col("rate") - F.floor("rate")).cast("int")
    return kept.join(targets, kept[source].eqNullSafe(targets["mix_source"])).withColumn("rate", rate).withColumn("copies", (F.floor("rate") + more).cast("int")).drop("mix_source", "weight")


def emit(mixed: DataFrame) -> DataFrame:
    """Each document ``copies`` times, with the columns it came with."""
    times = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))
    return mixed.withColumn("copy", times).drop("copy", "size", "source_size", "target", "rate", "copies")
