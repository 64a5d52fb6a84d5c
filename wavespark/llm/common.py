"""What the corpus operators share: word rules, tables in the shared folder, components of links.

Executors come and go, so lineage is cut only by Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``; nothing is kept in a machine's own folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same class is read by Java, Python and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named (tests on one machine) a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='wavespark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder by one operator; superseded ones are dropped as soon as they may be.

    The shuffle files of a write are of no use once its table stands, so Spark is asked to remove them with the
    query that made them; a lost executor then costs a re-read of the table, not of its history.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []  # so that no other table gets the id of a written one

    def write(self, df: DataFrame) -> DataFrame:
        """Write and reread: the result's lineage is a scan."""
        self.n += 1
        path, was = f"{self.root}/{self.n}", self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(self.CLEAN) if was is None else self.spark.conf.set(self.CLEAN, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.kept.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_bound(share: float) -> int:
    """The 64-bit hash below which that share of all hashes lie."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, exactly; others (whatever they are called) are left out before any join."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def components(scratch: Scratch, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(id, root)`` for every id that has a link, root the smallest.

    Large-star and small-star rounds (every node points its larger, then its smaller neighbours to the smallest it
    knows) until nothing moves. Each round joins on plain keys, so a hub with very many links is split by AQE's
    skew join; nothing is gathered on the driver but two sums a round.
    """
    one = F.col("a") != F.col("b")
    edges = scratch.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(one).distinct())
    before = None
    for turn in range(most_rounds + 1):
        if turn == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Sums are written before they are joined: joined right on top of them, a hub's links would all be one task's.
        low = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = scratch.write(both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(one).distinct())
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where(one).distinct()
        after = scratch.write(small)
        scratch.drop(edges, low, large, least)
        edges = after
        # Edges only ever move to smaller ends; equal sums of both ends mean that nothing moved.
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == before or now[0] == now[3] and _is_star(edges):
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _is_star(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has a parent of its own."""
    return edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
