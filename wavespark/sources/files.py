"""Reading capture files as text, in order, and folders that the whole cluster sees."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``; below one of this machine only where Spark runs on it alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='wavespark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: what follows goes over them several times, and a lost executor
    costs a read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of frames in a task where each becomes a hundred rows.
FRAMES = 16_384


def pieces(frames: DataFrame, each: int = FRAMES) -> int:
    """Tasks for so many frames: not by their size, which says little of the rows that they become."""
    return max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frames.count() // each))


def split_name() -> Column:
    """The file and the first byte of the split that a row is read in; in order they are the order of the text."""
    return F.concat("_metadata.file_path", F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` with ``block`` (the split it is in) and ``line`` (its place in the split) of a text file, or of the files
    of a folder in the order of their names.

    Splits are known by their file and first byte, so the order is that of the text whatever the order in which splits
    are read.
    """
    raw = spark.read.text(path).select(split_name().alias("block"), "value", F.monotonically_increasing_id().alias("_id"))
    return raw.withColumn("line", F.row_number().over(Window.partitionBy("block").orderBy("_id")) - 1).drop("_id")


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a file, or of the first file of a folder."""
    files = sorted(spark.read.text(path).inputFiles())
    return [r.value for r in spark.read.text(files[0]).limit(n).collect()] if files else []


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds the place in the text, from 0: one count per split is summed over the splits before."""
    counts = df.groupBy("block").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("block").alias("_b"), F.coalesce(F.sum("_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("line")) - 1
    return df.withColumn("_place", place).join(before, F.col("block") == F.col("_b")).withColumn(name, F.col("_before") + F.col("_place")).drop("_b", "_before", "_place", "_n")


def write_in_order(rows: DataFrame, order: list[str], path: str) -> None:
    """Column ``value`` as text files whose names are in the order of the columns ``order``, which are written side by side."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def write_bytes(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Column ``value`` (binary) in the order of the columns ``order`` as a folder of parts whose names are in that order; returns ``part, path,
    bytes`` of each.

    Parts are written side by side into a folder beside the path, and tasks that run twice write two files; those that the manifest (written
    by Spark, so of one attempt a task) names are kept. Only then does the folder take the place of what lay at the path before.
    """
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(made)
        fs.create_dir(root, recursive=True)
        name, size, part = f"{uuid.uuid4().hex}.bin", 0, None
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                part = batch.column(0)[0].as_py() if part is None and batch.num_rows else part
                data = b"".join(batch.column(1).to_pylist())
                out.write(data)
                size += len(data)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "bytes": size}] if part is not None else [], pa.schema([("part", pa.int64()), ("path", pa.string()), ("bytes", pa.int64())]))

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "value")
    spark = rows.sparkSession
    parts = settled(dealt.mapInArrow(run, "part long, path string, bytes long"), "bytes").orderBy("part").collect()  # a row for each task
    fs, root = pafs.FileSystem.from_uri(made)
    fs.create_dir(root, recursive=True)
    kept = [(i, f"part-{i:08d}.bin", r.bytes) for i, r in enumerate(parts)]
    for r, (_, name, _) in zip(parts, kept, strict=True):
        fs.move(f"{root}/{r.path}", f"{root}/{name}")
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.base_name not in {n for _, n, _ in kept}:
            fs.delete_file(info.path)
    last = pafs.FileSystem.from_uri(path.rstrip("/"))[1]
    if fs.get_file_info(last).type != pafs.FileType.NotFound:
        old = f"{last}.{uuid.uuid4().hex}.old"
        fs.move(last, old)
        fs.move(root, last)
        fs.delete_dir(old) if fs.get_file_info(old).type == pafs.FileType.Directory else fs.delete_file(old)
    else:
        fs.move(root, last)
    return spark.createDataFrame(kept, "part long, path string, bytes long")
