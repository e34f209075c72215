"""What the operators share: reading tables, the shared scratch folder, staged tables and binary files."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET = "spark.checkpoint.dir"
#: Bits of a bitmap, which is 16 MiB at most, in 4,096 rows.
BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Sets what operators on whole texts need: Arrow batches bounded in rows and bytes, and workers that find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    # Python workers give freed memory back instead of keeping it for later, but for blocks that each chunk of texts takes anew.
    env.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608"})
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared checkpoint folder; a local one only where that is unset and all runs in one JVM, as in tests."""
    base = spark.sparkContext.getConf().get(_UNSET) or spark.conf.get(_UNSET, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_UNSET} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(_UNSET, base)
    return f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputing.

    clean: the shuffle files behind it are let go, where they are large and the work goes on for long.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if clean:
        free(spark)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def _position() -> Column:
    return F.pmod("r1", F.lit(BITS))


def bitmap(keys: DataFrame, name: str) -> DataFrame:
    """A staged bitmap of the hashes r1 of keys: rows (part, bits) that are BITS bits together, whatever the number of keys."""
    at = _position()
    return staged(keys.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")), name)


def marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """rows with `flag`: false for rows whose hash r1 is surely not in the bitmap. What is broadcast is bounded by BITS."""
    at = F.pmod(F.col("r1"), F.lit(BITS))
    bit = at.bitwiseAND(F.lit(32767))
    found = rows.join(F.broadcast(bits), F.shiftright(at, 15) == F.col("part"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.shiftright(byte, 0).bitwiseAND(F.shiftleft(F.lit(1), 0))  # the lowest bit
    for k in range(1, 8):
        set_ = F.when(bit.bitwiseAND(F.lit(7)) == k, F.shiftright(byte, k).bitwiseAND(F.lit(1))).otherwise(set_)
    return found.withColumn("flag", F.coalesce(set_ == 1, F.lit(False))).drop("part", "bits")


def write_files(df: DataFrame, column: str, path: str, ending: bytes) -> None:
    """Writes each row's bytes as a file of its own, ended by the given bytes, by Spark's own committer.

    The text writer puts a line separator after each row; with one row a file, and the format's closing
    magic number as the separator, every file is exactly the bytes wanted, on any store that Spark can write.
    This rests on the writer passing a string's bytes through unchecked, which a test holds for all 256 of them.
    """
    (df.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("encoding", "ISO-8859-1").option("lineSep", ending.decode("latin-1")).text(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file there."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
