"""Cut lineage through a Parquet table in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where the setting is absent (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gradewell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _on(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _on(spark, path)
    files.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table whose readers have all ended."""
    files, where = _on(spark, path)
    files.delete(where, True)


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: executors lost later cost no recomputation."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT = 4096  # rows of one key that one task may join
LISTED = 50_000  # hot keys in a broadcast


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """many joined to one, in which key is unique and n counts its rows in many (total: all of them).

    A key of more than HOT rows is dealt over tasks by a hash of column by, its row of one being repeated for each. Keys of more than
    total / LISTED rows are LISTED at most, so their list is small at any size. one is read three times: a stored table.
    """
    most = max(HOT, total // LISTED)
    hot = F.broadcast(one.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def one_text(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """docs in which each id has one text, whatever the order of rows, and the rows of other texts of these ids, if there are any.

    Of an id's different texts the one with the smallest hash stands for it.
    """
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    by = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(h).alias("_kept"), F.max(h).alias("_other"))
    several = store(by.where("_kept != _other").select(F.col(doc_id), "_kept"), "texts-of-one-id")
    if several.isEmpty():
        return docs, None
    marked = docs.join(several, doc_id, "left").withColumn("_own", F.coalesce(F.col("_kept") == h, F.lit(True)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where("_own").select(*columns), marked.where("not _own").select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
