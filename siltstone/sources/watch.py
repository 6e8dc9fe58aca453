"""A watch over folders of text files: what is new, changed or gone since the look before.

Each look compares what Spark lists with the last state: a table of paths with their size, time and hash, written under the
look's number beside what changed. Only files whose size or time differ are read, and only those whose hash differs count.
An empty file counts as not there, as Spark lists none. A look that is done again replaces its own tables from the state before it, so nothing is found twice and nothing lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "path string, size long, modified timestamp, sha256 string"
CHANGES = "path string, change string, sha256 string, content string"


def listed(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """path, size, modified of the files below a folder, whose contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def numbers(spark: SparkSession, out: str) -> list[int]:
    """The looks whose state is whole, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/state")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [x.getPath() for x in fs.listStatus(path)]
    return sorted(int(p.getName().removeprefix("look=")) for p in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def state_before(spark: SparkSession, out: str, look: int) -> DataFrame:
    before = [n for n in numbers(spark, out) if n < look]
    return spark.read.schema(STATE).parquet(f"{out}/state/look={before[-1]}") if before else spark.createDataFrame([], STATE)


def look(spark: SparkSession, folder: str, out: str, number: int, names: str = "*") -> None:
    """Writes the changes (path, change: new, changed or removed, sha256, content) and the state of look `number`."""
    before = state_before(spark, out, number)
    old = before.select("path", *(F.col(c).alias(f"old_{c}") for c in ("size", "modified", "sha256")))
    met = listed(spark, folder, names).join(old, "path", "full")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified"))
    kept = f"{out}/listing/look={number}"
    met.withColumn("same", F.coalesce(same, F.lit(False))).write.mode("overwrite").parquet(kept)
    met = spark.read.parquet(kept)
    todo = met.where("not same and size is not null").select("path", "old_sha256")
    # the least time among them keeps the reader from opening older files
    since = met.where("not same and size is not null").agg(F.min("modified")).first()[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    files = files.where(F.col("modificationTime") >= F.lit(since)) if since is not None else files.where(F.lit(False))
    read = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    hashed = todo.join(read, "path")
    found = hashed.where(F.col("old_sha256").isNull() | (F.col("sha256") != F.col("old_sha256"))).select("path", F.when(F.col("old_sha256").isNull(), "new").otherwise("changed").alias("change"), "sha256", "content")
    gone = met.where("size is null").select("path", F.lit("removed").alias("change"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("content"))
    found.unionByName(gone).write.mode("overwrite").parquet(f"{out}/changes/look={number}")
    unread = met.where("same").select("path", "size", "modified", F.col("old_sha256").alias("sha256"))
    unread.unionByName(hashed.select("path", "size", "modified", "sha256")).write.mode("overwrite").parquet(f"{out}/state/look={number}")


def changes(spark: SparkSession, out: str) -> DataFrame:
    """look, path, change, sha256, content of all looks whose state is whole."""
    done = numbers(spark, out)
    rows = [spark.read.schema(CHANGES).parquet(f"{out}/changes/look={n}").select(F.lit(n).alias("look"), "*") for n in done]
    out_rows = spark.createDataFrame([], "look int, " + CHANGES)
    for x in rows:
        out_rows = out_rows.unionByName(x)
    return out_rows


def watch(spark: SparkSession, folder: str, out: str, every: str = "30 seconds", names: str = "*"):
    """A running query that looks at fixed intervals, numbered by its checkpoint: after a restart it goes on from the last
    state, and a look that was cut short is done again under its number."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, number: look(spark, folder, out, number, names)).option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime=every).start()
