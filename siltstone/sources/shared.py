"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    return written_to(df, scratch_path(df.sparkSession, name))


class Scratch:
    """Tables that one operation needs on its way, in a folder of their own that is deleted when the operation ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, scratch_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete(self.path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return written_to(df, f"{self.path}/{self.n}-{name}")

    def replaced(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in place of the one of that name before, which df may still read."""
        before = f"{self.path}/{self.n}-{name}"
        out = self.written(df, name)
        self.delete(before)
        return out

    def delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Keys that hold more than one in HEAVY of all rows are heavy: fewer than HEAVY keys are, so they may be broadcast.
HEAVY = 20_000


def heavy_split(rows: DataFrame, keys: str | list[str], stats: DataFrame, most: int) -> DataFrame:
    """rows joined with their keys' stats, of which k is the number of rows: keys of more than `most` rows by broadcast, the
    others by shuffle."""
    heavy = F.broadcast(stats.where(F.col("k") > most))
    rest = rows.join(heavy, keys, "left_anti").join(stats.where(F.col("k") <= most), keys)
    return rows.join(heavy, keys).unionByName(rest)


STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files of `source`, built once in an application and again if the files change."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    state = "|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files))
    key = (spark.sparkContext.applicationId, state, name)
    if key not in STORED:
        STORED[key] = written(build(), name)
    return STORED[key]


#: At most so many rows go to a Python worker at a time.
BATCH_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def lowered_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of a batch, never raises them; 0 or less is no limit."""
    now = int(spark.conf.get(BATCH_ROWS))
    if not 0 < now <= MOST_ROWS:
        spark.conf.set(BATCH_ROWS, str(MOST_ROWS))
