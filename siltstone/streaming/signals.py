"""Event streams: idempotent delivery, hourly windows, signals, and incremental relations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.model import instant
from siltstone.operators import detect
from siltstone.sources.shared import shared_dir, written

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder of Parquet files as they arrive, each event once while it is less than LATE late."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return batch(raw).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def batch(events: DataFrame) -> DataFrame:
    at = instant("ts") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.col("ts")
    return events.select("event_id", at.alias("ts"), "user_id", "event_type", "value")


def hourly(events: DataFrame) -> DataFrame:
    """Counts and totals of each event type in windows of an hour."""
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def signals(windows: DataFrame, spike: float = 2.0) -> DataFrame:
    """Windows that stand out among their event type's others: spike or drop by z-score, and stall where an hour had at
    most a tenth of the mean. The strength is the z-score. These measures are this engine's own."""
    w = Window.partitionBy("event_type")
    z = (F.col("n") - F.avg("n").over(w)) / F.stddev_pop("n").over(w)
    kind = F.when(F.col("n") <= F.avg("n").over(w) / 10, "stall").when(z >= spike, "spike").when(z <= -spike, "drop")
    return windows.select("window", "event_type", "n", z.alias("strength"), kind.alias("signal")).where("signal is not null and strength is not null")


def trends(windows: DataFrame, least: float = 0.1) -> DataFrame:
    """event_type, slope (per hour), trend of hourly windows: rising or falling where a line explains that share."""
    x = F.unix_seconds("window.start") / 3600.0
    g = windows.groupBy("event_type").agg(F.regr_slope(F.col("n").cast("double"), x).alias("slope"), F.regr_r2(F.col("n").cast("double"), x).alias("fit"))
    clear = F.col("fit") >= least
    return g.withColumn("trend", F.when(clear & (F.col("slope") > 0), "rising").when(clear & (F.col("slope") < 0), "falling").otherwise("flat"))


#: Fixed choices of this engine's measures: how far from the median a window is an anomaly (in deviations that outliers don't
#: stretch), the longest period and least autocorrelation of a season, the least number and the greatest unevenness of the gaps
#: of what recurs, a spike's distance from the mean, and the fit of a trend.
ANOMALY, MOST_LAG, LEAST_SEASON, LEAST_GAPS, MOST_UNEVEN, SPIKE, LEAST_FIT = 3.5, 48, 0.3, 3, 0.25, 2.0, 0.1
MAD = 0.6745


def series(windows: DataFrame) -> DataFrame:
    """event_type, hour (hours since 1970), n of every hour from a type's first to its last, 0 where no event came."""
    x = windows.select("event_type", F.floor(F.unix_seconds("window.start") / 3600).alias("hour"), F.col("n").cast("double").alias("n"))
    ends = x.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return ends.select("event_type", F.explode(F.sequence("a", "b")).alias("hour")).join(x, ["event_type", "hour"], "left").fillna(0.0, ["n"])


def patterns(windows: DataFrame) -> DataFrame:
    """event_type, pattern, strength, confidence (0 to 1), grade, first_hour, last_hour of what stands out in hourly windows:
    trend, spike, drop, stall, anomaly, seasonality and recurrence. Confidence grows with the hours (or gaps) seen. A series
    that does not vary shows nothing; hours without events count as 0."""
    s = written(series(windows), "series")
    whole = s.groupBy("event_type").agg(
        F.count("*").alias("hours"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.expr("percentile(n, 0.5)").alias("middle"), F.min("hour").alias("a"), F.max("hour").alias("b"),
        F.regr_slope("n", "hour").alias("slope"), F.regr_r2("n", "hour").alias("fit"),
    ).where("sd > 0")
    x = s.join(whole, "event_type")
    spread = x.groupBy("event_type").agg((F.expr("percentile(abs(n - middle), 0.5)") / MAD).alias("spread"))
    z, seen = (F.col("n") - F.col("mean")) / F.col("sd"), F.col("hours") / (F.col("hours") + 24)

    def rows(df: DataFrame, pattern: Column, strength: Column, confidence: Column, first: str = "hour", last: str = "hour") -> DataFrame:
        return df.select("event_type", pattern.alias("pattern"), F.least(F.lit(1.0), strength).alias("strength"), confidence.alias("confidence"), F.col(first).alias("first_hour"), F.col(last).alias("last_hour"))

    kind = F.when(F.col("n") <= F.col("mean") / 10, "stall").when(z >= SPIKE, "spike").when(z <= -SPIKE, "drop")
    out = [rows(x.withColumn("kind", kind).where("kind is not null"), F.col("kind"), F.when(F.col("kind") == "stall", 1 - F.col("n") / F.col("mean")).otherwise(F.abs(z) / (2 * SPIKE)), seen)]
    far = F.abs(F.col("n") - F.col("middle")) / F.col("spread")
    out.append(rows(x.join(spread, "event_type").where((F.col("spread") > 0) & (far >= ANOMALY)), F.lit("anomaly"), far / (2 * ANOMALY), seen))
    out.append(rows(whole.where(F.col("fit") >= LEAST_FIT), F.lit("trend"), F.sqrt("fit"), F.col("fit") * seen, "a", "b"))
    # each hour meets those up to MOST_LAG before it
    ahead = x.select("event_type", "hours", "a", "b", F.explode(F.sequence(F.lit(2), F.lit(MOST_LAG))).alias("lag"), (F.col("hour") + F.col("lag")).alias("hour"), ((F.col("n") - F.col("mean")) / F.col("sd")).alias("before"))
    both = ahead.where(F.col("lag") * 2 <= F.col("hours")).join(x.select("event_type", "hour", z.alias("now")), ["event_type", "hour"])
    waves = both.groupBy("event_type", "lag", "hours", "a", "b").agg((F.sum(F.col("before") * F.col("now")) / F.count("*")).alias("r"))
    best = waves.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc(F.round("r", 9)), "lag"))).where((F.col("place") == 1) & (F.col("r") >= LEAST_SEASON))
    out.append(rows(best, F.lit("seasonality"), F.col("r"), F.least(F.lit(1.0), F.col("hours") / (F.col("lag") * 8)), "a", "b"))
    times = x.where(z >= SPIKE).select("event_type", "hour", (F.col("hour") - F.lag("hour").over(Window.partitionBy("event_type").orderBy("hour"))).alias("gap"))
    gaps = times.groupBy("event_type").agg(F.count("gap").alias("gaps"), (F.stddev_pop("gap") / F.avg("gap")).alias("uneven"), F.min("hour").alias("a"), F.max("hour").alias("b"))
    out.append(rows(gaps.where((F.col("gaps") >= LEAST_GAPS) & (F.col("uneven") <= MOST_UNEVEN)), F.lit("recurrence"), 1 - F.col("uneven"), F.col("gaps") / (F.col("gaps") + 2), "a", "b"))
    grade = F.when(F.col("strength") * F.col("confidence") >= 0.5, "clear").when(F.col("strength") * F.col("confidence") >= 0.2, "likely").otherwise("possible")
    return reduce(DataFrame.unionByName, out).withColumn("grade", grade)


def delivered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream two times over, as a source does that delivers again, into a table of the shared
    folder; what is within the watermark is dropped as a duplicate."""
    out = f"{shared_dir(spark)}/redelivered-{uuid.uuid4().hex}"
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(sf_dir + "/events.parque*")
    twice = batch(raw).withColumn("times", F.explode(F.array(F.lit(1), F.lit(2))))
    once = twice.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]).drop("times")
    stream = once.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{out}/table")


def counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, n of the events table read to its end as a stream into a table of the shared folder; what is read back
    is the last version of each count."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = batch(spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(sf_dir + "/events.parque*")).groupBy("event_type").agg(F.count("*").alias("n"))

    def save(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    stream = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.option("basePath", f"{out}/table").parquet(f"{out}/table")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").select("event_type", "n")


def related(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Relations of new claims with one another and with stored ones."""
    return detect.relations(new).unionByName(detect.new_relations(new, stored)).select("from_id", "to_id", "type")


def relate_batch(stored: DataFrame, path: str):
    """A foreachBatch function: relations of each batch of claims (claim_id, text) with one another and with stored ones,
    written under the batch's number, so that a batch that is delivered again replaces its own rows."""

    def run(rows: DataFrame, number: int) -> None:
        related(rows, stored).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
