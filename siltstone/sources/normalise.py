"""Text, CSV and JSON inputs as event contents, and export as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole text files (.txt, .md)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_json_items(spark: SparkSession, path: str) -> DataFrame:
    """path, content of JSON files: an event for each item of an array, one for an object."""
    return read_texts(spark, path).select("path", F.explode(json_items(F.col("content"))).alias("content"))


def json_items(content: Column) -> Column:
    """The items of a JSON array, or the one value that is no array, each as JSON."""
    items = F.coalesce(F.from_json(F.when(F.ltrim(content).startswith("["), content), "array<variant>"), F.array(F.try_parse_json(content)))
    return F.transform(items, lambda x: F.to_json(x))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """content of a CSV file with a header: an event for the header and one for each row."""
    return csv_rows(spark.read.option("header", True).csv(path))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def inline_texts(spark: SparkSession, texts: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """content, metadata of texts given in a call."""
    return spark.createDataFrame(texts, "content string, metadata map<string,string>")


def commits(log: DataFrame) -> DataFrame:
    """sha, author, at, content of an exported log: lines `sha<TAB>author<TAB>ISO time<TAB>subject` (value), others dropped."""
    parts = F.split("value", "\t", 4)
    return log.where(F.col("value").rlike(r"^[0-9a-f]{7,40}\t[^\t]*\t[^\t]+\t")).select(parts[0].alias("sha"), parts[1].alias("author"), flexible_time(parts[2]).alias("at"), parts[3].alias("content"))


def unseen(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, each key once."""
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def flexible_time(text: Column) -> Column:
    """A time in RFC 3339, with zone and fraction, or a date; null for anything else."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), text.try_cast("timestamp"))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp"))
    return F.coalesce(full, day)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 of text files as they arrive or change, each content of a path once."""
    raw = spark.readStream.format("text").option("wholetext", True).load(path)
    x = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return x.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["path", "sha256"])


def text_chunks(df: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """key, chunk_index, content of the trimmed parts between separators, without empty ones."""
    x = df.select(key, F.posexplode(F.split(text, separator)).alias("chunk_index", "content"))
    return x.select(key, "chunk_index", F.trim("content").alias("content")).where("content <> ''")


def csv_rows(df: DataFrame) -> DataFrame:
    """content: the header as JSON, and each row with its values as strings; unnamed columns are col_N."""
    names = [c or f"col_{i + 1}" for i, c in enumerate(df.columns)]
    rows = df.toDF(*names).select(F.to_json(F.struct(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("row"))).alias("content"))
    header = df.sparkSession.range(1).select(F.to_json(F.struct(F.array(*map(F.lit, names)).alias("headers"))).alias("content"))
    return header.unionByName(rows)


def stamped(events: DataFrame, source: dict[str, Column], form: str) -> DataFrame:
    """Events with a metadata map: where the input came from, under names that begin with input_, and its form."""
    entries = [x for name, value in source.items() for x in (F.lit(f"input_{name}"), value.cast("string"))]
    return events.withColumn("metadata", F.create_map(*entries, F.lit("normalized_from"), F.lit(form)))


def markdown(key: Column, fields: dict[str, Column], body: Column) -> Column:
    """A document with its fields as front matter."""
    lines = [F.lit("---\nid: "), key.cast("string"), F.lit("\n")]
    for name, value in fields.items():
        lines += [F.lit(f"{name}: "), value.cast("string"), F.lit("\n")]
    return F.concat(*lines, F.lit("---\n"), body, F.lit("\n"))


def from_markdown(content: Column, names: list[str]) -> Column:
    """The fields and body of a Markdown export."""
    fields = [F.regexp_extract(content, rf"(?m)^{name}: (.*)$", 1).alias(name) for name in names]
    return F.struct(*fields, F.regexp_extract(content, r"(?s)\A---\n.*?\n---\n(.*)\n\z", 1).alias("body"))


def new_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (path, content) whose content is not stored under their path yet: a first read, or a changed file."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(stored.select("path", "sha256"), ["path", "sha256"], "left_anti")
