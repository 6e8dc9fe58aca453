"""Lines of growing files as a data source: in batches by byte ranges, in streams by offsets, so that appended lines come once.

    register(spark)
    spark.read.format("tailed_lines").load(folder)          path, offset, value
    spark.readStream.format("tailed_lines").load(folder)    the same, as files grow
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a partition if option splitBytes doesn't say so.
SPLIT_BYTES = 64 << 20
SCHEMA = "path string, offset long, value string"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def files_of(uri: str) -> tuple[object, list[tuple[str, int]]]:
    """The file system and (path, size) of a file or of the files of a folder, names with . or _ in front left out."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    at = system.get_file_info(root)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def ranges(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, at, min(at + size, end)) for at in range(start, end, size)]


def lines(uri: str, part: Range) -> Iterator[tuple[str, int, str]]:
    """The lines that begin in a range, whole, with the byte that each begins at; bytes that are no UTF-8 are replaced."""
    system, _ = files_of(uri)
    with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < part.end and (line := f.readline()):
            yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


def whole_lines(system: object, path: str, size: int, block: int = 1 << 16) -> int:
    """The bytes of a file up to its last line end: a line that is being written isn't read yet."""
    with system.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - block)
            f.seek(start)
            found = f.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


class Batch(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def partitions(self) -> list[Range]:
        return [r for path, n in files_of(self.uri)[1] for r in ranges(path, 0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        return lines(self.uri, partition) if partition.path else iter(())


class Stream(DataSourceStreamReader):
    """An offset is the bytes read of each file; a file that shrank is read from its start."""

    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, found = files_of(self.uri)
        return {"files": json.dumps({path: whole_lines(system, path, n) for path, n in found})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        grown = ((path, n, before.get(path, 0)) for path, n in after.items())
        return [r for path, n, seen in grown for r in ranges(path, seen if seen <= n else 0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        return lines(self.uri, partition) if partition.path else iter(())


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def _of(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema: StructType) -> Batch:
        return Batch(*self._of())

    def streamReader(self, schema: StructType) -> Stream:
        return Stream(*self._of())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailedLines)


def metrics(text: DataFrame) -> DataFrame:
    """name, labels, number of lines (value) `name{label="x",...} number [time]`; comments and lines of another form go. In
    labels \\" \\\\ and \\n stand for a quotation mark, a backslash and a line end."""
    label = r'[a-zA-Z_][a-zA-Z0-9_]*="(?:[^"\\]|\\.)*"'
    form = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{{((?:{label},?)*)\}})?[ \t]+([^ \t]+)(?:[ \t]+-?[0-9]+)?[ \t]*$"
    x = text.where(F.col("value").rlike(form)).select(*(F.regexp_extract("value", form, i).alias(n) for i, n in ((1, "name"), (2, "said"), (3, "number"))))
    pairs = F.regexp_extract_all("said", F.lit(label), F.lit(0))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), _unescaped(F.regexp_extract(p, r'(?s)^[^=]*="(.*)"$', 1)))))
    number = F.regexp_replace(F.regexp_replace("number", r"^\+", ""), "^(-?)Inf$", "$1Infinity").try_cast("double")
    return x.select("name", labels.alias("labels"), number.alias("number")).where("number is not null")


def _unescaped(said: Column) -> Column:
    """Pairs of backslashes first become a mark that no text has, so that what follows them isn't taken for an escape."""
    x = F.replace(said, F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
