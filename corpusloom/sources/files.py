"""Text folders and JSON lines, read and written by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusloom.functions import conversations, payloads, text


def text_pages(spark: SparkSession, folder: str) -> DataFrame:
    """file, page, content of the *.txt files of a folder, whole and stripped."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), text.strip(F.col("value")).alias("content")).withColumn("page", text.page_name(F.col("file")))


def json_lines(spark: SparkSession, path: str, strict: bool = True, blank: str = "skip") -> DataFrame:
    """line (a string), value (variant) and position (in the order of the file) of every line.

    strict: a line that isn't one JSON value fails the query when it is read; else it is dropped.
    blank: "skip" leaves out blank lines, "error" takes them as lines that aren't JSON.
    """
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return parse_lines(spark.read.text(path).select(F.col("value").alias("line"), place.alias("position")), strict, blank)


def parse_lines(lines: DataFrame, strict: bool = True, blank: str = "skip") -> DataFrame:
    """json_lines() for lines (line and other columns) that a table has."""
    if blank not in ("skip", "error"):
        raise ValueError("blank must be skip or error")
    rows = lines.filter(text.strip(F.col("line")) != "") if blank == "skip" else lines
    # through a generator, so that a filter on the value doesn't parse the line again
    parsed = rows.select(*[c for c in rows.columns if c != "value"], F.explode(F.array(payloads.strict_json(F.col("line")))).alias("value"))
    if strict:
        return parsed.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.col("line"))).cast("variant")).otherwise(F.col("value")))
    return parsed.filter("value is not null")


def samples(lines: DataFrame) -> DataFrame:
    """messages of json_lines() rows; null where they aren't a list of objects."""
    return lines.select(payloads.messages(F.col("value")).alias("messages"))


def existing_questions(spark: SparkSession, path: str) -> DataFrame:
    """question keys of a file that may be malformed in places; none where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "question string")
    found = samples(json_lines(spark, path, strict=False))
    first = F.get(F.col("messages"), 0)
    return found.filter(F.coalesce(first["role"] == "user", F.lit(False))).select(conversations.question_key(F.col("messages"), collapsed=False).alias("question")).filter("question is not null").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)  # noqa: SLF001


def missing_inputs(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """One message for each of the named paths that isn't there."""
    return [f"missing {name}: {path}" for name, path in paths.items() if not exists(spark, path)]


def too_few(rows: DataFrame, least: int = 50) -> bool:
    """Whether a table has fewer rows than training should have; reads `least` rows at most."""
    return rows.limit(least).count() < least


def ascii_json(rows: DataFrame, *columns: str) -> Column:
    """A row as a line of JSON with every character beyond ASCII escaped, in UTF-16 units."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    units = F.encode(line, "UTF-16BE")
    groups = F.regexp_extract_all(F.hex(units), F.lit("(.{4})"), F.lit(1))
    escaped = F.array_join(F.transform(groups, lambda h: F.when(h < "0080", F.decode(F.unhex(F.substring(h, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\u"), F.lower(h)))), "")
    return F.when(F.rlike(line, F.lit("[^\\x00-\\x7f]")), escaped).otherwise(line)


def write_json_lines(rows: DataFrame, path: str, by: list[str] | None = None, ascii_only: bool = False) -> None:
    """JSON lines, in a folder for each value of `by`; in UTF-8, or with ascii_only escaped beyond ASCII."""
    by = by or []
    if ascii_only:
        line = ascii_json(rows, *[c for c in rows.columns if c not in by])
        rows.select(*by, line.alias("value")).write.mode("overwrite").partitionBy(*by).text(path)
    else:
        rows.write.mode("overwrite").partitionBy(*by).json(path)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _PageFiles(DataSource):
    """A sink of one file for each row (text_file, value) in the folder `path`, of any file system that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PageFilesWriter(self.options["path"])


class _PageFilesWriter(DataSourceWriter):
    """Tasks write the files under other names and rename them; an abort removes what tasks have renamed."""

    def __init__(self, path: str):
        self.path = path

    def _folder(self):
        from pyarrow import fs

        at = self.path if "://" in self.path or ":/" not in self.path else self.path.replace(":/", ":///", 1)
        return fs.FileSystem.from_uri(at) if ":" in at.split("/")[0] else (fs.LocalFileSystem(), at)

    def write(self, rows: Iterator) -> _Written:
        files, folder = self._folder()
        files.create_dir(folder, recursive=True)
        names: list[str] = []
        try:
            for row in rows:
                hidden = f"{folder}/.{uuid.uuid4().hex}"
                try:
                    with files.open_output_stream(hidden) as out:
                        out.write(row.value.encode())
                    files.move(hidden, f"{folder}/{row.text_file}")
                except BaseException:
                    _remove(files, hidden)
                    raise
                names.append(row.text_file)
        except BaseException:
            for name in names:
                _remove(files, f"{folder}/{name}")
            raise
        return _Written(names)

    def abort(self, messages: list) -> None:
        files, folder = self._folder()
        for message in messages:
            for name in message.names if message else []:
                _remove(files, f"{folder}/{name}")


def _remove(files, path: str) -> None:
    try:
        files.delete_file(path)
    except OSError:
        pass


def write_pages(files: DataFrame, path: str) -> None:
    """One UTF-8 file, named by text_file, for each text_file of (text_file, value, place).

    Of equal names the value with the greatest place stays, as when pages are written in the order of a crawl; without a
    column place, the greatest value. That is decided before anything is written, so every file has one writer, and a task
    that is repeated writes the same files again. If the job fails, the files that it has written are removed.
    """
    order = "place" if "place" in files.columns else "value"
    last = files.groupBy("text_file").agg(F.max_by("value", order).alias("value"))
    files.sparkSession.dataSource.register(_PageFiles)
    last.write.format("page_files").mode("append").option("path", path).save()


def json_array(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row, value: all rows as an indented JSON array, in order. For an index of a crawl's size (its page limit bounds it)."""
    columns = rows.columns
    one = rows.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], F.struct(*columns).alias("r")))).alias("a"))
    return one.select(F.to_json(F.transform("a", lambda x: x["r"]), {"pretty": "true"}).alias("value"))


def preview(rows: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows in order."""
    return rows.orderBy(*order).limit(n)
