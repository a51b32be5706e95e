"""Table scans with caps, text and directory scans, routing, URL lists."""

from __future__ import annotations

import os
import shutil
import sys
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_blank
from ..ordering import stored
from ..pyship import ship


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Read a table in a columnar, CSV or JSON form.

    CSV needs a header row; without a schema all its columns are strings (``inferSchema`` as an
    option reads the file twice to find types). JSON is one object a line, types as found.
    """
    if fmt not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"unsupported table format {fmt!r}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def _check_caps(max_rows: int, max_cols: int) -> None:
    if max_rows < 0 or max_cols < 0:
        raise ValueError("max_rows and max_cols must not be negative")


def capped_scan(df: DataFrame, key: list[str], max_rows: int = 0, max_cols: int = 0) -> DataFrame:
    """First ``max_rows`` rows by ``key`` and first ``max_cols`` columns (0: all)."""
    _check_caps(max_rows, max_cols)
    cols = df.columns[:max_cols] if max_cols else df.columns
    if not max_rows:
        return df.select(*cols)
    return df.orderBy(*key).limit(max_rows).select(*cols)


def capped_scan_flags(df: DataFrame, max_rows: int = 0, max_cols: int = 0) -> DataFrame:
    """One row: sizes and whether the caps cut rows or columns."""
    _check_caps(max_rows, max_cols)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        (n > max_rows if max_rows else F.lit(False)).alias("rows_truncated"),
        F.lit(bool(max_cols) and len(df.columns) > max_cols).alias("cols_truncated"),
    )


#: Files that are listed at a time: the driver holds the names of so many, however many texts there are.
FOLDER_FILES = 50_000


def write_texts(df: DataFrame, column: str, path: str, folder_files: int = FOLDER_FILES) -> None:
    """Write every text as a file of its own, ended by one line feed, in folders of at most ``folder_files`` files.

    A folder holds texts of one partition and ends its name with their number. On a file system the tasks
    make the files themselves, since Spark's local writer starts a process for each file; elsewhere Spark's
    writer makes them, and tasks move theirs to their place (committer version 2), which is else work of the driver.
    """
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(root)
    texts = df.select(F.col(column).cast("binary").alias("value"))
    if files.getScheme() != "file":
        folders = max(-(-df.count() // folder_files), 1)
        texts.select(F.col("value").cast("string"), (F.monotonically_increasing_id() % folders).alias("folder")).write.mode("append").partitionBy(
            "folder").options(lineSep="\n", maxRecordsPerFile=1, **{"mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
        return
    base = root.toUri().getPath()

    def run(batches):
        task = TaskContext.get()
        aside, n, k = None, 0, 0

        def done():
            # an attempt's folder is moved as a whole, so a second attempt adds nothing
            os.makedirs(f"{base}/parts", exist_ok=True)
            try:
                os.rename(aside, f"{base}/parts/folder={task.partitionId()}.{k}.{n}")
            except OSError:
                shutil.rmtree(aside)

        for batch in batches:
            for text in batch.column(0):
                if n == folder_files:
                    done()
                    aside, n, k = None, 0, k + 1
                if aside is None:
                    aside = f"{base}/aside/{task.taskAttemptId()}.{k}"
                    os.makedirs(aside)
                with open(f"{aside}/{n}.txt", "wb") as file:
                    file.write((text.as_py() or b"") + b"\n")
                n += 1
        if aside is not None:
            done()
        yield pa.RecordBatch.from_pydict({"files": [k * folder_files + n]})

    texts.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _by_folder(spark: SparkSession, path: str, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Rows of ``read`` over the folders of :func:`write_texts`, some at a time; a plain folder is read as it is.

    Spark counts a small file as 4 MB, which makes a task of every 32; a few tasks a slot read them all.
    """
    found = []
    for folders in (f"{path}/parts/folder=*", f"{path}/folder=*"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(folders)
        found += [f.getPath().toString() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []]
    tasks = 4 * spark.sparkContext.defaultParallelism
    groups, room = [], 0
    for one in sorted(found):
        n = one.rpartition("=")[2].split(".")
        n = int(n[2]) if len(n) == 3 else FOLDER_FILES
        if not groups or n > room:
            groups.append([])
            room = FOLDER_FILES
        groups[-1].append(one)
        room -= n
    return reduce(DataFrame.union, [stored(read(g).coalesce(tasks)) for g in groups]) if groups else read([path]).coalesce(tasks)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; undecodable bytes become U+FFFD."""
    return _by_folder(spark, path, lambda p: spark.read.text(p, wholetext=True).select(
        F.input_file_name().alias("path"), F.make_valid_utf8("value").alias("text")
    ))


def read_directory(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Matching files of a folder as path, size and text, for one transform over all."""
    return _by_folder(spark, path, lambda p: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(p).select(
        "path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    ))


def written_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Texts as they were before :func:`write_texts` ended them."""
    return df.withColumn(column, F.regexp_replace(column, "\n\\z", ""))


# Extensions of each source type.
SOURCE_TYPES = {
    "pdf": [".pdf"],
    "doc": [".docx", ".doc", ".docm", ".odt", ".rtf", ".epub", ".html", ".htm", ".ipynb",
            ".tex", ".latex", ".rst", ".org", ".typ"],
    "excel": [".xlsx", ".xlsm", ".xls", ".xlsb", ".ods", ".csv"],
    "ppt": [".pptx", ".pptm", ".ppsx", ".ppsm", ".ppt", ".pps", ".pot", ".odp"],
}


def source_type(path: Column) -> Column:
    """Source type of a path or URL; NULL when the extension is unknown."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    # a leading dot starts a hidden name, not an extension
    ext = F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))
    out = F.when(path.rlike(r"(?i)^https?://"), F.lit("web"))
    for kind, exts in SOURCE_TYPES.items():
        out = out.when(ext.isin(exts), F.lit(kind))
    return out


def route_sources(df: DataFrame, path_col: str) -> DataFrame:
    kind = source_type(F.col(path_col))
    return df.withColumn("source_type", kind).withColumn(
        "error",
        F.when(
            F.col("source_type").isNull(),
            F.concat(F.lit("Cannot detect source type for "), F.col(path_col),
                     F.lit(". Provide sourceType explicitly.")),
        ),
    )


def is_url(c: Column) -> Column:
    """http or https with a non-empty host part."""
    return c.rlike(r"^(?i:https?)://[^/?#]+")


def clean_url_list(lines: DataFrame, column: str) -> DataFrame:
    """Trimmed URLs without blank and comment lines, with a validity flag."""
    url = strip_blank(F.col(column))
    return (
        lines.withColumn("url", url)
        .where((F.col("url") != "") & ~F.col("url").startswith("#"))
        .withColumn("valid", is_url(F.col("url")))
    )


ship(sys.modules[__name__])
