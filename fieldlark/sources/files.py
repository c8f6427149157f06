"""Text and CSV sources, and the sinks of exports."""

from __future__ import annotations

import io
import tempfile
import time
import zipfile
from collections.abc import Sequence
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.expr import parse, parse_transform
from ..schemas import DATASET_COLUMNS, POINT_COLUMNS


class SourceError(ValueError):
    """A file that lacks what its reader needs."""


def missing_columns(columns: Sequence[str], needed: Sequence[str]) -> list[str]:
    have = {c.strip().lstrip("﻿") for c in columns}
    return [c for c in needed if c not in have]


def read_points(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A point table: three typed columns, others as they are inferred; ``row_id`` numbers the rows in file order."""
    df = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*(c.strip().lstrip("﻿") for c in df.columns))
    if lacking := missing_columns(df.columns, POINT_COLUMNS):
        raise SourceError(f"missing columns: {', '.join(lacking)}")
    typed = {"Latitude": F.col("Latitude").cast("double"), "Longitude": F.col("Longitude").cast("double"), "Year": F.col("Year").cast("int")}
    df = df.withColumns(typed).withColumn("row_id", F.monotonically_increasing_id())
    return df.limit(rows) if rows else df


def read_dataset_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A table of extractions; every expression and transform in it is validated."""
    df = spark.read.csv(path, header=True)
    if lacking := missing_columns(df.columns, DATASET_COLUMNS):
        raise SourceError(f"missing columns: {', '.join(lacking)}")
    df = df.limit(rows) if rows else df
    for row in df.select(*DATASET_COLUMNS[2:]).toLocalIterator():  # a hand-written table
        parse(row[0])
        parse_transform(row[1])
    return df


def read_list(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Lines of a list, trimmed, without blank lines and comments."""
    df = spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return df.limit(rows) if rows else df


def corrections_of(lines: DataFrame) -> DataFrame:
    """original and corrected of ``a:b`` or ``a,b`` lines; a line with neither is an error."""
    parts = F.split("value", "[:,]", 2)
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("malformed correction: "), F.col("value"))).cast("array<string>"))
    rows = lines.select(checked.alias("p"))
    return rows.select(F.trim(F.col("p")[0]).alias("original"), F.trim(F.col("p")[1]).alias("corrected"))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return corrections_of(read_list(spark, path))


def scoped_questions(lines: DataFrame) -> DataFrame:
    """question_scope and question_body of ``scope: question`` lines."""
    parts = F.split("value", ":", 2)
    return lines.where(F.contains("value", F.lit(":"))).select(F.trim(parts[0]).alias("question_scope"), F.trim(parts[1]).alias("question_body"))


def organic(results: DataFrame, limit: int = 10) -> DataFrame:
    """The first organic results of each question: (question_id, type, position, url)."""
    order = Window.partitionBy("question_id").orderBy("position")
    return results.where("type = 'organic'").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).drop("__r")


def write_csv(df: DataFrame, path: str, header: bool = True, quote_all: bool = False, one_file: bool = False) -> None:
    """CSV with proper escapes; empty tables give a header.  One file only where a person asks for one."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").csv(path, header=header, quoteAll=quote_all, escape='"', emptyValue="")


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def _csv_line(values: Sequence[object], missing: str) -> str:
    cells = [missing if v is None else str(v) for v in values]
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in cells) + "\r\n"


def stream_csv(df: DataFrame, out: io.TextIOBase, missing: str = "", bom: bool = False) -> int:
    """Rows to a text file on the driver, a partition at a time; gives their number."""
    if bom:
        out.write("﻿")
    out.write(_csv_line(df.columns, missing))
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        out.write(_csv_line(row, missing))
        n += 1
    return n


def write_zip(tables: dict[str, DataFrame], path: str, missing: dict[str, str] | None = None) -> None:
    """A ZIP of CSV files, for a person's download; tables without rows give their header."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            with z.open(name, "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                stream_csv(df, text, (missing or {}).get(name, ""))


def remove_expired(folder: str | Path, seconds: float = 3600, pattern: str = "*.zip", now: float | None = None) -> list[str]:
    """Removes a folder's downloads that are older than ``seconds``; gives their names."""
    old = [p for p in sorted(Path(folder).glob(pattern)) if (now or time.time()) - p.stat().st_mtime > seconds]
    for p in old:
        p.unlink(missing_ok=True)
    return [p.name for p in old]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise SourceError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='scratch-')).rstrip('/')}/{name}-{uuid4().hex}"


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions of a table kept by ``write_version``."""
    path, fs = _filesystem(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_version(df: DataFrame, folder: str) -> int:
    """Writes ``df`` as the table's next version, which leaves those before as its backup; gives its number."""
    number = max(versions(df.sparkSession, folder), default=0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/v={number}")
    return number


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """One version of a table, the last by default."""
    return spark.read.parquet(f"{folder}/v={number or max(versions(spark, folder))}")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def template_csv(columns: Sequence[str] = POINT_COLUMNS) -> str:
    return ",".join(columns) + "\n"


def joined_results(points: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """``points`` with a column of results by row_id; of several the last by ``seq`` counts."""
    last = values.groupBy("row_id").agg(F.max_by("value", "seq").alias(name))
    return points.join(last, "row_id", "left")


def numeric_if_all(df: DataFrame, column: str) -> DataFrame:
    """``column`` as doubles when every value converts, else as it is."""
    bad = df.agg(F.count_if(F.col(column).isNotNull() & F.col(column).try_cast("double").isNull())).first()[0]
    return df if bad else df.withColumn(column, F.col(column).cast("double"))


def expand_years(df: DataFrame, column: str = "Year") -> DataFrame:
    """A row for each year of ``a-b``; other values stay."""
    both = F.split(column, "-")
    years = F.when(F.col(column).rlike("^[0-9]+-[0-9]+$"), F.transform(F.sequence(both[0].cast("int"), both[1].cast("int")), lambda y: y.cast("string"))).otherwise(F.array(column))
    return df.withColumn(column, F.explode(years))

