"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Largest table, in bytes, that an operator broadcasts.
BROADCAST_BYTES = 32 << 20
#: Rows that go to a Python worker at once.
BATCH_ROWS = 1000
#: Texts of Latin letters and common punctuation, whose lower case and classes are the same in every library.
PLAIN = re.compile("[\t-\r\x20-\x7e\x85\xa0-ɏ‐-‧‰-⁞€]*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode and where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="shared-")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_or_not(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` rows of ``row_bytes`` stay within the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from every column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``; a null key stays.

    The keys are counted: texts are only shuffled when the keys are too many to broadcast.
    """
    keys = cut(gone.select(key).distinct())
    return docs.join(small_or_not(keys, keys.count(), 64), key, "left_anti").select(*docs.columns)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the directory; the first call sends the package to the workers.

    Whole texts go to Python workers in batches of ``BATCH_ROWS``, unless the session asks for fewer.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, that gives a worker's free memory back to the system after each task: workers live on, and what a task of one stage took would add to what the next needs."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
