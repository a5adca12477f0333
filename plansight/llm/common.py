"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, without_shuffles

#: The white space that separates words and surrounds lines: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


#: Bytes of texts that a Python worker takes at once.
GROUP_BYTES = 1 << 21


def give_back() -> None:
    """Free memory goes back to the system: workers stay alive beside the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, in the shared folder of the session."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


#: Row groups and pages of tables with rows of megabytes hold few of them: writers and readers take a group or page whole.
PACKED = {"parquet.block.size": 1 << 23, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go when it ends. ``packed``: rows may be megabytes long."""
    with without_shuffles(df.sparkSession):
        df.write.mode("overwrite").options(**(PACKED if packed else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of this run that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(taken: Sequence[str], name: str) -> str:
    """A column name that does not clash with those taken (names compare without case in Spark)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes groups of documents so that each fits in a task."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
