"""Session set-up and table access for the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.sources.scratch import shared_folder, stored

__all__ = ["hand_back", "id_and_text", "prepare", "shared_folder", "stored", "table"]

#: Rows and bytes handed to a Python worker at once; bounds a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


#: Applications that have the package.
_sent: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches, and send this package to the executors once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.applicationId not in _sent and os.path.isdir(package):  # else it was itself loaded from a shipped archive
        folder = tempfile.mkdtemp()  # the driver's own; Spark serves the archive from there until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, "netweave.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for place, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(place, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(target)
        _sent.add(context.applicationId)
    return spark


def hand_back() -> None:
    """Give a Python worker's free memory back to the system, so that the next stage's tasks do not find it taken."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps what it keeps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns cannot clash with its own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
