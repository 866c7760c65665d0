"""Small helpers of the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import cut_lineage, scratch_path  # noqa: F401 - used by the operators

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
BATCH_ROWS = "512"
BATCH_BYTES = str(4 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ready_for_python(spark: SparkSession) -> None:
    """What operators with Python tasks need: the package on every executor, and Arrow batches of bounded size.

    The default is 10,000 rows, which with long texts is more than a worker should
    hold; a session that sets its own number keeps it.
    """
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", 10000, BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 26, BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or int(now) <= 0 or int(now) >= default:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(prefix="linkloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))
