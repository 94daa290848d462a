"""What the training-data operators share: reading tables, storing intermediates, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else the warehouse; a temporary
    one only where all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="attest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows per Arrow batch for the jobs inside: texts are long, and a batch's size bounds the memory
    of a Python worker and of the JVM that fills it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, rows: int = 1_000, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor
    costs a re-read of a file rather than a re-run. The files live under ``attest-<application>`` and can
    go once the application has ended. ``by``: a column whose values get folders of their own, so that a filter on it
    reads no others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attest-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with small_batches(spark, rows):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These column names, lengthened where ``df`` has them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that only a piece's texts become Python strings at a time. What a batch
    took goes back to the system, as workers live on from task to task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out."""
    return F.crc32(doc_id.cast("string")) % 4


def sample_fraction(rows: int, bound: int) -> float:
    return 1.0 if rows <= bound else bound / rows


def hash_unit(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns, F.lit("unit")), F.lit(1 << 40)) / F.lit(float(1 << 40))
