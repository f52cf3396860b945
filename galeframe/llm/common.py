"""Helpers shared by the text operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one batch of documents holds at most, one longer document aside.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Arrow carry fewer rows at once, for rows may be whole books; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, of: int) -> Column:
    """crc32 of an id written as text, modulo ``of``; NULL ids have no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text; NULL counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def pieces(batches, column: str = "text", limit: int = BATCH_BYTES):
    """Arrow record batches cut so that each holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        start = held = 0
        for row, size in enumerate(sizes.to_pylist()):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, NULL as empty."""
    return [t or "" for t in column(batch, name).to_pylist()]
