"""What the training-data operators share: tables, the shared folder, Arrow columns of whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and the ASCII white space \t\n\v\f\r to spaces; other bytes stay.
LOWER_SPACED = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same for words of [0-9a-z] and non-ASCII characters: every other byte becomes a space.
LOWER_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tideglass-")
        shared_dir.own = folder
    return folder


def staged(df: DataFrame, *partitions: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back, so that lost executors cost no recomputation of what lies before."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_crc(column: Column | str, modulus: int) -> Column:
    """crc32 of the column as text, modulo modulus (null counts as 0)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0))


def text_bytes(batch: pa.RecordBatch, k: int) -> Iterator[bytes | None]:
    """The UTF-8 bytes of column k, row by row, without decoding."""
    column = batch.column(k)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for value in column:
        yield value.as_py()
