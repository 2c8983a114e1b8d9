"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage with a reliable checkpoint in the shared folder."""
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut as by ``checkpoint``, columns are packed."""
    path = f"{_shared_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name`` with underscores appended until no column of ``taken`` has it, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def spread(df: DataFrame, minimum: int = 1) -> int:
    """Shuffle partitions of the session, at least ``minimum``."""
    return max(minimum, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of texts that are sent to a Python worker at once; Spark's own default may hold gigabytes of long texts.
BATCH_ROWS, DEFAULT_ROWS = 1_000, "10000"


def lean(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small, unless the session sets a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name, DEFAULT_ROWS) == DEFAULT_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def hex64(c: Column) -> Column:
    """A long as 16 lowercase hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so that a worker's own arrays stay small; freed memory goes back at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
        del b
        pa.default_memory_pool().release_unused()
