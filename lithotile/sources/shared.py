"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast, counted as 64 a row and column; larger tables are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a local temporary one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lithotile-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lake-{uuid.uuid4().hex}"


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", bound: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast small only if it has few rows (of short columns); otherwise Spark joins by shuffle with skew handling. Counting stops at the bound."""
    most = bound // (64 * len(small.columns))
    return big.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)
