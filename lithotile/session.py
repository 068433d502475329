"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of rows in an Arrow batch: long texts would else fill a worker's memory with a batch of default size.
ARROW_BATCH = "8m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors once per application, so that Arrow functions can import it there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
        home = Path(importlib.util.find_spec("lithotile").submodule_search_locations[0])
        path = Path(tempfile.mkdtemp(prefix="lithotile-ship-")) / "lithotile.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lithotile")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true", **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
