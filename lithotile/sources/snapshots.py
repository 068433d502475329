"""Versions of a lake. A run writes files of its own; one small JSON file, created last, makes them the current version.

A version names the run of each live tile (a table of one row per tile), the runs in use, the manifest and the cells' state.
Version files are numbered and created only if their number is free, so a run that dies leaves the version before it, and of
two runs at once one is refused.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another run has published a version meanwhile."""


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def new_run() -> str:
    """A name that sorts by time and is no number or date to a reader of partitions."""
    return f"r{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def _read(fs, path) -> dict | None:  # noqa: ANN001
    """The file's JSON; None if it was not finished."""
    stream = fs.open(path)
    try:
        data = bytes(stream.readAllBytes())
    finally:
        stream.close()
    try:
        return json.loads(data)
    except ValueError:
        return None


def versions(spark: SparkSession, root: str) -> list[dict]:
    """All finished versions, oldest first."""
    fs, path = _hadoop(spark, root)
    at = path(f"{root.rstrip('/')}/_versions")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    found = [_read(fs, path(f"{root.rstrip('/')}/_versions/{n}")) for n in names if n.endswith(".json")]
    return [v for v in found if v is not None]


def current(spark: SparkSession, root: str) -> dict | None:
    found = versions(spark, root)
    return found[-1] if found else None


def publish(spark: SparkSession, root: str, after: dict | None, version: dict) -> dict:
    """Make version current if `after` still is."""
    fs, path = _hadoop(spark, root)
    found = current(spark, root)
    if (found or {}).get("number") != (after or {}).get("number"):
        raise Conflict(f"version {found and found['number']} of {root} was published meanwhile")
    number = after["number"] + 1 if after else 0
    version = version | {"number": number}
    spot = path(f"{root.rstrip('/')}/_versions/{number:010d}.json")
    if fs.exists(spot) and _read(fs, spot) is None:
        fs.delete(spot, False)  # a run died while it wrote this
    try:
        stream = fs.create(spot, False)
    except Exception as e:  # py4j wraps the file system's error
        raise Conflict(f"version {number} of {root} exists") from e
    stream.write(bytearray(json.dumps(version).encode()))
    stream.close()
    return version


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete partitions that none of the last `keep` versions uses, and what belongs to older versions; the runs that lost files.

    File systems list and delete folders one by one, so the driver goes through them: one for each tile and run.
    """
    fs, path = _hadoop(spark, root)
    root = root.rstrip("/")
    kept = versions(spark, root)[-keep:]
    live = {(r.tile_z, r.tile_x, r.tile_y, r.p_run) for v in kept for r in spark.read.parquet(f"{root}/_tiles/{v['run']}").toLocalIterator()}
    gone = set()
    for status in fs.globStatus(path(f"{root}/p_tile_z=*/p_tile_x=*/p_tile_y=*/p_run=*")) or []:
        z, x, y, run = (part.partition("=")[2] for part in status.getPath().toString().rsplit("/", 4)[1:])
        if (int(z), int(x), int(y), run) not in live:
            gone.add(run)
            fs.delete(status.getPath(), True)
    named = {v["run"] for v in kept}
    for kind in ("_tiles", "_cells", "_manifests"):
        for status in fs.globStatus(path(f"{root}/{kind}/*")) or []:
            run = status.getPath().getName()
            if run not in named:
                gone.add(run)
                fs.delete(status.getPath(), True)
    first = kept[0]["number"] if kept else 0
    for status in fs.globStatus(path(f"{root}/_versions/*.json")) or []:
        if int(status.getPath().getName()[:10]) < first:
            fs.delete(status.getPath(), False)
    return sorted(gone)
