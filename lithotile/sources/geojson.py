"""The features of GeoJSON collections of any size: byte ranges are scanned by many tasks, whatever lies in a range.

Text is read in records that end at a closing brace, so a range begins right behind one. A first scan gives each range's
quotes and depth for either answer to whether it begins inside a string; running over the ranges in order settles that. A
second scan cuts out the objects of the array `features` of the top-level object; what a range's end cuts is put together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder

QUOTE, SLASH, OPEN, CLOSE, BRACKET, END = 34, 92, 123, 125, 91, 93
_SPACE = (9, 10, 13, 32)
#: Bytes that are scanned at once.
STEP = 1 << 20


def _scan(d: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes after a closing brace: whether each lies in a string (its opening quote does), the depth after each, and the quotes."""
    at = np.arange(len(d))
    plain = np.maximum.accumulate(np.where(d != SLASH, at, -1))
    quotes = np.flatnonzero(d == QUOTE)
    slashes = np.where(quotes > 0, quotes - 1 - plain[quotes - 1], 0)
    quotes = quotes[slashes % 2 == 0]
    turn = np.zeros(len(d), np.int8)
    turn[quotes] = 1
    held = (np.cumsum(turn, dtype=np.int64) + inside) % 2 == 1
    step = ((d == OPEN) | (d == BRACKET)).astype(np.int8) - ((d == CLOSE) | (d == END))
    step[held] = 0
    return held, depth + np.cumsum(step, dtype=np.int64), quotes


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """(file, start of its range) and bytes, in order, in pieces of about STEP that end at a closing brace."""
    for batch in batches:
        text = batch.column("value").cast(pa.large_binary())
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        held, size = [], 0
        for k, record in enumerate(text):
            held.append(record.as_py() + b"}")
            size += len(held[-1])
            if size >= STEP or k + 1 == len(keys) or keys[k + 1] != keys[k]:
                yield keys[k], np.frombuffer(b"".join(held), np.uint8)
                held, size = [], 0


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, for both ways in which it may begin: whether it ends inside a string, and the change of depth."""
    out: dict = {}
    for key, d in _ranges(batches):
        states = out.setdefault(key, [(False, 0), (True, 0)])
        for k, (inside, depth) in enumerate(states):
            held, depths, _ = _scan(d, inside, depth)
            states[k] = (bool(held[-1]), int(depths[-1]))
    rows = [(*key, *a, *b) for key, (a, b) in out.items()]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "start", "out0", "deep0", "out1", "deep1"])


def _keys(d: np.ndarray, held: np.ndarray, depths: np.ndarray, quotes: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of the top-level object's keys, and whether each is `features` with an array as its value."""
    ends = quotes[~held[quotes] & (depths[quotes] == 1)]
    places, good = [], []
    for end in ends.tolist():
        at = end + 1
        while at < len(d) and d[at] in _SPACE:
            at += 1
        if at < len(d) and d[at] == 58:
            k = int(np.searchsorted(quotes, end)) - 1
            name = bytes(d[quotes[k] : end + 1]) if k >= 0 else b'""'  # one that began in an earlier piece holds a brace
            at += 1
            while at < len(d) and d[at] in _SPACE:
                at += 1
            places.append(end)
            good.append(int(at < len(d) and d[at] == BRACKET and json.loads(name) == "features"))
    return places, good


def _cut(states: dict):  # noqa: ANN202
    """states: for each range whether it begins inside a string, and its depth there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, key, nr, part, rows = None, False, 0, None, 0, [], []

        def emit(begun: bool, ended: bool) -> None:
            rows.append((*now, nr, begun, ended, own, b"".join(part).decode()))
            part.clear()

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "start", "nr", "begun", "ended", "own", "text"])
            rows.clear()
            return out

        begun, own = False, None
        for range_, d in _ranges(batches):
            if range_ != now:
                if now is not None:
                    if part:
                        emit(begun, False)
                    rows.append((*now, nr, None, None, key, None))  # what the range leaves behind: its number of features and last key
                now, (inside, depth), key, nr, part, begun, own = range_, states[range_], None, 0, [], False, None
            if depth >= 3 and not part:  # the piece goes on with an object that began before it
                begun, own = False, None
            held, depths, quotes = _scan(d, inside, depth)
            places, good = _keys(d, held, depths, quotes)
            firsts = np.flatnonzero((d == OPEN) & ~held & (depths == 3))
            lasts = np.flatnonzero((d == CLOSE) & ~held & (depths == 2))
            which = np.searchsorted(places, firsts) - 1
            going, k = depth >= 3, 0
            data = d.tobytes()
            if going:
                end = int(lasts[0]) + 1 if len(lasts) else len(d)
                part.append(data[:end])
                if len(lasts):
                    emit(begun, True)
                    lasts = lasts[1:]
                    going = False
            for first in firsts.tolist():
                nr += 1
                begun, own = True, key if which[k] < 0 else good[which[k]]
                if k < len(lasts):
                    part.append(data[first : int(lasts[k]) + 1])
                    emit(True, True)
                else:
                    part.append(data[first:])
                k += 1
            key = good[-1] if good else key
            inside, depth = bool(held[-1]), int(depths[-1])
            if len(rows) > 5000:
                yield batch()
        if now is not None:
            if part:
                emit(begun, False)
            rows.append((*now, nr, None, None, key, None))
        yield batch()

    return run


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """file and text: each object of the array `features` of each file's top-level object, as it is written there.

    One row for each byte range comes to the driver. Ranges are as long as spark.sql.files.maxPartitionBytes says.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = raw.mapInArrow(_totals, "file string, start long, out0 boolean, deep0 long, out1 boolean, deep1 long")
    states, now, inside, depth = {}, None, False, 0
    for r in sorted(found.toLocalIterator(), key=lambda r: (r.file, r.start)):
        if r.file != now:
            now, inside, depth = r.file, False, 0
        states[r.file, r.start] = (inside, depth)
        inside, depth = (r.out1, depth + r.deep1) if inside else (r.out0, depth + r.deep0)
    work = folder(spark)
    raw.mapInArrow(_cut(states), "file string, start long, nr long, begun boolean, ended boolean, own int, text string").write.parquet(f"{work}/features")
    pieces = spark.read.parquet(f"{work}/features")
    ranges, now, before, key = [], None, 0, 0
    for r in sorted(pieces.filter("text is null").toLocalIterator(), key=lambda r: (r.file, r.start)):
        if r.file != now:
            now, before, key = r.file, 0, 0
        ranges.append((r.file, r.start, before, key))
        before, key = before + r.nr, key if r.own is None else r.own
    ranges = spark.createDataFrame(ranges, "file string, start long, before long, key int")
    x = pieces.filter("text is not null").join(F.broadcast(ranges), ["file", "start"])
    x = x.select("file", "start", F.expr("before + nr").alias("nr"), "begun", "ended", F.coalesce("own", "key").alias("key"), "text")
    whole = x.filter("begun and ended and key = 1").select("file", "text")
    cut = x.filter("not (begun and ended)").groupBy("file", "nr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text"), F.max(F.when(F.col("begun"), F.col("key"))).alias("key"))
    return whole.unionByName(cut.filter("key = 1").select("file", "text"))
