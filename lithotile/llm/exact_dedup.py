"""Exact dedup by an extendible-hash index on shared files.

A text's key is the first 60 bits of the SHA-256 of its normalised text (white-space runs become one space). The
directory doubles until each bucket of distinct keys fits its capacity; owner tasks take whole buckets, which are
ranges of keys, chain texts whose keys collide and compare their bytes.

Defined results: a null text counts as empty and equals other empty texts; rows that repeat a doc_id are separate rows
and all of them stay if their doc_id is the smallest of the group; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_join, stash

SPACES = r"[\x20\x09-\x0D]+"
KEY_BITS = 60
ENTRY = "bucket int, key long, sha string, norm binary, keep_id long, n long"
GROUP = "bucket int, key long, chain int, sha string, keep_id long, n long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def key_of(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, KEY_BITS // 4), 16, 10).cast("long")


def build_directory(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Directory and local depths from the distinct keys in each of 2^max_depth cells.

    An overfull bucket splits on its next bit; the directory doubles when the bucket was as deep as the directory.
    A bucket at the greatest depth keeps what it has as an overflow chain, so no key is dropped.
    """
    max_depth = int(np.log2(len(counts)))
    total = np.concatenate([[0], np.cumsum(counts)])
    depth, work, done = 0, [(0, 0)], []
    while work:
        prefix, local = work.pop()
        width = 1 << (max_depth - local)
        if total[(prefix + 1) * width] - total[prefix * width] > capacity and local < max_depth:
            depth = max(depth, local + 1)
            work += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            done.append((prefix, local))
    directory, locals_ = np.empty(1 << depth, np.int32), np.empty(len(done), np.int32)
    for bucket, (prefix, local) in enumerate(sorted(done, key=lambda x: x[0] << (max_depth - x[1]))):
        width = 1 << (depth - local)
        directory[prefix * width : (prefix + 1) * width] = bucket
        locals_[bucket] = local
    return directory, locals_


def _combine(directory: np.ndarray, flush_bytes: int):
    shift = np.int64(KEY_BITS - int(np.log2(len(directory))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush() -> pa.RecordBatch:
            keys = np.array([k for k, _ in held], np.int64)
            rows = list(held.items())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(directory[keys >> shift], pa.int32()), pa.array(keys, pa.int64()), pa.array([v[2] for _, v in rows], pa.string()),
                    pa.array([k[1] for k, _ in rows], pa.binary()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64()),
                ],
                names=["bucket", "key", "sha", "norm", "keep_id", "n"],
            )

        for batch in batches:
            for doc, key, sha, norm in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "sha", "norm")), strict=True):
                old = held.get((key, norm))
                if old is None:
                    held[key, norm] = [doc, 1, sha]
                    size += len(norm) + 200
                else:
                    old[0] = doc if old[0] is None else old[0] if doc is None else min(doc, old[0])
                    old[1] += 1
            if size > flush_bytes:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by key. Of each key the distinct texts are held, and nothing else."""
    last, chain = None, []

    def told(done: list) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "key", "chain", "sha", "keep_id", "n"])

    done: list = []

    def close() -> None:
        shas = [x["sha"] for x in chain]
        if len(set(shas)) < len(shas):
            raise ValueError("two different texts have one SHA-256")
        done.extend((x["bucket"], last, i, x["sha"], x["keep"], x["n"]) for i, x in enumerate(chain))

    for batch in batches:
        for bucket, key, sha, norm, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                if chain:
                    close()
                last, chain = key, []
            for x in chain:
                if x["norm"] == norm:  # the bytes decide
                    x["n"] += n
                    x["keep"] = keep if x["keep"] is None else x["keep"] if keep is None else min(keep, x["keep"])
                    break
            else:
                chain.append({"norm": norm, "sha": sha, "keep": keep, "n": n, "bucket": bucket})
        if len(done) > 10_000:
            yield told(done)
            done = []
    if chain:
        close()
    if done:
        yield told(done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 512, max_depth: int = 16, flush_bytes: int = 32 << 20, bound: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    capacity: distinct keys in a bucket; max_depth: bits of the directory, of at most 2^max_depth entries.
    Only texts whose key occurs again travel to the owners, after equal ones have been combined in each map task.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    read = read.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    read = read.withColumn("key", key_of(F.col("sha")))
    prints = stash(read.select("doc_id", "key", "sha"), "dedup-prints")
    per_key = stash(prints.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    cells = per_key.groupBy(F.shiftright("key", KEY_BITS - max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(1 << max_depth, np.int64)
    for cell, n in cells.collect():  # 2^max_depth rows at most
        counts[cell] = n
    directory, _ = build_directory(counts, capacity)
    again = per_key.filter("n > 1").select("key")
    entries = bounded_join(read, again, ["key"], "left_semi", bound)
    entries = entries.select("doc_id", "key", "sha", F.col("norm").cast("binary").alias("norm")).mapInArrow(_combine(directory, flush_bytes), ENTRY)
    owned = entries.repartition("bucket").sortWithinPartitions("key").mapInArrow(_own, GROUP)
    index = stash(owned, "dedup-index")
    found = prints.join(index.select("key", "sha", "keep_id", "n"), ["key", "sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def sha256_of(text: str | None) -> str:
    import re

    return hashlib.sha256(re.sub(SPACES, " ", text or "").encode()).hexdigest()
