"""Token counts by scanning flat, unindexed token files for the end-of-document identifier.

A token file is a run of fixed-size blocks of ids with a separator after each document and no table of lengths; beside it
lie the doc_ids in the same order. The scan searches whole blocks at once, sums each block up in one row, and a prefix
scan over the rows of a file stitches documents that cross blocks together.

Defined results: null and empty texts have 0 tokens (the separator isn't counted); rows that repeat a doc_id have a row
each; an empty table gives an empty result; extra columns are ignored. The separator cannot come out of a text, since
special tokens' strings are encoded as ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stash, text_bytes
from .tokens import default_ranks, rank_encoder, read_definition

#: The rank file has the ids 0 to 50255.
SEPARATOR = 50256
BLOCK = 1 << 19
FILE = "file long, kind string, block long, payload binary"


def _write(ranks: str, pattern: str, separator: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(ranks, pattern)
        file, end = TaskContext.get().partitionId(), np.array([separator], "<u2").tobytes()
        counts, held = {"tokens": 0, "ids": 0}, bytearray()

        def row(kind: str, payload: bytes) -> pa.RecordBatch:
            counts[kind] += 1
            return pa.RecordBatch.from_pydict({"file": [file], "kind": [kind], "block": [counts[kind] - 1], "payload": [payload]})

        for whole in batches:
            for batch in slices(whole):
                for ids in own.encode_many(list(text_bytes(batch.column("text")))):
                    held += ids
                    held += end
                yield row("ids", pc.fill_null(batch.column("doc_id"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                while len(held) >= 2 * block:
                    yield row("tokens", bytes(held[: 2 * block]))
                    del held[: 2 * block]
        if held:
            yield row("tokens", bytes(held))

    return run


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None, pattern: str | None = None, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """The token files in the shared folder: (file, kind, block, payload) with kinds tokens and ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path, split = default_ranks() if ranks is None else (ranks, pattern)
    return stash(texts.mapInArrow(_write(read_definition(path), split, separator, block), FILE), "token-files")


def _scan(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, payload in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "payload")), strict=True):
                tokens = np.frombuffer(payload, "<u2")
                at = np.flatnonzero(tokens == separator)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int32()))], names=["file", "block", "size", "ends"])

    return run


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, block, payload in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "payload")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([np.frombuffer(payload, "<i8").tolist()], pa.list_(pa.int64()))], names=["file", "block", "ids"])


def scan_token_files(files: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """doc_id and n_tokens of every document in the files."""
    blocks = files.filter("kind = 'tokens'").select("file", "block", "payload").mapInArrow(_scan(separator), "file long, block long, size long, ends array<int>")
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("size").over(along), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1))
    blocks = blocks.withColumn("first_doc", F.coalesce(F.sum(F.size("ends")).over(along), F.lit(0))).withColumn("last", last)
    blocks = blocks.withColumn("before", F.coalesce(F.max("last").over(along), F.lit(-1)))
    ends = F.transform("ends", lambda e: F.col("start") + e)
    previous = F.concat(F.array("before"), F.slice(ends, 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    lengths = F.zip_with(ends, previous, lambda e, p: e - p - 1)
    counted = blocks.filter(F.size("ends") > 0).select("file", "first_doc", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("first_doc") + F.col("k")).alias("doc"), "n_tokens")
    ids = files.filter("kind = 'ids'").select("file", "block", "payload").mapInArrow(_ids, "file long, block long, ids array<long>")
    ids = ids.withColumn("first_doc", F.coalesce(F.sum(F.size("ids")).over(along), F.lit(0)))
    ids = ids.select("file", "first_doc", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first_doc") + F.col("k")).alias("doc"), "doc_id")
    missing = F.lit(int(np.iinfo(np.int64).min))
    return ids.join(counted, ["file", "doc"]).select(F.when(F.col("doc_id") != missing, F.col("doc_id")).alias("doc_id"), "n_tokens")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    separator = options.get("separator", SEPARATOR)
    return scan_token_files(write_token_files(docs, id_col, text_col, **options), separator)
