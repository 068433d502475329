"""Packing into optimal length buckets.

Lengths are in ids of a public tokenizer. A dynamic programme over the global histogram of lengths chooses the bucket
boundaries of least padding, exactly, in integers; batches of a token budget then form inside each bucket in a seeded order.

Defined results: null and empty texts have length 0 and share the first bucket; a text longer than the budget is a batch
of its own; repeated rows are packed as rows of their own; an empty table gives an empty result; extra columns are ignored
or, in `pack_documents`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import give_back, slices, stash, text_bytes
from .tokens import encoder, read_definition

#: Words whose ids a task remembers at least; about twice as many at most.
REMEMBERED = 200_000


def n_tokens(text: Column, tokenizer: str | None = None) -> Column:
    """Ids of each whole text by a tokenizer file (word_bpe_49k.json unless given); null counts as empty."""
    definition = read_definition(tokenizer)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(definition, dtype="<u4", most=REMEMBERED)
        for texts in batches:
            parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]))
            yield pa.array([len(ids) // own.dtype.itemsize for part in parts for ids in own.encode_many(list(text_bytes(part.column("text"))))], pa.int64())
        own.forget()
        give_back()

    return F.arrow_udf(count, LongType())(text)


def choose_boundaries(cells: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets that minimise sum(count * (boundary - cell)); convex-hull dynamic programme."""
    n = len(cells)
    if not n:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(object).tolist()
    best = [0] + [cells[j - 1] * upto[j] for j in range(1, n + 1)]
    back = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        hull: list[int] = []  # indices i of lines best[i] - length * upto[i]
        at, new, came = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) >= 2:
                a, b = hull[-2], hull[-1]
                if (best[i] - best[a]) * (upto[b] - upto[a]) <= (best[b] - best[a]) * (upto[i] - upto[a]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            at = min(at, len(hull) - 1)
            x = cells[j - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - x * upto[hull[at + 1]] <= best[hull[at]] - x * upto[hull[at]]:
                at += 1
            came[j] = hull[at]
            new[j] = best[hull[at]] + x * (upto[j] - upto[hull[at]])
        best = new
        back.append(came)
    ends, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        ends.append(cells[j - 1])
        j = came[j]
    return ends[::-1]


def plan_batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = 16, budget: int = 16384, shards: int = 1024, seed: int = 23, tokenizer: str | None = None) -> DataFrame:
    """doc_id, length (in ids), bucket, padded_length, batch (number within the bucket) and slot (place within the batch)."""
    sized = stash(docs.select(F.col(id_col).alias("doc_id"), n_tokens(F.col(text_col), tokenizer).alias("length")), "pack-lengths")
    return batches_of(sized, buckets=buckets, budget=budget, shards=shards, seed=seed)


def batches_of(sized: DataFrame, *, buckets: int = 16, budget: int = 16384, shards: int = 1024, seed: int = 23) -> DataFrame:
    """plan_batches for a written table of doc_id and length, and perhaps nr, a number of each row that then comes with its plan."""
    nr = ["nr"] if "nr" in sized.columns else []
    # Different lengths: their number squared is less than 2 * (ids + lengths), so 100 thousand at 5 * 10^9 ids.
    histogram = sorted((r.length, r.n) for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = choose_boundaries([c for c, _ in histogram], [n for _, n in histogram], buckets) or [0]
    bounds = F.array(*[F.lit(x).cast("long") for x in ends])
    bucket = F.array_size(F.filter(bounds, lambda e: e < F.col("length")))
    x = sized.withColumn("bucket", bucket).withColumn("padded_length", F.element_at(bounds, F.col("bucket") + 1))
    # rows without a doc_id are spread by their number
    x = x.withColumn("order", F.xxhash64(F.lit(seed), F.when(F.col("doc_id").isNull(), F.col("nr")).otherwise(F.col("doc_id")) if nr else F.col("doc_id"))).withColumn("shard", F.pmod("order", F.lit(shards)))
    counts = x.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))  # buckets * shards rows at most
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "shard").orderBy("order", "doc_id", "length", *nr)
    x = x.withColumn("rank", F.row_number().over(within)).join(F.broadcast(offsets), ["bucket", "shard"])
    place = F.col("rank") + F.col("offset") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded_length")))).cast("long")
    return x.select(*nr, "doc_id", "length", "bucket", "padded_length", F.floor(place / room).cast("long").alias("batch"), F.pmod(place, room).cast("long").alias("slot"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = 16, budget: int = 16384, tokenizer: str | None = None) -> DataFrame:
    """docs with pack_bucket, pack_length, pack_batch and pack_slot in place of columns of those names. Each row has its own place."""
    rows = docs.select(F.monotonically_increasing_id().alias("nr"), F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), n_tokens(F.col(text_col), tokenizer).alias("length"))
    rows = stash(rows, "pack-rows")
    plan = batches_of(rows.select("nr", "doc_id", "length"), buckets=buckets, budget=budget)
    out = {"pack_bucket": "bucket", "pack_length": "padded_length", "pack_batch": "batch", "pack_slot": "slot"}
    joined = rows.select("nr", "row").join(plan.select("nr", *out.values()), "nr")
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in out], *[F.col(c).alias(k) for k, c in out.items()])
