"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the order of its nearest reference points (pivots). It is posted to the lists of its first LENGTH
pivots, per label. In a list the pivots that two vectors share are counted first; those that share SHARED or more are
candidates, in the list of their least shared pivot only, so each counts once; candidates are then verified by their cosine
in double precision. Lists longer than a block are cut into pairs of blocks. Lists give sums and spanning edges, never pairs.
Equal vectors are one node with a multiplicity.

The index is approximate: pivots come from a bounded sample, every row is indexed, and recall against brute force is measured
in the tests. There are PER_ROOT pivots for each unit of the square root of the vectors, MOST at most, so lists grow as that
root too. Pivots are chosen farthest first and keep twice the angle of a link apart, so a group of near copies holds few of
them and its vectors agree on the order of the others.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing; vectors of different lengths do not link; rows that repeat a vec_id count as vectors of their own; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import bounded_join, stash
from .components import connected_components

PER_ROOT, FEWEST, MOST = 6, 64, 4096
LENGTH, SHARED, BLOCK = 8, 2, 1024
#: Sampled vectors for each pivot that is chosen among them.
SAMPLE = 4


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def choose_pivots(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """At most `most` of the unit vectors, each the farthest from those before it, until the farthest has a cosine of `apart`."""
    took, near = [0], sample @ sample[0]
    while len(took) < most:
        k = int(np.argmin(near))
        if near[k] >= apart:
            break
        took.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[took]


def _nearest(pivots: dict[int, np.ndarray], length: int, names: list[str]):
    """Adds to each row the first pivots in its order; where a length of vectors has none, pivot 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                for a in range(0, whole.num_rows, 2048):
                    batch = whole.slice(a, 2048).filter(pa.array(sizes[a : a + 2048] == size))
                    if not batch.num_rows:
                        continue
                    own = pivots.get(size)
                    near = np.zeros((batch.num_rows, 1), np.int32)
                    if own is not None:
                        k = min(length, len(own))
                        cosine = _unit(_matrix(batch.column("vector")).astype(np.float64)) @ own.T
                        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(own) else np.tile(np.arange(k), (batch.num_rows, 1))
                        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
                    ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], names=[*names, "nearest"])

    return run


def _links(near: np.ndarray, v: np.ndarray, own: np.ndarray, pivot: int, i: int, j: int, least: float, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of block i, rows of block j, and the matrix of the links between them that are counted in this pivot's list."""
    a = np.flatnonzero(own == i)
    b = a if i == j else np.flatnonzero(own == j)
    ids, place = np.unique(near, return_inverse=True)
    has = np.zeros((len(near), len(ids)), np.float32)
    np.put_along_axis(has, place.reshape(near.shape), 1, axis=1)
    lower = int(np.searchsorted(ids, pivot))
    link = has[a] @ has[b].T >= min(shared, near.shape[1])  # shared pivots are counted first
    if lower:
        link &= has[a, :lower] @ has[b, :lower].T == 0
    if i == j:
        link = np.triu(link, 1)
    rows = np.flatnonzero(link.any(axis=1))
    link[rows] &= v[a[rows]] @ v[b].T >= least  # then candidates are verified
    return a, b, link


def _search(least: float, shared: int):
    def found(pivot: int, i: int, j: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col = lambda c: np.concatenate([p.column(c).to_numpy() for p in parts])
        own, ids, times = col("own"), col("id"), col("times")
        if len(own) < 2:
            return
        near, v = (np.concatenate([_matrix(p.column(c)) for p in parts]) for c in ("nearest", "vector"))
        a, b, link = _links(near, _unit(v.astype(np.float64)), own, pivot, i, j, least, shared)
        links, label = np.zeros(len(own), np.int64), np.arange(len(own))
        edges: list[tuple[int, int]] = []
        np.add.at(links, a, link @ times[b])
        np.add.at(links, b, link.T @ times[a])
        for n in np.flatnonzero(link.any(axis=1)):
            k, to = a[n], b[link[n]]
            for other in np.unique(label[to]):
                if other != label[k]:
                    edges.append((int(ids[label[k]]), int(ids[other])))
                    label[label == other] = label[k]
        hit = np.flatnonzero(links)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.nulls(len(hit), pa.int64())], names=["id", "links", "other"])
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.nulls(len(edges), pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["id", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (label, pivot, i, j): two blocks at most at a time."""
        now, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "size", "pivot", "i", "j")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y and keys[x] != now:
                    if parts:
                        yield from found(*now[2:], parts)
                    now, parts = keys[x], []
                if x < y:
                    parts.append(batch.slice(x, y - x))
        if parts:
            yield from found(*now[2:], parts)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, least: float = 0.98, pivots: int | None = None, length: int = LENGTH, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable) and kept."""
    v = F.col("vector")
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "float" if single else "double"  # single precision travels as it is, and is exact in double
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)
    # equal vectors share 128 bits of two hashes, by which nodes are found again
    marks = {f"mark{k}": F.when(F.col("good"), F.xxhash64(F.lit(k), "label", "vector")) for k in (1, 2)}
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumns(marks)
    key = ["label", "mark1", "mark2"]
    nodes = rows.filter("good").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector"))
    nodes = stash(nodes.withColumn("size", F.size("vector")), "pivot-nodes")
    most = pivots or int(min(MOST, max(FEWEST, PER_ROOT * nodes.count() ** 0.5)))
    own: dict[int, np.ndarray] = {}
    for r in nodes.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most).collect():  # a bounded sample
        own.setdefault(len(r.vector), []).append(r.vector)
    own = {k: choose_pivots(_unit(np.array(x, np.float64)), most, 2 * least * least - 1) for k, x in own.items()}
    told = nodes.select("label", "size", "id", "times", "vector")
    told = stash(told.mapInArrow(_nearest(own, length, told.columns), f"label string, size int, id long, times long, vector array<{kind}>, nearest array<int>"), "pivot-orders")
    lists = ["label", "size", "pivot"]
    sizes = told.select("label", "size", F.explode("nearest").alias("pivot")).groupBy(*lists).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = stash(sizes.select(*lists, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "pivot-sizes")
    x = bounded_join(told.select("*", F.explode("nearest").alias("pivot")), sizes, lists).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [*lists, "i", "j"]
    x = x.select(*lists, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "times", "nearest", "vector")
    x = x.repartition(*[F.col(c) for c in place]).sortWithinPartitions(*place, "id")
    found = stash(x.mapInArrow(_search(least, shared), "id long, links long, other long"), "pivot-found")
    links = found.filter("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    nodes = nodes.select(*key, "id", "times").join(links, "id", "left").join(component, "id", "left")
    nodes = stash(nodes.select(*key, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "pivot-told")
    out = rows.select("vec_id", *key).join(nodes, key, "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))
