"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the hashed shingles make all signature coordinates: the first scatters the shingles, the second is
applied after a circular shift by k for coordinate k. Documents with one and the same shingle set are one node. In each
band bucket every node is first checked against the smallest one (a star, so a bucket of n gives n - 1 pairs); buckets
that still hold several components then have their crossing pairs checked where they lie, in blocks, so no link between a
bucket's members is lost. All checks use the whole sets.

Defined results: texts without words have no shingle, link with nothing and are kept; texts of fewer than five words are
one shingle; null is empty; rows that repeat a doc_id are one node that links through any of its texts; a null doc_id
links with nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_join, hash_words, joined, lean, mix64, slices, stash
from .components import connected_components

WORDS = 5
BANDS, ROWS = 32, 4
PRINT = "doc_id long, n long, f1 long, f2 long, bands array<long>"
_STEP = np.uint32(0x9E3779B1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, starts = joined(column)
    hashes, at = hash_words(data)
    bounds = np.searchsorted(at, starts)
    if len(hashes) >= words:
        run = np.zeros(len(hashes) - words + 1, np.uint64)
        for j in range(words):
            run = mix64(run + hashes[j : j + len(run)])
    else:
        run = np.zeros(0, np.uint64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(run[a : b - words + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                one = mix64(one * np.uint64(31) + h)
            yield one
        else:
            yield np.zeros(0, np.uint64)


def _mix32(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place on unsigned 32-bit integers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: minima of the second permutation over the first one shifted by k steps."""
    first = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = (np.arange(1, size + 1, dtype=np.uint32) * _STEP)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(first), 256):
        np.minimum(out, _mix32(first[None, a : a + 256] + shifts).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for col in sig.reshape(bands, -1).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + col.astype(np.uint64))
    return key.view(np.int64)


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            n, f1, f2, bands, lens = [], [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                f1.append(int(a))
                f2.append(int(b))
                lens.append(BANDS if len(s) else 0)
                if len(s):
                    bands.append(band_keys(signature(s)))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "n", "f1", "f2", "bands"])


def _check(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (centre, salt), the centre's own first."""
        now, centres = None, []
        for whole in batches:
            for batch in slices(whole):
                a, b = [], []
                keys = zip(batch.column("centre").to_pylist(), batch.column("salt").to_pylist(), batch.column("kind").to_pylist(), batch.column("id").to_pylist(), strict=True)
                for (centre, salt, kind, id_), s in zip(keys, shingle_sets(batch.column("text")), strict=True):
                    if (centre, salt) != now:
                        now, centres = (centre, salt), []
                    if kind == 0:
                        centres.append(s)
                        continue
                    for c in centres:
                        if min(len(c), len(s)) * 100 >= percent * max(len(c), len(s)) and len(s):
                            both = len(np.intersect1d(c, s, assume_unique=True))
                            if 100 * both >= percent * (len(c) + len(s) - both):
                                a.append(centre)
                                b.append(id_)
                                break
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, percent: int, salt_rows: int = 256, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts' sets reach the similarity. A hot a is split into salts of about salt_rows."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts"))
    degree = stash(degree, "minhash-degrees")
    members = bounded_join(pairs, degree, ["a"], "inner", bound).select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("id"))
    centres = degree.select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("id"))
    asked = stash(members.union(centres), "minhash-asked")
    rows = bounded_join(texts.withColumnRenamed("doc_id", "id"), asked, ["id"], "inner", bound).select("centre", "salt", "kind", "id", "text")
    return rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "kind").mapInArrow(lean(_check(percent)), "a long, b long")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact sizes of all intersections between two lists of sets, by products of 0/1 matrices over shared members."""
    out = np.zeros((len(a), len(b)), np.float32)
    ha, hb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ha, hb)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ca, cb = np.searchsorted(both, ha), np.searchsorted(both, hb)
    la, lb = np.isin(ha, both), np.isin(hb, both)
    ra, ca, rb, cb = ra[la], ca[la], rb[lb], cb[lb]
    for c in range(0, len(both), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        sa, sb = (ca >= c) & (ca < c + width), (cb >= c) & (cb < c + width)
        x[ra[sa], ca[sa] - c] = 1
        y[rb[sb], cb[sb] - c] = 1
        out += x @ y.T
    return out.astype(np.int64)


STRAY, LYING, BOTH = 0, 1, 2


def _cross(percent: int):
    def links(role: list, ids: list, comp: list, sets: list) -> list[tuple[int, int]]:
        first, second = ([k for k in range(len(role)) if role[k] in (r, BOTH)] for r in (STRAY, LYING))
        if not first or not second:
            return []
        label = np.array(comp)
        m = common_counts([sets[k] for k in first], [sets[k] for k in second])
        na, nb = np.array([len(sets[k]) for k in first]), np.array([len(sets[k]) for k in second])
        near = (100 * m >= percent * (na[:, None] + nb[None, :] - m)) & (label[first][:, None] != label[second][None, :])
        out = []
        for x, y in zip(*np.nonzero(near), strict=True):
            p, q = first[x], second[y]
            if label[p] != label[q]:  # a link within what is joined already says nothing new
                out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
                label[label == label[q]] = label[p]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (band, key, i, j): one piece of strays and one block are held."""
        now, held = None, ([], [], [], [])

        def close() -> Iterator[pa.RecordBatch]:
            if now is not None and (found := links(*held)):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for whole in batches:
            for batch in slices(whole):
                rows = zip(*(batch.column(c).to_pylist() for c in ("band", "key", "i", "j", "role", "id", "comp")), strict=True)
                for (band, key, i, j, role, id_, comp), s in zip(rows, shingle_sets(batch.column("text")), strict=True):
                    if (band, key, i, j) != now:
                        yield from close()
                        now, held = (band, key, i, j), ([], [], [], [])
                    for to, v in zip(held, (role, id_, comp, s), strict=True):
                        to.append(v)
        yield from close()

    return run


def crossing_links(members: DataFrame, texts: DataFrame, percent: int, block: int = 512, block_shingles: int = 400_000, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Links (a, b) between different components of one bucket; members (band, key, id, comp, n).

    A bucket's members outside its largest component are its strays: every crossing pair holds one. Members lie in blocks,
    strays in pieces, and a task group checks a piece against a block where they are, so the pairs are strays times members.
    What comes out are links that join components, never pairs.
    """
    bucket = ["band", "key"]
    each = members.groupBy(*bucket, "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    parts = lambda m, n: F.greatest(F.lit(1), F.ceil(m / block), F.ceil(n / block_shingles)).cast("int")
    most = F.max(F.struct("m", "n", "comp"))
    m, n = F.sum("m"), F.sum("n")
    open_ = each.groupBy(*bucket).agg(parts(m, n).alias("blocks"), parts(m - most["m"], n - most["n"]).alias("pieces"), most["comp"].alias("major"), F.count(F.lit(1)).alias("comps"))
    open_ = stash(open_.filter("comps > 1").drop("comps"), "minhash-open-buckets")
    x = bounded_join(members, open_, bucket, "inner", bound)
    own, piece = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int")
    one = (F.col("blocks") == 1) & (F.col("pieces") == 1)  # all members meet at once
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    strays = x.filter(~one & F.expr("comp != major")).select(*bucket, piece.alias("i"), upto("blocks").alias("j"), F.lit(STRAY).alias("role"), "id", "comp")
    lying = x.select(*bucket, upto("pieces").alias("i"), own.alias("j"), F.when(one, BOTH).otherwise(LYING).alias("role"), "id", "comp")
    x = stash(strays.union(lying), "minhash-open")
    rows = bounded_join(texts.withColumnRenamed("doc_id", "id"), x, ["id"], "inner", bound).select(*bucket, "i", "j", "role", "id", "comp", "text")
    rows = rows.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")
    return rows.mapInArrow(lean(_cross(percent)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept. Links: 100 * intersection >= percent * union."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stash(texts.mapInArrow(lean(_print), PRINT), "minhash-prints")
    some = prints.filter("n > 0 and doc_id is not null")
    nodes = stash(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "minhash-nodes")
    buckets = nodes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    full = buckets.groupBy("band", "key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", "key", "centre")
    members = stash(bounded_join(buckets, stash(full, "minhash-buckets"), ["band", "key"]), "minhash-members")
    star = members.filter("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = stash(verified(stash(star, "minhash-star"), texts, percent), "minhash-links")
    first = stash(connected_components(links), "minhash-first")
    labelled = bounded_join(members, first.withColumnRenamed("node", "id"), ["id"], "left").select("band", "key", "id", F.coalesce("component", "id").alias("comp"), "n")
    links = links.union(stash(crossing_links(labelled, texts, percent), "minhash-crossing"))
    # a repeated doc_id joins what its texts belong to
    ids = some.join(nodes.select("f1", "f2", "n", "id"), ["f1", "f2", "n"]).select("doc_id", "id")
    twins = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id")
    same = bounded_join(ids, stash(twins, "minhash-twins"), ["doc_id"], "left_semi").filter("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    component = stash(connected_components(links.union(same)), "minhash-components")
    member = nodes.select("f1", "f2", "n", "id").join(component.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", F.col("n"), F.coalesce("component", "id").alias("component"))
    out = prints.select("doc_id", "n", "f1", "f2").join(member, ["f1", "f2", "n"], "left")
    found = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null last.

    Rows are told apart by a number of their own, so of rows that repeat a doc_id, and of rows without one, one stays where
    their texts are near; texts without words link with nothing and all stay. Columns may have any names.
    """
    rows = stash(docs.select(F.monotonically_increasing_id().alias("nr"), F.struct("*").alias("row")), "minhash-rows")
    gone = near_duplicates(rows.select("nr", F.col("row")[text_col].alias("text")), "nr", "text", percent=percent).filter("not kept").select(F.col("doc_id").alias("nr"), "component_id")
    gone = stash(gone, "minhash-gone")
    members = stash(gone.union(gone.select(F.col("component_id").alias("nr"), "component_id").distinct()), "minhash-groups")
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "nr"))
    ids = rows.select("nr", F.col("row")[id_col].cast("long").alias("id"))
    stays = bounded_join(ids, members, ["nr"]).groupBy("component_id").agg(order["nr"].alias("nr")).select("nr")
    drop = stash(members.select("nr").join(stays, "nr", "left_anti"), "minhash-dropped")
    return bounded_join(rows.select("nr", "row"), drop, ["nr"], "left_anti").select("row.*")
