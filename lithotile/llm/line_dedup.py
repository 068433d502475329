"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Words are put in one global order, rarest first by a fixed-size count sketch (any common
order keeps the join exact; the sketch only makes it selective). Two lines of Jaccard >= t share a word in their prefixes of
n - ceil(t n) + 1 words. Each prefix word has a list of its lines, cut into blocks of about block_rows lines where the sketch
says that it is long; equal lines are combined in each map task and again in each list. Inside a list only lines of
neighbouring length classes meet; length, positional and parity filters, all of them safe, thin them, and whole sets decide.
A line goes if a line before it, in order of doc_id and line number, matches it.

A line proposes its `cap` nearest candidates of each list and block. Lines of which more are left, or whose list has more
blocks, and which found no match, ask again: then the whole sets of the lists asked about travel, each asking line visits all
blocks of its lists, and what comes out are matched lines, never pairs. So no candidate is dropped and no list is one task.

Defined results: null text has no line; lines without words stay; rows that repeat a doc_id are one document, whose lines of
one number do not remove each other; a null doc_id is read, but loses no line; extra columns are kept by `drop_near_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_join, hash_words, joined, lean, mix64, slices, stash

BUCKETS = 1 << 22
#: Buckets in a row of counts, which travels as one array.
CHUNK = 1 << 15
PERCENT = 80
#: What a list holds of each line: its word, place, size, the word's place in it, two parity words and the sum of its hashes.
FIELDS = (("key", "<u4"), ("doc", "<i8"), ("line", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("odd0", "<u8"), ("odd1", "<u8"), ("sum", "<u8"))
#: The narrow form: doc is counted from the first of its array.
NARROW = {"doc": "<u4", "line": "<u2", "n": "<u2", "pos": "<u2"}
ENTRY_BYTES = 40
#: Entries that a task gathers before it deals them out.
HELD = 250_000
_U = np.uint64


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of every word of a batch, then document and number of every line."""
    data, starts = joined(column)
    hashes, at = hash_words(data)
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, starts[:-1])
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(breaks))))
    return hashes, np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(at, breaks), prepend=0)), doc, np.arange(len(breaks)) - first[doc]


def _sets(hashes: np.ndarray, line: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line that has any, in the global order: words, starts, sizes, lines."""
    r = np.zeros(1, np.uint8) if rank is None else rank[_bucket(hashes)]
    brief = (line.astype(_U) << _U(44)) | (r.astype(_U) << _U(36)) | (hashes >> _U(28))
    order = np.argsort(brief)
    h, ln, brief = hashes[order], line[order], brief[order]
    same = brief[1:] == brief[:-1]
    if len(line) and (line[-1] >= 1 << 20 or (h[1:][same] != h[:-1][same]).any()):  # too many lines, or words alike in 36 bits
        order = np.lexsort((hashes, np.broadcast_to(r, len(hashes)), line))
        h, ln = hashes[order], line[order]
        same = (h[1:] == h[:-1]) & (ln[1:] == ln[:-1])
    keep = np.ones(len(h), bool)
    keep[1:] = ~same
    h, ln = h[keep], ln[keep]
    starts = np.flatnonzero(np.diff(ln, prepend=-1))
    return h, starts, np.diff(np.append(starts, len(h))), ln[starts] if len(h) else ln


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & h.dtype.type(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.uint32)
    for whole in batches:
        for batch in slices(whole):
            bucket, n = np.unique(_bucket(hash_words(joined(batch.column("text"))[0])[0]), return_counts=True)
            total[bucket] += n.astype(np.uint32)
    for a in range(0, BUCKETS, CHUNK):  # low bytes first, so that the many zeros of the high bytes lie together
        part = total[a : a + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([a // CHUNK], pa.int32()), pa.array([part.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())], names=["chunk", "lows"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("lows").to_pylist(), strict=True):
            own = sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
            own += np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    for chunk, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "sums"])


def word_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of the words of each of BUCKETS hash buckets, over all documents: BUCKETS numbers whatever the corpus."""
    rows = texts.select("text").mapInArrow(lean(_count), "chunk int, lows binary").repartition(BUCKETS // CHUNK, "chunk").mapInArrow(lean(_total), "chunk int, sums binary").toArrow()
    out = np.zeros(BUCKETS, np.int64)
    for chunk, sums in zip(rows["chunk"].to_pylist(), rows["sums"].to_pylist(), strict=True):
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(sums, np.int64)
    return out


class Order:
    """The global order of words, and the blocks of their lists."""

    def __init__(self, counts: np.ndarray, percent: int, parts: int, block_rows: int):
        self.rank = np.clip(np.log2(np.maximum(counts, 1)) * 8 + 1, 1, 255).astype(np.uint8)
        self.rank[counts <= 1] = 0  # a word that occurs once is in no two lines
        self.percent, self.parts = percent, parts
        self.hot = np.flatnonzero(counts > block_rows)
        self.hot_blocks = -(-counts[self.hot] // block_rows)

    def blocks(self, key: np.ndarray) -> np.ndarray:
        out, bucket = np.ones(len(key), np.int64), _bucket(key)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, bucket), len(self.hot) - 1)
            out = np.where(self.hot[at] == bucket, self.hot_blocks[at], 1)
        return out

    def block(self, key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The block of a line with this sum; equal lines share it."""
        return ((mark >> _U(20)) % self.blocks(key).astype(_U)).astype(np.int64)

    def part(self, key: np.ndarray, block: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(_U) + (block.astype(_U) << _U(32))) % _U(self.parts)).astype(np.int64)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (-(-n * self.percent // 100)) + 1

    def need(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """The least overlap of sets of these sizes that reaches the similarity."""
        return -(-self.percent * (na + nb) // (100 + self.percent))

    def length_class(self, n: np.ndarray) -> np.ndarray:
        """Lines that can match differ by one class at most."""
        return n if self.percent == 100 else np.floor(np.log(n) / (np.log(100 / self.percent) * (1 + 1e-9))).astype(np.int64)


def _marks(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: two sums of its hashes, and the parities of 128 classes of words, where a word not in common turns one."""
    bit, high = _U(1) << ((h >> _U(57)) & _U(63)), h >> _U(63) > 0
    odd = [np.bitwise_xor.reduceat(np.where(high == k, bit, _U(0)), starts) for k in (False, True)]
    return np.add.reduceat(mix64(h), starts), np.add.reduceat(mix64(h ^ _U(0x5851F42D4C957F2D)), starts), *odd


def _places(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each of n, on end."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _pack(x: dict[str, np.ndarray]) -> tuple[str, bytes]:
    doc0 = int(x["doc"][0])
    narrow = int(x["doc"].min()) == doc0 and int(x["doc"].max()) - doc0 < 1 << 32 and all(int(x[f].max()) < 1 << 16 for f in ("line", "n", "pos"))
    out = [np.array([len(x["key"]), doc0], "<i8").tobytes()]
    for f, kind in FIELDS:
        out.append((x[f] - doc0 if f == "doc" and narrow else x[f]).astype(NARROW.get(f, kind) if narrow else kind).tobytes())
    return "narrow" if narrow else "wide", b"".join(out)


def _unpack(kind: str, blob: bytes) -> dict[str, np.ndarray]:
    n, doc0 = np.frombuffer(blob, "<i8", 2).tolist()
    out, at = {}, 16
    for f, wide in FIELDS:
        d = np.dtype(NARROW.get(f, wide) if kind == "narrow" else wide)
        got = np.frombuffer(blob, d, n, at)
        at += d.itemsize * n
        out[f] = got if d == wide else got.astype(wide)
    if kind == "narrow":
        out["doc"] = out["doc"] + doc0
    return out


def _entries(order: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        held: list[dict[str, np.ndarray]] = []
        gone: list[tuple[int, int]] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            rows = []
            if held:
                x = {f: np.concatenate([y[f] for y in held]) for f, _ in FIELDS}
                to = order.part(x["key"], order.block(x["key"], x["sum"]))
                by = np.lexsort((x["doc"], to))
                x, to = {f: v[by] for f, v in x.items()}, to[by]
                cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist() + [len(to)]
                rows += [(int(to[a]), *_pack({f: v[a:b] for f, v in x.items()})) for a, b in zip(cuts, cuts[1:], strict=False)]
            if gone:
                rows.append((gone[0][0] % order.parts, "gone", np.array(gone, "<i8").tobytes()))
            held.clear()
            gone.clear()
            if rows:
                yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "kind": [r[1] for r in rows], "blob": [r[2] for r in rows]})

        for whole in batches:
            for batch in slices(whole):
                hashes, line, doc, number = _words(batch.column("text"))
                if not len(hashes):
                    continue
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                h, starts, n, of = _sets(hashes, line, order.rank)
                d, ln = ids[of].astype(np.int64), number[of]
                s1, s2, odd0, odd1 = _marks(h, starts)
                rep = np.ones(len(n), bool)
                if len(seen) > 50_000:
                    seen.clear()
                for i, (key, place) in enumerate(zip(zip(s1.tolist(), s2.tolist(), strict=True), zip(d.tolist(), ln.tolist(), strict=True), strict=True)):
                    old = seen.setdefault(key, place)
                    if old is not place:
                        if place < old:
                            seen[key] = place
                            gone.append(old)
                        elif place != old:
                            rep[i] = False
                            gone.append(place)
                which = np.flatnonzero(rep)
                p = order.prefix(n[which])
                w, pos = np.repeat(which, p), _places(p)
                key = h[starts[w] + pos]
                live = order.rank[_bucket(key)] > 0
                w, pos, key = w[live], pos[live], key[live]
                held.append(dict(zip((f for f, _ in FIELDS), (key.astype(np.uint32), d[w], ln[w], n[w], pos, odd0[w], odd1[w], s1[w]), strict=True)))
                if sum(len(y["key"]) for y in held) > HELD:
                    yield from dealt()
        yield from dealt()

    return run


FOUND = "a_doc long, a_line int, b_doc long, b_line int, ask long"


def _found(doc: np.ndarray, line: np.ndarray, a_doc: np.ndarray | None = None, a_line: np.ndarray | None = None, ask: np.ndarray | None = None) -> pa.RecordBatch:
    """A line that goes; with a_doc and a_line a candidate for it; with ask a word whose list it has not seen to the end."""
    whole = lambda x, kind: pa.nulls(len(doc), kind) if x is None else pa.array(x.astype(kind.to_pandas_dtype()))
    return pa.RecordBatch.from_arrays([whole(a_doc, pa.int64()), whole(a_line, pa.int32()), whole(doc, pa.int64()), whole(line, pa.int32()), whole(ask, pa.int64())], names=["a_doc", "a_line", "b_doc", "b_line", "ask"])


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Numbers in the order of (doc, line), equal where both are."""
    if not len(doc):
        return doc
    low = doc.min()
    if int(doc.max()) - int(low) < 1 << 42 and line.max() < 1 << 21:
        return ((doc - low) << 21) | line
    by = np.lexsort((line, doc))
    out = np.empty(len(doc), np.int64)
    out[by] = np.cumsum(_heads(doc[by], line[by]))
    return out


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new) < 2:
        return new
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _match(order: Order, cap: int):
    def scan(x: dict[str, np.ndarray], start: np.ndarray, guest: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (earlier, later) as places in x, which is in order of list, document and line."""
        pos, odd0, odd1 = x["pos"].astype(np.int64), x["odd0"], x["odd1"]

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            na, nb = n[a], n[b]
            need = order.need(na, nb)
            ok = (np.minimum(na, nb) >= need) & ~(guest[a] & guest[b]) & (np.minimum(na - pos[a], nb - pos[b]) >= need)
            k = np.flatnonzero(ok)
            a, b = a[k], b[k]
            odd = np.bitwise_count(odd0[a] ^ odd0[b]).astype(np.int64) + np.bitwise_count(odd1[a] ^ odd1[b])
            return k[(odd <= na[k] + nb[k] - 2 * need[k]) & ((x["doc"][a] != x["doc"][b]) | (x["line"][a] != x["line"][b]))]

        found, at = np.zeros(len(n), np.int32), np.arange(len(n))
        live, d = np.flatnonzero(at > start), 1
        while len(live) > 32:
            hit = live[near(live - d, live)]
            if len(hit):
                yield hit - d, hit
                found[hit] += 1
            d += 1
            live = live[live - d >= start[live]]
            full = found[live] >= cap
            if full.any():
                self_asks.append(live[full])
                live = live[~full]
        for i in live.tolist():  # a few long lists are left
            b = i - d
            while b >= start[i]:
                a = np.arange(b, max(start[i], b - 4096 + 1) - 1, -1)
                got = a[near(a, np.full(len(a), i))]
                take = got[: cap - found[i]]
                if len(take):
                    yield take, np.full(len(take), i)
                    found[i] += len(take)
                b -= 4096
                if found[i] >= cap:
                    if b >= start[i] or len(got) > len(take) or take[-1] > start[i]:
                        self_asks.append(np.array([i]))
                    break

    self_asks: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == "gone":  # an equal line lies before it
                    gone = np.frombuffer(blob, "<i8").reshape(-1, 2)
                    yield _found(gone[:, 0], gone[:, 1])
                else:
                    held.append(_unpack(kind, blob))
        if not held:
            return
        x = {f: np.concatenate([y[f] for y in held]) for f, _ in FIELDS}
        held.clear()
        block = order.block(x["key"], x["sum"])
        lists = x["key"].astype(_U)
        if block.any():  # blocks of a word are lists of their own
            lists = np.unique(lists | (block.astype(_U) << _U(32)), return_inverse=True)[1].astype(_U)
        place = _place(x["doc"], x["line"])
        by = np.argsort((lists << _U(32)) | (mix64(x["sum"] + x["n"].astype(_U)) >> _U(32)))
        lists, place = lists[by], place[by]
        x = {f: v[by] for f, v in x.items()}
        heads = np.flatnonzero(_heads(lists, x["sum"], x["n"]))  # runs of equal lines of a list
        run_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(place))))
        first = np.minimum.reduceat(place, heads)
        equal = (place != first[run_of]) & (x["pos"] == 0)  # told where a line's first word is
        if equal.any():
            yield _found(x["doc"][equal], x["line"][equal])
        at = np.flatnonzero(place == first[run_of])
        at = at[_heads(run_of[at])]
        lists, place = lists[at], place[at]
        x = {f: v[at] for f, v in x.items()}
        cut = order.blocks(x["key"]) > 1
        if cut.any():
            yield _found(x["doc"][cut], x["line"][cut], ask=x["key"][cut])
        new = _heads(lists)
        number = np.cumsum(new) - 1
        more = np.bincount(number)[number] > 1
        x, place, number = {f: v[more] for f, v in x.items()}, place[more], number[more]
        if not len(place):
            return
        by = np.argsort(place, kind="stable")
        x, number = {f: v[by] for f, v in x.items()}, number[by]
        own = order.length_class(x["n"].astype(np.int64))
        cls = np.unique(np.concatenate([own, own + 1]), return_inverse=True)[1]
        rows = np.tile(np.arange(len(own)), 2)
        brief = (np.tile(number, 2).astype(_U) << _U(36)) | (cls.astype(_U) << _U(26)) | rows.astype(_U)
        if len(own) < 1 << 26 and cls.max() < 1 << 10:
            brief = np.sort(brief)
            rows, lists = (brief & _U((1 << 26) - 1)).astype(np.int64), brief >> _U(26)
            cls = ((brief >> _U(26)) & _U((1 << 10) - 1)).astype(np.int64)
            heads = _heads(lists)
        else:
            by = np.lexsort((rows, cls, np.tile(number, 2)))
            rows, cls, heads = rows[by], cls[by], _heads(np.tile(number, 2)[by], cls[by])
        guest = cls != np.unique(np.concatenate([own, own + 1])).searchsorted(own)[rows]
        size = np.bincount(np.cumsum(heads) - 1)
        keep = size[np.cumsum(heads) - 1] > 1  # not the lines alone in their list and class
        rows, heads, guest = rows[keep], heads[keep], guest[keep]
        start = np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))
        x = {f: v[rows] for f, v in x.items()}
        self_asks.clear()
        for a, b in scan(x, start, guest, x["n"].astype(np.int64)):
            yield _found(x["doc"][b], x["line"][b], x["doc"][a], x["line"][a])
        if self_asks:
            at = np.concatenate(self_asks)
            yield _found(x["doc"][at], x["line"][at], ask=x["key"][at])

    return run


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of the lines asked for."""
    for whole in batches:
        for batch in slices(whole):
            hashes, line, doc, number = _words(batch.column("text"))
            if not len(hashes):
                continue
            take = _asked(batch.column("lines"), doc, number)[line]
            h, starts, n, of = _sets(hashes[take], line[take])
            if len(n):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                words = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[of]].astype(np.int64)), pa.array(number[of].astype(np.int32)), words], names=["doc", "line", "words"])


def _asked(column: pa.Array, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which of the lines (document, number) are in their document's list of numbers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    wanted = (np.repeat(np.arange(len(n)), n) << 32) | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.isin((doc << 32) | number, wanted)


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, bound: int) -> DataFrame:
    """(b_doc, b_line) of the pairs whose sets reach the similarity."""
    both = pairs.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).union(pairs.select("b_doc", "b_line"))
    need = stash(both.groupBy("doc").agg(F.collect_set("line").alias("lines")).withColumnRenamed("doc", "doc_id"), "lines-needed")
    sets = bounded_join(texts, need, ["doc_id"], "inner", bound).select("doc_id", "text", "lines").mapInArrow(lean(_wanted), "doc long, line int, words array<long>")
    sets = stash(sets, "line-sets")
    a = sets.select(F.col("doc").alias("a_doc"), F.col("line").alias("a_line"), F.col("words").alias("a_words"))
    b = sets.select(F.col("doc").alias("b_doc"), F.col("line").alias("b_line"), F.col("words").alias("b_words"))
    x = pairs.join(a, ["a_doc", "a_line"]).join(b, ["b_doc", "b_line"])
    common = F.size(F.array_intersect("a_words", "b_words"))
    # written before distinct rows are sought, so that Spark may split a join's hot partition
    return stash(x.filter(100 * common >= percent * (F.size("a_words") + F.size("b_words") - common)).select("b_doc", "b_line"), "line-verified").distinct()


QUEST = "part int, key long, block int, ask boolean, doc long, line int, pos int, words binary"


def _quests(order: Order, wanted: np.ndarray):
    """Whole sets of the lines in lists that are asked about, to their block; asking lines (doc << 32 | line in lines, word in keys) to all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                hashes, line, doc, number = _words(batch.column("text"))
                if not len(hashes):
                    continue
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                h, starts, n, of = _sets(hashes, line, order.rank)
                s1 = np.add.reduceat(mix64(h), starts)
                p = order.prefix(n)
                w, pos = np.repeat(np.arange(len(n)), p), _places(p)
                key = h[starts[w] + pos].astype(np.uint32)
                live = wanted[_bucket(key)]
                w, pos, key = w[live], pos[live], key[live]
                asks = {(i, x["line"], x["key"]) for i, v in enumerate(batch.column("asks").to_pylist()) for x in v or ()}
                asking = np.array([k in asks for k in zip(doc[of[w]].tolist(), number[of[w]].tolist(), key.tolist(), strict=True)], bool)
                blocks = np.where(asking, order.blocks(key), 0)
                at = np.concatenate([np.arange(len(w)), np.repeat(np.arange(len(w)), blocks)])
                block = np.concatenate([order.block(key, s1[w]), _places(blocks)])
                flat, ends = h.tobytes(), (starts + n) * 8
                for a in range(0, len(at), 4096):
                    i = at[a : a + 4096]
                    k, b, own = key[i], block[a : a + 4096], w[i]
                    words = [flat[x:y] for x, y in zip((starts[own] * 8).tolist(), ends[own].tolist(), strict=True)]
                    arrays = [order.part(k, b).astype(np.int32), k.astype(np.int64), b.astype(np.int32), np.arange(a, a + len(i)) >= len(w), ids[of[own]].astype(np.int64), number[of[own]].astype(np.int32), pos[i].astype(np.int32), words]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["part", "key", "block", "ask", "doc", "line", "pos", "words"])

    return run


def _answers(order: Order):
    """Rows come by (part, key, block), asking lines first: those that an earlier line of the list matches."""

    def near(ask: tuple, docs: np.ndarray, lines: np.ndarray, pos: np.ndarray, sets: list[np.ndarray], n: np.ndarray) -> bool:
        doc, line, at, own = ask
        need = order.need(n, len(own))
        ok = (docs < doc) | ((docs == doc) & (lines < line))
        ok &= (np.minimum(n, len(own)) >= need) & (np.minimum(n - pos, len(own) - at) >= need)
        for i in np.flatnonzero(ok).tolist():
            if len(np.intersect1d(sets[i], own, assume_unique=True)) >= need[i]:
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, done = None, [], []
        for whole in batches:
            for batch in slices(whole, "words"):
                col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "ask", "doc", "line", "pos")}
                sets = [np.frombuffer(v, "<u8") for v in batch.column("words").to_pylist()]
                n = np.array([len(s) for s in sets])
                cuts = [*np.flatnonzero(_heads(col["key"], col["block"])).tolist(), len(sets)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if (int(col["key"][a]), int(col["block"][a])) != now:
                        now, asks = (int(col["key"][a]), int(col["block"][a])), []
                    first = a + int(col["ask"][a:b].sum())
                    asks += [(int(col["doc"][i]), int(col["line"][i]), int(col["pos"][i]), sets[i]) for i in range(a, first)]
                    rest = slice(first, b)
                    met = [near(x, col["doc"][rest], col["line"][rest], col["pos"][rest], sets[rest], n[rest]) for x in asks]
                    done += [x[:2] for x, m in zip(asks, met, strict=True) if m]
                    asks = [x for x, m in zip(asks, met, strict=True) if not m]
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int32())], names=["b_doc", "b_line"])
                    done = []

    return run


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, cap: int = 4, block_rows: int = 1 << 16, part_bytes: int = 12 << 20, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, line) of every line, counted from 0, that an earlier line matches."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    counts = word_counts(texts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum() * (100 - percent) / 100 * ENTRY_BYTES / part_bytes))
    order = Order(counts, percent, parts, block_rows)
    rows = texts.mapInArrow(lean(_entries(order)), "part int, kind string, blob binary")
    found = stash(rows.repartition(parts, "part").mapInArrow(lean(_match(order, cap)), FOUND), "line-candidates")
    line = ["b_doc", "b_line"]
    gone = stash(found.filter("a_doc is null and ask is null").select(*line).distinct(), "lines-equal")
    pairs = stash(found.filter("a_doc is not null").drop("ask").distinct().join(gone, line, "left_anti"), "line-pairs")
    sure = stash(_verify(pairs, texts, percent, bound), "line-matches")
    left = stash(found.filter("ask is not null").select(*line, "ask").distinct().join(gone, line, "left_anti").join(sure, line, "left_anti"), "lines-left")
    keys = left.select(F.col("ask").bitwiseAND(BUCKETS - 1).alias("bucket")).distinct().toArrow()["bucket"].to_numpy()  # BUCKETS rows at most
    if len(keys):
        wanted = np.zeros(BUCKETS, bool)
        wanted[keys] = True
        asks = left.groupBy("b_doc").agg(F.collect_list(F.struct(F.col("b_line").alias("line"), F.col("ask").alias("key"))).alias("asks")).withColumnRenamed("b_doc", "doc_id")
        asked = bounded_join(texts, stash(asks, "lines-asking"), ["doc_id"], "left", bound).select("doc_id", "text", "asks")
        finer = Order(counts, percent, parts, max(1, block_rows // 64))  # whole sets are larger than entries
        rows = asked.mapInArrow(lean(_quests(finer, wanted)), QUEST).repartition(parts, "part").sortWithinPartitions("key", "block", F.desc("ask"))
        sure = sure.union(stash(rows.mapInArrow(lean(_answers(finer)), "b_doc long, b_line int"), "line-answers"))
    return gone.union(sure).distinct().select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers; the lines are bound once, as a lambda's variable."""
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cut = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))
    return F.when(gone.isNull(), text).otherwise(F.get(cut, F.lit(0)))


def _joined(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    gone = later_matches(docs, id_col, text_col, **options).groupBy("doc_id").agg(F.collect_list("line").alias("gone")).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"))
    return bounded_join(rows, stash(gone, "lines-gone"), ["_id"], "left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers) and text (what is left)."""
    x = _joined(docs, id_col, text_col, **options)
    text = F.col("row")[text_col]
    return x.select(
        F.col("_id").alias("doc_id"), F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.array_sort(F.coalesce("gone", F.array().cast("array<int>"))).alias("removed"), without_lines(text, F.col("gone")).alias("text"),
    )


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the later matches cut out of their texts; a column n_chars follows the new text."""
    x = _joined(docs, id_col, text_col, **options).withColumn("_text", without_lines(F.col("row")[text_col], F.col("gone")))
    new = {text_col: F.col("_text"), "n_chars": F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("_text").cast("long")) if "n_chars" in docs.columns else None}
    return x.select(*[(new[c] if new.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns])
