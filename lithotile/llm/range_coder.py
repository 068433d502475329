"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block is up to BLOCK ids, cut into streams (lanes) that are coded in step by numpy over lanes and share one adaptive model,
which starts afresh with the block. The model mixes predictions of three orders: two guesses each of orders 2 and 1 get
shares of the interval by their hit rates so far for the confidences they have earned, and the rest goes to order 0, an
adaptive distribution over all ids. One interval in 2^32 codes an id. Each block carries the CRC-32 of its ids.

A file is the segments of one range of doc_ids. A segment holds whole documents: their ids, lengths and blocks.
Defined results: null and empty texts are the end identifier alone; rows are written in order of doc_id, then text, nulls
first; an empty table gives no file; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stash, text_bytes
from .tokens import encoder, read_definition

BLOCK = 1 << 21
SEGMENT = 4 << 20
END = 1
#: Most streams in a block, which are coded in step, and the least ids that each has.
LANES, LEAST = 4096, 512
#: Bits of the shares of orders 1 and 2, and of the order-2 table's index.
BITS, SLOTS2 = 16, 17
#: Most of the interval that guesses may take, of 2^BITS.
MOST = 64_000
SEGMENT_ROW = "file long, segment long, n_ids long, doc_ids array<long>, lengths array<int>, sizes binary, checks binary, payload binary"
_U = np.uint64


class _Model:
    """What all lanes of a block have seen after the same number of steps; a fresh one for each block.

    Order 0 is a distribution over the block's ids (numbered 0 .. ids - 1) that follows the counts so far; it is drawn anew
    after steps that double and then come every REDRAW. Orders 2 and 1 hold a guess for each context, with the confidence it
    has earned. The shares of the guesses are their hit rates so far in the same pair of confidences; order 0 has the rest.
    """

    REDRAW = 64

    def __init__(self, lanes: int, ids: int):
        self.ids, self.step, self.next, self.bits0 = ids, 0, 1, max(16, ids.bit_length() + 4)
        self.slot2, self.slot1 = np.zeros(1 << SLOTS2, np.int64), np.zeros(ids, np.int64)  # id * 8 + confidence
        self.hits2, self.hits1, self.tries = np.full(64, 2.0), np.full(64, 2.0), np.full(64, 16.0)
        self.counts, self.seen = np.zeros(ids, np.int64), []
        self.a, self.b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.draw()
        self.share()

    def draw(self) -> None:
        free = (1 << self.bits0) - self.ids
        freq = self.counts * free // max(int(self.counts.sum()), 1) + 1
        freq[0] += (1 << self.bits0) - int(freq.sum())
        self.freq0 = freq.astype(_U)
        self.cum0 = np.cumsum(self.freq0) - self.freq0
        self.drawn = None

    def share(self) -> None:
        """For each pair of confidences, and once more where both orders guess the same: ends of the guesses' shares, order 0's unit."""
        rate2, rate1 = self.hits2 / self.tries, self.hits1 / self.tries
        scale = (MOST - 64) / np.maximum(1.0, rate2 + rate1)
        w2 = ((rate2 * scale).astype(np.int64) + 8).astype(_U) << _U(32 - BITS)
        w1 = ((rate1 * scale).astype(np.int64) + 8).astype(_U) << _U(32 - BITS)
        self.end2, self.end1 = np.concatenate([w2, w2]), np.concatenate([w2 + w1, w2])
        self.units = ((_U(1) << _U(32)) - self.end1) >> _U(self.bits0)

    def predict(self) -> None:
        self.at2 = (self.a * 40503 + self.b * 0x9E3779B1 >> 7) & ((1 << SLOTS2) - 1)
        self.got2, self.got1 = self.slot2.take(self.at2), self.slot1.take(self.b)
        self.p2, self.p1 = self.got2 >> 3, self.got1 >> 3
        self.sure2, self.sure1 = self.got2 & 7, self.got1 & 7
        self.pair = (self.sure2 << 3) | self.sure1
        state = self.pair + ((self.p2 == self.p1).view(np.int8) * np.int64(64))
        self.upper2, self.upper1, self.unit = self.end2.take(state), self.end1.take(state), self.units.take(state)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id's interval."""
        self.hit2, self.same1 = self.p2 == ids, self.p1 == ids
        self.hit1 = self.same1 & ~self.hit2
        start = self.unit * self.cum0.take(ids) + self.upper1
        width = self.unit * self.freq0.take(ids)
        np.copyto(start, self.upper2, where=self.hit1)
        np.copyto(width, self.upper1 - self.upper2, where=self.hit1)
        np.copyto(start, _U(0), where=self.hit2)
        np.copyto(width, self.upper2, where=self.hit2)
        return start, width

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold these places."""
        if self.drawn is None:
            self.drawn = np.repeat(np.arange(self.ids, dtype=np.int32), self.freq0.astype(np.int64))
        inside = (np.maximum(place, self.upper1) - self.upper1) // self.unit
        out = self.drawn.take(inside.view(np.int64), mode="clip").astype(np.int64)
        np.copyto(out, self.p1, where=place < self.upper1)
        np.copyto(out, self.p2, where=place < self.upper2)
        return out

    def update(self, ids: np.ndarray) -> None:
        new = ids << 3
        for slot, at, got, sure, hit in ((self.slot2, self.at2, self.got2, self.sure2, self.hit2), (self.slot1, self.b, self.got1, self.sure1, self.same1)):
            # a hit is surer; a miss costs a sure guess two and replaces the others
            slot[at] = np.where(hit, got + (sure < 7), np.where(sure > 1, got - 2, new))
        told = np.bincount(self.pair + (self.hit2.view(np.int8) * np.int64(64)) + (self.hit1.view(np.int8) * np.int64(128)), minlength=192).reshape(3, 64)
        self.tries += told.sum(axis=0)
        self.hits2 += told[1]
        self.hits1 += told[2]
        self.seen.append(ids)
        self.a, self.b = self.b, ids
        self.step += 1
        if self.step == self.next:
            self.next += min(self.step, self.REDRAW)
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.ids)
            self.seen.clear()
            self.draw()
        if self.step % 16 == 0 or self.step < 32:
            self.share()


class _Coder:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, cum: np.ndarray, freq: np.ndarray) -> None:
        r = self.range >> _U(32)
        self.low += cum * r
        self.range = freq * r

    def settle(self):
        """Yields the lanes that shift 16 bits out; those whose range is too narrow across a carry give some of it up."""
        lanes = None
        while True:
            low, rng = (self.low, self.range) if lanes is None else (self.low[lanes], self.range[lanes])
            settled = ((low ^ (low + rng)) >> _U(48)) == 0
            narrow = rng < _U(1 << 48)
            need = settled | narrow
            at = np.flatnonzero(need)
            if not len(at):
                return
            cut = at[~settled[at]]
            lanes = at if lanes is None else lanes[at]
            low = low[at]
            rng = rng[at]
            if len(cut):
                fix = ~settled[at]
                rng[fix] = (_U(0) - low[fix]) & _U((1 << 48) - 1)
            yield lanes, (low >> _U(48)).astype(np.uint16)
            self.low[lanes] = low << _U(16)
            self.range[lanes] = rng << _U(16)


def _lanes(n: int) -> int:
    return min(LANES, max(1, n // LEAST))


def encode_block(ids: np.ndarray) -> bytes:
    """The bytes in the alphabet, the alphabet (a bit map of ids, by zlib), the 16-bit words in each lane, and the lanes' words on end."""
    lanes = _lanes(len(ids))
    steps = -(-len(ids) // lanes)
    there = np.zeros(int(ids.max()) + 1, bool)
    there[ids] = True
    alphabet = zlib.compress(np.packbits(there).tobytes())
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = (np.cumsum(there) - 1)[ids]
    model, coder, lane = _Model(lanes, int(there.sum())), _Coder(lanes), np.arange(lanes)
    out, used = np.zeros((lanes, steps * 2 + 64), np.uint16), np.zeros(lanes, np.int64)
    for x in np.ascontiguousarray(grid.reshape(lanes, steps).T):
        model.predict()
        coder.narrow(*model.interval(x))
        for at, words in coder.settle():
            out[at, used[at]] = words
            used[at] += 1
        if int(used.max()) > out.shape[1] - 16:
            out = np.concatenate([out, np.zeros_like(out)], axis=1)
        model.update(x)
    for k in range(4):
        out[lane, used + k] = (coder.low >> _U(48 - 16 * k)).astype(np.uint16)
    used += 4
    keep = np.arange(out.shape[1])[None, :] < used[:, None]
    return b"".join([np.array([len(alphabet)], "<u4").tobytes(), alphabet, used.astype("<u4").tobytes(), out[keep].astype("<u2").tobytes()])


def decode_block(block: bytes, n: int) -> np.ndarray:
    lanes = _lanes(n)
    steps = -(-n // lanes)
    at = 4 + int(np.frombuffer(block, "<u4", 1)[0])
    alphabet = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(block[4:at]), np.uint8)))
    used = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    padded = np.concatenate([np.frombuffer(block, "<u2", offset=at + 4 * lanes), np.zeros(8, np.uint16)])
    model, coder = _Model(lanes, len(alphabet)), _Coder(lanes)
    place = np.cumsum(used) - used
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _U(16)) | padded[place].astype(_U)
        place += 1
    out = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        model.predict()
        out[t] = x = model.find((code - coder.low) // (coder.range >> _U(32)))
        coder.narrow(*model.interval(x))
        for at, _ in coder.settle():
            code[at] = (code[at] << _U(16)) | padded.take(place[at], mode="clip").astype(_U)
            place[at] += 1
        model.update(x)
    return alphabet[out.T.ravel()[:n]]


def _even(n: int, block: int) -> int:
    """The length of equal blocks of at most `block` ids, but for the last."""
    return -(-n // -(-n // block)) if n else block


def pack_segment(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes, bytes]:
    """(bytes of each block, CRC-32 of each block's ids, payload) of a run of ids."""
    each = _even(len(ids), block)
    parts = [ids[a : a + each].astype("<u4") for a in range(0, len(ids), each)]
    coded = [encode_block(x) for x in parts]
    checks = np.array([zlib.crc32(x.tobytes()) for x in parts], "<u4")
    return np.array([len(w) for w in coded], "<u4").tobytes(), checks.tobytes(), b"".join(coded)


def unpack_segment(sizes: bytes, checks: bytes, payload: bytes, n: int, block: int = BLOCK) -> np.ndarray:
    parts, end, each = [], 0, _even(n, block)
    for i, (size, check) in enumerate(zip(np.frombuffer(sizes, "<u4").tolist(), np.frombuffer(checks, "<u4").tolist(), strict=True)):
        ids = decode_block(payload[end : end + size], min(each, n - i * each)).astype("<u4")
        if zlib.crc32(ids.tobytes()) != check:
            raise ValueError(f"block {i} does not match its checksum")
        parts.append(ids)
        end += size
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _write(definition: str, end: int, segment: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file, tail = encoder(definition), TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        number, docs, parts, size = 0, [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes, checks, payload = pack_segment(ids, block)
            lengths = [len(p) // 4 for p in parts]
            arrays = [pa.array([x], t) for x, t in zip((file, number, len(ids), docs, lengths, sizes, checks, payload), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "segment", "n_ids", "doc_ids", "lengths", "sizes", "checks", "payload"])

        for whole in batches:
            for batch in slices(whole):
                for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode_many(list(text_bytes(batch.column("text")))), strict=True):
                    docs.append(doc)
                    parts.append(ids + tail)
                    size += len(ids) // 4 + 1
                if size >= segment:
                    yield row()
                    number, docs, parts, size = number + 1, [], [], 0
        if docs:
            yield row()

    return run


def write_id_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end: int = END, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """The segments of all files, in the shared folder; files follow one another in ascending doc_id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stash(ordered.mapInArrow(_write(read_definition(tokenizer), end, segment, block), SEGMENT_ROW), "id-files")


def _read(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_segment(r["sizes"], r["checks"], r["payload"], r["n_ids"], block)
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ends - lengths + r["start"]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_id_files(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (with the end id), decoded from the files."""
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("n"))  # a row for each file
    files_before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("n").over(files_before), F.lit(0)).alias("file_start"))
    before = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", "segment", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("in_file"))
    starts = stash(starts.join(totals, "file").select("file", "segment", (F.col("in_file") + F.col("file_start")).alias("start")), "id-starts")
    return bounded_segments(files, starts).mapInArrow(_read(block), "doc_id long, start long, n_tokens long, ids_crc32 long")


def bounded_segments(files: DataFrame, starts: DataFrame) -> DataFrame:
    from .common import bounded_join

    return bounded_join(files, starts, ["file", "segment"])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return read_id_files(write_id_files(docs, id_col, text_col, **options), options.get("block", BLOCK))
