"""Byte-level BPE encoding and decoding by a pair occurrence index.

The different pieces of a batch lie one after another as symbols. An index maps each pair's rank to all positions of the pair
in the batch; ranks that have positions are applied in ascending order, each to all its positions at once, and the pairs that
a merge makes at its place and before it go to the lists of their ranks. A pair that holds a merged symbol ranks after that
merge (checked when the tokenizer is read), so a list is complete when its rank is due. Pieces met in earlier batches of a
task keep their ids in a table of bounded size.

Defined results: null counts as empty, empty texts have no id; rows that repeat an id are rows of their own; an id may be null; very long
texts are cut where white space begins, which no piece crosses; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, slices

# Fixed value: the pieces of byte-level tokenizers of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a task remembers at most.
REMEMBERED = 300_000
#: Characters of one step: longer texts are cut.
STEP = 1 << 21
ENCODED = "id long, ids binary"
NONE = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it shows, else the next one from 256 on."""
    out, spare = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if shown else spare))
        spare += not shown
    return out


class PairIndex:
    """Ids of pieces (bytes) by a table of ranked merges."""

    def __init__(self, symbols: np.ndarray, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        """symbols: the id of each byte; left, right, made: the merges in order of rank."""
        self.symbols, self.left, self.right, self.made = symbols.astype(np.int32), left, right, made
        self.width = int(max(symbols.max(), made.max(initial=0))) + 1
        born = np.full(self.width, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before its parts are made")
        keys = left.astype(np.int64) * self.width + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE without one."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        if not pieces:
            return []
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lens)
        n = int(ends[-1])
        if not n or not len(self.keys):
            sym = self.symbols[np.frombuffer(b"".join(pieces), np.uint8)]
            return np.split(sym, ends[:-1])
        sym = np.empty(n + 1, np.int32)  # place n stands for no neighbour
        sym[:n] = self.symbols[np.frombuffer(b"".join(pieces), np.uint8)]
        sym[n] = -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[lens > 0] - 1] = n
        before[(ends - lens)[lens > 0]] = n
        lists: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that begin at these places in the index."""
            at = at[after[at] < n]
            rank = self.ranks(sym[at], sym[after[at]])
            some = rank != NONE
            at, rank = at[some], rank[some]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in lists:
                    lists[r].append(part)
                else:
                    lists[r] = [part]
                    heapq.heappush(due, r)

        add(np.arange(n))
        while due:
            r = heapq.heappop(due)
            got = lists.pop(r)
            p = got[0] if len(got) == 1 else np.sort(np.concatenate(got))
            a, b = self.left[r], self.right[r]
            p = p[(sym[p] == a) & (sym[after[p]] == b)]  # others have lost a part to an earlier merge
            if a == b and len(p) > 1:  # in a run of the symbol, every other pair from its left end
                chained = np.concatenate([[False], after[p[:-1]] == p[1:]])
                run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
                p = p[(np.arange(len(p)) - run) % 2 == 0]
            if not len(p):
                continue
            gone = after[p]
            behind = after[gone]
            sym[p], sym[gone] = self.made[r], -1
            after[p] = behind
            before[behind] = p
            left = before[p]
            add(np.unique(np.concatenate([p, left[left < n]])))
        kept = np.flatnonzero(sym[:n] >= 0)
        return np.split(sym[kept], np.searchsorted(kept, ends[:-1]))


class Codec:
    """Encodes and decodes texts as the tokenizers library does with a byte-level BPE file, without special tokens of its own."""

    def __init__(self, definition: str, most: int = REMEMBERED):
        d = json.loads(definition)
        model, pre = d["model"], d["pre_tokenizer"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or d.get("normalizer") or d.get("post_processor"):
            raise ValueError("a plain byte-level BPE file is wanted")
        if (pre["type"], pre["add_prefix_space"], pre["use_regex"], d["decoder"]["type"]) != ("ByteLevel", False, True, "ByteLevel"):
            raise ValueError("a plain byte-level BPE file is wanted")
        added = d["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or match whole words only are not known here")
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        column = lambda f: np.array([vocabulary[f(m)] for m in merges], np.int64)
        letters = byte_letters()
        self.index = PairIndex(np.array([vocabulary[c] for c in letters]), column(lambda m: m[0]), column(lambda m: m[1]), column("".join))
        self.added = {t["content"]: t["id"] for t in added}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        byte = {c: b for b, c in enumerate(letters)}
        self.table = {i: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s, i in (vocabulary | self.added).items()}
        self.find = regex.compile(PIECES).findall
        self.library = Tokenizer.from_str(definition)
        self.common, self.strange = set(), set()
        self.known: dict[str, bytes] = {}
        self.most = most

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without added tokens. Characters that this Python's Unicode does not name go by the library's own classes."""
        new = set(text) - self.common
        if new:
            odd = {c for c in new if unicodedata.category(c) == "Cn"}
            self.common |= new - odd
            if odd:
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def cut(self, text: str) -> Iterator[str]:
        """Parts of a text that are encoded alone: a part ends where white space follows other characters."""
        at = 0
        while len(text) - at > STEP:
            m = _CUT.search(text, at + STEP)
            if m is None:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def steps(self, text: str) -> Iterator[str | int]:
        """Parts of text and ids of added tokens, in order."""
        at = 0
        for m in self.split_added.finditer(text) if self.split_added else ():
            if m.start() > at:
                yield from self.cut(text[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        if at < len(text):
            yield from self.cut(text[at:])

    def learn(self, pieces: set[str]) -> None:
        """Work out the ids of pieces that are not known yet, all in one index."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(pieces)
        for p, ids in zip(new, self.index.encode([p.encode() for p in new]), strict=True):
            self.known[p] = ids.astype("<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [[s if isinstance(s, int) else self.pieces(s) for s in self.steps(t)] for t in texts]
        self.learn({p for steps in parts for s in steps if not isinstance(s, int) for p in s})
        look = self.known.__getitem__
        return [b"".join(s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(look, s)) for s in steps) for steps in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids without a token nothing."""
        return b"".join([self.table.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


_CUT = re.compile(r"\S(?=[ \n])")
_codecs: dict[int, Codec] = {}


def codec(definition: str) -> Codec:
    """One per worker and definition."""
    key = hash(definition)
    if key not in _codecs:
        _codecs[key] = Codec(definition)
    return _codecs[key]


def read_definition(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """id and ids (little-endian unsigned 32-bit integers) of each whole text. tokenizer: a file of the tokenizers library."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(definition.value)
        for whole in batches:
            for batch in slices(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.encode_many(texts), pa.binary())], names=["id", "ids"])
        own.known.clear()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), ENCODED)


def decode(encoded: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """id, ids and text of a table of id and ids; null ids have a null text."""
    definition = encoded.sparkSession.sparkContext.broadcast(read_definition(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(definition.value)
        for whole in batches:
            for batch in slices(whole, "ids"):
                texts = [None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return encoded.select(F.col("id"), F.col("ids")).mapInArrow(lean(run), "id long, ids binary, text string")
