"""Token ids of whole texts by a public tokenizer file of the tokenizers library.

The library encodes white-space-free pieces, each once while it is remembered; this gives the ids of the
whole text where the tokenizer drops white space and its normaliser and splitter work inside pieces, which `TextEncoder`
holds by comparing a sample text when it is made. Plain pieces are cut into words, marks and digits and lower-cased by whole
buffers, and of these it runs the library's model alone, if samples allow that.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

_encoders: dict[tuple, TextEncoder] = {}
_SAMPLE = "A  one-two\tDon't  STOP\n café naïve <|endoftext|> x_1.5 (y) z İ ΣΣ. é 42%"
_WORDS = "The quick brown Fox, jumps! over (a) thnd. ingtion) Erhaine?! WORD;: z A... supercalifragilistic] aaaaaaaaaaaa it&ll A$%# b,### c***~ d_ 42 x_1.5 1a2B 007é. (ß)7-ÿ a.b@C.d =9= éÀ"
#: Bytes of the buffers that are encoded at a time, where a piece isn't longer.
WINDOW = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SPACE, _LETTER, _MARK, _DIGIT, _ODD = range(5)
#: What a byte of UTF-8 is. Letters are those of ASCII and Latin-1; pieces that hold odd bytes are the library's as a whole.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = _LETTER
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = _MARK
_KIND[list(b"0123456789")] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0x80, 0x97), *range(0x98, 0x9F)]] += 32
#: Whether words part between two bytes, by 8 * the kind of one + that of the next: letters and marks stay together, digits don't.
_PARTS = np.zeros(64, bool)
_PARTS[[8 * a + b for a in range(1, 5) for b in range(1, 5) if a != b or a == _DIGIT]] = True
_LATIN = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


class _Words(dict):
    """Numbers of words as they come, and the ids of those learnt: word k has ids[ends[k] : ends[k + 1]]."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class TextEncoder:
    """Ids of UTF-8 texts as packed little-endian unsigned integers. At most about twice `most` words are remembered, and those of a window."""

    def __init__(self, definition: str, special_as_text: bool = False, dtype: str = "<u4", most: int = 600_000):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model, self.dtype, self.most, self.letters = self.tokenizer.model, np.dtype(dtype), most, {}
        by_pieces = np.where(_KIND == _SPACE, _SPACE, _ODD).astype(np.uint8)
        self._take(by_pieces)
        if self.encode(_SAMPLE.encode()) != self.whole(_SAMPLE.encode()):
            raise ValueError("this tokenizer does not encode white-space-free pieces on their own")
        # Where its model alone gives the same ids for plain words, the normaliser and splitter need not run on them.
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda x: [(x, (0, 1))]
        self.letters = {c: split(c)[0][0] for c in _LATIN if c.islower()}
        marks = bytes(np.flatnonzero(_KIND == _MARK).tolist())
        plain = _WORDS.encode().split() + [f"x{c}y".encode() for c in _LATIN] + [_LATIN.encode(), marks] + [b"x" + marks[i : i + 1] + b"4" for i in range(len(marks))]
        self._take(_KIND)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        right = all(map(self.odd, added)) and self.encode_many(plain) == [self.whole(w) for w in plain]
        self._take(_KIND if right else by_pieces)

    def _take(self, kinds: np.ndarray) -> None:
        self.kinds, self.usual = kinds, bytes(np.flatnonzero((kinds != _SPACE) & (kinds != _ODD)).tolist())
        self.forget()

    def odd(self, word: bytes) -> bool:
        return bool(word.translate(None, self.usual))

    def forget(self) -> None:
        """Drop the remembered words; those met again are worked out again."""
        self.words, self.old = _Words(), _Words()

    def ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def whole(self, text: bytes) -> bytes:
        return np.array(self.ids(text), self.dtype).tobytes()

    def _learn(self) -> None:
        """Ids of the new words: of plain ones, whose letters are lower case, by the library's model alone."""
        words, old, tokenize = self.words, self.old, self.model.tokenize
        if not words.new:
            return
        texts = b" ".join(words.new).decode()
        for letter, split in () if texts.isascii() else self.letters.items():
            texts = texts.replace(letter, split)
        for word, text in zip(words.new, texts.split(" "), strict=True):
            k = old.get(word)
            if k is not None:
                ids = old.ids[old.ends[k] : old.ends[k + 1]]
            else:
                ids = self.ids(word) if self.odd(word) else [t.id for t in tokenize(text)]
            words.ids.extend(ids)
            words.ends.append(len(words.ids))
        words.new = []

    def _parted(self, data: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of whole pieces, and where each starts. Plain pieces are lower-cased and parted, the others are words as they are."""
        kind, low = self.kinds.take(data), _LOWER.take(data)
        start = np.empty(len(data), bool)
        start[0] = kind[0] != _SPACE
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        parts = _PARTS.take(pair)
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            spaces = np.concatenate([[-1], np.flatnonzero(kind == _SPACE), [len(data)]])
            piece = np.unique(np.searchsorted(spaces, odd))
            inside = np.zeros(len(data) + 1, np.int8)
            inside[spaces[piece - 1] + 1] += 1
            inside[spaces[piece]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            np.copyto(low, data, where=inside)
            parts &= ~inside[1:]
        start[1:] = parts | (pair - np.uint8(1) < 7)  # after white space
        there = kind != _SPACE
        low, first = low[there], np.flatnonzero(start[there])
        offsets = np.append(first, len(low)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
        return words.dictionary_encode(), np.flatnonzero(start)

    def _windows(self, data: np.ndarray):
        """Parts of about WINDOW bytes that end in white space, as data does."""
        a = b = 0
        while a < len(data):
            c = min(b + WINDOW, len(data))
            spaces = np.flatnonzero(self.kinds.take(data[b:c]) == _SPACE)
            if len(spaces):
                yield a, (a := b + int(spaces[-1]) + 1)
                b = a
            else:
                b = c

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        parts, cuts, n = [], [np.zeros(1, np.int64)], 0
        for a, b in self._windows(data):
            if len(self.words) >= self.most:
                self.old, self.words = self.words, _Words()
            words, starts = self._parted(data[a:b])
            distinct = words.dictionary.to_numpy(zero_copy_only=False)
            numbers = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct)).take(words.indices.to_numpy())
            try:
                self._learn()
            except Exception:
                self.forget()  # numbers without ids
                raise
            first = np.frombuffer(self.words.ends, np.int64)
            begin = first[numbers]
            upto = np.concatenate([[0], np.cumsum(first[numbers + 1] - begin)])
            at = np.repeat(begin - upto[:-1], np.diff(upto)) + np.arange(upto[-1])
            parts.append(np.frombuffer(self.words.ids, np.uint32)[at] if len(at) else np.zeros(0, np.uint32))
            here = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "right")]
            cuts.append(n + upto[np.searchsorted(starts, here - a)])
            n += int(upto[-1])
            del first
        packed = memoryview(np.concatenate(parts).astype(self.dtype).tobytes()) if parts else b""
        cuts = (np.concatenate(cuts) * self.dtype.itemsize).tolist()
        return [bytes(packed[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]


def encoder(definition: str, **options) -> TextEncoder:
    """One encoder per worker and definition."""
    key = (hash(definition), *sorted(options.items()))
    if key not in _encoders:
        _encoders[key] = TextEncoder(definition, **options)
    return _encoders[key]


def read_definition(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


class RankEncoder:
    """Ids of UTF-8 texts by a rank file of the tiktoken library; special tokens' strings are ordinary text."""

    def __init__(self, ranks: str, pattern: str, dtype: str = "<u2"):
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.dtype = np.dtype(dtype)

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(self.encoding.encode_ordinary(t.decode()), self.dtype).tobytes() for t in texts]


def rank_encoder(ranks: str, pattern: str) -> RankEncoder:
    key = (hash(ranks), pattern)
    if key not in _encoders:
        _encoders[key] = RankEncoder(ranks, pattern)
    return _encoders[key]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
