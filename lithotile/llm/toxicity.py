"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in hashed words and word beginnings; noisy-or,
1 - prod(1 - p), makes the document's score, and only documents carry labels in training. Scoring finds the sentences
that reach one half.

Defined results: null and empty texts have no sentence and score 0; labels that are null are skipped, a doc_id with
several labels is toxic if one of them is; rows that repeat a doc_id are scored each by its own text; without any
training row every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import collections
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

SENTENCE = re.compile(r"[^.!?\n]+")
DIMENSIONS = 1 << 20
PREFIXES = (4, 5, 6)
_STRIP = "\"'`,;:()[]{}<>*_-|/\\"
SCORE = "doc_id long, score double, offending array<struct<start:int,end:int,p:double>>"


def features(word: str) -> list[int]:
    """Hashed features of one word: itself and its beginnings."""
    w = word.strip(_STRIP)
    if not w:
        return []
    return [zlib.crc32(b"w" + w.encode()) % DIMENSIONS, *(zlib.crc32(b"p" + w[:k].encode()) % DIMENSIONS for k in PREFIXES if len(w) > k)]


def train(texts: list[str], toxic: list[int], rounds: int = 400, rate: float = 0.15, l2: float = 1e-4, min_docs: int = 3, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood of the documents' labels."""
    weights = np.zeros(DIMENSIONS, np.float32)
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return weights, -np.inf if not y.any() else 0.0
    vocabulary: dict[str, int] = {}
    ids, sentence_ends, doc_ends, in_docs = array("i"), array("q"), array("q"), collections.Counter()
    for t in texts:
        all_ = set()
        for m in SENTENCE.finditer(t.lower()):
            own = {vocabulary.setdefault(w, len(vocabulary)) for w in m[0].split()}
            if own:
                ids.extend(own)
                sentence_ends.append(len(ids))
                all_ |= own
        in_docs.update(all_)
        doc_ends.append(len(sentence_ends))
    ids_, ends, docs = np.frombuffer(ids, np.int32), np.array(sentence_ends), np.array(doc_ends)
    n_sent = np.diff(docs, prepend=0)
    sent_of, doc_of = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0)), np.repeat(np.arange(len(docs)), n_sent)
    feats = [features(w) for w in vocabulary]
    word_of, feat = np.repeat(np.arange(len(feats)), [len(f) for f in feats]), np.array([f for x in feats for f in x], np.int32)
    docs_with = np.array([in_docs[k] for k in range(len(vocabulary))])
    often = np.bincount(feat, weights=docs_with[word_of], minlength=DIMENSIONS) >= min_docs
    feat_live = often[feat]
    word_of, feat = word_of[feat_live], feat[feat_live]
    used, feat = np.unique(feat, return_inverse=True)
    share = y.mean()
    prior = share if prior is None else prior
    importance = np.where(y, prior / share, (1 - prior) / (1 - share))
    w, bias = np.zeros(len(used)), -np.log(max(2.0, n_sent.mean() / max(prior, 1e-3)))
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        word_weight = np.bincount(word_of, weights=w[feat], minlength=len(vocabulary))
        z = np.bincount(sent_of, weights=word_weight[ids_], minlength=len(ends)) + bias
        total = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(docs))
        pull = np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) * importance / len(docs)
        dz = pull[doc_of] / (1 + np.exp(-np.clip(z, -60, 60)))
        back = np.bincount(ids_, weights=dz[sent_of], minlength=len(vocabulary))
        g = np.bincount(feat, weights=back[word_of], minlength=len(used)) + l2 * w
        gb = dz.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        bias -= rate * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-8)
    weights[used] = w
    return weights, float(bias)


class _Weights(dict):
    """Weight of a raw word, worked out once; forgets all when it holds too many."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = float(sum(self.weights[f] for f in features(word)))
        return x


def score_text(text: str, known: dict, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or score and the offending sentences."""
    look, spans, zs = known.__getitem__, [], []
    for m in SENTENCE.finditer(text):  # lower case may be longer, so places are those of the text itself
        words = m[0].lower().split()
        if words:
            zs.append(sum(map(look, set(words))))
            spans.append(m.span())
    if not zs:
        return 0.0, []
    z = np.array(zs) + bias
    score = float(-np.expm1(-np.logaddexp(0, z).sum()))
    hot = np.flatnonzero(z >= 0)
    return score, [(*spans[i], float(1 / (1 + np.exp(-z[i])))) for i in hot]


def _scorer(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(weights)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for whole in batches:
            for batch in slices(whole):
                out = [score_text(t or "", known, bias) for t in batch.column("text").to_pylist()]
                spans = [[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in out]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    return run


def held_out(doc_id):  # noqa: ANN001, ANN201
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, per_class: int = 4000, max_chars: int = 16_000, max_rows: int = 16_000) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample: per_class labelled rows of each class at most, by hash, with texts of max_chars at most, and of rows that repeat such ids max_rows."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    pick = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).union(pick(1))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(max_rows).toPandas()  # of 2 * per_class ids
    rows = rows.sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["toxic"].tolist(), prior=share)


def score_documents(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_scorer(weights, bias)), SCORE)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted and offending (the sentences that reach one half, as code-point spans)."""
    scored = score_documents(docs, *fit(docs, labels, id_col, text_col, **options), id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def _keeper(weights: np.ndarray, bias: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(weights)
        for whole in batches:
            for batch in slices(whole, text_col):
                clean = [score_text(t or "", known, bias)[0] < 0.5 for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that score one half or more. Each row goes by its own text, whatever its doc_id."""
    return docs.mapInArrow(lean(_keeper(*fit(docs, labels, id_col, text_col, **options), text_col)), docs.schema)
