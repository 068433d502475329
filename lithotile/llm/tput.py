"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

The postings of all terms that any item asks for are written as blocks: a batch of documents, inverted, so that a term's list
is one run of its block and sums over lists meet without a shuffle. Between the phases only bounds travel.
1: heads of the lists give partial sums; the documents with the best ones are looked up, and the k-th best exact score over
all blocks is an item's lower bound. 2: each list gives every entry of at least bound / (slack * lists); a document's sum is at
most what was given plus the least of the threshold and the list's head for each list that did not give it. 3: documents that
may reach the bound are looked up in all lists, and the k best of these are the answer.

Contributions of a term are whole numbers, weight * ((10^9 * tf) div (1000 * tf + 8 * m)), so sums are exact.

Items are taken in groups of at most ITEM_BYTES of text, whose terms go to every task; any number of groups gives the same rows.

Defined results: null and empty texts have no term and are never found, nor counted in N; rows that repeat a doc_id are
documents of their own, a null doc_id is ranked after others of its score; items that share an item_id are one item, whose
terms are those of its different texts together; a null item_id is an item; an item without terms, or whose terms no document
holds, has no row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, slices, stash, text_bytes

#: Bytes of terms: digits, letters (A-Z lower-cased) and all of other scripts; every other byte parts them.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text in a group of items.
ITEM_BYTES = 16 << 20
#: Bytes of text in a block of documents, but that a document is never cut.
BLOCK_BYTES = 8 << 20
#: How far below bound / lists the threshold lies: lower ones give more entries and leave fewer candidates.
SLACK = 4
BLOCKS = "ids array<long>, n array<long>, term array<int>, df array<int>, at array<int>, tf array<long>"


def count_terms(text: bytes, piece: int = 1 << 20) -> Counter:
    """Occurrences of each term of a text; a long text is cut between terms."""
    text, out, at = text.translate(_TERM), Counter(), 0
    while len(text) - at > piece:
        end = text.find(b" ", at + piece)
        if end < 0:
            break
        out.update(text[at:end].split())
        at = end
    out.update(text[at:].split())
    return out


def _invert(vocabulary):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block: its documents' ids and numbers of terms; for each term its documents' places and occurrences."""
        known = vocabulary.value.get
        for whole in batches:
            for batch in slices(whole, size=BLOCK_BYTES):
                ns, terms, at, tfs = [], [], [], []
                for k, t in enumerate(text_bytes(batch.column("text"))):
                    got = count_terms(t)
                    ns.append(got.total())
                    for w, tf in got.items():
                        i = known(w)
                        if i is not None:
                            terms.append(i)
                            at.append(k)
                            tfs.append(tf)
                terms, at, tfs = np.array(terms, np.int32), np.array(at, np.int32), np.array(tfs, np.int64)
                order = np.argsort(terms, kind="stable")
                found, df = np.unique(terms, return_counts=True)
                row = (batch.column("id").to_pylist(), ns, found, df.astype(np.int32), at[order], tfs[order])
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(k)) for x, k in zip(row, kinds, strict=True)], names=["ids", "n", "term", "df", "at", "tf"])

    return run


class Block:
    """The lists of a block, each in order of contribution downwards."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, n = row["ids"], np.asarray(row["n"].values)
        m = 25 + (75 * n * n_docs) // max(1, n_terms)
        term, df = np.asarray(row["term"].values), np.asarray(row["df"].values)
        at, tf = np.asarray(row["at"].values), np.asarray(row["tf"].values)
        of = np.repeat(term, df)
        c = weights[of] * ((10**9 * tf) // (1000 * tf + 8 * m[at]))
        order = np.lexsort((-c, of))
        self.at, self.c, self.docs = at[order], c[order], len(n)
        first = np.cumsum(df) - df
        self.lists = dict(zip(term.tolist(), zip(first.tolist(), (first + df).tolist(), strict=True), strict=True))

    def given(self, terms: list[tuple[int, int]], head: int | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of an item's lists: places, values, and the list of each. head: so many from each; least: those of at least that value."""
        at, value, which = [], [], []
        for k, (t, q) in enumerate(terms):
            if t in self.lists:
                a, b = self.lists[t]
                if head is not None:
                    b = min(b, a + head)
                if least > 0:
                    b = a + int(np.searchsorted(-self.c[a:b], -(-(-least // q)), side="right"))
                if b > a:
                    at.append(self.at[a:b])
                    value.append(q * self.c[a:b])
                    which.append(np.full(b - a, k))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(value), np.concatenate(which)

    def sums(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact sums of each document: in two parts, which doubles hold."""
        high, low = value >> 24, value & 0xFFFFFF
        return (np.bincount(at, high, self.docs).astype(np.int64) << 24) + np.bincount(at, low, self.docs).astype(np.int64)

    def exact(self, terms: list[tuple[int, int]], docs: np.ndarray) -> np.ndarray:
        """Scores of some documents, looked up in all lists."""
        want = np.zeros(self.docs, bool)
        want[docs] = True
        at, value, _ = self.given(terms)
        some = want[at]
        return self.sums(at[some], value[some])[docs]


def _blocks(batches: Iterator[pa.RecordBatch], shared: dict) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block({c: batch.column(c)[k] for c in batch.schema.names}, shared["weights"], shared["n_docs"], shared["n_terms"])


def _heads(payload, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best exact scores of a task's blocks for each item, of documents that list heads lead to."""
        shared, best = payload.value, {}
        for block in _blocks(batches, shared):
            for item, terms in shared["items"].items():
                at, value, _ = block.given(terms, head=k)
                if len(at):
                    partial = block.sums(at, value)
                    docs = np.unique(at)
                    docs = docs[np.argsort(-partial[docs], kind="stable")[:k]]
                    best[item] = sorted([*best.get(item, ()), *block.exact(terms, docs).tolist()], reverse=True)[:k]
        rows = [(i, s) for i, scores in best.items() for s in scores]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.int64())], names=["item", "score"])

    return run


def _answers(payload, k: int, slack: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that reach an item's bound, with their exact scores."""
        shared = payload.value
        for block in _blocks(batches, shared):
            items, ids, scores = [], [], []
            for item, terms in shared["items"].items():
                bound = max(1, shared["bounds"].get(item, 1))
                least = max(1, -(-bound // (slack * len(terms))))
                at, value, which = block.given(terms, least=least)
                if not len(at):
                    continue
                top = np.array([q * int(block.c[block.lists[t][0]]) if t in block.lists else 0 for t, q in terms])
                missed = np.minimum(top, least - 1)
                upper = block.sums(at, value) + int(missed.sum()) - block.sums(at, missed[which])
                docs = np.unique(at)
                docs = docs[upper[docs] >= bound]
                score = block.exact(terms, docs)
                some = score >= bound
                items += [item] * int(some.sum())
                ids.append(docs[some])
                scores.append(score[some])
            if items:
                names = block.ids.values.take(pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), names, pa.array(np.concatenate(scores), pa.int64())], names=["item", "doc_id", "score"])

    return run


def _group(items: list[tuple], texts: DataFrame, k: int, slack: int) -> DataFrame:
    """item_id, rank, doc_id and score for a group of items (item_id, text)."""
    spark = texts.sparkSession
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(count_terms(text))
    names = list(asked)
    vocabulary: dict[bytes, int] = {}
    for terms in asked.values():
        for t in terms:
            vocabulary.setdefault(t, len(vocabulary))
    blocks = stash(texts.mapInArrow(lean(_invert(spark.sparkContext.broadcast(vocabulary))), BLOCKS), "tput-blocks")
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    n_docs, n_terms = blocks.agg(F.sum(F.size(F.filter("n", lambda x: x > 0))), F.sum(sum_of("n"))).first()
    n_docs, n_terms = int(n_docs or 0), int(n_terms or 0)
    df = np.zeros(len(vocabulary), np.int64)  # of the group's terms
    each = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    for r in each.toLocalIterator():
        df[r.term] = r.df
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    lists = {n: [(vocabulary[t], q) for t, q in asked[i].items() if df[vocabulary[t]]] for n, i in enumerate(names)}
    shared = {"items": {n: terms for n, terms in lists.items() if terms}, "weights": weights, "n_docs": n_docs, "n_terms": n_terms, "bounds": {}}
    # 1
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    found = blocks.mapInArrow(lean(_heads(spark.sparkContext.broadcast(shared), k)), "item long, score long")
    kth = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == k)
    shared = shared | {"bounds": {r.item: r.score for r in kth.toLocalIterator()}}
    # 2 and 3
    scores = blocks.mapInArrow(lean(_answers(spark.sparkContext.broadcast(shared), k, slack)), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")  # of the group
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, *, k: int = 10, slack: int = SLACK, item_bytes: int = ITEM_BYTES, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item with a score above 0, by score and then doc_id."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    groups = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    rows = stash(rows.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups))), "tput-items")
    out = None
    for g in range(groups):
        group = [(r.item_id, r.text.encode()) for r in rows.filter(F.col("group") == g).select("item_id", "text").orderBy(F.asc_nulls_last("item_id"), "text").toLocalIterator()]
        if group:
            part = _group(group, texts, k, slack)
            part = stash(part, "tput-group") if groups > 1 else part
            out = part if out is None else out.union(part)
    return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
