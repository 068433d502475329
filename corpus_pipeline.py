"""A corpus pipeline of five stages: toxicity, line dedup, near-document dedup, mixing and packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithotile.llm import common, line_dedup, minhash, mixing, packing, toxicity
from lithotile.llm.common import documents, stash
from lithotile.session import ship


_held: list[str] = []


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what earlier stages have written for themselves, but what its docs are still read from."""

    @functools.wraps(run)
    def held(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _held, docs)
        _held[:] = [p for p in _held if p in common.written]
        before = set(common.written)
        out = run(spark, docs, sf_dir)
        _held.extend(p for p in common.written if p not in before)
        return out

    return held


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, each by its own text; null and empty texts score 0 and stay, as do repeated rows. An empty table stays empty."""
    return toxicity.drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that earlier lines match; a null text stays null, an empty one empty, repeated rows stay. An empty table stays empty."""
    return line_dedup.drop_near_lines(docs)


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id (null last), of each group of near-duplicates; texts without words all stay. An empty table stays empty."""
    return minhash.drop_near_duplicates(docs, percent=80)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, some of them repeated and some left out, so that sources come near their target shares; a null source is one, texts without words go. An empty table stays empty."""
    return mixing.mix_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their length bucket, batch and slot; null and empty texts have length 0, repeated rows places of their own. An empty table stays empty."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("mixing", mix_sources), ("packing", pack)]

#: A trained classifier and an optimal partition have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written and read again before the next."""
    docs = documents(ship(spark), sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
