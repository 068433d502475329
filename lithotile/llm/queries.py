"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import exact_dedup, line_dedup, minhash, mixing, packing, pair_index, pivot_index, range_coder, repair, secrets, separator_scan, toxicity, tput
from .common import documents


def _op1(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken")


def _op2(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def _op3(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, d))


def _op4(spark: SparkSession, d: str) -> DataFrame:
    return pivot_index.near_vectors(spark.read.parquet(f"{d}/embeddings.parquet"))


def _op5(spark: SparkSession, d: str) -> DataFrame:
    return separator_scan.count_tokens(documents(spark, d))


def _op6(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, d)).drop("found")


def _op7(spark: SparkSession, d: str) -> DataFrame:
    return packing.plan_batches(documents(spark, d))


def _op8(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, d), percent=85)


def _op9(spark: SparkSession, d: str) -> DataFrame:
    return range_coder.round_trip(documents(spark, d))


def _op10(spark: SparkSession, d: str) -> DataFrame:
    x = line_dedup.dedup_lines(documents(spark, d))
    return x.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def _op11(spark: SparkSession, d: str) -> DataFrame:
    return tput.search(spark.read.parquet(f"{d}/benchmark.parquet"), documents(spark, d))


def _op12(spark: SparkSession, d: str) -> DataFrame:
    return repair.repaired_digests(spark.read.parquet(f"{d}/conversations.parquet"))


def _op13(spark: SparkSession, d: str) -> DataFrame:
    x = pair_index.decode(pair_index.encode(documents(spark, d)))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return x.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("text").alias("decoded_sha256"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(ship(spark), d)


QUERIES = {
    name: _shipped(f)
    for name, f in {
        "op1_mixing": _op1, "op2_toxicity": _op2, "op3_exact_dedup": _op3, "op4_embedding_dedup": _op4, "op5_token_counts": _op5,
        "op6_secrets": _op6, "op7_packing": _op7, "op8_minhash": _op8, "op9_token_ids": _op9, "op10_line_dedup": _op10,
        "op11_tput": _op11, "op12_repair": _op12, "op13_bpe": _op13,
    }.items()
}

_WS = r"[\x20\x09-\x0D]+"
_COMPONENTS = """
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT id AS node, id AS other FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
    comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
"""

ORACLES = {
    "op3_exact_dedup": rf"""
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents)
    """,
    "op4_embedding_dedup": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
        good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
                 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
                  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
        {_COMPONENTS}
        SELECT id AS vec_id, (SELECT count(*) FROM edges WHERE a = id) AS n_links, component_id, id = component_id AS kept
        FROM nodes JOIN comp ON node = id
    """,
    "op8_minhash": rf"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        nodes AS (SELECT doc_id AS id, len(s) AS n FROM shingles),
        each AS (SELECT doc_id, unnest(s) AS g FROM shingles),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM each x JOIN each y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
        {_COMPONENTS}
        SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN comp ON node = id
    """,
    "op11_tput": r"""
        WITH counted AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM (
                 SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                 FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)) GROUP BY row, term),
        sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, total GROUP BY term, docs),
        asked AS (SELECT item_id, term, count(*) AS q FROM (
                 SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                 FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
        scored AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
                   FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (row), total GROUP BY item_id, row),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
