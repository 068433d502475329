"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Equal blocks of words go to the sources by highest quotients target / (2 seats + 1), then each source's blocks go to its
shards in the same way. Within a shard rows lie in a seeded order and its blocks have seeded ranks, a permutation of their
numbers; the blocks of the first ranks are chosen, as many as the quota leaves after whole passes. A divisor method's first seats can be
given at once: seats of round(weight * (N - n) / total) are a prefix of the quotient order, round(weight * (N + n) / total)
covers all N seats, so at most 3 n quotients are ever ranked, whatever the number of blocks.

Defined results: null text has size 0 and takes nothing; a null source is a source of its own, ranked last; repeated rows
are laid out as rows of their own; the last block of a shard may be short and has the last rank; an empty table gives an empty mix; extra columns are ignored or, in `mix_documents`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_join, n_words, stash

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def sainte_lague(parts: DataFrame, group: list[str], part: list[str], weight: str, seats: str) -> DataFrame:
    """parts with column quota: the seats of each group shared among its parts by highest quotients."""
    all_ = Window.partitionBy(*group)
    total, n = F.sum(weight).over(all_), F.count(F.lit(1)).over(all_)
    near = lambda sign: F.floor(F.greatest(F.lit(0.0), F.col(weight) * F.greatest(F.lit(0), F.col(seats) + sign * n) / total) + 0.5)
    x = parts.withColumn("_lo", F.when(total > 0, near(-1)).otherwise(0).cast("long")).withColumn("_hi", F.when(total > 0, near(1)).otherwise(0).cast("long"))
    x = x.withColumn("_left", F.col(seats) - F.sum("_lo").over(all_))
    tries = x.filter("_hi > _lo").select(*group, *part, weight, "_left", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_k"))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), *[F.asc_nulls_last(p) for p in part], F.asc("_k"))
    won = tries.withColumn("_r", F.row_number().over(best)).filter("_r <= _left").groupBy(*group, *part).agg(F.count(F.lit(1)).alias("_more"))
    keys = [*group, *part]
    a, b = x.alias("a"), won.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left").select("a.*", F.col("b._more").alias("_more")).withColumn("quota", F.col("_lo") + F.coalesce("_more", F.lit(0))).drop("_lo", "_hi", "_left", "_more")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """sizes (src, source_size) with weight and target: shares by weight, none above cap times its size.

    One row per source, ranked in one window: the table of sources is the plan of the mix, not a corpus table.
    """
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.asc_nulls_last("src"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * cap).cast("double")).withColumn("full_at", F.col("limit") / F.col("weight"))
    before = one.orderBy("full_at", F.asc_nulls_last("src")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(one)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    place = F.row_number().over(one.orderBy("full_at", F.asc_nulls_last("src")))
    x = x.withColumn("level", level).withColumn("place", place)
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(one)["level"])
    return x.withColumn("target", F.when(F.col("level") * F.col("weight") >= F.col("limit"), F.col("limit")).otherwise(F.col("level") * F.col("weight"))).select("src", "source_size", "target")


#: Primes near 2^31. A prime above the number of blocks has no factor in common with it, so that
#: rank = number * prime + offset, modulo the number of blocks, is a permutation.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def _block_rank(number: Column, blocks: Column, prime: Column, offset: Column) -> Column:
    """The seeded rank of a block among its shard's blocks, fewer than 2^31; the last block, which may be short, comes last."""
    others = F.greatest(F.lit(1), blocks - 1)
    return F.when(number < blocks - 1, (number * (prime % others) + offset) % others).otherwise(blocks - 1)


def _seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 17, block: int = 16, shard_words: int = 1 << 16, max_shards: int = 4096, cap: int = 3, row_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (0 to cap: for a mix of whole documents).

    block: words in a block; shard_words: words for which a source gets another shard, up to max_shards; row_col: a number of
    each row, which then comes with its plan as the column row and orders rows that are equal otherwise.
    """
    row = [] if row_col is None else ["row"]
    sized = stash(docs.select(*[F.col(row_col).alias(r) for r in row], F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("src"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    sources = source_targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), cap=cap)
    one = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("blocks", F.round(F.sum("target").over(one) / block).cast("long")).withColumn("one", F.lit(0))
    sources = sainte_lague(sources, ["one"], ["src"], "target", "blocks").select(
        "src", F.coalesce("src", F.lit("")).alias("src_key"), F.col("src").isNull().alias("src_null"), "source_size", "target", F.col("quota").alias("seats"),
        F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long").alias("shards"),
    )
    sources = stash(sources, "mix-sources")
    keyed = sized.select(*row, "doc_id", "size", F.coalesce("src", F.lit("")).alias("src_key"), F.col("src").isNull().alias("src_null"))
    keyed = bounded_join(keyed, sources.drop("src"), ["src_key", "src_null"])
    keyed = keyed.withColumn("order", _seeded(seed, F.col("doc_id"))).withColumn("shard", F.pmod(_seeded(seed + 1, F.col("doc_id")), F.col("shards")))
    shard = ["src_key", "src_null", "shard"]
    parts = keyed.groupBy(*shard).agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    quotas = stash(sainte_lague(parts, ["src_key", "src_null"], ["shard"], "words", "seats").select(*shard, "words", "quota"), "mix-quotas")
    laid = bounded_join(keyed, quotas, shard)
    along = Window.partitionBy(*shard).orderBy("order", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.withColumn("start", F.sum("size").over(along) - F.col("size"))
    blocks, some, size = F.col("blocks"), F.col("words") > 0, F.col("size")
    laid = laid.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("long"))
    want = F.least(F.col("quota") * block, F.col("words") * cap)
    laid = laid.withColumn("passes", F.when(some, F.floor(want / F.col("words"))).otherwise(0).cast("long"))
    laid = laid.withColumn("rest", F.when(some, F.round((want - F.col("passes") * F.col("words")) / block)).otherwise(0).cast("long"))
    chance = lambda k: _seeded(seed + k, *[F.col(c) for c in shard])
    laid = laid.withColumn("prime", F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (F.pmod(chance(3), F.lit(len(PRIMES))) + 1).cast("int")))
    laid = laid.withColumn("offset", F.pmod(chance(4), F.greatest(F.lit(1), blocks - 1))).withColumn("end", F.col("start") + size)
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long")
    words_in = lambda k: F.least(F.col("end"), (k + 1) * block) - F.greatest(F.col("start"), k * block)
    chosen = lambda k: _block_rank(k, blocks, F.col("prime"), F.col("offset")) < F.col("rest")
    taken = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda n, k: n + F.when(chosen(k), words_in(k)).otherwise(F.lit(0).cast("long")))
    # Whole documents: those whose first word lies in one run of as many words, from a seeded place of the seeded order; it may wrap round.
    run_from = F.when(some, F.pmod(chance(2), F.when(some, F.col("words")))).otherwise(0)
    laid = laid.withColumn("from", run_from).withColumn("to", F.col("from") + F.least(F.col("rest") * block, F.col("words")))
    hit = lambda shift: ((F.col("start") + shift >= F.col("from")) & (F.col("start") + shift < F.col("to"))).cast("long")
    return laid.select(
        *row, "doc_id", "size", "source_size", "target", F.when((size > 0) & (F.col("rest") > 0), F.col("passes") * size + taken).otherwise(F.col("passes") * size).cast("long").alias("taken"),
        F.when(size > 0, F.col("passes") + hit(F.lit(0)) + hit(F.col("words"))).otherwise(0).cast("long").alias("copies"),
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed table itself: whole documents, each row as often as the seeded choice takes it, in the columns of docs.

    Rows are planned one by one, so rows that repeat a doc_id or have none are taken each as often as its own plan says.
    """
    rows = stash(docs.select(F.monotonically_increasing_id().alias("nr"), F.struct("*").alias("row")), "mix-rows")
    names = [id_col, options.get("text_col", "text"), options.get("source_col", "source")]
    flat = rows.select("nr", *[F.col("row")[c].alias(f"_{k}") for k, c in enumerate(names)])
    plan = plan_mix(flat, "_0", **options | {"text_col": "_1", "source_col": "_2", "row_col": "nr"}).filter("copies > 0").select(F.col("row").alias("nr"), "copies")
    joined = rows.select("nr", "row").join(plan, "nr")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
