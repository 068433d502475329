"""Secret scans with multipart credential linking (DataFrame functions only).

Strong spans are found by their pattern alone: assign, access and hex. Weak candidates (identifiers, bare secrets and
endpoints) are reported only where complementary parts lie in the same scope, which is a distance of SCOPE code points
from the end of one to the start of the next: an ident needs a secret, a weak secret needs an identifier or an endpoint, an endpoint needs both.
The interval join is two running extremes over the parts of a document, the furthest end of those that start before and the
nearest start of those after, so it makes no pairs and needs no cross join.

Defined results: null and empty texts have no span; rows that repeat a doc_id, or have none, are rows of their own; extra columns
are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: Code points between parts that belong together.
SCOPE = 256
# The patterns of each kind. Keywords are matched in either case of their ASCII letters.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(?:user_?name|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?i)(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""
STRONG = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
LINKED = (("ident", IDENT), ("weak", WEAK), ("endpoint", ENDPOINT))
KINDS = [k for k, _ in STRONG + LINKED]


#: Lengths of which sums run at once: arrays grow by one within such a part, so the work is a part's length for each match.
PART = 128


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often it is used, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(lengths: Column) -> Column:
    """The sums of an array of longs up to each element, in parts."""
    longs = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    grow = lambda a, x: F.concat(a, F.array(last(a) + x))
    parts = lambda whole: F.transform(F.sequence(F.lit(0), F.ceil(F.size(whole) / PART).cast("int") - 1), lambda k: F.aggregate(F.slice(whole, k * PART + 1, F.lit(PART)), longs, grow))
    upto = lambda own: F.aggregate(F.transform(own, last), longs, grow)
    lift = lambda own, sums: F.flatten(F.transform(own, lambda a, k: let(F.when(k > 0, F.get(sums, k - 1)).otherwise(F.lit(0).cast("long")), lambda off: F.transform(a, lambda x: x + off))))
    return let(lengths, lambda whole: F.when(F.size(whole) > 0, let(parts(whole), lambda own: let(upto(own), lambda sums: lift(own, sums)))).otherwise(longs))


def find(text: Column, kind: str, pattern: str) -> Column:
    """The leftmost, non-overlapping matches as array<struct<start,rank,end>>: what lies between matches gives their places."""
    rank, long = F.lit(KINDS.index(kind)), lambda c: F.length(c).cast("long")
    pair = lambda gaps, matches: F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(long(g).alias("gap"), long(m).alias("match")))
    both = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: pair(F.split(text, pattern, -1), matches))
    place = lambda x, end: F.struct((end - x["match"]).cast("int").alias("start"), rank.alias("rank"), end.cast("int").alias("end"))
    spans = let(both, lambda b: F.zip_with(b, running(F.transform(b, lambda x: x["gap"] + x["match"])), place))
    if kind == "assign":  # the base match comes first, its value's length is judged after
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        pairs = F.zip_with(spans, values, lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n")))
        spans = F.transform(F.filter(pairs, lambda p: p["n"] >= 6), lambda p: p["s"])
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scope: int = SCOPE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and found (the spans as structs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.monotonically_increasing_id().alias("mark"), F.col(id_col).alias("doc_id"), *[find(text, k, p).alias(k) for k, p in STRONG + LINKED])
    x = stash(x, "secrets-spans")  # every text is searched once
    parts = x.filter(F.size("ident") + F.size("weak") + F.size("endpoint") > 0)
    parts = parts.select("mark", F.explode(F.concat(*KINDS)).alias("s")).select("mark", "s.*")
    one = Window.partitionBy("mark")
    before, after = (one.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("start"), F.desc("start")))

    def kind(*names: str) -> Column:
        of = lambda c: F.when(F.col("rank").isin([KINDS.index(n) for n in names]), F.col(c))
        reach, next_ = F.max(of("end")).over(before), F.min(of("start")).over(after)
        return F.coalesce(reach >= F.col("start") - scope, F.lit(False)) | F.coalesce(next_ <= F.col("end") + scope, F.lit(False))

    parts = parts.withColumn("has_id", kind("access", "ident")).withColumn("has_secret", kind("assign", "hex", "weak")).withColumn("has_end", kind("endpoint"))
    is_ = lambda name: F.col("rank") == KINDS.index(name)
    linked = parts.filter((is_("ident") & F.col("has_secret")) | (is_("weak") & (F.col("has_id") | F.col("has_end"))) | (is_("endpoint") & F.col("has_id") & F.col("has_secret")))
    linked = linked.groupBy("mark").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    a, b = x.alias("a"), linked.alias("b")
    both = a.join(b, F.col("a.mark") == F.col("b.mark"), "left")
    base = F.concat("assign", "access", "hex")
    found = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    return both.select(
        F.col("a.doc_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(found).alias("spans"), found.alias("found"),
    )
