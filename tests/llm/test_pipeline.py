"""The pipeline's run() against a plain run of its five stages, and its stages on repeated and null ids."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lithotile.llm import common, minhash, mixing, packing, toxicity

WORDS = [f"w{i}" for i in range(300)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def table(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    foul = lambda n: " ".join(rng.choices(["vile1", "vile2", "vile3", *WORDS[:40]], [6, 6, 6, *[1] * 40], k=n))
    shared = [text(14) for _ in range(4)]
    docs = []
    for i in range(70):
        kind = i % 7
        if kind == 0:
            t = ". ".join(foul(8) for _ in range(4))
        elif kind == 1:
            t = "\n".join([text(30), rng.choice(shared), text(25)])
        elif kind == 2 and i > 10:
            t = docs[rng.randrange(1, len(docs))][1] or ""
        elif kind == 3 and i > 10:
            old = words(docs[rng.choice([k for k in range(len(docs)) if k % 7 in (4, 5)])][1])
            old = [*old[:-2], "new", "end"]
            t = "\n".join(" ".join(old[k : k + 7]) for k in range(0, len(old), 7))  # its lines are like no other's
        else:
            t = text(rng.choice([1, 3, 60, 90, 400]))
        docs.append((i, t, "en", None if i % 11 == 0 else f"s{min(i % 5, 2)}", len(t)))
    docs += [(70, None, None, "s0", None), (71, "", "en", None, 0), (72, " \n", "en", "s1", 2)]
    labels = [(d[0], 1, int(d[0] % 7 == 0)) for d in docs if d[0] % 3]
    return docs, labels


def without_later_lines(docs):
    seen, out = [], []
    for d in docs:
        left = []
        for line in d[1].split("\n") if d[1] is not None else []:
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
            if not (s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen)):
                left.append(line)
            if s:
                seen.append(s)
        text = None if d[1] is None else "\n".join(left)
        out.append((d[0], text, d[2], d[3], None if text is None else len(text)))
    return out


def groups(texts, percent=80):
    """The number of each text's group: shingles of five words, links of the similarity, reachable texts."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words((t or "").lower())) else frozenset() for t in texts]
    group = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return group


def without_near_copies(docs):
    group = groups([d[1] for d in docs])
    first = {}
    for g, d in sorted(zip(group, docs, strict=True), key=lambda x: x[1][0]):
        first.setdefault(g, d[0])
    return [d for g, d in zip(group, docs, strict=True) if first[g] == d[0]]


def mixed(spark, docs):
    """Copies of each document: Sainte-Lague seats of blocks of 16 words, then a run of the seeded order."""
    hashed = lambda *v: spark.range(1).select(F.xxhash64(*v)).first()[0]
    size = {d[0]: len(words(d[1])) for d in docs}
    names = sorted({d[3] for d in docs if d[3] is not None}) + [None] * any(d[3] is None for d in docs)
    total = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left, w = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    seats = collections.Counter()
    for _ in range(round(sum(target.values()) / 16)):
        seats[max(names, key=lambda s: target[s] / (2 * seats[s] + 1))] += 1
    out = []
    for s in names:
        n = total[s]
        if not n:
            continue
        want = min(seats[s] * 16, 3 * n)
        passes, rest = divmod(want, n)
        rest = int(rest / 16 + 0.5)
        begin = hashed(F.lit(19), F.lit(s or ""), F.lit(s is None), F.lit(0).cast("long")) % n
        end, at = begin + min(rest * 16, n), 0
        for d in sorted((d for d in docs if d[3] == s), key=lambda d: (hashed(F.lit(17), F.lit(d[0]).cast("long")), d[0])):
            copies = passes + (begin <= at < end) + (begin <= at + n < end) if size[d[0]] else 0
            out += [d] * copies
            at += size[d[0]]
    return out, {s: (target[s], sum(size[d[0]] for d in out if d[3] == s), max([0, *(size[d[0]] for d in docs if d[3] == s)])) for s in names}


def packed(spark, docs, buckets=16, budget=16384):
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = [len(library.encode(d[1] or "", add_special_tokens=False).ids) for d in docs]
    ends = packing.choose_boundaries(*map(list, zip(*sorted(collections.Counter(length).items()), strict=True)), buckets)
    order = {i: spark.range(1).select(F.xxhash64(F.lit(23), F.lit(i).cast("long"))).first()[0] for i in {d[0] for d in docs}}
    of = lambda n: next(k for k, e in enumerate(ends) if e >= n)
    out = []
    for bucket in range(len(ends)):
        rows = sorted((order[d[0]] % 1024, order[d[0]], d[0], d) for n, d in zip(length, docs, strict=True) if of(n) == bucket)
        room = max(1, budget // max(1, ends[bucket]))
        out += [(*d, bucket, ends[bucket], k // room, k % room) for k, (_, _, _, d) in enumerate(rows)]
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = table()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    weights, bias = toxicity.fit(*read)
    known = toxicity._Weights(weights)
    clean = [d for d in docs if toxicity.score_text(d[1] or "", known, bias)[0] < 0.5]
    assert {d[0] for d in docs} - {d[0] for d in clean} == {d[0] for d in docs if "vile" in (d[1] or "")}  # the toxic ones, and they alone
    lines = without_later_lines(clean)
    unlike = without_near_copies(lines)
    assert len(unlike) < len(lines) and sum(len(d[1] or "") for d in lines) < sum(len(d[1] or "") for d in clean)
    some, shares = mixed(spark, unlike)
    assert all(abs(got - target) <= most + 16 for target, got, most in shares.values())
    want = packed(spark, some)
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    places = lambda rows: sorted((r[0], *r[5:]) for r in rows)
    assert places(got) == places(want)
    assert sorted(got, key=str) == sorted(want, key=str)
    left = [p for p in common.written if spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) and "pipeline-" in p]
    assert len(left) >= 5 and not [p for p in common.written if "minhash-rows" in p]  # what a stage wrote for itself is gone


def test_near_copies_by_row(spark):
    rng = random.Random(4)
    a, b = (" ".join(rng.choices(WORDS, k=60)) for _ in range(2))
    rows = [(5, a, "x"), (5, a, "x"), (None, a, "y"), (7, a + " more", "z"), (None, b, "n"), (None, b, "n"), (9, b + " tail", "t"), (None, "one two", "q"), (None, "one  two", "q"), (1, "", "e"), (1, "", "e"), (None, None, "f"), (3, " ", "g")]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "doc_id long, text string, row string, nr long, id long, component_id long").repartition(4)
    got = minhash.drop_near_duplicates(df, percent=80)
    assert got.columns == df.columns
    kept = sorted([(r.doc_id, r.text) for r in got.collect()], key=str)
    assert [k for k in kept if k[1] != "one two" and k[1] != "one  two"] == sorted([(5, a), (9, b + " tail"), (1, ""), (1, ""), (None, None), (3, " ")], key=str) and len(kept) == 7


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_rows_follow_their_plan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, None, 50 + i]), " ".join(rng.choices(WORDS, k=rng.choice([0, 20, 50]))), rng.choice(["a", "b", None])) for i in range(80)]
    rows += [(6, "six words are in this row", "c")] * 40
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, nr long, row string").repartition(3)
    taken = collections.Counter()
    out = [tuple(r)[:3] for r in mixing.mix_documents(df).collect()]
    for r in out:
        taken[r[2]] += len(words(r[1]))
    plan = mixing.plan_mix(df)
    target = {r.source: r.target for r in plan_targets(plan, df).collect()}
    most = {s: max(len(words(r[1])) for r in rows if r[2] == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= most[s] + 16 for s in target)
    have, got = collections.Counter(rows), collections.Counter(out)
    assert all(got[r] <= 3 * have[r] for r in got)


def plan_targets(plan, df):
    """target by source: a source's rows share its size."""
    sizes = df.select("source", common.n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return plan.select("source_size", "target").distinct().join(sizes, "source_size").select("source", "target")
