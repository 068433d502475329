"""Search, conversation repair and BPE against brute force, with nulls, empties, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lithotile.llm import pair_index, queries, repair, tput

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
EXTRA = "n long, term string, c long, block long, ids binary, row long"


def ranked(items, docs, k=10):
    """Scores of every document for every item."""
    count = lambda t: collections.Counter(TERM.findall((t or "").translate(LOWER)))
    held = [(i, count(t)) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, collections.Counter()).update(count(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "İx", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: rng.choice([" ", ", ", "\n", "-", "\x00"]).join(rng.choices(words, weights, k=k))
    docs = [(i, text(rng.choice([0, 1, 3, 30, 200]))) for i in range(n)] + [(n, None), (n + 1, " .\t"), (None, text(40)), (None, text(40)), (5, text(9))]
    docs += [docs[3], docs[7], (n + 2, text(30_000))] + [(n + 3 + i, "w1 w2 rare") for i in range(14)]
    items = [(i, text(rng.choice([1, 5, 20]))) for i in range(25)] + [(None, "w3 W4 w4"), (90, None), (91, "absent words"), (92, "w1 w1 rare"), (93, ""), (3, "w5 É"), (0, "w9")]
    return [*items, items[2]], docs


@pytest.mark.parametrize("seed", [1])
def test_search(spark, seed):
    items, docs = corpus(seed, 300)
    d = spark.createDataFrame([(i, t, 1, "x", 1, 1, b"x", 1) for i, t in docs], f"doc_id long, text string, {EXTRA}").repartition(5)
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, q long, item long".replace("item long", "item string"))
    got = sorted(map(tuple, tput.search(b, d).collect()), key=str)
    assert got == ranked(items, docs)
    assert sorted(map(tuple, tput.search(b, d, k=2).collect()), key=str) == ranked(items, docs, 2)


@pytest.mark.parametrize(("slack", "item_bytes", "block_bytes"), [(1, 1 << 20, 3000), (9, 300, 1 << 20)])
def test_search_in_groups_and_blocks(spark, monkeypatch, slack, item_bytes, block_bytes):
    items, docs = corpus(3, 100)
    monkeypatch.setattr(tput, "BLOCK_BYTES", block_bytes)
    got = tput.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), slack=slack, item_bytes=item_bytes, k=4)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(items, docs, 4)


def test_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert tput.search(items, docs).count() == tput.search(items, some).count() == tput.search(some.toDF("item_id", "text"), docs).count() == 0


def test_count_terms_cuts_between_terms():
    text = " ".join(f"word{i % 97}" for i in range(3000)).encode()
    assert tput.count_terms(text, 50) == collections.Counter(text.split()) == tput.count_terms(text + b" " * 200, 7)


SPACES = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, repaired lines) by a plain dynamic programme over rows (role, text, fault) and grammar states, with strings."""
    nxt = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    far = (10**9, "~", ())
    ahead = None
    for role, text, fault in [(None, None, None), *reversed(rows)]:
        best = {}
        for q in range(4):
            if role is None:
                best[q] = (0, "", ()) if q in (0, 3) else far
                continue
            options = [(ahead[q][0] + 2, "D" + ahead[q][1], ahead[q][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                if keep is not None:
                    options.append((ahead[keep][0] + more, "K" + ahead[keep][1], (f"{role}:{text}", *ahead[keep][2])))
                to, new = nxt[q]
                options.append((ahead[to][0] + 1 + more, "R" + ahead[to][1], (f"{new}:{text}", *ahead[to][2])))
            best[q] = min(options)
        for _ in range(4):
            for q in range(4):
                to, new = nxt[q]
                best[q] = min(best[q], (best[to][0] + 5, "I" + best[to][1], (f"{new}:", *best[to][2])))
        ahead = best
    return ahead[0]


def expected(rows):
    """One row per conv_id, by the wording of the contract."""
    out, ids = [], {r[0] for r in rows}
    for conv in ids:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            do = zlib.crc32(key.encode()) % 20
            if do == 0:
                continue
            text = "" if do == 1 else re.sub("[.!?]", "", text) if do == 2 else text
            after += [(turn, "user" if do == 4 else role, text)] * (2 if do == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in after:
            end = text.rstrip(SPACES)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        bad = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = cheapest(marked)
        faults = collections.Counter(f for _, _, f in marked)
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umbrella", "Sys"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "end? ", "a:b\nc.", "x" * 2000 + ".", "ü."]
    rows = []
    for c in convs:
        size = rng.randint(1, most)
        for t in range(size):
            turn = rng.choice([None, t, t, t, t, t + 3])
            rows.append((c, turn, rng.choice(roles[:3] if rng.random() < 0.6 else roles), rng.choice(texts) if rng.random() < 0.5 else f"turn {rng.randint(0, 40)}."))
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def test_repair(spark):
    rows = talk(4, [*range(120), None], 9)
    df = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], COLUMNS + ", mark string, pos long, fault string").repartition(3)
    assert got(repair.repaired_digests(df)) == expected(rows)


def test_repair_of_conversations_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = talk(5, [1, 2, 3, None], 150)
    assert got(repair.repaired_digests(spark.createDataFrame(rows, COLUMNS).repartition(2))) == expected(rows)


def test_repair_of_dropped_and_empty(spark):
    gone = [(c, t, "user", "Hi.") for c in range(400) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert len(gone) > 3 and got(repair.repaired_digests(spark.createDataFrame(gone, COLUMNS))) == expected(gone)
    assert all(r[1:8] == (0, 0, 0, 0, 0, 0, "") for r in expected(gone))
    assert repair.repaired_digests(spark.createDataFrame([], COLUMNS)).count() == 0


def test_automaton_is_lazy_and_small():
    own = repair.Automaton()
    rng = random.Random(2)
    own.scan((0, repair.FAR, repair.FAR, repair.FAR), "uaua")
    assert len(own.table) < 5
    for _ in range(300):
        own.costs("".join(rng.choices("suaxSUAXd", k=rng.choice([3, 40, 900]))))
    assert len(own.vectors) < 200 and len(own.table) <= 9 * len(own.vectors)


def test_automaton_equals_brute_force():
    rng, own = random.Random(3), repair.Automaton()
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for n in range(1500):
        rows = "".join(rng.choices("suaxSUAXd", [1, 5, 5, 1, 1, 2, 2, 1, 2], k=rng.randint(0, 14)))
        cost, audit, _ = cheapest([(names.get(r.lower(), "user"), str(i), "blank" if r == "d" else "truncated" if r.isupper() else "") for i, r in enumerate(rows)])
        edits, out = own.trace(0, rows, repair.FINAL)
        assert ("".join(edits), own.costs(rows)[0][out]) == (audit, cost), (n, rows)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(pair_index.read_definition())


PARTS = ["a", "aa", "ab", " ", "  ", "\n", "\t", "'s", "'RE", "1", "½", "é", "漢", "<|endoftext|>", "<|", "\x1c", "\x85", " ", "՘", "\U0001f600", "!", "́", "the", "ing", "\x00", "Ġ", "�"]


def test_codec_equals_the_library(monkeypatch):
    rng, own, other = random.Random(7), pair_index.Codec(pair_index.read_definition(), most=500), library()
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 50))) for _ in range(1500)] + ["a" * n for n in range(40)] + ["ab" * 4000, " " * 3000 + "x", "x " * 9000]
    for step in (1 << 21, 20):
        monkeypatch.setattr(pair_index, "STEP", step)
        for a in range(0, len(texts), 200):
            ids = own.encode_many(texts[a : a + 200])
            want = [e.ids for e in other.encode_batch(texts[a : a + 200], add_special_tokens=False)]
            assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in ids] == want
            assert [own.decode(pair_index.np.frombuffer(x, "<u4")) for x in ids] == [other.decode(w, skip_special_tokens=False) for w in want]


def test_decode_of_broken_bytes():
    own, other = pair_index.Codec(pair_index.read_definition()), library()
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(pair_index.np.array(ids, "<u4")) == other.decode(ids, skip_special_tokens=False)


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="made"):
        pair_index.PairIndex(pair_index.np.arange(256), pair_index.np.array([256, 97]), pair_index.np.array([97, 98]), pair_index.np.array([257, 256]))


def test_bpe_query(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", *["".join(rng.choices(PARTS, k=30)) for _ in range(60)], "word " * 20000]
    rows = [(i if i % 9 else None, t, b"x", "x") for i, t in enumerate(texts)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, ids binary, id string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    other, want = library(), []
    for i, t, _, _ in rows:
        ids = other.encode(t or "", add_special_tokens=False).ids
        text = other.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = queries.QUERIES["op13_bpe"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = pair_index.decode(spark.createDataFrame([(1, None)], "id long, ids binary"))
    assert none.filter(F.col("text").isNull()).count() == 1 and pair_index.decode(pair_index.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
