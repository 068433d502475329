"""Conversation structure repair by a lazily determinised weighted automaton.

The grammar of role initials is (s?(ua)+)? with four states. What a row costs in each state depends on its symbol alone (its
role's class and its fault), so a vector of four costs, less its minimum, is a state of a deterministic automaton; states
and arcs are made when a row first asks for them and kept in a table. A scan of that table gives costs. A backward trace
over tight arcs marks the grammar states that lie on a cheapest path; a walk over marked states that takes the least letter
each time is the audit.

Rows are sorted over all partitions by (conversation, turn, role, text), and a conversation's rows are scanned in blocks of at
most BLOCK rows: a block is a table of costs from each entry state to each exit state. The blocks of a conversation are
chained by these small tables, then each is traced on its own. Only a conversation's repaired text, whose one hash is asked
for, passes through one task: as a stream of chunks of a block or a megabyte, since SHA-256 has no parallel form.

Defined results: null roles and texts are one space, as are nulls in the key of the damage; a null conv_id is a conversation;
a null turn comes first; rows of one turn are ordered by role, the first 1024 characters of text and the text's hash;
repeated rows are rows; an initial is a role's first character, an empty role has none and fits nowhere; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

SPACE = " \t\n\x0b\f\r"
#: Rows of a block, as a power of two.
BLOCK_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. Conversations end in 0 or 3.
USER_OR_ASSISTANT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
FINAL = tuple(0 if q in ENDS else FAR for q in range(4))


def symbol(initial: Column, fault: Column) -> Column:
    """One letter for what decides a row's costs: s, u, a or x for another role, upper case if truncated; d if it must go."""
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(kind)).otherwise(kind)


def arcs(row: str, q: int) -> list[tuple[str, int, int]]:
    """(letter, next grammar state, cost) of the edits of a row in state q, in order of letters."""
    out = [("D", q, DELETE)]
    if row != "d":
        more = TRUNCATED if row.isupper() else 0
        if (q, row.lower()) in FITS:
            out.append(("K", FITS[q, row.lower()], KEEP + more))
        out.append(("R", USER_OR_ASSISTANT[q][0], REROLE + more))
    return out


def _inserted(costs: list[int]) -> list[int]:
    """Costs after any number of insertions."""
    for _ in range(4):
        for q, (to, _role) in USER_OR_ASSISTANT.items():
            costs[to] = min(costs[to], costs[q] + INSERT)
    return costs


class Automaton:
    """The deterministic automaton, as far as rows have asked for it. States are numbers of normalised cost vectors.

    A vector holds the cost of each grammar state after any insertions that follow the row.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.back: dict[tuple[int, str, int], int] = {}

    def state(self, costs: list[int]) -> tuple[int, int]:
        """Number and subtracted minimum of a vector, without grammar states that no cheapest path visits, so that vectors are few.

        What state 1 can do, state 3 can at the same cost, and what state 0 can at 2 more, since it deletes the s that 0 keeps.
        """
        c0, c1, _, c3 = costs
        least = min(costs)
        vector = tuple(FAR if c >= FAR or (q == 0 and c0 > c3 + DELETE) or (q == 1 and c1 > c3) else c - least for q, c in enumerate(costs))
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def enter(self, costs: tuple[int, ...]) -> tuple[int, int]:
        return self.state(_inserted(list(costs)))

    def step(self, state: int, row: str) -> tuple[int, int]:
        got = self.table.get((state, row))
        if got is None:
            new = [FAR] * 4
            for q, c in enumerate(self.vectors[state]):
                for _, to, cost in arcs(row, q):
                    new[to] = min(new[to], c + cost)
            got = self.table[state, row] = self.state(_inserted(new))
        return got

    def scan(self, costs: tuple[int, ...], rows: str) -> tuple[list[int], int]:
        """Numbers of the states before each row and after the last, and the cost taken out of them."""
        state, total = self.enter(costs)
        states, table = [state], self.table
        for row in rows:
            got = table.get((state, row)) or self.step(state, row)
            state = got[0]
            total += got[1]
            states.append(state)
        return states, total

    def costs(self, rows: str) -> list[list[int]]:
        """From each grammar state (before insertions) to each one after the rows and insertions."""
        out = []
        for q in range(4):
            states, total = self.scan(tuple(0 if p == q else FAR for p in range(4)), rows)
            out.append([min(FAR, c + total) for c in self.vectors[states[-1]]])
        return out

    def tight_inserts(self, state: int, marked: int) -> int:
        """Marked grammar states and those from which a tight insertion leads to one."""
        v = self.vectors[state]
        for _ in range(4):
            for q, (to, _role) in USER_OR_ASSISTANT.items():
                if marked >> to & 1 and v[q] < FAR and v[to] == v[q] + INSERT:
                    marked |= 1 << q
        return marked

    def before(self, state: int, row: str, marked: int) -> int:
        """The grammar states of a state that have a tight arc of the row to marked ones, with those that insert to get there."""
        got = self.back.get((state, row, marked))
        if got is None:
            after, less = self.step(state, row)
            v, w = self.vectors[state], self.vectors[after]
            got = sum(1 << q for q in range(4) if v[q] < FAR and any(marked >> to & 1 and v[q] + cost == w[to] + less for _, to, cost in arcs(row, q)))
            got = self.back[state, row, marked] = self.tight_inserts(state, got)
        return got

    def trace(self, entry: int, rows: str, ahead: tuple[int, ...]) -> tuple[list[str], int]:
        """Letters of each row's edits, insertions before it first, and of what is inserted at the end; and the state of exit.

        Entered in one grammar state; ahead: the cost from each state after the rows to the end of the conversation, at once.
        The edits are the least in ASCII of the cheapest.
        """
        states, _ = self.scan(tuple(0 if q == entry else FAR for q in range(4)), rows)
        last = [c + a for c, a in zip(self.vectors[states[-1]], ahead, strict=True)]
        marked = sum(1 << q for q in range(4) if last[q] == min(last))
        exits = marked
        marks = [self.tight_inserts(states[-1], marked)]
        for state, row in zip(reversed(states[:-1]), reversed(rows), strict=True):
            marks.append(self.before(state, row, marks[-1]))
        marks.reverse()
        out, q = [], entry
        for i, row in enumerate(rows):
            v, (after, less) = self.vectors[states[i]], self.step(states[i], row)
            w, letters = self.vectors[after], ""
            while True:
                tight = {x: to for x, to, cost in arcs(row, q) if marks[i + 1] >> to & 1 and v[q] + cost == w[to] + less}
                to = USER_OR_ASSISTANT[q][0]
                if "D" not in tight and marks[i] >> to & 1 and v[to] == v[q] + INSERT:
                    letters, q = letters + "I", to
                    continue
                letter = min(tight)
                q = tight[letter]
                out.append(letters + letter)
                break
        v, letters = self.vectors[states[-1]], ""
        while not exits >> q & 1:
            letters, q = letters + "I", USER_OR_ASSISTANT[q][0]
        return [*out, letters], q


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32(conv_id:turn) % 20 does; a dropped row is gone."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")).alias("_crc"))
    x = x.withColumn("_crc", F.col("_crc") % 20).filter("_crc <> 0")
    text = F.when(F.col("_crc") == 1, "").when(F.col("_crc") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_crc") == 3, 2).otherwise(1)
    return x.select("conv_id", "turn", F.when(F.col("_crc") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def laid_out(rows: DataFrame) -> DataFrame:
    """rows with pos, increasing in order of conversation, turn, role and text over the whole table; written, so it stays as it is.

    Equal rows may lie in different partitions, so no conversation, turn or text meets in one task.
    """
    rows = stash(rows.withColumn("mark", F.sha2("text", 256)).withColumn("id", F.monotonically_increasing_id()), "repair-rows")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 1024), F.col("mark"), F.col("id")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stash(rows.withColumn("pos", F.monotonically_increasing_id()).drop("id"), "repair-laid")


def _faults(laid: DataFrame) -> DataFrame:
    """conv_id, turn, pos, block, initial and fault."""
    first = laid.groupBy("conv_id", "role", "mark").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    x = laid.select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    x = x.join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return x.select("conv_id", "turn", "pos", F.shiftright("pos", BLOCK_BITS).alias("block"), "initial", fault.alias("fault"))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each conversation and block of at most 2^BLOCK_BITS rows: its symbols in order, and what the counts need."""
    each = F.struct("pos", symbol(F.col("initial"), F.col("fault")).alias("symbol"), "initial")
    x = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(each)).alias("rows"), *[F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    initials = F.col("rows")["initial"]
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.size("rows") - 1), F.slice(initials, F.lit(2), F.size("rows") - 1), lambda a, b: F.concat(a, F.lit("|"), b))
    bad = F.size(F.filter(pairs, lambda p: ~p.isin(*_LEGAL))).cast("long")
    return x.select("conv_id", "block", F.array_join(F.col("rows")["symbol"], "").alias("symbols"), bad.alias("illegal"), F.element_at(initials, 1).alias("head"), F.element_at(initials, -1).alias("tail"), "blank", "duplicate", "truncated")


_LEGAL = ("s|u", "u|a", "a|u")


def _counts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and blocks of each conversation that has rows."""
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    along = Window.partitionBy("conv_id").orderBy("block")  # one row per 2^BLOCK_BITS rows
    before = F.lag("tail").over(along)
    seam = F.when(before.isNotNull() & ~F.concat(before, F.lit("|"), F.col("head")).isin(*_LEGAL), 1).otherwise(0)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    counts = blocks.withColumn("illegal", F.col("illegal") + seam).groupBy("conv_id").agg(*sums, F.count(F.lit(1)).alias("blocks"))
    a, b = counts.alias("a"), turns.alias("b")
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Automaton()
    for batch in batches:
        costs = [sum(own.costs(s), []) for s in batch.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], names=[*batch.schema.names, "costs"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come by conversation, the last first, without their rows: the cost that is ahead after each."""
    now, ahead = object(), FINAL
    for batch in batches:
        out = []
        for conv, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            if conv != now:
                now, ahead = conv, FINAL
            out.append(list(ahead))
            ahead = tuple(min(FAR, *(costs[4 * q + p] + ahead[p] for p in range(4))) for q in range(4))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "block", "ahead"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exit state of a block for each state of entry."""
    own = Automaton()
    for batch in batches:
        out = [[own.trace(q, s, tuple(a))[1] for q in range(4)] for s, a in zip(batch.column("symbols").to_pylist(), batch.column("ahead").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "block")] + [pa.array(out, pa.list_(pa.int32()))], names=["conv_id", "block", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come by conversation in order: the state in which each is entered."""
    now, q = object(), 0
    for batch in batches:
        out = []
        for conv, exits in zip(batch.column("conv_id").to_pylist(), batch.column("exits").to_pylist(), strict=True):
            if conv != now:
                now, q = conv, 0
            out.append(q)
            q = exits[q]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(out, pa.int32())], names=["conv_id", "block", "entry"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's edits (one text per row, and what is inserted at its end) and its cost."""
    own = Automaton()
    for batch in batches:
        edits, costs = [], []
        for s, q, a in zip(batch.column("symbols").to_pylist(), batch.column("entry").to_pylist(), batch.column("ahead").to_pylist(), strict=True):
            letters, out = own.trace(q, s, tuple(a))
            edits.append(letters)
            costs.append(own.costs(s)[q][out])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "block", "entry")], pa.array(edits, pa.list_(pa.string())), pa.array(costs, pa.int64())], names=["conv_id", "block", "entry", "edits", "cost"])


def plan_edits(blocks: DataFrame) -> DataFrame:
    """conv_id, block, entry, edits and cost of each block of cheapest edits. blocks is a written table."""
    tables = stash(blocks.select("conv_id", "block", "symbols").mapInArrow(_tables, "conv_id long, block long, symbols string, costs array<long>"), "repair-tables")
    several = tables.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = tables.alias("a"), several.alias("b")
    x = stash(a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", "n"), "repair-chains")
    one = x.filter("n = 1").select("conv_id", "block", "symbols", F.lit(0).alias("entry"), F.lit(list(FINAL)).cast("array<long>").alias("ahead"))
    many = x.filter("n > 1")
    by = lambda df, *order: df.repartition("conv_id").sortWithinPartitions("conv_id", *order)  # noqa: E731  small rows, one per block
    ahead = stash(by(many.select("conv_id", "block", "costs"), F.desc("block")).mapInArrow(_chain, "conv_id long, block long, ahead array<long>"), "repair-ahead")
    same = lambda l, r: (F.col(f"{l}.conv_id").eqNullSafe(F.col(f"{r}.conv_id"))) & (F.col(f"{l}.block") == F.col(f"{r}.block"))  # noqa: E731, E741
    with_ahead = stash(many.alias("m").join(ahead.alias("h"), same("m", "h")).select("m.conv_id", "m.block", "m.symbols", "h.ahead"), "repair-many")
    exits = with_ahead.mapInArrow(_exits, "conv_id long, block long, exits array<int>")
    entries = stash(by(exits, "block").mapInArrow(_entries, "conv_id long, block long, entry int"), "repair-entries")
    rest = with_ahead.alias("m").join(entries.alias("e"), same("m", "e")).select("m.conv_id", "m.block", "m.symbols", "e.entry", "m.ahead")
    return one.unionByName(rest).mapInArrow(_edits, "conv_id long, block long, entry int, edits array<string>, cost long")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (conv_id, block, pos), the block's plan before its rows: chunks of the repaired lines of each block, in order.

    A line is '\\n' and role:text, so that chunks can be joined as they are; the first character of a conversation goes when it is hashed.
    """
    conv = block = None
    edits: list[str] = []
    at, q, part, size, chunk, letters = 0, 0, 0, 0, [], []
    out: list[tuple] = []

    def line(role: str, text: str) -> None:
        nonlocal size
        s = f"\n{role}:{text}"
        size += len(s)
        chunk.append(s)

    def insert() -> None:
        nonlocal q
        q, role = USER_OR_ASSISTANT[q]
        line(role, "")

    def flush() -> None:
        nonlocal part, size
        out.append((conv, block, part, "".join(letters), "".join(chunk).encode()))
        part, size = part + 1, 0
        chunk.clear()
        letters.clear()

    def ended() -> Iterator[pa.RecordBatch]:
        kind = [pa.int32() if k == 2 else pa.string() if k == 3 else pa.binary() if k == 4 else pa.int64() for k in range(5)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names=["conv_id", "block", "part", "letters", "chunk"])
            out.clear()

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "entry", "edits", "role", "text")), strict=True):
            if row[3] is not None:
                conv, block, q, edits = row[0], row[1], row[2], row[3]
                at = part = 0
            else:
                for x in edits[at]:
                    letters.append(x)
                    if x == "I":
                        insert()
                    elif x == "K":
                        q = FITS[q, row[4][:1]]
                        line(row[4], row[5])
                    elif x == "R":
                        q, role = USER_OR_ASSISTANT[q]
                        line(role, row[5])
                at += 1
            if at == len(edits) - 1:
                for x in edits[at]:
                    letters.append(x)
                    insert()
                flush()
            elif size >= 1 << 20:
                flush()
                yield from ended()
        yield from ended()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come by (conv_id, block, part): audit and hash of each conversation."""
    now: object = None
    begun, digest, first, letters = False, hashlib.sha256(), True, []

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for conv, more, chunk in zip(batch.column("conv_id").to_pylist(), batch.column("letters").to_pylist(), batch.column("chunk"), strict=True):
            if not begun or conv != now:
                if begun:
                    yield close()
                begun, now, digest, first, letters = True, conv, hashlib.sha256(), True, []
            letters.append(more)
            chunk = memoryview(chunk.as_buffer())
            if first and len(chunk):
                chunk, first = chunk[1:], False
            digest.update(chunk)
    if begun:
        yield close()


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of faults and cheapest edits of conversations (conv_id, turn, role, text as they are, without nulls in role and text).

    First: conv_id, gaps, blank, duplicate, truncated, illegal, cost. Second: conv_id, block, part, letters and chunk, the
    edits and the repaired lines in order, each line after a newline.
    """
    laid = laid_out(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))
    rows = stash(_faults(laid), "repair-faults")
    blocks = stash(_blocks(rows), "repair-blocks")
    edits = stash(plan_edits(blocks), "repair-edits")
    counts = _counts(rows, blocks)
    cost = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    a, b = counts.alias("a"), cost.alias("b")
    counts = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    block = F.shiftright("pos", BLOCK_BITS)
    texts = laid.select("conv_id", block.alias("block"), F.col("pos").alias("at"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("array<string>").alias("edits"), "role", "text")
    none = F.lit(None).cast("string")
    plans = edits.select("conv_id", "block", F.lit(-1).cast("long").alias("at"), "entry", "edits", none.alias("role"), none.alias("text"))
    both = plans.unionByName(texts).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").select("conv_id", "block", "entry", "edits", "role", "text")
    return counts, both.mapInArrow(_repaired, "conv_id long, block long, part int, letters string, chunk binary")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Damaged conversations repaired: one row per conv_id of the table, with its counts, cost, audit and hash."""
    conversations = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    counts, chunks = repair(damage(conversations))
    whole = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    a, b, c = conversations.select("conv_id").distinct().alias("a"), counts.alias("b"), whole.alias("c")
    x = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").join(c, F.col("a.conv_id").eqNullSafe(F.col("c.conv_id")), "left")
    number = lambda n: F.coalesce(f"b.{n}", F.lit(0)).cast("long").alias(n)
    return x.select(
        F.col("a.conv_id").alias("conv_id"), *[number(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("c.audit", F.lit("")).alias("audit"), F.coalesce("c.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
