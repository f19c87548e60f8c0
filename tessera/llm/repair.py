"""Repair of the structure of conversations with scalar integer weights.

A conversation is a chain of rows, each reduced to one symbol: must go, or its
role's initial and whether it is truncated.  Edits form a graph whose nodes are
(row, last role of the repaired text) and whose arcs are Delete, Insert, Keep
and Rerole.  An arc's cost and audit letter are one integer: the cost stands in
the high digits, the letters of a path in fixed-width digits below, the first
letter highest, zeros after the last.  Integers then compare as (cost, audit)
does, a shorter audit before its continuations, and an ordinary minimum over
the graph decides everything: cost, edits and ties.

Long conversations are taken in blocks of rows.  Inserts stand before a row,
so two ways through a block that tie in cost and differ at all differ inside
the block; what follows it adds only cost, and each block keeps its own digits.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TwoGenerationCache, staged

#: what edits cost
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: audit letters by digit; 0 pads the end (digits ascend as the letters do)
LETTERS = " DIKR"
DIGIT = {c: i for i, c in enumerate(LETTERS)}
BITS = 3
#: rows of a block
BLOCK = 64
#: states: nothing yet, after a leading s, after u, after a
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: roles that may follow a state, and the state they lead to
NEXT = {NOTHING: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
ROLE = {"u": "user", "a": "assistant"}
#: the state after a role that was inserted or given
STATE = {"u": AFTER_U, "a": AFTER_A}
#: symbols: must go; initial of the role (``o``: any other), upper case if truncated
GONE = "x"


def _row_arcs(symbol: str, state: int):
    """(cost, letter, next state) of the edits of a row."""
    yield DELETE, "D", state
    if symbol != GONE:
        extra = TRUNCATED if symbol.isupper() else 0
        initial = symbol.lower()
        if initial in NEXT[state]:
            yield extra, "K", NEXT[state][initial]
        for role in NEXT[state]:
            if role in ROLE and role != initial:
                yield extra + REROLE, "R", NEXT[state][role]


def _inserts(state: int):
    """(letters so far, next state) of no, one and two inserts."""
    for n in range(3):
        yield n, state
        state = next(NEXT[state][r] for r in NEXT[state] if r in ROLE)


ARCS = {(symbol, state): [(n * INSERT + cost, "I" * n + letter, after) for n, mid in _inserts(state) for cost, letter, after in _row_arcs(symbol, mid)]
        for symbol in "xsuaoSUAO" for state in range(4)}


def _block(symbols: str, after: list[int]) -> tuple[list[int], list[tuple[str, int]]]:
    """For a block of rows and the least costs from each state after it: the
    least cost from each state before it, and (audit letters, state after)."""
    width = BITS * 3 * len(symbols)  # at most two inserts before each row
    low = (1 << width) - 1
    best = [c << width for c in after]
    for symbol in reversed(symbols):
        now = []
        for state in range(4):
            least = None
            for cost, letters, follow in ARCS[symbol, state]:
                # the letters take the first digits, those of the rest move down
                rest = best[follow]
                digits = (rest & low) >> BITS * len(letters)
                for at, letter in enumerate(letters, 1):
                    digits |= DIGIT[letter] << width - BITS * at
                weight = ((rest >> width) + cost << width) | digits
                least = weight if least is None or weight < least else least
            now.append(least)
        best = now
    ways = []
    for state, weight in enumerate(best):
        digits, letters = weight & low, []
        for at in range(width - BITS, -1, -BITS):
            d = digits >> at & (1 << BITS) - 1
            if not d:
                break
            letters.append(LETTERS[d])
        audit = "".join(letters)
        ways.append((audit, _walk(symbols, audit, state)[-1][2] if audit else state))
    return [w >> width for w in best], ways


def _walk(symbols: str, audit: str, state: int = NOTHING) -> list[tuple[str, str, int]]:
    """(letter, role initial or empty, state after) of each edit; the letters
    leave one choice of roles."""
    out, at = [], 0
    for letter in audit:
        role = ""
        if letter == "K":
            role = symbols[at].lower()
        elif letter != "D":
            role = next(r for r in NEXT[state] if r in ROLE)
        if role:
            state = NEXT[state][role]
        out.append((letter, role, state))
        at += letter != "I"
    return out


#: costs after the last row: inserts complete what is open
END = {NOTHING: (0, ""), AFTER_S: (2 * INSERT, "II"), AFTER_U: (INSERT, "I"), AFTER_A: (0, "")}


def cheapest(symbols: str) -> tuple[int, str]:
    """Least cost and, of the audits with that cost, the ASCII-least."""
    after = [END[s][0] for s in range(4)]
    blocks = []
    for end in range(len(symbols), 0, -BLOCK):
        after, ways = _block(symbols[max(0, end - BLOCK):end], after)
        blocks.append(ways)
    state, audit = NOTHING, []
    for ways in reversed(blocks):
        letters, state = ways[state]
        audit.append(letters)
    return after[NOTHING], "".join(audit) + END[state][1]


def damaged(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows after damage: ``conv``, ``turn``, ``role``, ``text`` (a null
    role or text is one space)."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_id).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = df.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"),
                     F.coalesce(F.col(text).cast("string"), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                          changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _sha(c) -> F.Column:
    return F.unhex(F.sha2(c, 256))


def runs(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation as one: ``conv``, ``turn``, ``role``,
    ``digest`` (of the text), ``n``, ``kind`` (blank, truncated or fine) and
    ``first`` (no earlier row has that role and text).

    Counted before the shuffle, so a row that is repeated very often is one
    row per task."""
    black = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    kind = F.when(F.length(black) == 0, "b").when(F.substring(black, -1, 1).isin(".", "!", "?"), "f").otherwise("t")
    same = rows.select("conv", "turn", "role", _sha("text").alias("digest"), kind.alias("kind")) \
        .groupBy("conv", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"))
    # ``rank`` orders turns with nulls first without a null
    same = same.withColumn("known", F.col("turn").isNotNull()).withColumn("rank", F.coalesce("turn", F.lit(0).cast("bigint")))
    first = same.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "rank")).alias("earliest"))
    a, b = same.alias("a"), first.alias("b")
    on = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    return a.join(b, on).select("a.*", (F.struct("a.known", "a.rank") == F.col("b.earliest")).alias("first"))


FIELDS = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


class _Chain:
    """Rows of one conversation in order, read run by run."""

    def __init__(self):
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = self.turn = None

    def add(self, turn, role: str, n: int, kind: str, first: bool) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        initial = _initial(role)
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.last = initial
        if kind == "b":
            self.blank += n
            self.symbols.append(GONE * n)
            return
        copies = n - first
        self.duplicate += copies
        if first:
            self.truncated += kind == "t"
            self.symbols.append(initial.upper() if kind == "t" else initial)
        self.symbols.append(GONE * copies)

    def counts(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation that ``rows`` has: its faults, ``cost`` and ``audit``.
    A conversation's rows stream through a task in order, one symbol each."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "known", "rank", "role", "digest"]
    ordered = runs(rows).select(F.col("conv").cast("string").alias("conv"), "turn", "role", "n", "kind", "first", "known", "rank", "digest") \
        .repartition(parts, "conv").sortWithinPartitions(*order).select("conv", "turn", "role", "n", "kind", "first")

    def run(batches):
        solved = TwoGenerationCache(cheapest, 100_000)
        chain, key, out = None, None, []

        def close():
            symbols = "".join(chain.symbols)
            return key, *chain.counts(), *(solved[symbols] if len(symbols) <= BLOCK else cheapest(symbols))

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)

        for b in batches:
            for conv, turn, role, n, kind, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chain is None or conv != key:
                    if chain is not None:
                        out.append(close())
                    chain, key = _Chain(), conv
                chain.add(turn, role, n, kind, first)
            if len(out) > 2000:
                yield table()
                out = []
        if chain is not None:
            out.append(close())
        if out:
            yield table()

    return ordered.mapInArrow(run, FIELDS)


NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in FIELDS.split(", ")]


def _edited(rows: DataFrame, plan: DataFrame):
    """Each conversation's plan, then its rows in order, in one partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    head = plan.select(F.col("conv_id").alias("conv"), F.lit(0).alias("row"), none.cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
                       none.cast("binary").alias("digest"))
    body = rows.select(F.col("conv").cast("string").alias("conv"), F.lit(1).alias("row"), "turn", "role", "text", _sha("text").alias("digest"))
    return head.unionByName(body).repartition(parts, "conv").sortWithinPartitions("conv", "row", F.asc_nulls_first("turn"), "role", "digest") \
        .select("conv", "row", "role", "text")


class _Replay:
    """Applies a conversation's audit to its rows as they come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _give(self) -> str:
        role = next(r for r in NEXT[self.state] if r in ROLE)
        self.state = NEXT[self.state][role]
        return ROLE[role]

    def inserts(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield "I", self._give(), ""

    def row(self, role: str, text: str):
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            yield letter, self._give(), text
        elif letter == "K":
            self.state = NEXT[self.state][_initial(role)]
            yield letter, role, text


def _replayed(batches):
    """(conversation, edits) in order; a conversation's edits come in parts,
    and end with None."""
    replay, key = None, None
    for b in batches:
        for conv, row, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row == 0:
                if replay is not None:
                    yield key, replay.inserts()
                    yield key, None
                replay, key = _Replay(text), conv
            else:
                yield key, replay.row(role, text)
    if replay is not None:
        yield key, replay.inserts()
        yield key, None


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``: the repaired ``role:text`` lines of
    a conversation, hashed as they stream by."""
    def run(batches):
        out, hashed, some = [], sha256(), False
        for key, edits in _replayed(batches):
            if edits is None:
                out.append((key, hashed.hexdigest()))
                hashed, some = sha256(), False
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["conv_id", "repaired_sha256"])
                    out = []
                continue
            for _, role, text in edits:
                hashed.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
                some = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["conv_id", "repaired_sha256"])

    return _edited(rows, plan).mapInArrow(run, "conv_id string, repaired_sha256 string")


def repaired(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` (from 0), ``edit`` (K, R or I),
    ``role``, ``text``."""
    def run(batches):
        out, place = [], 0
        for key, edits in _replayed(batches):
            if edits is None:
                place = 0
                continue
            for edit, role, text in edits:
                out.append((key, place, edit, role, text))
                place += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(["conv_id", "place", "edit", "role", "text"], zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(["conv_id", "place", "edit", "role", "text"], zip(*out, strict=True), strict=True)))

    return _edited(rows, audits(rows) if plan is None else plan).mapInArrow(run, "conv_id string, place long, edit string, role string, text string")


def repair_damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation id of ``df``: its rows are damaged (see
    ``damaged``), judged, and repaired at the least cost.

    ``gaps`` (turn numbers missing between the least and the greatest),
    ``blank``, ``duplicate`` and ``truncated`` (each row's first fault),
    ``illegal`` (neighbours whose initials aren't su, ua or au), ``cost``,
    ``audit`` (initials of the cheapest edits, the ASCII-least of them) and
    ``repaired_sha256`` (of the repaired ``role:text`` lines).

    Rows follow their turn, nulls first; rows of one turn follow role and
    SHA-256 of the text, so equal rows are neighbours.  A null id is a
    conversation of its own, a null role or text one space, a null turn is no
    turn.  Repeated rows are duplicates.  A conversation whose rows are all
    dropped has zeros, an empty audit and the digest of the empty string.  An
    empty table gives an empty result; other columns aren't read.  The digest
    of a conversation runs through one task, as its text is one string; rows
    are streamed, never held.
    """
    rows = damaged(df, conv_id, turn, role, text)
    plan = staged(audits(rows), "audits")  # read again with the texts
    hashed = digests(rows, plan).withColumnRenamed("conv_id", "conv_key")
    done = plan.join(hashed, plan["conv_id"].eqNullSafe(hashed["conv_key"])).drop("conv_key").withColumnRenamed("conv_id", "found")
    ids = df.select(F.col(conv_id).alias("conv_id")).distinct()
    out = ids.join(done, ids["conv_id"].cast("string").eqNullSafe(done["found"]), "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
