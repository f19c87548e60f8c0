import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import repair as rp

WHITE = " \t\n\x0b\f\r"


def ways(symbols, roles=""):
    """All edits of the rows that are left, with up to two inserts anywhere."""
    for n in range(3):
        for put in itertools.product("ua", repeat=n):
            now = roles + "".join(put)
            if not symbols:
                yield 5 * n, "I" * n, now
                continue
            c, rest = symbols[0], symbols[1:]
            steps = [(2, "D", "")]
            if c != "x":
                extra = 5 if c.isupper() else 0
                steps += [(extra, "K", c.lower()), (extra + 1, "R", "u"), (extra + 1, "R", "a")]
            for cost, letter, role in steps:
                # a prefix that no ending can complete
                if not re.fullmatch("s?(ua)*u?", now + role):
                    continue
                for more, letters, end in ways(rest, now + role):
                    yield 5 * n + cost + more, "I" * n + letter + letters, end


def brute(symbols):
    return min((cost, audit) for cost, audit, roles in ways(symbols) if re.fullmatch("(s?(ua)+)?", roles))


def plain(symbols):
    """Shortest path with (cost, audit) pairs, forward, without blocks."""
    best = {0: (0, "")}
    for c in [*symbols, None]:
        for state in (0, 1, 2, 3, 2, 3):  # inserts
            if state in best:
                cost, audit = best[state]
                role, after = ("a", 3) if state == 2 else ("u", 2)
                best[after] = min(best.get(after, (10**9, "")), (cost + 5, audit + "I"))
        if c is None:
            break
        now = {}

        def offer(state, cost, audit, now=now):
            now[state] = min(now.get(state, (10**9, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            offer(state, cost + 2, audit + "D")
            if c != "x":
                extra = 5 if c.isupper() else 0
                for role, after in ({0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]})[state]:
                    if role == c.lower():
                        offer(after, cost + extra, audit + "K")
                    elif role != "s":
                        offer(after, cost + extra + 1, audit + "R")
        best = now
    return min(best[s] for s in (0, 3) if s in best)


def test_all_short_chains():
    for n in range(4):
        for symbols in itertools.product("xsuaoSUAO", repeat=n):
            symbols = "".join(symbols)
            assert rp.cheapest(symbols) == brute(symbols), symbols
    assert rp.cheapest("") == (0, "")


@pytest.mark.parametrize("block", [1, 2, 64])
def test_long_chains_in_blocks(monkeypatch, block):
    monkeypatch.setattr(rp, "BLOCK", block)
    rng = random.Random(block)
    for n in (5, 9, 40, 200, 700):
        for letters in ("xsuaoSUAO", "ua", "uuaU", "uaA", "sua"):
            symbols = "".join(rng.choice(letters) for _ in range(n))
            assert rp.cheapest(symbols) == plain(symbols), symbols
    symbols = "ua" * 30 + "a" + "ua" * 30
    assert rp.cheapest(symbols) == plain(symbols)


def repaired_lines(rows, audit):
    out, state, at = [], "", 0
    for letter in audit:
        nxt = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((nxt, ""))
        else:
            role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            out.append((role if letter == "K" else nxt, text))
        state = out[-1][0][:1]
    assert at == len(rows)
    return out


def brute_rows(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, *_ in own if t is not None}
        seen, symbols, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            body = text.rstrip(WHITE)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not body:
                faults[0] += 1
                symbols.append("x")
            elif (role, text) in seen:
                faults[1] += 1
                symbols.append("x")
            elif body[-1] not in ".!?":
                faults[2] += 1
                symbols.append(initial.upper())
            else:
                symbols.append(initial)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = plain("".join(symbols))
        lines = "\n".join(f"{r}:{t}" for r, t in repaired_lines([r[1:] for r in own], audit))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", "é ", "tail. \n", None, "x" * 30_000 + ".", " " * 20_000 + "y", "two\nlines."]
    rows = [(1, 1, "user", "Hello there."), (1, 2, "assistant", "Hi."), (2, None, None, None), (3, 7, "system", None), (None, 1, "user", "Null id."), (None, None, "user", "Null id.")]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "User", "", None, "usr", "tool"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, -turn]), role, rng.choice(texts)))
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t}{'.' if t % 7 else ''}") for t in range(1000)]
    rows += [(98, None, "user", "same.")] * 300 + [(97, 4, "user", "same.")] * 300
    return rows + rows[:40]


@pytest.fixture(scope="module")
def talk_df(spark, talk):
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit("clash").alias(c) for c in ("conv", "kind", "n", "audit", "digest", "first", "rank", "copy", "found"))).repartition(4)


def test_messy_conversations(talk, talk_df):
    got = rp.repair_damaged(talk_df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_rows(talk)
    assert rp.repair_damaged(talk_df.where("false")).count() == 0


def test_repaired_rows(talk_df):
    rows = rp.damaged(talk_df, "conv_id", "turn", "role", "text")
    out = {}
    for r in rp.repaired(rows).collect():
        out.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    want = {None if r["conv_id"] is None else str(r["conv_id"]): r["repaired_sha256"] for r in rp.repair_damaged(talk_df).collect()}
    for conv, lines in out.items():
        lines.sort()
        assert [p for p, *_ in lines] == list(range(len(lines)))
        assert re.fullmatch("s?(ua)+", "".join(r[:1] for _, r, _ in lines))
        assert want[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(digest == empty for conv, digest in want.items() if conv not in out)


def test_given_table(spark):
    sf = "/root/testdata/sf0.01/conversations.parquet"
    df = spark.read.parquet(sf)
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, rp.repair_damaged(df).collect()), key=str) == brute_rows(rows)
