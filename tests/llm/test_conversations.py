import hashlib
import random
import re
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from voxelake.llm import conversations as cv

ROWS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


@lru_cache(None)
def plain(codes):
    """Least (cost, audit) by trying all edits from the end, and the roles' initials that they give."""

    @lru_cache(None)
    def best(i, state, inserts):
        out = []
        made = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        to = 3 if made == "a" else 2
        if i == len(codes) and state in (0, 3):
            out.append((0, "", ""))
        if inserts < 3:
            c, a, r = best(i, to, inserts + 1)
            out.append((c + 2, "I" + a, made + r))
        if i < len(codes):
            code = codes[i]
            c, a, r = best(i + 1, state, 0)
            out.append((c + 3, "D" + a, r))
            if code != "d":
                cut = code.isupper()
                c, a, r = best(i + 1, to, 0)
                out.append((c + 2 + cut, "R" + a, made + r))
                for p, role, q in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (3, "u", 2), (2, "a", 3)):
                    if p == state and role == code.lower():
                        c, a, r = best(i + 1, q, 0)
                        out.append((c + cut, "K" + a, role + r))
        return min(out, default=(10**9, "", ""))

    return best(0, 0, 0)


def solved(codes, cuts=()):
    """By layers, over the segments between ``cuts``."""
    parts = [codes[a:b] for a, b in zip((0, *cuts), (*cuts, len(codes)), strict=True)]
    cost, after = cv.chained([cv.costs(p) for p in parts])
    state, audit = 0, ""
    for k, (p, a) in enumerate(zip(parts, after, strict=True)):
        letters, state = cv.walks(p, a, k == 0, k == len(parts) - 1)[state]
        audit += letters
    return cost, audit


def test_layers_equal_plain():
    rng = random.Random(5)
    for _ in range(600):
        codes = "".join(rng.choice("suaxSUAXduaua") for _ in range(rng.randint(1, 12)))
        cost, audit, roles = plain(codes)
        assert GRAMMAR.fullmatch(roles)
        assert solved(codes) == (cost, audit), codes
        cuts = tuple(sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randint(0, 3)))))
        assert solved(codes, cuts) == (cost, audit), (codes, cuts)


def test_long_segments():
    rng = random.Random(6)
    codes = "".join(rng.choice("uaUAsd") for _ in range(900))
    assert solved(codes) == solved(codes, (100, 101, 450)) and solved(codes) == plain_loop(codes)
    assert solved("ua" * 1024) == (0, "KK" * 1024)


def plain_loop(codes):
    """``plain`` without recursion: a table from the end."""
    now = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    for code in reversed(codes):
        used = {}
        for p in range(4):
            out = [(now[p][0] + 3, "D" + now[p][1])]
            if code != "d":
                cut = code.isupper()
                out.append((now[to[p]][0] + 2 + cut, "R" + now[to[p]][1]))
                if (q := {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((p, code.lower()))) is not None:
                    out.append((now[q][0] + cut, "K" + now[q][1]))
            used[p] = min(out)
        now = {p: min(used[p], (used[to[p]][0] + 2, "I" + used[to[p]][1]), (used[to[to[p]]][0] + 4, "II" + used[to[to[p]]][1])) for p in range(4)}
    return now[0]


def plain_repair(rows):
    """The contract's columns by conversation, from (turn, role, text) rows."""
    out = {}
    for conv, own in rows.items():
        own = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in own]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        codes = "".join("d" if f in ("blank", "duplicate") else (lambda c: c.upper() if f else c)(r[1][:1] if r[1][:1] in ("s", "u", "a") else "x") for f, r in zip(faults, own, strict=True))
        cost, audit, roles = plain(codes)
        lines, left, places = [], list(own), iter(roles)
        for letter in audit:
            row = left.pop(0) if letter != "I" else None
            if letter != "D":
                place = next(places)
                name = row[1] if letter == "K" else {"u": "user", "a": "assistant"}[place]
                lines.append(f"{name}:{row[2] if row else ''}")
        turns = [t for t, _, _ in own if t is not None]
        n = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", None, "Ende?\n", "x" * 70_000 + ".", "Yes.", "mid. cut"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            for _ in range(rng.choice((1, 1, 1, 2))):
                rows.append((conv, rng.choice((None, turn, turn, turn, turn + 3)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)), rng.choice(texts)))
    return rows + rows[:5]


@pytest.mark.parametrize("segment", [cv.SEGMENT, 2])
def test_rows_equal_plain(spark, monkeypatch, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    rows = made_rows()
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.repair(spark.createDataFrame(rows, ROWS).repartition(7)).collect()}
    assert got == plain_repair(by)


def test_repaired_turns_read_as_the_digest(spark):
    df = spark.createDataFrame(made_rows(4), ROWS)
    turns = cv.repaired_turns(df).orderBy("conv_id", "position").collect()
    lines = {}
    for t in turns:
        lines.setdefault(t["conv_id"], []).append(f"{t['role']}:{t['text']}")
    want = {r["conv_id"]: r["repaired_sha256"] for r in cv.repair(df).collect()}
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == want
    assert all(GRAMMAR.fullmatch("".join(x[0] for x in own)) for own in lines.values())


def test_damage_and_lost_conversations(spark):
    """crc32('0:17') % 20 and others as Python has them; conversations without rows, and none at all."""
    from zlib import crc32

    law = lambda c, t: crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    rows = [(c, t, "assistant", "One. Two! Three?") for c in [None, *range(40)] for t in (None, 0, 1)]
    want = Counter()
    for c, t, r, x in rows:
        k = law(c, t)
        want[(c, t, "user" if k == 4 else r, "" if k == 1 else "One Two Three" if k == 2 else x)] += {0: 0, 3: 2}.get(k, 1)
    df = spark.createDataFrame(rows, ROWS)
    assert Counter(map(tuple, cv.damaged(df).select("conv_id", "turn", "role", "text").collect())) == +want
    gone = next(c for c in range(10_000) if law(c, 0) == 0)
    lone = spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS)
    assert [tuple(r) for r in cv.repair(cv.damaged(lone), lone).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", cv.EMPTY)]
    assert cv.repair(cv.damaged(lone.limit(0)), lone.limit(0)).count() == 0
    clash = df.withColumn("code", F.lit("d")).withColumn("fault", F.lit("blank")).withColumn("pos", F.lit(1))
    assert sorted(map(str, cv.repair(clash).collect())) == sorted(map(str, cv.repair(df).collect()))
