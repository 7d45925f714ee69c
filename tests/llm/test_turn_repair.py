"""Repair of conversations against an enumeration of all edits, a plain search over states, and the whole query rebuilt row by row."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from studyspark.llm import turn_repair
from studyspark.llm.turn_repair import START, STATES, WHOLE, damaged, joined, repair, repaired, run_ways, script, segment_ways, with_missing

GRAMMAR = re.compile("(s?(ua)+)?")


def _enumerated(codes):
    """The least (cost, audit) over all edits with at most two inserted rows at each place."""
    inserts = [("", 0, "")] + [(r, 5, "I") for r in "ua"] + [(a + b, 10, "II") for a, b in product("ua", repeat=2)]
    per_row = []
    for c in codes:
        options = [("", 2, "D")]
        if c != "x":
            stays = 5 if c.isupper() else 0
            options += [(c.lower(), stays, "K")] + [(r, stays + 1, "R") for r in "ua"]
        per_row.append(options)
    best = None
    for gaps in product(inserts, repeat=len(codes) + 1):
        for rows in product(*per_row):
            steps = [s for pair in zip(gaps, rows) for s in pair] + [gaps[-1]]
            if GRAMMAR.fullmatch("".join(s[0] for s in steps)):
                way = sum(s[1] for s in steps), "".join(s[2] for s in steps)
                best = way if best is None else min(best, way)
    return best


def _searched(codes):
    """The same for any number of rows: the least way to each state, row by row."""
    def grown(ways):
        for _ in range(3):
            for (state, (cost, audit)) in list(ways.items()):
                nxt = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                way = (cost + 5, audit + "I")
                if nxt not in ways or way < ways[nxt]:
                    ways[nxt] = way
        return ways
    ways = grown({0: (0, "")})
    for c in codes:
        new = {}
        for state, (cost, audit) in ways.items():
            options = [(state, cost + 2, audit + "D")]
            if c != "x":
                stays = 5 if c.isupper() else 0
                to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                options.append((to, cost + stays + 1, audit + "R"))
                if c.lower() == "s" and state == 0:
                    options.append((1, cost + stays, audit + "K"))
                elif c.lower() == "ua"[to == 3]:
                    options.append((to, cost + stays, audit + "K"))
            for to, *way in options:
                if to not in new or tuple(way) < new[to]:
                    new[to] = tuple(way)
        ways = grown(new)
    return min(ways[s] for s in (0, 3) if s in ways)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_repairs_equal_enumeration(n):
    alphabet = "suaUAoSOx" if n < 3 else "suaUx"
    for codes in map("".join, product(alphabet, repeat=n)):
        assert repaired(codes) == _enumerated(codes), codes


@pytest.mark.parametrize("alphabet", ["ua", "suaUAx", "suaoSUAOx", "uuuuuaU", "a", "uaua" * 4 + "xUs"])
def test_long_repairs_equal_search(alphabet, monkeypatch):
    rng = random.Random(len(alphabet))
    for n in [*range(4, 30), 64, 65, 90, 130]:
        codes = "".join(rng.choice(alphabet) for _ in range(n))
        assert repaired(codes) == _searched(codes), codes
        monkeypatch.setattr(turn_repair, "SEGMENT", 3)
        assert repaired(codes) == _searched(codes), codes
        monkeypatch.setattr(turn_repair, "SEGMENT", 64)


def test_neighbouring_runs_join():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("suaUAx") for _ in range(rng.randint(1, 6))) for _ in range(2))
        ways, _ = joined(segment_ways(a), segment_ways(b))
        assert ways == segment_ways(a + b)
        cost, audit = min(w for pair, w in zip(STATES, ways) if pair in WHOLE and w)
        assert (cost, audit) == repaired(a + b)
        left = "".join(c.lower() if s == "K" else s.lower() for step, c in zip(script(a + b, audit, START), a + b) for s in step)
        assert GRAMMAR.fullmatch(left)


def _expected(rows):
    """The whole query in plain Python: {conv: columns}."""
    def text_of(v):
        return " " if v is None else str(v)
    damaged_rows = {}
    for conv, turn, role, text in rows:
        damaged_rows.setdefault(conv, [])
        k = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        damaged_rows[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, found in damaged_rows.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            low = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else low.upper() if fault else low
        cost, audit = _searched(codes) if codes else (0, "")
        left, i, state = [], 0, ""
        for letter in audit:
            wanted = "assistant" if state == "u" else "user"
            if letter == "D":
                i += 1
                continue
            role, text = (wanted, "") if letter == "I" else (found[i][1] if letter == "K" else wanted, found[i][2])
            i += letter != "I"
            left.append(f"{role}:{text}")
            state = role[0]
        turns = [t for t, _, _ in found if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:])), cost, audit,
                     hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def _rows():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "", " \t\n", "cut off", "Why?  ", "é. ", "x" * 5000 + ".", None, "Yes.\n"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice([role] * 9 + ["system", None, "tool", "", "admin"]), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}."))
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 9 else "Same.") for t in range(700)]        # a long and hot one
    rows += [(501, 3, "user", "Again.")] * 40 + [(None, 1, "user", "Hi."), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("partitions", [1, 40])
def test_query_equals_plain_python(spark, partitions):
    rows = _rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fault", "'x' AS copy", "'y' AS id").repartition(6)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        audits, kept = repair(damaged(table), keep_rows=True)
        got = with_missing(audits, table).collect()
        left = kept.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = _expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id
    texts = {}
    for r in sorted(left, key=lambda r: (r.part, r.at, r.step)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == v[-1] for c, v in want.items())


def test_no_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits, kept = repair(table, keep_rows=True)
    assert with_missing(audits, table).count() == 0 == kept.count()
