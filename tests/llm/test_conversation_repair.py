"""Repairs against an enumeration of edits and a plain reading of the rules."""

import hashlib
import itertools
import re
import zlib
from functools import cache

import numpy as np
import pandas as pd

from placebook.llm import conversation_repair as repairs
from placebook.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SHAPE = re.compile(r"(s?(ua)+)?")


@cache
def cheapest(kinds):
    """Least (cost, edits) over all edit strings that give a legal shape, by what has been
    put so far; at most three rows are inserted in a row."""

    @cache
    def go(i, last, run):
        found = []
        if i == len(kinds) and last in ("", "a"):
            found.append((0, ""))
        following = [x for x in "ua" if re.fullmatch(r"s?(ua)*u?", {"": "", "s": "s", "u": "u", "a": "ua"}[last] + x)]
        if i < len(kinds):
            kind = kinds[i]
            found.append((4, "D", i + 1, last))
            if kind != "x":
                more = 3 * kind.isupper()
                if kind.lower() in following or (kind == "s" or kind == "S") and last == "":
                    found.append((more, "K", i + 1, kind.lower()))
                found += [(3 + more, "R", i + 1, x) for x in following]
        if run < 3:
            found += [(3, "I", i, x) for x in following]
        out = []
        for cost, letter, *rest in found:
            if rest:
                later = go(rest[0], rest[1], run + 1 if letter == "I" else 0)
                if later is not None:
                    out.append((cost + later[0], letter + later[1]))
            else:
                out.append((cost, letter))
        return min(out, default=None)

    return go(0, "", 0)


def test_block_lookups_equal_enumeration():
    rng = np.random.default_rng(2)
    cases = [c for n in range(4) for c in itertools.product(repairs.KINDS[1:], repeat=n)]
    cases += [tuple(rng.choice(list(repairs.KINDS[1:]), rng.integers(4, 40))) for _ in range(300)]
    for kinds in cases:
        places = np.array([repairs.KINDS.index(k) for k in kinds], np.int64)
        assert repairs.repair(places) == cheapest(tuple(map(str, kinds))), kinds


def test_segments_of_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    places = rng.integers(1, len(repairs.KINDS), 4001)
    whole = repairs.repair(places)
    for size in (1, 7, 1001):
        monkeypatch.setattr(repairs, "SEGMENT", size)
        assert repairs.repair(places) == whole


def test_blocks_are_composed_of_rows():
    t = repairs.tables()
    assert all(min(v) == 0 for v in t.vectors) and len(set(t.vectors)) == len(t.vectors)
    rng = np.random.default_rng(3)
    for _ in range(500):
        vector, kinds = int(rng.integers(len(t.vectors))), rng.integers(0, len(repairs.KINDS), repairs.BLOCK)
        costs = t.vectors[vector]
        for kind in kinds[::-1]:
            costs = repairs.cost_before(costs, repairs.KINDS[kind])
        block = int("".join(map(str, kinds)))
        assert tuple(int(t.offset[vector, block]) + x for x in t.vectors[t.block[vector, block]]) == costs


def expected(rows):
    """All columns of each conversation, by the rules read row by row."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            lot = zlib.crc32(name.encode()) % 20
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            turns += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        turns.sort(key=order)
        seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = role[:1] if role[:1] in tuple("sua") else "o"
            kinds.append("x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        known = {t[0] for t in turns if t[0] is not None}
        cost, audit = cheapest(tuple(kinds))
        left, new = iter(turns), []
        for letter in audit:
            last = new[-1][0][:1] if new else ""
            role, text = ("user" if last != "u" else "assistant"), ""
            if letter != "I":
                _, old, text = next(left)
                role = old if letter == "K" else role
            if letter != "D":
                new.append((role, text))
        assert SHAPE.fullmatch("".join(r[0] for r, _ in new))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def check(got, rows):
    want = expected(rows)
    assert len(got) == len(want)
    for conv, *row in got:
        assert tuple(row) == want[conv], conv


def test_query_equals_the_rules(spark):
    frame = pd.read_parquet(f"{SF}/conversations.parquet")
    rows = [(int(c), int(t), r, x) for c, t, r, x in frame.values.tolist()]
    got = QUERIES["op13_conversation_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    check([tuple(r) for r in got.collect()], rows)


def test_hard_rows(spark):
    rng = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "tool", "", None, "u", "sys", "Assistant"]
    texts = ["Yes.", "No", "", None, " \n ", "a?", "é…", "what\n", "x" * 100_000 + ".", "s:ua\nuser:", "漢字。", "Yes."]
    rows = [(int(c), int(t), roles[rng.integers(9)], texts[rng.integers(12)]) for c in range(60) for t in rng.integers(0, 6, rng.integers(1, 12))]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (61, None, "user", "Hi."), (61, None, "user", "Hi."), (61, -5, "assistant", "Ho!")]
    rows += [(62, None, "user", "Hi."), (62, None, None, "a.")]
    lost = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "Gone.")]
    frame = spark.createDataFrame([(*r, 1, "d", True) for r in rows], "conv_id long, turn long, role string, text string, kind int, digest string, present boolean")
    got = [tuple(r) for r in repairs.repaired(frame).collect()]
    check(got, rows)
    empty = hashlib.sha256().hexdigest()
    assert (lost, 0, 0, 0, 0, 0, 0, "", empty) in got
    assert repairs.repaired(frame.limit(0)).count() == 0


def test_long_conversation_with_one_text(spark):
    """One conversation of most rows, nearly all alike."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "Same." if i % 3 else f"Row {i}.") for i in range(3000)] + [(2, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repairs.repaired(frame).collect()}
    assert got[1].duplicate > 1500 and set(got[1].audit) <= set("DIKR") and got[1].cost >= 4 * got[1].duplicate
