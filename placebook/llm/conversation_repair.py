"""The cheapest repair of conversations whose turns are damaged.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its rows are kept (cost 0),
given the role that must come next (3) or deleted (4, the only choice for blank and
duplicate rows); empty turns are inserted (3); a truncated row that is not deleted costs 3
more. Of the cheapest edits the string of initials that sorts first is taken.

What a conversation costs from a row on depends on the role before it: a vector of four
costs. Less its least entry such a vector is one of a few, so the step over a row is a
table by (vector, kind of row), and the step over a block of ``BLOCK`` rows is a table by
(vector, block): the Four-Russians way. Blocks are looked up from the last to the first,
which leaves the vector at every border; each block is then expanded, backward for the
vectors between its rows and forward for the first best edit of each. Such costs to go
decide ties rightly, which costs so far could not.

Two streams in order of turns do the rest: one reads the kind of every row and makes the
audit, one byte a row; the next takes each audit ahead of its conversation's rows and
hashes what they become. A conversation of any length passes through one task of each, as
its checksum needs; no text is held beyond its batch.

* Null conversation: one of its own. Null role or text: a space. Null turns come first.
* Rows of one turn: ordered by role, then by a digest of role and text, so repeats adjoin.
* Equal (role, text): the first in that order is the original, the others duplicates.
* Roles are told apart by their first character; only s, u and a can be kept.
* Very long texts: hashed as they pass. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.common import stored

RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4
SEGMENT = 100_000
WHITE = " \t\n\x0b\x0c\r"
# Kinds of rows: no row, to be deleted, and role initials, upper case where truncated.
KINDS = ".xsuaoSUAO"
# States: nothing yet, after a system, user, assistant turn; what may be put next in each.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDING = ("", "II", "I", "")
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def row_costs(after: tuple[int, ...], kind: str) -> list[dict[str, tuple[int, int]]]:
    """For every state before a row: cost to go and next state of each edit that takes the row."""
    out = []
    for state in range(4):
        edits = {"D": (DELETE + after[state], state)}
        if kind != "x":
            more = TRUNCATED * kind.isupper()
            if (kept := KEEPS.get((kind.lower(), state))) is not None:
                edits["K"] = (more + after[kept], kept)
            edits["R"] = (RELABEL + more + after[NEXT[state]], NEXT[state])
        out.append(edits)
    return out


def cost_before(after: tuple[int, ...], kind: str) -> tuple[int, ...]:
    """Costs to go before a row from those after it."""
    if kind == ".":
        return after
    taken = [min(cost for cost, _ in edits.values()) for edits in row_costs(after, kind)]
    return tuple(min(taken[q], INSERT + taken[NEXT[q]], 2 * INSERT + taken[NEXT[NEXT[q]]]) for q in range(4))


def first_edits(after: tuple[int, ...], kind: str, state: int) -> tuple[str, int]:
    """The edits, least by letter, that go from ``state`` over a row at least cost."""
    letters = ""
    before = cost_before(after, kind)
    while kind != ".":
        edits = row_costs(after, kind)[state]
        if edits["D"][0] == before[state]:
            return letters + "D", state
        if INSERT + before[NEXT[state]] == before[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        letter = next(x for x in "KR" if x in edits and edits[x][0] == before[state])
        return letters + letter, edits[letter][1]
    return letters, state


@dataclass(frozen=True)
class Tables:
    """Normalised vectors and the steps over one row and over a block."""

    vectors: list[tuple[int, ...]]
    last: int
    row: np.ndarray
    block: np.ndarray
    offset: np.ndarray
    expanded: dict


@cache
def tables() -> Tables:
    end = tuple(INSERT * len(x) for x in ENDING)
    vectors, row, offset = [end], [], []
    for vector in vectors:  # grows while it is read, until no step leaves it
        steps = [cost_before(vector, kind) for kind in KINDS]
        least = [min(s) for s in steps]
        normal = [tuple(x - low for x in s) for s, low in zip(steps, least, strict=True)]
        vectors += [v for v in dict.fromkeys(normal) if v not in vectors]
        row.append([vectors.index(v) for v in normal])
        offset.append(least)
    one, cost = np.array(row), np.array(offset)
    block, total = one, cost
    for _ in range(BLOCK - 1):  # one more row in front of those of a shorter block
        block, total = one[block].transpose(0, 2, 1), cost[block].transpose(0, 2, 1) + total[:, None, :]
        block, total = block.reshape(len(one), -1), total.reshape(len(one), -1)
    return Tables(vectors, 0, one, block, total, {})


def expand(t: Tables, right: int, block: int, state: int) -> tuple[str, int]:
    """Edits of a block from ``state``, its right border's vector given; and the state after."""
    known = t.expanded.get((right, block, state))
    if known is None:
        kinds = [block // len(KINDS) ** i % len(KINDS) for i in range(BLOCK)]  # the last row first
        after = [right]
        for kind in kinds[:-1]:
            after.append(int(t.row[after[-1], kind]))
        letters, q = "", state
        for vector, kind in zip(reversed(after), reversed(kinds), strict=True):
            more, q = first_edits(t.vectors[vector], KINDS[kind], q)
            letters += more
        known = t.expanded[right, block, state] = letters, q
    return known


def repair(kinds: np.ndarray) -> tuple[int, str]:
    """Cost and edits of a conversation from the kinds of its rows, places in ``KINDS``.

    Two bytes a row are held besides the edits; lists cover ``SEGMENT`` blocks at a time.
    """
    t = tables()
    padded = np.concatenate([np.zeros(-len(kinds) % BLOCK, np.uint8), kinds.astype(np.uint8)])
    blocks = np.zeros(len(padded) // BLOCK, np.uint16)
    for column in padded.reshape(-1, BLOCK).T:
        blocks = blocks * np.uint16(len(KINDS)) + column
    segments = [slice(i, i + SEGMENT) for i in range(0, len(blocks), SEGMENT)]
    borders = np.empty(len(blocks), np.uint16)
    vector, cost = t.last, 0
    for segment in reversed(segments):
        right = []
        for block in reversed(blocks[segment].tolist()):
            right.append(vector)
            cost += int(t.offset[vector, block])
            vector = int(t.block[vector, block])
        borders[segment] = right[::-1]
    edits, state = [], 0
    for segment in segments:
        parts = []
        for right, block in zip(borders[segment].tolist(), blocks[segment].tolist(), strict=True):
            letters, state = expand(t, right, block, state)
            parts.append(letters)
        edits.append("".join(parts))
    return cost + t.vectors[vector][0], "".join(edits) + ENDING[state]


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, present, turn, role, text, digest`` after the damage; dropped rows stay as
    rows that are not present, so that their conversations do."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("lot") != 0, F.when(F.col("lot") == 3, 2).otherwise(1))).alias("present")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)
    return rows.withColumn("digest", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))


def described(rows: DataFrame) -> DataFrame:
    """``conv_id, present, turn, role, digest, initial, blank, again, cut``: what the repair
    has to know of a row, without its text. ``again``: equal rows come at an earlier turn."""
    repeated = rows.where("present").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated.select(F.col("conv_id").alias("conv"), "digest", "first.turn").withColumnRenamed("turn", "earliest"), "repeated-turns")
    said = F.rtrim("text", F.lit(WHITE))
    plain = rows.select("conv_id", "present", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    same = plain.conv_id.eqNullSafe(repeated.conv) & (plain.digest == repeated.digest)
    joined = plain.join(repeated.withColumn("known", F.lit(True)), same, "left")
    again = F.coalesce(F.col("known") & ~F.col("turn").eqNullSafe(F.col("earliest")), F.lit(False))
    return joined.select(*(plain[c] for c in plain.columns), again.alias("again"))


class _Conversation:
    """What one stream gathers of a conversation: counts, and a byte for each row."""

    def __init__(self):
        self.kinds = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low: int | None = None
        self.last: tuple | None = None

    def add(self, turn: int | None, role: str, digest: str, initial: str, blank: bool, again: bool, cut: bool) -> None:
        if self.last is not None and self.last[3] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and (self.last is None or self.last[0] != turn):
            self.turns += 1
            self.low = turn if self.low is None else self.low
        again = again or (self.last is not None and self.last[:3] == (turn, role, digest))
        self.last = (turn, role, digest, initial)
        kind = initial if initial in ("s", "u", "a") else "o"
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
            kind = kind.upper()
        self.kinds.append(KINDS.index("x" if blank or again else kind))

    def row(self, conv: int | None) -> tuple:
        gaps = self.last[0] - self.low + 1 - self.turns if self.low is not None else 0
        cost, audit = repair(np.frombuffer(self.kinds, np.uint8))
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """All columns of ``OUT`` but the last, for every conversation."""
    schema = OUT.rpartition(", ")[0]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "present", "turn", "role", "digest")
    fields = ("turn", "role", "digest", "initial", "blank", "again", "cut")

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, None
        for batch in batches:
            done = []
            lists = (batch.column(c).to_pylist() for c in ("conv_id", "present", *fields))
            for conv, present, *row in zip(*lists, strict=True):
                if own is None or conv != current:
                    if own is not None:
                        done.append(own.row(current))
                    current, own = conv, _Conversation()
                if present:
                    own.add(*row)
            yield out(done)
        if own is not None:
            yield out([own.row(current)])

    return ordered.mapInArrow(run, schema)


class _Repaired:
    """The repaired rows of a conversation, hashed one by one under its audit."""

    def __init__(self, row: tuple):
        self.row, self.hash = row, hashlib.sha256()
        self.audit, self.at, self.state, self.first = row[-1], 0, 0, True

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self.put(ROLE[self.state], "")

    def add(self, role: str, text: str) -> None:
        self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = KEEPS[role[0], self.state]
            self.put(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.put(ROLE[self.state], text)

    def done(self) -> tuple:
        self.inserts()
        return *self.row, self.hash.hexdigest()


def repaired(turns: DataFrame) -> DataFrame:
    """``OUT``: damage, faults, cheapest edits and the checksum of what they give."""
    rows = damaged(turns)
    found = audits(described(rows))
    names = [f.split(" ")[0] for f in OUT.split(", ")]
    texts = rows.where("present").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    both = found.withColumn("part", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest").select(*names[:-1], "part", "role", "text")

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            done = []
            for *row, part, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part:
                    own.add(role, text)
                    continue
                if own is not None:
                    done.append(own.done())
                own = _Repaired(tuple(row))
            yield out(done)
        if own is not None:
            yield out([own.done()])

    return ordered.mapInArrow(run, OUT)
