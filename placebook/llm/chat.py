"""Conversations as training windows of whole turns within a token budget.

Formatted turns are counted in tokens before anything moves. In each conversation the running sums
of its turns' tokens choose spans: a window takes new turns while the sum since its first
fits what the budget leaves. The conversation's leading system turn opens every window; a
few turns before the span are repeated as history within a budget of their own. Only
assistant turns that are new carry loss, so a repeated target is masked and each target is
learned once. A turn that does not fit the budget beside the system turn makes a window
with it alone, the only kind that exceeds the budget.

``<|im_start|>role<|im_sep|>text<|im_end|>`` marks a turn. Control strings of common
templates inside roles and texts get a backslash after their first character, backslashes
are doubled; ``unescape`` undoes both.

A conversation is streamed in turn order through one task: it keeps one window in memory,
whatever the conversation's length. Its checksums need that order.

* Null text or role: empty. Null conversation id: one conversation of its own.
* Repeated turn numbers: ordered by role, then by the text's hash; every row is a turn.
* Very long turns: a window of their own; memory follows the longest.
* No assistant turn: no loss; its digest is that of nothing. Empty table: no rows.
* Columns other than ``conv_id, turn, role, text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.common import stored, text_or_empty, within_arrow
from placebook.llm.tokens import default_tokenizer, encoder

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
BATCH_BYTES = 2_000_000
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Control strings of common chat templates.
CONTROLS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.DOTALL)
WINDOWS = "conv_id long, window int, n_repeated int, n_tokens long, formatted string, loss array<struct<start:int,length:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> str:
    """A turn as windows hold it. The line feed after it is a token of its own, so a
    window has as many tokens as its turns together."""
    return START + escape(role) + MIDDLE + escape(text) + END


def counted(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, turn, role, text, n_tokens``; nulls of role and text are empty. Counted is
    the turn as it is formatted, marks and escapes included."""
    schema = "conv_id long, turn long, role string, text string, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            turns = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            sizes = [len(x) // 4 for x in encode([formatted(*t) for t in turns])]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "n_tokens"])

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    return plain.mapInArrow(run, schema)


class _Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_tokens = budget, history_tokens
        self.last: deque = deque(maxlen=history_turns or None)
        self.keeps = history_turns > 0
        self.system: tuple[str, str, int] | None = None
        self.number = self.taken = 0
        self.sum = self.sum_at_start = 0  # running sums of new turns
        self.ahead: list = []
        self.new: list = []

    def room(self) -> int:
        return self.budget - sum(t[2] for t in self.ahead)

    def add(self, turn: tuple[str, str, int]):
        """Take the next turn; returns a finished window or nothing."""
        done = None
        if self.new and self.sum + turn[2] - self.sum_at_start > self.room():
            done = self.finish()
            self.ahead = [self.system] if self.system else []
            self.sum_at_start, left, history = self.sum, self.history_tokens, []
            for t in reversed(self.last):
                left -= t[2]
                if left < 0 or t is self.system:
                    break
                history.insert(0, t)
            while history and sum(t[2] for t in history) + turn[2] > self.room():
                del history[0]
            self.ahead += history
        if not self.taken and turn[0] == "system":
            self.system = turn
        self.taken += 1
        self.sum += turn[2]
        self.new.append(turn)
        if self.keeps:
            self.last.append(turn)
        return done

    def finish(self):
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate([*self.ahead, *self.new]):
            head, body = START + escape(role) + MIDDLE, escape(text)
            if i >= len(self.ahead) and role == "assistant" and body:
                loss.append({"start": at + len(head), "length": len(body)})
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        out = (self.number, len(self.ahead), sum(t[2] for t in [*self.ahead, *self.new]), "".join(parts), loss)
        self.number += 1
        self.new = []
        return out


def windows(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``conv_id, window, n_repeated, n_tokens, formatted, loss``: one row per window.

    ``n_repeated`` turns at the start are repeats; ``loss`` lists spans of ``formatted``.
    """
    ordered = counted(turns, tokenizer or default_tokenizer()).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = object(), None

        def out(rows: list) -> pa.RecordBatch:
            names = [f.split(" ")[0] for f in WINDOWS.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            rows = []
            for conv, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n_tokens")), strict=True):
                if own is None or conv != current:
                    if own is not None:
                        rows.append((current, *own.finish()))
                    current, own = conv, _Windows(budget, history_turns, history_tokens)
                if (done := own.add((role, text, n))) is not None:
                    rows.append((conv, *done))
            yield out(rows)
        if own is not None:
            yield out([(current, *own.finish())])

    return ordered.mapInArrow(run, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows: turns and loss text as checksums and counts."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = object(), None

        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

        def closed() -> tuple:
            n, turns, chars, loss, formatted_chars, count = own
            return current, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, count

        for batch in batches:
            rows = []
            for conv, repeated, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "formatted", "loss")), strict=True):
                if own is None or conv != current:
                    if own is not None:
                        rows.append(closed())
                    current, own = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in _TURN.findall(text)[repeated:]:
                    own[0] += 1
                    own[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["start"] + span["length"]])
                    own[2] += len(target)
                    own[3].update(target.encode())
                own[4] += len(text)
                own[5] += 1
            yield out(rows)
        if own is not None:
            yield out([closed()])

    return ordered.mapInArrow(run, schema)


def formatted_digest(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Format, write, read the windows back, and describe each conversation by them."""
    return read_back(stored(windows(turns, tokenizer), "chat-windows"))


def with_control_case(turns: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two turns are control strings."""
    rows = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(["user", "assistant"])]
    own = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)
