"""Chat formatting in budgeted windows.

Turns are written between markers, control strings in texts are escaped.  Running sums of turn
tokens cut a conversation into spans of whole turns; every window repeats the system turn and a
limited history, whose targets are masked so that each assistant text is trained on once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</turn>\n"
TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in TITLES.items()}
WINDOWS = "conv_id long, window long, text string, n_tokens long, over_budget boolean, n_context long, n_turns long, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    """Backslashes are doubled; the starts of markers get one in front."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def head(role: str) -> str:
    """The marker before a text; roles without a title are written as they are, escaped."""
    title = TITLES.get(role) or ("\\" if role in ROLES else "") + escape(role).replace(":", "\\:")
    return f"### {title}: "


def tokens(role: str, text: str) -> int:
    """Tokens of a turn for the budget: a quarter of its characters, rounded up, and four for its markers."""
    return (len(text) + 3) // 4 + 4


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a formatted window; start and end enclose the escaped text."""
    found, at = [], 0
    turn = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
    while at < len(text):
        m = turn.match(text, at)
        if not m:
            raise ValueError("not a formatted window")
        found.append((ROLES.get(m[1]) or unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return found


class _Conversation:
    """Windows of one conversation, from turns that come in order; holds the open window and the history only."""

    def __init__(self, key, budget: int, history: int) -> None:
        self.key, self.budget, self.history = key, budget, history
        self.sums, self.turns, self.system, self.number, self.context = [0], [], None, 0, 0

    def add(self, role: str, text: str):
        cost = tokens(role, text)
        if self.system is None and not self.turns and role == "system":
            self.system = (role, text, cost)
            return None
        out = None
        fixed = self.system[2] if self.system else 0
        if len(self.turns) > self.context and fixed + self.sums[-1] - self.sums[0] + cost > self.budget:
            out = self.window()
            room = min(self.history, self.budget - fixed - cost)  # for turns that are shown again
            first = bisect_left(self.sums, self.sums[-1] - room) if room > 0 else len(self.turns)
            self.turns, self.sums = self.turns[first:], self.sums[first:]
            self.context = len(self.turns)
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + cost)
        return out

    def window(self) -> tuple:
        shown = ([self.system[:2]] if self.system else []) + self.turns
        context = self.context + (1 if self.system and self.number else 0)
        parts, loss, at = [], [], 0
        for k, (role, text) in enumerate(shown):
            body, start = escape(text), at + len(head(role))
            parts += [head(role), body, END]
            if role == "assistant" and k >= context:
                loss.append({"start": start, "end": start + len(body)})
            at = start + len(body) + len(END)
        total = (self.system[2] if self.system else 0) + self.sums[-1] - self.sums[0]
        row = (self.key, self.number, "".join(parts), total, total > self.budget, context, len(shown), loss)
        self.number += 1
        return row

    def last(self) -> list[tuple]:
        return [self.window()] if len(self.turns) > self.context or self.system and not self.number else []


def chat_windows(turns: DataFrame, budget: int = 512, history: int = 128, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted windows of at most ``budget`` tokens, in order within each conversation.

    Turns are taken by (turn, role, text); rows that repeat are turns of their own, null roles and
    texts are empty ones, null conversation ids form one conversation.  A turn that exceeds the
    budget with the system turn has a window to itself (``over_budget``); nothing is cut.  The
    shuffle is by conversation and rows then stream in order, so a conversation of any length
    needs the memory of one window.  An empty table gives no window; other columns are not looked
    at, whatever their names.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in WINDOWS.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
        now: _Conversation | None = None
        for b in it:
            rows, size = [], 0
            for key, r, t in zip(b["conv_id"], b["role"], b["text"], strict=True):
                key = None if pd.isna(key) else int(key)
                if now is None or now.key != key:
                    rows += now.last() if now else []
                    now = _Conversation(key, budget, history)
                if (done := now.add(r or "", t or "")) is not None:
                    rows.append(done)
                    size += len(done[2])
                if size > 8_000_000:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)
        if now:
            yield frame(now.last())

    own = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInPandas(batches, WINDOWS)


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say when they are parsed again; takes the rows of ``chat_windows`` in their order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    columns = [x.split()[0] for x in schema.split(", ")]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed(x) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6]

        now: list | None = None
        for b in it:
            rows = []
            for key, window, text, context, loss in zip(b["conv_id"], b["window"], b["text"], b["n_context"], b["loss"], strict=True):
                key = None if pd.isna(key) else int(key)
                if window == 0:
                    rows += [closed(now)] if now else []
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for r, t, *_ in parse(text)[int(context) :]:
                    now[1] += 1
                    now[2].update(f"{r}\n{t}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
                now[6] += 1
            yield pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
        if now:
            yield pd.DataFrame([closed(now)], columns=columns).astype({"conv_id": "Int64"})

    return windows.mapInPandas(batches, schema)


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose two texts look like markers."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
