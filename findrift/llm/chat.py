"""Chat formatting in budgeted windows.

The rows of a conversation, in turn order, stream through one sorted partition; nothing of a
conversation is held but the open window.  Prefix sums of turn tokens choose turn-aligned windows
within the budget; each later window repeats the system turn and a limited history, masked, so every
assistant text is a target once.

A turn is ``<|ROLE|>TEXT<|end|>``; inside texts and roles ``\\`` becomes ``\\\\`` and ``<`` becomes
``\\l``, in roles ``|`` becomes ``\\p``, so no text can hold a mark, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread

BUDGET, HISTORY = 1024, 2
TARGET = "assistant"
SYSTEM = "system"

WINDOW_SCHEMA = (
    "conv_id {kind}, window bigint, n_tokens bigint, first_turn bigint, last_turn bigint, formatted string, "
    "fresh array<int>, loss array<struct<start:int,end:int>>"
)
_TOKEN = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(r"<\|([^<|]*)\|>([^<]*)<\|end\|>")


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\l")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "p": "|"}.get(m[1], m[1]), s, flags=re.S)


def count_tokens(s: str) -> int:
    """Words and signs; any other counter may be given instead."""
    return sum(1 for _ in _TOKEN.finditer(s))


def turn_tokens(role: str, text: str, counter=count_tokens) -> int:
    """Tokens of a whole turn: its role, its text and two for the marks around it, so never none."""
    return 2 + counter(role) + counter(text)


class _Conversation:
    """Turns one conversation's stream of turns into windows."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.fresh_from = 0  # in self.turns: those before are repeated history
        self.total = 0
        self.number = 0
        self.next_turn = 0

    def _emit(self, led: bool) -> dict:
        text, fresh, loss = [], [], []
        at = n = 0
        shown = ([self.system] if led and self.system else []) + self.turns
        repeated = len(shown) - len(self.turns) + self.fresh_from
        for i, (role, body, tokens) in enumerate(shown):
            head, inner = f"<|{escape(role).replace('|', chr(92) + 'p')}|>", escape(body)
            if i >= repeated:
                fresh.append(i)
                if role == TARGET:
                    loss.append({"start": at + len(head), "end": at + len(head) + len(inner)})
            piece = f"{head}{inner}<|end|>"
            text.append(piece)
            at += len(piece)
            n += tokens
        count = len(shown) - repeated
        out = {"window": self.number, "n_tokens": n, "first_turn": self.next_turn, "last_turn": self.next_turn + count - 1,
               "formatted": "".join(text), "fresh": fresh, "loss": loss}
        self.number += 1
        self.next_turn += count
        return out

    def add(self, role: str, body: str, tokens: int) -> dict | None:
        """Takes one turn; returns the window that it closed, if any."""
        out = None
        if len(self.turns) > self.fresh_from and self.total + tokens > self.budget:
            out = self._emit(led=self.number > 0)
            room = self.budget - tokens - (self.system[2] if self.system else 0)
            past: list[tuple[str, str, int]] = []
            for turn in reversed(self.turns):
                if len(past) == self.history or turn is self.system or turn[2] > room:
                    break
                past.insert(0, turn)
                room -= turn[2]
            self.turns, self.fresh_from = past, len(past)
            self.total = (self.system[2] if self.system else 0) + sum(t[2] for t in past)
        turn = (role, body, tokens)
        if not self.number and not self.turns and role == SYSTEM:
            self.system = turn
        self.turns.append(turn)
        self.total += tokens
        return out

    def end(self) -> dict | None:
        return self._emit(led=self.number > 0) if len(self.turns) > self.fresh_from else None


def format_chat(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, counter=count_tokens) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as windows of formatted text.

    Returns conv_id, window (from 0), n_tokens, first_turn and last_turn (positions of the turns that
    are new in it), formatted, fresh (positions of the new turns among the window's turns) and loss
    (spans in code points, end exclusive, of the new assistant texts).  A window holds turns up to
    ``budget`` tokens, or one longer turn alone with the system turn; nothing is cut.  A leading
    system turn and up to ``history`` turns that fit are repeated without loss.  Null roles and texts
    are empty; a turn's tokens are those of its role, its text and its two marks; turns sort by (turn, role, text), nulls first; repeated rows are turns of their own;
    rows of a null conv_id are one conversation; other columns are ignored.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    schema = WINDOW_SCHEMA.format(kind=kind)
    n = spread(df)
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The conversation's hash spreads the rows; the sort within streams a long one without holding it.
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = None
        current, talk, began = None, None, False
        for b in batches:
            out: list[dict] = []
            size = 0
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not began or conv != current:
                    if talk and (w := talk.end()):
                        out.append({"conv_id": current, **w})
                    current, talk, began = conv, _Conversation(budget, history), True
                if w := talk.add(role, text, turn_tokens(role, text, counter)):
                    out.append({"conv_id": current, **w})
                size += len(text)
                if size > 1 << 24 and out:
                    into = into or _arrow(b.schema.field(0).type)
                    yield pa.RecordBatch.from_pylist(out, into)
                    out, size = [], 0
            if out:
                into = into or _arrow(b.schema.field(0).type)
                yield pa.RecordBatch.from_pylist(out, into)
            into = into or _arrow(b.schema.field(0).type)
        if talk and (w := talk.end()):
            yield pa.RecordBatch.from_pylist([{"conv_id": current, **w}], into)

    return ordered.mapInArrow(run, schema)


def _arrow(kind: pa.DataType) -> pa.Schema:
    span = pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())])
    return pa.schema(
        [("conv_id", kind), ("window", pa.int64()), ("n_tokens", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
         ("formatted", pa.string()), ("fresh", pa.list_(pa.int32())), ("loss", pa.list_(span))]
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def digest(windows: DataFrame) -> DataFrame:
    """Reads windows back and returns one row per conversation with its digests.

    Windows must come as ``format_chat`` gives them: a conversation's windows follow each other in
    one partition.
    """
    kind = windows.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done() -> list:
            conv, turns, all_, chars, loss, total = state
            return [conv, turns, all_.hexdigest(), chars, loss.hexdigest(), total]

        for b in batches:
            out = []
            for conv, number, text, fresh, spans in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if number == 0:
                    if state:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                for i in fresh:
                    role, body = turns[i]
                    state[2].update(f"{role}\n{body}\n".encode())
                state[1] += len(fresh)
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    state[3] += len(body)
                    state[4].update(body.encode())
                state[5] += len(text)
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds, strict=True)], names=names)

    schema = T.StructType(
        [T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
         T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    )
    return windows.select("conv_id", "window", "formatted", "fresh", "loss").mapInArrow(run, schema)
