r"""Chat formatting with budgeted windows.

A turn is written as ``### role: text </turn>`` and a newline. Inside roles and texts a
backslash is put before every backslash and control string, so that the format can be
read back whatever a text says.

Prefix sums of the turns' tokens choose spans of whole turns: each window holds the
system turn, as much of the preceding turns as the history budget allows, and then new
turns up to the budget (one at least, however long). An assistant text is a target in
the one window where it is new; where it is repeated as history it is masked.

One pass over turns sorted within their conversation keeps one window and its history in
memory, so a conversation of any length is formatted in bounded memory; its turns do
meet in one task, because windows and digests depend on their order.

Defined cases: a null role or text is empty; turns sort by number (nulls first), then
role, then text; repeated rows are turns of their own; a null conversation id is a
conversation; an empty table gives no windows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import bounded_batches

OPEN, CLOSE, NEXT = "### ", " </turn>\n", ": "
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
WINDOWS = "conv_id long, window long, formatted string, n_repeated int, loss array<struct<start:int,end:int>>"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("n_repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def estimated_tokens(text: str) -> int:
    """A quarter of the bytes, rounded up."""
    return (len(text.encode("utf-8", "surrogatepass")) + 3) // 4


class Windows:
    """Windows of one conversation, fed turn by turn."""

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]):
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: tuple | None = None
        #: Turns that a window may still need, their prefix sums, and where new ones begin.
        self.turns: list[tuple[str, str, bool]] = []
        self.sums = [0]
        self.new = self.n = self.windows = 0

    def _fixed(self) -> int:
        return self.system[1] if self.system else 0

    def _from(self) -> int:
        """The first turn of the history: the longest run within its budget."""
        return min(self.new, bisect_left(self.sums, self.sums[self.new] - self.history))

    def add(self, role: str, text: str) -> Iterator[dict]:
        turn = (OPEN + escape(role).replace(":", "\\:") + NEXT, escape(text), role == "assistant")
        size = self.tokens(turn[0] + turn[1] + CLOSE)
        first = self.n == 0
        self.n += 1
        if first and role == "system":
            self.system = (turn, size, False)
            return
        if self.new < len(self.turns) and self._fixed() + self.sums[-1] + size - self.sums[self._from()] > self.budget:
            yield self.flush()
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + size)

    def flush(self) -> dict:
        """The window of the turns that are new; they then become history."""
        begin = self._from()
        while begin < self.new and self._fixed() + self.sums[-1] - self.sums[begin] > self.budget:
            begin += 1
        out, spans, at = [], [], 0
        repeated = self.new - begin
        if self.system:
            repeated += self.system[2]
            out.append("".join(self.system[0][:2]) + CLOSE)
            at = len(out[0])
            self.system = (self.system[0], self.system[1], True)
        for k in range(begin, len(self.turns)):
            head, text, target = self.turns[k]
            if target and k >= self.new and text:
                spans.append({"start": at + len(head), "end": at + len(head) + len(text)})
            out.append(head + text + CLOSE)
            at += len(out[-1])
        made = {"window": self.windows, "formatted": "".join(out), "n_repeated": repeated, "loss": spans}
        self.windows += 1
        self.new = len(self.turns)
        cut = self._from()
        self.turns, self.sums, self.new = self.turns[cut:], [x - self.sums[cut] for x in self.sums[cut:]], self.new - cut
        return made

    def close(self) -> Iterator[dict]:
        if self.new < len(self.turns) or self.windows == 0:
            yield self.flush()


def _format(budget: int, history: int, tokens: Callable[[str], int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows, held = object(), None, [], 0
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != key:
                    rows += [{"conv_id": key} | w for w in state.close()] if state else []
                    key, state = conv, Windows(budget, history, tokens)
                rows += [{"conv_id": conv} | w for w in state.add(role, text)]
                held += len(text)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        rows += [{"conv_id": key} | w for w in state.close()] if state else []
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return of


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 512, tokens: Callable[[str], int] = estimated_tokens) -> DataFrame:
    """Windows of all conversations of ``turns`` (conv_id, turn, role, text).

    ``loss`` lists the spans of ``formatted``, in code points, that are trained on;
    ``n_repeated`` is how many of a window's turns an earlier window has already shown.
    Rows of a conversation come out together and in order.
    """
    bounded_batches(turns.sparkSession)
    t = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.drop("turn").mapInArrow(_format(budget, history, tokens), WINDOWS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window; ValueError if it is no sequence of turns."""
    out, at = [], 0
    while at < len(formatted):
        m, end = _HEAD.match(formatted, at), formatted.find(CLOSE, at)
        if not m or end < m.end() - 1:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(formatted[m.end() : end])))
        at = end + len(CLOSE)
    return out


#: Digests of what read_back finds.
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, started, rows = None, False, []

    def done() -> dict:
        return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total, "n_windows": windows}

    for b in batches:
        for conv, text, repeated, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "n_repeated", "loss")), strict=True):
            if not started or conv != key:
                rows += [done()] if started else []
                key, started = conv, True
                turns, loss, n, chars, total, windows = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for role, said in parse(text)[repeated:]:
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for s in spans:
                said = unescape(text[s["start"] : s["end"]])
                loss.update(said.encode())
                chars += len(said)
            total += len(text)
            windows += 1
        yield pa.RecordBatch.from_pylist(rows, _DIGESTS)
        rows = []
    yield pa.RecordBatch.from_pylist([done()] if started else [], _DIGESTS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, from windows as ``chat_windows`` orders them."""
    return windows.mapInArrow(_digest, DIGESTS)
