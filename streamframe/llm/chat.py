"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Successive prefixes of a
conversation are rendered and consecutive outputs compared: what a turn adds is its
span; where an output does not begin with the one before, the template rewrites
history, which is reported, and the span begins where the two part. A probe text in
the turn's place shows where in its span the text stands, so the loss mask covers the
assistant's texts and no marker.

Prefixes are whole, so the work grows with the square of a conversation. Of the default
template it is known that what a turn adds depends on that turn alone: from turn WHOLE on,
its prefixes are rendered with their first HEAD and last RECENT turns only, which gives
the same spans in linear work. Rows
are sorted within hash partitions and read as a stream: a task holds one conversation's
turns, never a partition.

Defined results: null role or text is empty. Turns stand by turn (null first), then
role, then text; rows that repeat are turns each. A null conv_id is a conversation of its own.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

WHOLE, HEAD, RECENT = 64, 2, 30
PROBE = "\x02probe\x02"

#: The control strings of the template.
BEGIN = "<s>"
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[ASST]"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER, AS, END = "[ROLE]", "[AS]", "[/ROLE]"
CONTROL = (BEGIN, *OPEN.values(), *CLOSE.values(), OTHER, AS, END)

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_GUARD = re.compile(r"\\(\\?)")
_TURN = re.compile(
    "|".join(rf"(?P<{r}>{re.escape(OPEN[r])}(?P<{r}_text>.*?){re.escape(CLOSE[r])})" for r in OPEN)
    + rf"|(?P<other>{re.escape(OTHER)}(?P<role>.*?){re.escape(AS)}(?P<other_text>.*?){re.escape(END)})",
    re.S,
)


def escape(text: str) -> str:
    """Double backslashes, then guard each control string with one after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _GUARD.sub(r"\1", text)


def template(turns: Sequence[Turn]) -> str:
    """The default template: every turn between its role's markers, texts escaped."""
    out = [BEGIN]
    for role, text in turns:
        if role in OPEN:
            out += (OPEN[role], escape(text), CLOSE[role])
        else:
            out += (OTHER, escape(role), AS, escape(text), END)
    return "".join(out)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a string that the default template made."""
    if not formatted.startswith(BEGIN):
        raise ValueError("it does not begin with the begin mark")
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        kind = m.lastgroup if m.lastgroup in OPEN or m.lastgroup == "other" else next(r for r in (*OPEN, "other") if m[r] is not None)
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[f"{kind}_text"])))
        at = m.end()
    return turns


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common prefix, by halves
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def spans(turns: Sequence[Turn], render: Template = template) -> Iterator[tuple[int, int, int, int, bool]]:
    """Per turn: the start and end of what it adds, the start and end of its text, and whether the template rewrote history.

    Positions are in the rendering of the whole conversation, given that it appends;
    where it rewrites, they are positions in the turn's own prefix.
    """
    offset, before, local = 0, render([]), render is template
    for k, (role, text) in enumerate(turns):
        head, low = (), 0
        if local and k >= WHOLE:
            head, low = turns[:HEAD], k - RECENT
            before = render([*head, *turns[low:k]])
        prefix = [*head, *turns[low:k]]
        now, probe = render([*prefix, (role, text)]), render([*prefix, (role, PROBE)])
        rewrites = not now.startswith(before)
        start = _common(before, now) if rewrites else len(before)
        at = probe.find(PROBE, _common(before, probe) if rewrites else start)
        tail = len(probe) - at - len(PROBE) if at >= 0 else 0
        shift = offset - len(before) if local and k >= WHOLE else 0
        yield start + shift, len(now) + shift, (at if at >= 0 else start) + shift, len(now) - tail + shift, rewrites
        offset = len(now) + shift
        before = now


def format_conversation(turns: Sequence[Turn], render: Template = template) -> tuple[str, list[tuple[int, int]], bool]:
    """The formatted string, the loss spans (the assistant's texts), and whether the template rewrites history."""
    loss, rewrites = [], False
    for (role, _), (_, _, low, high, changed) in zip(turns, spans(turns, render)):
        rewrites |= changed
        if role == "assistant":
            loss.append((low, high))
    return render(turns), loss, rewrites


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    started, key, turns = False, None, []
    for b in batches:
        for k, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if started and k != key:
                yield key, turns
                turns = []
            started, key = True, k
            turns.append((role or "", text or ""))
    if started:
        yield key, turns


_OUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rewrites", pa.bool_())])


def format_chats(conversations: DataFrame, render: Template = template) -> DataFrame:
    """conv_id, formatted, loss (spans of code points), rewrites: one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for key, turns in _conversations(batches):
            text, loss, rewrites = format_conversation(turns, render)
            rows.append((key, text, [{"start": s, "end": e} for s, e in loss], rewrites))
            held += len(text)
            if len(rows) >= 512 or held > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("role"), F.col("text"), F.col("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start: long, end: long>>, rewrites boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text, loss in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = read_back(text)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                under = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                out.append((key, len(turns), digest, len(under), hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
