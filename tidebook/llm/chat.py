"""Chat formatting: a template is a black box from turns to text; spans come from rendering successive prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Control strings of the bracket template (fixed values).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]")
#: What stands for a text when its place is looked for; a private-use character.
MARK = "\ue000"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_ESCAPED_ROLE = re.compile(r"\\([\\n]?)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of a control string, so that none is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """escape(), and a line feed, which ends a role, as a backslash and n: no control string goes on with an n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def bracket(turns: list[Turn]) -> str:
    """The bracket template: user turns in [INST], system turns in <<SYS>>, assistant turns closed by </s>, others in [TURN] with their role."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "system":
            out.append(f"<<SYS>> {escape(text)} <</SYS>>")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            out.append(f"[TURN]{escape_role(role)}\n{escape(text)}[/TURN]")
    return "".join(out)


_PIECE = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|\[TURN\](?P<role>.*?)\n(?P<other>.*?)\[/TURN\]| (?P<assistant>.*?) </s>", re.S)


def read_bracket(text: str) -> list[Turn]:
    """The turns of a text that bracket() made."""
    turns, at = [], len("<s>")
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape_role(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


def spans_of(template: Template, turns: list[Turn], learn: str = "assistant") -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], int]:
    """(rendered text, span of each turn, spans under the loss mask, number of turns that rewrote history).

    Prefix k+1 is rendered and compared with prefix k: what was added is turn k's span. If the longer output doesn't
    begin with the shorter one, the template rewrote history; the span then starts at the first difference, and spans
    before it are cut there. The text of a turn of role learn is found inside its span by rendering that turn with a
    mark in its place; where the surroundings don't match, the whole span counts.
    """
    spans: list[tuple[int, int]] = []
    loss: list[tuple[int, int]] = []
    rewritten, before = 0, template([])
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            rewritten += 1
            low, high = 0, min(len(before), len(now))
            while low < high:  # the first difference, by bisection on equal prefixes
                mid = (low + high + 1) // 2
                low, high = (mid, high) if before[:mid] == now[:mid] else (low, mid - 1)
            start = low
            spans = [(min(a, start), min(b, start)) for a, b in spans]
            loss = [(a, min(b, start)) for a, b in loss if a < start]
        spans.append((start, len(now)))
        if role == learn:
            marked = template([*turns[:k], (role, MARK)])
            at = marked.find(MARK, start)
            tail = len(marked) - at - len(MARK)
            fits = at >= start and marked[:at] == now[:at] and marked[at + len(MARK) :] == now[len(now) - tail :]
            loss.append((at, len(now) - tail) if fits else (start, len(now)))
        before = now
    return before, spans, loss, rewritten


def format_chats(rows: DataFrame, template: Template = bracket, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans and loss (arrays of start and end in code points), rewritten for each conversation.

    rows: conv_id, turn, role, text. Turns go by turn; equal ones by role and text, so repeated rows give repeated
    turns. Null texts and roles are empty; null conv_ids make one conversation. A conversation is one output row, so
    its turns meet in one row too; as each prefix is rendered anew, its time grows with the square of its turns. Other
    columns of rows are left out. An empty table stays empty.
    """

    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(template, [(t["role"], t["text"]) for t in turns], learn) for turns in batch.column(1).to_pylist()]
            pairs = lambda k: pa.array([[{"start": a, "end": b} for a, b in x[k]] for x in found], pair)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pairs(1), pairs(2), pa.array([x[3] for x in found], pa.int32())], names=["conv_id", "formatted", "spans", "loss", "rewritten"])

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = "array<struct<start:long,end:long>>"
    return by.mapInArrow(formatted, f"conv_id long, formatted string, spans {kind}, loss {kind}, rewritten int")


def digests(chats: DataFrame, read: Callable[[str], list[Turn]] = read_bracket) -> DataFrame:
    """What is read back from format_chats(): counts and digests of the turns and of the text under the loss mask."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read(text)
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    wanted = chats.select("conv_id", "formatted", "loss")
    return wanted.mapInArrow(digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
