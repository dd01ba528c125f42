"""Chat formatting by a template that is only called, never read: spans of turns are found by rendering longer and longer prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: A text that no template should change: a character for private use.
PROBE = ""
#: Turns that are rendered together, and those before them that are rendered again so that their surroundings are the same.
WINDOW, CONTEXT = 24, 2

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Puts one more backslash between < and |, so that no control string is left; unescape() takes it away."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def marked_turns(turns: list[Turn]) -> str:
    """The template of this module: each turn between marks, the role in a line of its own, control strings escaped."""
    line = lambda role: escape(role).replace("\\", "\\\\").replace("\n", "\\n")
    return "".join(f"{START}{line(role)}\n{escape(text)}{END}\n" for role, text in turns)


def read_role(head: str) -> str:
    """The role from what stands before a turn's text in marked_turns()."""
    line = head[head.index(START) + len(START) : -1]
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


def common(a: str, b: str) -> int:
    return len(a) if b.startswith(a) else len(commonprefix([a, b]))


def locate_turns(render: Callable[[list[Turn]], str], turns: list[Turn], first: int, stop: int, ends: bool) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendering of turns[:stop + 1] and, for turns first to stop - 1, (start, end, text_start, text_end) in it.

    Outputs of successive prefixes are compared: a turn begins where the output with it departs from that without it. What
    the shorter output has beyond that place is a trailer if the longer one ends with it too; otherwise the template has
    rewritten history, which the last value tells. The place of the text comes from the same prefix with a probe as its
    last text; it is -1, -1 if the text is not there as escaped. The last turn ends with the output if `ends`, else where
    the turn at `stop` begins."""
    outs = [render(turns[:k]) if k else "" for k in range(first, min(stop + 1, len(turns)) + 1)]
    starts, rewrites = [], False
    for k, (before, after) in enumerate(zip(outs, outs[1:])):
        at = common(before, after)
        trailer = before[at:]
        rewrites |= not after.endswith(trailer) or len(after) - len(trailer) < at or bool(starts) and at < starts[-1]
        starts.append(at)
    if ends:
        starts.append(len(outs[-1]))
    spans = []
    for k in range(first, stop):
        start, end, out = starts[k - first], starts[k - first + 1], outs[k - first + 1]
        probed = render([*turns[:k], (turns[k][0], PROBE)])
        at = probed.find(PROBE, start)
        text_end = len(out) - (len(probed) - at - len(PROBE))
        good = at >= 0 and at <= text_end <= end and unescape(out[at:text_end]) == turns[k][1]
        spans.append((start, end, at, text_end) if good else (start, end, -1, -1))
    return outs[-1], spans, rewrites


#: Characters of formatted text that a task gathers before it passes them on.
BATCH = 1_000_000
PIECE = [
    *(pa.field(name, pa.int64()) for name in ("piece", "turn", "offset")), pa.field("formatted", pa.string()),
    pa.field("turns", pa.list_(pa.struct([*((name, pa.int64()) for name in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())]))), pa.field("rewrites", pa.bool_()),
]
SPANS = "array<struct<start:long,end:long,text_start:long,text_end:long,loss:boolean>>"


def conversation_pieces(turns: Iterator[Turn], render: Callable[[list[Turn]], str], window: int, context: int, loss_role: str) -> Iterator[dict]:
    """Pieces of one conversation in turn, each with its spans. Only a window of turns is held."""
    held: list[Turn] = []
    first = piece = offset = at = 0
    seen, done = "", False
    while not done:
        while len(held) < first + window + 1 and (turn := next(turns, None)) is not None:
            held.append(turn)
        done = len(held) <= first + window
        stop = len(held) if done else len(held) - 1
        # turns rendered again must look as they did: if not, the template looks further back than the context
        again = max(first - 1, 0)
        out, spans, rewrites = locate_turns(render, held, again, stop, done)
        if first > 1:
            rewrites |= out[spans[0][0] : spans[0][1]] != seen
        new = spans[first - again :]
        begin, finish = (new[0][0], new[-1][1]) if new else (0, 0)
        begin = 0 if not piece else begin
        shift = lambda x: x - begin if x >= 0 else x  # noqa: E731, B023
        rows = [{"start": shift(s), "end": shift(e), "text_start": shift(a), "text_end": shift(b), "loss": held[first + k][0] == loss_role and a >= 0} for k, (s, e, a, b) in enumerate(new)]
        yield {"piece": piece, "turn": at, "offset": offset, "formatted": out[begin:finish], "turns": rows, "rewrites": rewrites}
        seen = out[new[-1][0] : new[-1][1]] if new else ""
        piece, at, offset = piece + 1, at + len(new), offset + finish - begin
        keep = min(context, stop)
        held, first = held[stop - keep :], keep


def format_conversations(conversations: DataFrame, render: Callable[[list[Turn]], str] = marked_turns, loss_role: str = "assistant", window: int = WINDOW, context: int = CONTEXT) -> DataFrame:
    """Conversations as the template renders them, with the place of every turn and of the text that training is to learn.

    Returns rows of at most `window` turns in order, without a gap: conv_id, piece (from 0), turn (number of its first one),
    offset (of its first character in the conversation), formatted, turns (start, end, text_start, text_end and loss of
    each, in characters of `formatted`; text_start is -1 where the template does not show the text as escaped) and
    rewrites, true if the template changed what it had rendered for earlier turns, or depends on more than `context` turns
    before; spans of such a row are those of its last rendering. The pieces of a conversation make up its whole text.

    Rows go by turn, ties by role and text, nulls first. Null role and text are empty; rows with a null conv_id are one
    conversation. Equal rows are turns of their own. An empty table gives no rows; other columns are ignored. A conversation
    is streamed through one task, which holds a window of turns, because it is rendered and hashed in order.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = ((batch.schema.field(0), *row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        coming, ready, size = next(flat, None), [], 0
        while coming is not None:
            field, current = coming[:2]
            schema = pa.schema([field, *PIECE])

            def turns() -> Iterator[Turn]:
                nonlocal coming
                while coming is not None and coming[1] == current:  # noqa: B023
                    turn = coming[2:]
                    coming = next(flat, None)
                    yield turn

            for row in conversation_pieces(turns(), render, window, context, loss_role):
                ready.append({field.name: current, **row})
                size += len(row["formatted"])
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return rows.mapInArrow(work, f"conv_id {kind}, piece long, turn long, offset long, formatted string, turns {SPANS}, rewrites boolean")


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what format_conversations() wrote by marked_turns(), read from the formatted text and its spans alone: conv_id,
    n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 (texts under the loss
    mask), formatted_chars. Takes the pieces as that function returns them, those of a conversation after each other."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state = None

        def result(state: list) -> pa.RecordBatch:
            key, n, turns, loss, learnt, chars = state
            return pa.RecordBatch.from_arrays([key, *(pa.array([x]) for x in (n, turns.hexdigest(), loss, learnt.hexdigest(), chars))], names)

        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in ("piece", "formatted", "turns")}
                if row["piece"] == 0:
                    if state:
                        yield result(state)
                    state = [batch.column(0).slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for t in row["turns"]:
                    if t["text_start"] < 0:
                        raise ValueError("a turn's text is not in its rendering")
                    own = unescape(text[t["text_start"] : t["text_end"]])
                    state[2].update(f"{read_role(text[t['start'] : t['text_start']])}\n{own}\n".encode())
                    if t["loss"]:
                        state[3] += len(own)
                        state[4].update(own.encode())
                state[1] += len(row["turns"])
                state[5] += len(text)
        if state:
            yield result(state)

    return pieces.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
