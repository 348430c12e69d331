"""Chat formatting with spans found by rendering, for templates that are only known as a function.

A template is any function from a list of (role, text) turns to a string.  Successive prefixes of a
conversation are rendered; where each output begins with the one before, the difference is the turn's
span, and rendering the turn once more with a probe for its text tells where its text stands inside.
Where an output does not begin with the one before, the template rewrites history: the conversation is
marked, and its whole output is returned as one piece without spans.

Conversations stream through tasks in order.  The prefixes are those of the whole conversation, which is
held until its last turn; its cost grows with the square of its length.  A template that is declared
`local` (what it gives for turns is the outputs of the single turns, one after the other) is rendered in
blocks of `BLOCK` turns, and a conversation is never held as a whole.  `instruction_template` is local.

The default template marks turns with control strings.  Control strings inside texts get one backslash
more than they have, and lose it when read back, so formatting is reversible for every text.

Defined cases: null texts and roles count as empty; turns are ordered by turn, then role and text, nulls
first, and equal rows are turns of their own; rows without a conversation id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.shared import narrow
from rankwell.scratch import staged

Template = Callable[[list[tuple[str, str]]], str]
#: Turns of a local template whose prefixes are rendered together.
BLOCK = 16
_CONTROL = r"(?:</?s>|\[/?INST\]|\[/?ROLE)"
_PLAIN = re.compile(rf"(\\*{_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*{_CONTROL})")
#: Stands for a turn's text when the place of the text is looked for; texts may hold it as well.
_PROBE = "probe"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruction_template(turns: list[tuple[str, str]]) -> str:
    """User turns as <s>[INST] ... [/INST], assistant turns up to </s>, any other role under its own name."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s>[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            out.append(f"<s>[ROLE {quote(role, safe='')}] {escape(text)} [/ROLE]")
    return "".join(out)


_OTHER = re.compile(r"<s>\[ROLE ([^\]]*)\] ")


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of `instruction_template`; the range is that of the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        if formatted.startswith("<s>[INST] ", at):
            role, start, close = "user", at + 10, " [/INST]"
        elif formatted.startswith("<s>[ROLE ", at):
            head = _OTHER.match(formatted, at)
            role, start, close = unquote(head[1]), head.end(), " [/ROLE]"
        elif formatted.startswith(" ", at):
            role, start, close = "assistant", at + 1, " </s>"
        else:
            raise ValueError(f"no turn starts at {at}")
        # A control string inside a text stands behind a backslash, never behind a space.
        end = formatted.index(close, start)
        out.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(close)
    return out


def rendered_spans(turns: list[tuple[str, str]], template: Template, before: tuple[str, str] | None = None
                   ) -> list[tuple[str, int, int]] | None:
    """(piece, start, end) per turn: what the turn adds to the output and where its text stands in it.

    `before` is the turn in front of the first one.  None if the template rewrites history.  A turn whose
    text cannot be told from its surroundings has start and end -1.
    """
    lead = [before] if before is not None else []
    last = template(lead) if lead else ""
    out = []
    for k, (role, _) in enumerate(turns):
        shown = template(lead + turns[:k + 1])
        if not shown.startswith(last):
            return None
        piece = shown[len(last):]
        probed = template([*lead, *turns[:k], (role, _PROBE)])
        start = end = -1
        if probed.startswith(last) and probed[len(last):].count(_PROBE) == 1:
            head, tail = probed[len(last):].split(_PROBE)
            if piece.startswith(head) and piece.endswith(tail) and len(head) + len(tail) <= len(piece):
                start, end = len(head), len(piece) - len(tail)
        out.append((piece, start, end))
        last = shown
    return out


_PIECES = "conv_id long, part long, turns long, role string, piece string, text_start long, text_end long, rewrites boolean"


def format_conversations(conversations: DataFrame, template: Template = instruction_template, local: bool | None = None) -> DataFrame:
    """(conv_id, part, turns, role, piece, text_start, text_end, rewrites) for `conversations` (conv_id, turn, role, text).

    The pieces of a conversation in the order of `part` are its formatted text; a piece is one turn, with
    the range of its text inside, or, if the template rewrites history, the output for `turns` turns.
    `local` declares that a turn's output depends on that turn alone; by default it holds for `instruction_template` only.
    """
    local = template is instruction_template if local is None else local
    rows = narrow(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"conv": None, "begun": False, "before": None, "part": 0, "block": []}

        def close(rows_out: list[tuple]) -> None:
            turns = state["block"]
            if not turns:
                return
            found = rendered_spans(turns, template, state["before"])
            if found is None:
                if local:
                    raise ValueError("a template that is declared local rewrites history")
                whole = template(turns)
                rows_out.append((state["conv"], state["part"], len(turns), None, whole, -1, -1, True))
            else:
                for i, ((role, _), (piece, start, end)) in enumerate(zip(turns, found)):
                    rows_out.append((state["conv"], state["part"] + i, 1, role, piece, start, end, False))
            state["part"] += len(turns)
            state["before"], state["block"] = turns[-1], []

        def batch_of(rows_out: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in _PIECES.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            return pa.RecordBatch.from_arrays(
                [pa.array(v, kinds[c.split()[1]]) for v, c in zip(zip(*rows_out), _PIECES.split(", "))], names=names)

        out: list[tuple] = []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not state["begun"] or conv != state["conv"]:
                    close(out)
                    state.update(conv=conv, begun=True, before=None, part=0, block=[])
                state["block"].append((role or "", text or ""))
                if local and len(state["block"]) == BLOCK:
                    close(out)
                if sum(len(r[4]) for r in out[-BLOCK:]) > 1 << 20 or len(out) >= 2048:
                    yield batch_of(out)
                    out = []
        close(out)
        if out:
            yield batch_of(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(render, _PIECES)


def read_back(pieces: DataFrame, learn: str = "assistant") -> DataFrame:
    """Digests of what the pieces of `instruction_template` hold, one row per conversation, read from the pieces alone.

    Under the loss mask stand the texts of the role `learn`, in the ranges that the spans name.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        n = chars = learned = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*done), kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for own, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "text_start", "text_end"))):
                if not begun or own != conv:
                    if begun:
                        done.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
                    conv, begun, n, chars, learned = own, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(piece)
                for role, text, a, b in read_turns(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == learn:
                        if (a, b) != (start, end):
                            raise ValueError("the span found by rendering is not the text's place")
                        masked = unescape(piece[start:end])
                        learned += len(masked)
                        loss.update(masked.encode("utf-8", "surrogatepass"))
                if len(done) >= 2048:
                    yield batch_of()
                    done = []
        if begun:
            done.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
        if done:
            yield batch_of()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").select(
        "conv_id", "piece", "text_start", "text_end").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Format, write, read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    return read_back(staged(format_conversations(conversations), "formatted"))
