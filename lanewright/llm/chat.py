"""Chat formatting by grammar round trip.

Grammar of the rendered text::

    conversation := turn*
    turn         := "### " role ": " body " </turn>" "\\n"
    role, body   := characters, where "\\" makes the next character literal

A deterministic parser (:func:`parse`) reads the rendered text. Rendering starts from the plain body, reparses it and
compares the recovered turn with the source; while they differ, conflicting content is escaped one step further:
first the control strings get a backslash, then backslashes are doubled as well. The last step always round-trips.

Turns are rendered and checked where they lie; only then are they brought together by conversation, sorted by turn
and folded as a stream, so a conversation of any length needs the memory of one batch. A conversation is one task's
work, as the digest over its turns is sequential.

Null text or role: empty. Null conv_ids: all one conversation. Null turn: first. Equal turns: in the order of
their rendered text; repeated rows all stay. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import in_batches

HEAD, COLON, END = "### ", ": ", " </turn>\n"
#: What must not stand bare in a body; at its end ``###`` would take the blank of the end marker.
_CONTROL = re.compile(r"###(?= |\Z)|</turn>")
_SPECIAL = re.compile(r"\\(?:(.)|$)|### | ?</turn>\n?", re.DOTALL)
_ROLE = re.compile(r"([\\:#<\n])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
STEPS = (
    lambda text: text,
    lambda text: _CONTROL.sub(r"\\\g<0>", text),
    lambda text: _CONTROL.sub(r"\\\g<0>", text.replace("\\", "\\\\")),
)


class GrammarError(ValueError):
    """The text is not a rendered conversation."""


def render(role: str, body: str) -> str:
    """One turn from an escaped body."""
    return f"{HEAD}{_ROLE.sub(r'\\\1', role)}{COLON}{body}{END}"


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the body's span (code points) of each turn of a rendered conversation."""
    at = 0
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise GrammarError(f"no turn begins at {at}")
        m = re.compile(r"((?:\\.|[^\\:])*): ", re.DOTALL).match(text, at + len(HEAD))
        if not m:
            raise GrammarError(f"no role at {at}")
        role, start, at = _ESCAPED.sub(r"\1", m[1]), m.end(), m.end()
        parts = []
        while True:
            m = _SPECIAL.search(text, at)
            if not m or m[0] == HEAD:
                raise GrammarError(f"the turn at {start} does not end")
            parts.append(text[at : m.start()])
            at = m.end()
            if m[0] == END:
                yield role, "".join(parts), start, m.start()
                break
            if m[1] is None:
                raise GrammarError(f"a control string stands bare at {m.start()}")
            parts.append(m[1])


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """The rendered turn, its body's span, and the step of escaping that made the round trip identical."""
    for step, escape in enumerate(STEPS):
        rendered = render(role, escape(text))
        try:
            turns = list(parse(rendered))
        except GrammarError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2], turns[0][3], step
    raise AssertionError("the last step escapes everything")


def format_conversations(df: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """A row per turn: conv_id, turn, rendered, mask_start, mask_end (the body, if ``learn_role`` says it), step.

    A conversation's formatted text is its rendered turns in order of turn, with nothing between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [format_turn(r, x) for r, x in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True)]
            learn = [r == learn_role for r in b["role"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b["conv_id"],
                    b["turn"],
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] if on else None for r, on in zip(rows, learn, strict=True)], pa.int64()),
                    pa.array([r[2] if on else None for r, on in zip(rows, learn, strict=True)], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int32()),
                ],
                names=["conv_id", "turn", "rendered", "mask_start", "mask_end", "step"],
            )

    turns = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return in_batches(turns, run, "conv_id long, turn long, rendered string, mask_start long, mask_end long, step int")


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("max_step", pa.int32())]
)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Read the rendered turns back, a row per conversation: what they say, and what lies under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> tuple:
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

        for b in batches:
            done = []
            columns = (b[k].to_pylist() for k in ("conv_id", "rendered", "mask_start", "mask_end", "step"))
            for conv, rendered, start, end, step in zip(*columns, strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = _ESCAPED.sub(r"\1", rendered[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(rendered)
                state[5] = max(state[5], step)
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r, strict=True)) for r in done], _DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, row(), strict=True))], _DIGEST)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return in_batches(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, max_step int")
