r"""Chat formatting with a grammar round trip.

Template: each turn is ``### Role: text </turn>`` and a line end.  A deterministic parser reads a rendered turn
back; where the recovered role or text differs from the source, or the rendering does not parse as exactly one
turn, the conflicting content is escaped further until the round trip is identical.

Grammar (``role`` and ``body`` in their escaped forms)::

    turn  =  "### " role ": " body " </turn>" "\n"
    role  =  any text; backslash, colon and line end stand escaped
    body  =  any text without an unescaped "###" or "</turn>"

In a body a backslash escapes only a backslash, ``###`` or ``</turn>``; other backslashes stand for themselves.

Turns are rendered and parsed one by one and conversations are streamed in the order (turn, role, text), with
running digests only, so a conversation of any length needs the memory of one batch.  The digests are sequential, so
a conversation is one task's work: 140 s of Python for each GB of it (measured on turns of 1 KB).

Defined results: a null text counts as empty, a null role as the empty role; a null conversation id is a
conversation of its own, null turns come first; repeated rows are turns of their own; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROLE = re.compile(r"\\(.)", re.S)
_BODY = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(
    r"### (?P<role>(?:[^\\:\n]|\\[\\:n])*+): (?P<body>(?:[^\\<#]++|\\(?:\\|###|</turn>)|\\(?!###|</turn>)|<(?!/turn>)|#(?!##))*+)</turn>\n", re.S
)


def _role_out(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """(role, text, start and end of the body, end of the turn) of the turn at ``at``, or None."""
    m = _TURN.match(rendered, at)
    if m is None or not m["body"].endswith(" "):
        return None
    return _unescape_role(m["role"]), _BODY.sub(r"\1", m["body"][:-1]), m.start("body"), m.end("body") - 1, m.end()


def _escapes(text: str) -> Iterator[str]:
    """The text itself, then with its control strings escaped, then with all backslashes escaped too."""
    yield text
    yield re.sub(r"###|</turn>", r"\\\g<0>", text)
    yield re.sub(r"\\|###|</turn>", r"\\\g<0>", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of the body) with the least escaping whose round trip is identical."""
    head = f"### {_role_out(role)}: "
    for body in _escapes(text):
        rendered = f"{head}{body} </turn>\n"
        back = parse_turn(rendered)
        if back is not None and back[:2] == (role, text) and back[4] == len(rendered):
            return rendered, back[2], back[3]
    raise ValueError("no escaping gives the source back")


FORMATTED = "conv_id long, position long, rendered string, char_start long, loss_start long, loss_end long"


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant"
) -> DataFrame:
    """One row per turn, in order within its conversation: the rendered turn, its place in the conversation's text, and the loss span.

    The conversation's text is the concatenation of ``rendered`` by ``position``; spans count its code points.
    Conversations are not divided between partitions, and each partition is sorted.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation
        position = chars = 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if conv != now:
                    now, position, chars = conv, 0, 0
                rendered, a, b = render_turn(role, text)
                span = (chars + a, chars + b) if role == learn_role else (None, None)
                for column, value in zip(out, (conv, position, rendered, chars, *span)):
                    column.append(value)
                position += 1
                chars += len(rendered)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["conv_id", "position", "rendered", "char_start", "loss_start", "loss_end"]
            )

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Per conversation, parsed from the joined rendered text alone: turns and the text under the loss mask, as digests.

    Where turns end and which bodies are learnt is found by the grammar; rows may cut the text anywhere.  Loss spans
    that the rows state are checked against it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done: list[tuple] = []
        reader = Reader(learn_role)
        for batch in batches:
            for conv, rendered, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 5))):
                if conv != now:
                    if now is not run:
                        done.append((now, *reader.close()))
                    now, reader = conv, Reader(learn_role)
                reader.feed(rendered, None if a is None else (a, b))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
                done.clear()
        if now is not run:
            done.append((now, *reader.close()))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


class Reader:
    """Parses one conversation's text as it comes in, and digests its turns and its learnt text."""

    def __init__(self, learn_role: str):
        self.learn_role, self.rest, self.before = learn_role, "", 0  # text not parsed yet, and characters before it
        self.turns = self.loss = 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()
        self.stated: list[tuple[int, int]] = []

    def feed(self, text: str, span: tuple[int, int] | None = None) -> None:
        self.rest += text
        if span is not None:
            self.stated.append(span)
        at = 0
        while (parsed := parse_turn(self.rest, at)) is not None:
            role, body, a, b, end = parsed
            self.all.update(f"{role}\n{body}\n".encode())
            self.turns += 1
            if role == self.learn_role:
                self.learnt.update(body.encode())
                self.loss += len(body)
                if self.stated and self.stated.pop(0) != (self.before + a, self.before + b):
                    raise ValueError("a stated loss span is not that of its turn")
            at = end
        self.rest, self.before = self.rest[at:], self.before + at

    def close(self) -> tuple[int, str, int, str, int]:
        """(turns, their digest, learnt characters, their digest, characters)."""
        if self.rest or self.stated:
            raise ValueError("not a rendered conversation")
        return self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.before


#: The contract's additional conversation.
HARD = r"\### Assistant: </turn> ok"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(hard)))
