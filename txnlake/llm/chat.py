"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation (rows by turn; null turns first, then by role and text, so ties
have one order) become text segments with loss flags: header, escaped text, end mark.
The machine follows the roles; a conversation is ``valid`` if every turn had a
transition and it ended in an accepting state.  All conversations are formatted, valid
or not.  Control strings inside texts get a backslash before them, as does a backslash
itself, so reading back is exact.

A conversation streams through one task in order, turn by turn, with digests as the only
state, so its length is not bounded by memory.

Defined cases: a null text or role is empty; a role outside the template gets the
template's general header and keeps its name; rows of a null conversation id form one
conversation; repeated rows are turns; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.llm.common import ship

INVALID = "invalid"


@dataclasses.dataclass(frozen=True)
class Template:
    headers: dict[str, str]
    other: tuple[str, str]  # before and after the name of any other role
    end: str
    controls: tuple[str, ...]  # strings that texts may hold only escaped
    loss: frozenset[str]  # roles whose texts count in the loss
    moves: dict[str, dict[str, str]]  # state -> role -> state
    accepting: frozenset[str]
    start: str = "start"


TURNS = Template(
    headers={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    other=("### [", "]: "),
    end="</turn>\n",
    controls=("###", "</turn>"),
    loss=frozenset({"assistant"}),
    moves={"start": {"system": "system", "user": "user"}, "system": {"user": "user"},
           "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    accepting=frozenset({"assistant"}),
)


class Codec:
    """Writes and reads single turns of a template."""

    def __init__(self, template: Template) -> None:
        self.t = template
        marks = "|".join(map(re.escape, ("\\", *template.controls)))
        self._mark, self._marked = re.compile(marks), re.compile(rf"\\({marks})")
        # a role's name may also not hold the mark that closes it
        close = re.escape(template.other[1])
        self._role, self._roled = re.compile(f"{close}|{marks}"), re.compile(rf"\\({close}|{marks})")
        plain = rf"(?:\\(?:{close}|{marks})|(?!{close}|{marks}).)*"
        self._other = re.compile(f"{re.escape(template.other[0])}({plain}){close}", re.S)

    def escape(self, text: str) -> str:
        return self._mark.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._marked.sub(lambda m: m[1], text)

    def header(self, role: str) -> str:
        if role in self.t.headers:
            return self.t.headers[role]
        return self.t.other[0] + self._role.sub(lambda m: "\\" + m[0], role) + self.t.other[1]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, in the loss) of one turn."""
        return [(self.header(role), False), (self.escape(text), role in self.t.loss),
                (self.t.end, False)]

    def read(self, turn: str) -> tuple[str, str]:
        """(role, text) of a formatted turn."""
        if not turn.endswith(self.t.end):
            raise ValueError("a turn without its end mark")
        for role, header in self.t.headers.items():
            if turn.startswith(header):
                break
        else:
            m = self._other.match(turn)
            role, header = self._roled.sub(lambda m: m[1], m[1]), m[0]
        return role, self.unescape(turn[len(header):-len(self.t.end)])


def _schema(kind: T.DataType, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in {"conv_id": kind, **fields}.items()])


def format_chats(df: DataFrame, template: Template = TURNS, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn, each conversation's rows together and in order: conv_id, turn_no
    (from 0), state (of the machine after it), segments (texts) and loss (a flag each)."""
    ship(df.sparkSession)
    ordered = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _schema(ordered.schema["conv_id"].dataType, turn_no=T.LongType(),
                     state=T.StringType(), segments=T.ArrayType(T.StringType()),
                     loss=T.ArrayType(T.BooleanType()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, no, state = Codec(template), (), 0, template.start
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(),
                                        batch["text"].to_pylist()):
                if at != (conv,):
                    at, no, state = (conv,), 0, template.start
                state = template.moves.get(state, {}).get(role, INVALID)
                parts = codec.segments(role, text)
                rows.append((conv, no, state, [p for p, _ in parts], [x for _, x in parts]))
                no += 1
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(),
                     pa.list_(pa.string()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], schema.names)

    return ordered.select("conv_id", "role", "text").mapInArrow(write, schema)


class _Digest:
    def __init__(self, codec: Codec, conv) -> None:
        self.codec, self.conv = codec, conv
        self.turns, self.lost = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.state = codec.t.start

    def add(self, state: str, parts: list[str], flags: list[bool]) -> None:
        turn = "".join(parts)
        role, text = self.codec.read(turn)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        held = self.codec.unescape("".join(p for p, x in zip(parts, flags) if x))
        self.lost.update(held.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(held)
        self.chars += len(turn)
        self.n_turns += 1
        self.state = state

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars,
                self.lost.hexdigest(), self.chars, self.state in self.codec.t.accepting)


def read_back(formatted: DataFrame, template: Template = TURNS) -> DataFrame:
    """One row per conversation of format_chats' output, from the formatted text alone."""
    ship(formatted.sparkSession)
    schema = _schema(formatted.schema["conv_id"].dataType, n_turns=T.LongType(),
                     turns_sha256=T.StringType(), loss_chars=T.LongType(),
                     loss_sha256=T.StringType(), formatted_chars=T.LongType(),
                     valid=T.BooleanType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, kind = Codec(template), None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for conv, no, state, parts, flags in zip(*(batch[c].to_pylist() for c in (
                    "conv_id", "turn_no", "state", "segments", "loss"))):
                if no == 0:
                    if now:
                        done.append(now.row())
                    now = _Digest(codec, conv)
                now.add(state, parts, flags)
            if done:
                yield out(done)
        if now:
            yield out([now.row()])

    return formatted.mapInArrow(read, schema)
