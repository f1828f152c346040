"""Chat formatting by incremental rendering of a black-box template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows handed back at once, and characters in them.
BATCH_TURNS = 1024
BATCH_CHARS = 1 << 22

Turn = tuple[str, str]


class MarkedTemplate:
    """``### Role: text</turn>`` and a line end per turn; nothing a text says can be taken for a marker.

    ``\\``, ``###`` and ``</turn>`` inside a text become ``\\\\``, ``\\h`` and ``\\e``. The
    roles of ``NAMES`` have their names; any other is written ``\\r`` and the role itself,
    with a colon in it as ``\\c``.
    """

    NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
    _CODES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", ":": "\\c"}
    _TURN = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.DOTALL)

    def __init__(self):
        self._roles = {v: k for k, v in self.NAMES.items()}
        self._texts = {v: k for k, v in self._CODES.items()}

    def escape(self, text: str, codes: tuple[str, ...] = ("\\", "###", "</turn>")) -> str:
        for plain in codes:  # the backslash first
            if plain in text:
                text = text.replace(plain, self._CODES[plain])
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\.", lambda m: self._texts[m.group()], text) if "\\" in text else text

    def __call__(self, turns: list[Turn]) -> str:
        return "".join([
            f"### {self.NAMES.get(role) or chr(92) + 'r' + self.escape(role, tuple(self._CODES))}: {self.escape(text)}</turn>\n"
            for role, text in turns])

    def read(self, rendered: str) -> list[Turn]:
        """The turns of a rendered text; an error if it is not made of whole turns."""
        out, at = [], 0
        while at < len(rendered):
            m = self._TURN.match(rendered, at)
            if m is None:
                raise ValueError(f"no turn at {at}: {rendered[at:at + 40]!r}")
            name = m[1]
            out.append((self.unescape(name[2:]) if name.startswith("\\r") else self._roles[name], self.unescape(m[2])))
            at = m.end()
        return out


def _shared(a: str, b: str) -> int:
    """How many characters two texts have in common from the start."""
    return len(a) if b.startswith(a) else len(commonprefix([a, b]))


class Renderer:
    """Renders one conversation turn after turn through a template it knows nothing about.

    Each turn is the difference between the outputs for all turns up to it and for
    those before it. An output that does not start with the one before shows a template
    that rewrites history, however far back.

    With ``context`` the template is given the last ``context`` to ``2 * context`` turns
    only. A longer conversation then moves on by rendering its last ``context`` turns
    alone: what the turns after the first of them added must come out the same, else the
    template looks back further than ``context`` turns, which counts as rewriting too.
    """

    def __init__(self, template: Callable[[list[Turn]], str], context: int | None = None):
        self.template, self.context = template, context and max(1, context)
        self.turns: list[Turn] = []
        self.out, self.shift = template([]), 0

    def start(self) -> str:
        """What the template writes before any turn."""
        return self.out

    def add(self, role: str, text: str, located: bool = True) -> tuple[int, str, int | None, int | None, bool]:
        """Where the turn's output starts, the output from there on, the span of its text if ``located``, and whether history changed."""
        moved = bool(self.context) and len(self.turns) >= 2 * self.context and self._move_on()
        turns = [*self.turns, (role, text)]
        out = self.template(turns)
        start = _shared(self.out, out)
        rewrites = moved or start < len(self.out)
        span = self._text_span(role, out, start) if located and not rewrites else (None, None)
        self.turns, self.out = turns, out
        return self.shift + start, out[start:], *span, rewrites

    def _text_span(self, role: str, out: str, start: int) -> tuple[int | None, int | None]:
        """Two other texts in its place show what the template puts before and behind the text."""
        one, two = (self.template([*self.turns, (role, probe)]) for probe in ("a", "b"))
        if not (one.startswith(self.out[:start]) and two.startswith(self.out[:start])):
            return None, None
        head = start + _shared(one[start:], two[start:])
        tail = _shared(one[:head:-1], two[:head:-1])
        if len(out) < head + tail or one[start:head] != out[start:head] or one[len(one) - tail:] != out[len(out) - tail:]:
            return None, None
        return self.shift + head, self.shift + len(out) - tail

    def _move_on(self) -> bool:
        last = self.turns[-self.context:]
        alone, first = self.template(last), len(self.template(last[:1]))
        added = alone[first:]
        changed = not self.out.endswith(added)
        self.shift += len(self.out) - len(alone)
        self.turns, self.out = last, alone
        return changed


def format_chats(
    convs: DataFrame, template: Callable[[list[Turn]], str], context: int | None = None, loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn of ``convs`` (``conv_id, turn, role, text``), in order, conversations whole within a partition.

    Returns ``conv_id, place, role, start, rendered, loss_start, loss_end, rewrites``:
    the turn's place from 0, where its output starts in that of the conversation (code
    points), the output itself, the span of its text to learn where its role is one of
    ``loss_roles`` (null otherwise, and where it cannot be told), and whether the
    template changed earlier output there. A conversation's output is
    ``output[:start] + rendered`` after each row; without rewrites that is all rows
    joined. What a template writes before any turn is part of the first row.

    Turns are ordered by turn, then role and text; a missing turn comes first, missing
    roles and texts are empty. Repeated rows are turns each. A null ``conv_id`` is one
    conversation. Empty texts have an empty span. Other columns are ignored; an empty table gives none.

    Rows are dealt by conversation and sorted on disk; a task streams them and holds the
    conversation it is at. The template renders every turn behind all the turns before
    it, so work grows with the square of a conversation's length, whatever their number.
    ``context`` bounds both for conversations without end (see :class:`Renderer`).
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, chars, now, renderer, place = [], 0, object(), None, 0
        for batch in batches:
            ids = batch.column("conv_id")
            for conv, role, text in zip(ids.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if renderer is None or conv != now:
                    now, renderer, place = conv, Renderer(template, context), 0
                before = renderer.start() if place == 0 else ""
                start, rendered, a, z, rewrites = renderer.add(role, text, role in loss_roles)
                if place == 0 and start >= len(before):
                    start, rendered = 0, before + rendered
                held.append((conv, place, role, start, rendered, a, z, rewrites))
                place += 1
                chars += len(rendered)
                if len(held) >= BATCH_TURNS or chars >= BATCH_CHARS:
                    yield told(held, ids.type)
                    held, chars = [], 0
            if held:
                yield told(held, ids.type)
                held, chars = [], 0

    def told(rows, kind) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[
            "conv_id", "place", "role", "start", "rendered", "loss_start", "loss_end", "rewrites"])

    slim = convs.select(
        "conv_id", F.col("turn").alias("place"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    kind = slim.schema["conv_id"].dataType.simpleString()
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "text").select(
        "conv_id", "role", "text").mapInArrow(
        run, f"conv_id {kind}, place bigint, role string, start bigint, rendered string, loss_start bigint, "
             "loss_end bigint, rewrites boolean")


def read_back(formatted: DataFrame, template: MarkedTemplate) -> DataFrame:
    """What :func:`format_chats` wrote, read from its output alone, per conversation.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Turns are found by the template's marks, the learned text by the loss spans, and both
    are unescaped; ``turns_sha256`` is over role, line end, text, line end of each turn.
    Rows are read in the order they come in, no conversation is held. A conversation
    with rewritten history is an error: its rows joined are not its output.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        state, kind = None, None

        def told():
            conv, n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], kind), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()),
                 pa.array([loss.hexdigest()]), pa.array([size], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if state is not None:
                        yield told()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if row["rewrites"] or row["start"] != state[5]:
                    raise ValueError(f"the template rewrites the history of conversation {row['conv_id']}")
                for role, text in template.read(row["rendered"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if row["loss_start"] is not None:
                    learned = template.unescape(row["rendered"][row["loss_start"] - state[5]:row["loss_end"] - state[5]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(row["rendered"])
        if state is not None:
            yield told()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "place", "start", "rendered", "loss_start", "loss_end", "rewrites").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
             "formatted_chars bigint")
