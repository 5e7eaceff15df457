"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are dealt by id, sorted by turn and streamed: a task holds one turn at a time, whatever the length of a
conversation. Every turn becomes text segments with a loss flag each; control strings inside texts are escaped
reversibly, so that the output can be parsed back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a role's text, which roles are learned, and which role may follow which.

    markers: role to (opening, closing) control string; other holds those of any further role, whose name stands in
    front of name_end. turns: state to the roles that may come next, the state being the last role; "" is the start
    and "end" among the roles marks a state in which a conversation may end.
    """

    markers: dict[str, tuple[str, str]]
    other: tuple[str, str]
    name_end: str
    learned: tuple[str, ...]
    turns: dict[str, tuple[str, ...]]
    escape: str = "\\"
    extra: tuple[str, ...] = ()
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        strings = [s for pair in (*self.markers.values(), self.other) for s in pair] + [self.name_end, *self.extra]
        if any(len(s) < 2 or self.escape in s for s in strings):
            raise ValueError("control strings have two characters at least and none is the escape")
        if any(set(s[:1]) & set(t[1:]) for s in strings for t in strings):
            raise ValueError("a control string's first character stands at no other place in one")
        object.__setattr__(self, "controls", tuple(sorted(set(strings), key=lambda s: (-len(s), s))))

    def inside(self) -> re.Pattern:
        """Where an escape has to go in a text: after an escape, and after a control string's first character."""
        return re.compile(f"{re.escape(self.escape)}|(?:{'|'.join(f'{re.escape(s[0])}(?={re.escape(s[1:])})' for s in self.controls)})")


INST = Template(
    markers={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[ROLE]", "[/ROLE]"),
    name_end="[:]",
    learned=("assistant",),
    turns={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "end")},
    extra=("<|endoftext|>",),
)

SEGMENTS = "conv_id long, n long, role string, turn_valid boolean, segment int, text string, loss boolean, last boolean"


def _escaper(template: Template) -> Callable[[str], str]:
    pattern, escape = template.inside(), template.escape
    return lambda text: pattern.sub(lambda m: m[0] + escape, text)


def unescape(template: Template, text: str) -> str:
    """Undo the escapes: an escape is dropped, or stands for itself after another."""
    e = re.escape(template.escape)
    return re.sub(f"{e}{e}|{e}", lambda m: template.escape if len(m[0]) == 2 else "", text)


def turn_segments(template: Template, role: str, text: str, escaped: Callable[[str], str]) -> list[tuple[str, bool]]:
    """A turn's segments: what opens it, its text, what closes it. Only a learned role's text bears loss."""
    if role in template.markers:
        before, after = template.markers[role]
    else:
        before, after = template.other[0] + escaped(role) + template.name_end, template.other[1]
    return [(before, False), (escaped(text), role in template.learned), (after, False)]


def format_chats(conversations: DataFrame, template: Template = INST) -> DataFrame:
    """Segments of every turn, in order within each partition and conversation.

    Rows of a conversation are taken by turn, ties by role and text; null texts and roles are empty, a null conv_id is a
    conversation of its own and null turns come first. turn_valid says whether the machine allows the role there (last
    marks a conversation's last segment, where it must also be allowed to end). Turns out of order are formatted like others.
    Columns of other names are not read.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaped = _escaper(template)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        conv, n, state, held = object(), 0, "", None

        def rows_of(conv_id, n, role, text, valid, last) -> list[tuple]:
            parts = turn_segments(template, role, text, escaped)
            return [(conv_id, n, role, valid, k, s, loss, last and k == len(parts) - 1) for k, (s, loss) in enumerate(parts)]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out, size = [], 0
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                new = conv_id != conv
                if held is not None:
                    valid = held[4] and (not new or "end" in template.turns.get(state, ()))
                    out += rows_of(*held[:4], valid, new)
                    size += len(held[3])
                if new:
                    conv, n, state = conv_id, 0, ""
                held = (conv_id, n, role, text, role in template.turns.get(state, ()))
                n, state = n + 1, role
                if size >= 1 << 22:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)
        if held is not None:
            yield packed(rows_of(*held[:4], held[4] and "end" in template.turns.get(state, ()), True))

    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(emit, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = INST) -> DataFrame:
    """Parse the formatted text of each conversation into turns again; a digest row for each.

    Only the segments' text and loss flags are read, from one segment to the next; what is between an opening and a
    closing control string is a turn. segments must be in the order in which format_chats() leaves them.
    """
    opening = {before: (role, after) for role, (before, after) in template.markers.items()}
    opening[template.other[0]] = (None, template.other[1])
    mark = re.compile("|".join(map(re.escape, template.controls)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        turns, loss, n_turns, loss_chars, chars, valid, kept = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, ""
        for batch in batches:
            done = []
            for conv_id, ok, text, flag, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_valid", "text", "loss", "last")), strict=True):
                chars += len(text)
                valid = valid and ok
                if flag:
                    plain = unescape(template, text)
                    loss.update(plain.encode())
                    loss_chars += len(plain)
                kept += text
                while first := mark.match(kept):
                    role, closing = opening[first[0]]
                    end = next((m for m in mark.finditer(kept, first.end()) if m[0] == closing), None)
                    if end is None:
                        break
                    body = kept[first.end() : end.start()]
                    if role is None:
                        role, _, body = body.partition(template.name_end)
                        role = unescape(template, role)
                    turns.update(f"{role}\n{unescape(template, body)}\n".encode())
                    n_turns += 1
                    kept = kept[end.end() :]
                if last:
                    if kept:
                        raise ValueError(f"conversation {conv_id} does not end with a turn")
                    done.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    turns, loss, n_turns, loss_chars, chars, valid = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return segments.mapInArrow(digest, DIGESTS)
