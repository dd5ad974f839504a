"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  The turns' prefixes are
rendered one after the other; what a prefix's output has beyond the one before is the new
turn's span, and a template that changes earlier output has rewritten history.  The text's own
place within the span comes from a second rendering with a probe in its stead.

By default nothing is taken for granted and every prefix is rendered whole: exact for any template, in time that grows
with the square of a conversation's turns.  A template may declare ``lookback``: a turn's output follows all earlier output
unchanged, and depends on the turn itself and the ``lookback`` turns before it only.  Then a block of turns is rendered at a
time, with those turns as context, so a conversation of any length takes linear time.

A template made by ``turn_by_turn`` from a function of a turn and the turns before it keeps this by its making, and takes the memory
of a block.  For any other function the declaration is checked, however long the conversation: when its turns have doubled and at its
end, what was put together must equal one rendering of the whole, else the job fails.  Only the whole can tell, so one
conversation's turns and their rendering must fit a task's memory; where they don't, the job fails too.
What a function changes at some length and takes back before the next of these checks isn't seen; without a declaration it is.

Rows of a conversation come in order of turn (then role and text; rows equal in all are interchangeable) to one task.
Output is a row per turn.

A null role or text is empty.  Rows of a null conv_id are one conversation.  Repeated rows are
repeated turns.  Empty tables give no rows; extra columns, whatever their names, are left out.  Texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import rows_to_batch

Render = Callable[[list[tuple[str, str]]], str]
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"
#: A control string, or one that was escaped before: one backslash more after its first sign.
ESCAPE = re.compile(rf"([<\[])(\\*)(?={CONTROL})")
UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={CONTROL})")
PROBE = "probe"
BLOCK = 16


@dataclass(frozen=True)
class Template:
    """render: a black box.  lookback: see above; None where any turn may change any output.  proven: the lookback needs no check."""

    render: Render
    lookback: int | None = None
    proven: bool = False


def turn_by_turn(one: Callable[[list[tuple[str, str]], tuple[str, str]], str], lookback: int = 0) -> Template:
    """The template that joins what ``one`` makes of each turn, given the (up to) ``lookback`` turns before it."""
    return Template(lambda turns: "".join(one(turns[max(0, i - lookback) : i], turn) for i, turn in enumerate(turns)), lookback, proven=True)


def escape(text: str) -> str:
    """No control string survives in the result; ``unescape`` restores the text."""
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def marked_turn(before: list[tuple[str, str]], turn: tuple[str, str]) -> str:
    """The markup used here: <|im_start|>role<|im_sep|>text<|im_end|>."""
    return f"{START}{escape(turn[0])}{SEP}{escape(turn[1])}{END}"


#: A turn's output depends on nothing but the turn.
TURN_MARKUP = turn_by_turn(marked_turn)
turn_markup = TURN_MARKUP.render


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def turn_spans(turns: list[tuple[str, str]], render: Render, known: int = 0) -> Iterator[tuple[int, int, str, int, int, bool]]:
    """(turn, where its output starts, its output, where its text starts and ends in that, whether earlier output was rewritten).

    The first ``known`` turns are context and not reported.
    """
    before = render(turns[:known])
    for k in range(known + 1, len(turns) + 1):
        now = render(turns[:k])
        same = common_prefix(before, now)
        new = now[same:]
        probed = render([*turns[: k - 1], (turns[k - 1][0], PROBE)])
        at = probed.find(PROBE, same)
        start, end = (at - same, len(new) - (len(probed) - at - len(PROBE))) if at >= 0 and probed[:at] == now[:at] else (0, len(new))
        yield k - 1, same, new, start, end, same < len(before)
        before = now


class Conversation:
    """Turns as they come, and the spans of those rendered so far."""

    def __init__(self, template: Template, block: int = BLOCK):
        self.template, self.block = template, block
        self.turns: list[tuple[str, str]] = []
        self.known, self.length, self.place = 0, 0, 0  # turns of context, length of all output, turns reported
        #: All turns and the digest of all output, of a template whose lookback must be checked.
        self.every: list[tuple[str, str]] | None = [] if template.lookback is not None and not template.proven else None
        self.output, self.checked = hashlib.sha256(), 0

    def add(self, role: str, text: str) -> Iterator[tuple[int, int, str, int, int, bool]]:
        """Spans (see turn_spans, places and starts within the conversation) that are ready with this turn."""
        self.turns.append((role, text))
        if self.template.lookback is not None and len(self.turns) - self.known >= self.block:
            yield from self.close()
            if self.place >= 2 * self.checked:
                self.check()

    def end(self) -> Iterator[tuple[int, int, str, int, int, bool]]:
        """The spans of all turns not reported yet; the conversation has ended."""
        yield from self.close()
        self.check()

    def check(self) -> None:
        """What was put together equals a rendering of the whole; one at twice as many turns each, and one at the end."""
        if self.every is None or self.place == self.checked:
            return
        if self.output.digest() != hashlib.sha256(self.template.render(self.every).encode()).digest():
            raise ValueError(f"the template's output depends on more than the {self.template.lookback} turns before: declare no lookback")
        self.checked = self.place

    def close(self) -> Iterator[tuple[int, int, str, int, int, bool]]:
        """The spans of all turns not reported yet."""
        if len(self.turns) == self.known:
            return
        # Output of the context was counted before: starts are moved by what stands before it.
        offset = self.length - len(self.template.render(self.turns[: self.known])) if self.known else self.length
        for k, at, new, a, z, rewrites in turn_spans(self.turns, self.template.render, self.known):
            if rewrites and self.every is not None:
                raise ValueError("the template rewrites earlier output: declare no lookback")
            self.length, self.place = offset + at + len(new), self.place + 1
            if self.every is not None:
                self.every.append(self.turns[k])
                self.output.update(new.encode())
            yield self.place - 1, offset + at, new, a, z, rewrites
        if self.template.lookback is None:
            self.turns, self.known = [], 0  # the conversation has ended
            return
        keep = min(self.template.lookback, len(self.turns))
        self.turns, self.known = self.turns[len(self.turns) - keep :], keep


def format_turns(conversations: DataFrame, template: Template = TURN_MARKUP, loss_roles: tuple[str, ...] = ("assistant",), block: int = BLOCK) -> DataFrame:
    """conv_id, place (from 0), start (of the turn's output in the conversation's), output, text_start and text_end
    (in output), loss, rewrites; ordered by conversation and place within partitions.
    """
    id_type = conversations.schema["conv_id"].dataType
    names = pa.schema([("place", pa.int64()), ("start", pa.int64()), ("output", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size, roles = [], [], 0, []
        conv, now, id_arrow = None, Conversation(template, block), None

        def take(spans: Iterator[tuple[int, int, str, int, int, bool]]) -> None:
            nonlocal size
            for place, start, new, a, z, rewrites in spans:
                ids.append(conv[0])
                rows.append((place, start, new, a, z, roles[place - done] in loss_roles, rewrites))
                size += len(new)

        def batch() -> pa.RecordBatch:
            nonlocal size
            more = rows_to_batch(rows, names)
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), *more.columns], ["conv_id", *names.names])
            ids.clear()
            rows.clear()
            size = 0
            return out

        done = 0  # places reported; roles are those of the others
        for b in batches:
            id_arrow = b.column(0).type
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if conv is None or c != conv[0]:
                    if conv is not None:
                        take(now.end())
                    conv, now, roles, done = (c,), Conversation(template, block), [], 0
                roles.append(role or "")
                take(now.add(role or "", text or ""))
                if now.place > done:
                    del roles[: now.place - done]
                    done = now.place
                if size > 4 << 20:
                    yield batch()
        if conv is not None:
            take(now.end())
            yield batch()

    rows = conversations.select("conv_id", F.col("role").cast("string"), F.col("text").cast("string"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, f"conv_id {id_type.simpleString()}, place long, start long, output string, text_start long, text_end long, loss boolean, rewrites boolean")


def parsed_role(output: str) -> str:
    """The role of one turn of ``turn_markup``, read back from its output."""
    return unescape(output[len(START) : output.index(SEP)])


def conversation_digests(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewrites: read back from the output.

    Digests are updated turn by turn as the ordered rows stream by.
    """
    id_type = conversations.schema["conv_id"].dataType
    names = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_rewrites", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ids, rows, id_arrow = None, [], [], None
        n = chars = loss_chars = rewrites = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            ids.append(conv[0])
            rows.append((n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites))

        def batch() -> pa.RecordBatch:
            more = rows_to_batch(rows, names)
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), *more.columns], ["conv_id", *names.names])
            ids.clear()
            rows.clear()
            return out

        for b in batches:
            id_arrow = b.column(0).type
            for c, output, a, z, masked, rewritten in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7)), strict=True):
                if conv is None or c != conv[0]:
                    if conv is not None:
                        close()
                    conv, n, chars, loss_chars, rewrites = (c,), 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                text = unescape(output[a:z])
                n, chars, rewrites = n + 1, chars + len(output), rewrites + rewritten
                turns.update(f"{parsed_role(output)}\n{text}\n".encode())
                if masked:
                    loss_chars += len(text)
                    loss.update(text.encode())
            if len(rows) > 5000:
                yield batch()
        if conv is not None:
            close()
            yield batch()

    rows = format_turns(conversations, TURN_MARKUP, block=block)
    return rows.mapInArrow(run, f"conv_id {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    """``conversations`` plus number -7, whose two turns are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
