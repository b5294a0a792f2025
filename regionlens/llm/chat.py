"""Chat formatting by incremental rendering of a black-box template.

A template is a function from a list of (role, text) turns to the formatted text; nothing
else is known of it.  Each successive prefix of a conversation is rendered, and consecutive
outputs are compared: what the longer output adds is the new turn's span, and if it does not
begin with the shorter one, the template has rewritten history, which is reported.  Two more
renderings of the same prefix, with one-character texts that differ, show where the turn's
own text stands between what the template puts before and after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Rows are handed back in batches of about this many characters.
BATCH = 1 << 22


class Marked:
    """A template that marks turns: ``<turn ROLE>``, newline, the text, ``</turn>``, newline.

    In a text, a backslash goes before each backslash and each ``<`` that begins one of
    the two control strings, in a role before each backslash, ``<`` and ``>``.  So a mark
    never stands in a text or role, and `read` gets every turn back.
    """

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"<turn {re.sub(r'([<>\\])', r'\\\1', role)}>\n{self.escape(text)}</turn>\n" for role, text in turns)

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("</turn>", "\\</turn>").replace("<turn ", "\\<turn ")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def read(self, text: str) -> list[Turn]:
        """The turns of formatted text."""
        turn = re.compile(r"<turn ((?:[^\\>]|\\.)*+)>\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
        out, at = [], 0
        while at < len(text):
            m = turn.match(text, at)
            if not m:
                raise ValueError(f"no turn at character {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Rendering:
    """One conversation, rendered turn by turn.

    Prefixes are rendered from ``window`` turns (and ``chars`` characters) of history on
    from half of it, if it is seen that a rendering without the earlier half ends with
    the same text for the later half, so that long conversations take time and memory in
    proportion to their length.  Else, or once history was rewritten, all of it is kept.
    So a template is caught rewriting if it does so once while the turn is among the last
    ``window`` / 2; one that changes only older turns is not.
    """

    template: Template
    window: int
    chars: int
    turns: list[Turn] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    out: str = ""
    shift: int = 0  # place of ``out`` in the whole text, less what its own beginning adds
    rewritten: bool = False

    def add(self, role: str, text: str) -> dict:
        """The new turn's place: ``keep`` characters of the text so far stay, ``piece`` follows."""
        if len(self.turns) >= self.window or len(self.out) >= self.chars:
            self._drop()
        before, self.out = self.out, self.template([*self.turns, (role, text)])
        keep = len(before) if self.out.startswith(before) else _common(self.out, before)
        self.rewritten |= keep < len(before)
        zero, one = (self.template([*self.turns, (role, t)]) for t in "01")
        head = _common(zero, one)
        tail = _common(zero[:head:-1], one[:head:-1])
        body = None
        if (keep == len(before) and head >= keep and len(zero) == len(one) and head + tail + 1 == len(zero)
                and len(self.out) >= head + tail and self.out.startswith(zero[:head])
                and self.out.endswith(zero[len(zero) - tail:])):
            body = (self.shift + head, self.shift + len(self.out) - tail)
        self.turns.append((role, text))
        self.starts.append(keep)
        return {"keep": self.shift + keep, "dropped": len(before) - keep, "piece": self.out[keep:],
                "start": self.shift + keep, "end": self.shift + len(self.out), "body": body}

    def _drop(self) -> None:
        half = max(1, len(self.turns) // 2)
        if not self.rewritten and half < len(self.turns):
            later = self.template(self.turns[half:])
            if later.endswith(self.out[self.starts[half]:]):
                moved = len(self.out) - len(later)
                self.turns, self.starts = self.turns[half:], [s - moved for s in self.starts[half:]]
                self.out, self.shift = later, self.shift + moved
                self.chars = max(self.chars, 2 * len(later))
                return
        self.window, self.chars = 2 * max(self.window, len(self.turns)), 2 * max(self.chars, len(self.out))


SPANS = ("conv_id bigint, turn bigint, role string, keep bigint, dropped bigint, start bigint, `end` bigint, "
         "body_start bigint, body_end bigint, loss boolean, piece string")
_TYPES = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("keep", pa.int64()),
          ("dropped", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("body_start", pa.int64()),
          ("body_end", pa.int64()), ("loss", pa.bool_()), ("piece", pa.string())]


def format_turns(turns: DataFrame, template: Template, lossy: tuple[str, ...] = ("assistant",), window: int = 64,
                 chars: int = 1 << 20) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text), in conversation order within a partition.

    The formatted text of a conversation is built up from the rows: its first ``keep``
    characters stay, then ``piece`` follows; ``dropped`` counts the characters of earlier
    output that the template took back (0 unless it rewrites history).  start and end
    bound the piece, body_start and body_end the turn's own text in it, in code points of
    the formatted text; both are null where they cannot be told, as after a rewriting.
    loss is true for turns of the roles in ``lossy`` whose text was located.

    Null roles and texts count as empty; rows of null conv_id form one conversation; a
    null turn comes first, and rows of one turn go by role, then text.  A conversation
    without rows has none here.  A conversation streams through one task, in order; of its
    history no more is held than `Rendering` says.
    """
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    plain = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = plain.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, at, now = [], 0, ..., None
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if conv != at:
                    at, now = conv, Rendering(template, window, chars)
                got = now.add(role, text)
                body = got["body"] or (None, None)
                rows.append((conv, turn, role, got["keep"], got["dropped"], got["start"], got["end"], *body,
                             role in lossy and got["body"] is not None, got["piece"]))
                size += len(got["piece"])
                if size >= BATCH or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    return ordered.mapInArrow(render, SPANS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES)], names=[n for n, _ in _TYPES])


def rewriting(spans: DataFrame) -> DataFrame:
    """Conversations whose history the template rewrote: conv_id, the first such turn, characters taken back.

    Spans and loss of a conversation listed here hold for the rendering up to that turn only.
    """
    return (spans.where("dropped > 0").groupBy("conv_id")
            .agg(F.min("turn").alias("first_turn"), F.sum("dropped").alias("dropped")))


READ = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint")


def read_back(spans: DataFrame, template: Marked) -> DataFrame:
    """What the formatted text of each conversation says, read again: one row per conversation.

    ``spans`` come from `format_turns` with a template that rewrites nothing and can be
    read.  The pieces are parsed in order: n_turns, the SHA-256 over role, newline, text,
    newline of each turn; the number of characters and the SHA-256 of the unescaped text
    under the loss mask; and the length of the formatted text.  No conversation is held
    whole.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        at, n, chars, length, turns, loss, out = ..., 0, 0, 0, None, None, []

        def result():
            return (at, n, turns.hexdigest(), chars, loss.hexdigest(), length)

        for batch in batches:
            for conv, start, end, b0, b1, masked, piece in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "start", "end", "body_start", "body_end", "loss", "piece"))):
                if conv != at:
                    if turns:
                        out.append(result())
                    at, n, chars, turns, loss = conv, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in template.read(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if masked:
                    text = template.unescape(piece[b0 - start:b1 - start])
                    chars += len(text)
                    loss.update(text.encode())
                length = end
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if turns:
            out.append(result())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return spans.mapInArrow(read, READ)
