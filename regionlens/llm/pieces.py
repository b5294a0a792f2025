"""SentencePiece BPE encoding and decoding through a table of prefixes.

For a merge vocabulary every prefix of a text has one encoding, and so one last token.
An Aho-Corasick pass proposes, for each prefix, the pieces that end there; the right one
is the piece that is compatible with the last token of the prefix before it, that is,
the two stand side by side when their text is encoded alone.  The ids are then read off
the table backwards.

Two pieces are compatible if no merge crosses their border: their inner borders (the
last parts of the first, the first parts of the second) grow in the order of the merge
scores, and a crossing merge wins if it scores above the next merge on either side
(the left one wins ties).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

SPACE = "▁"


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver; they travel with the task (half a MB for 32k pieces)."""
    with open(path, "rb") as f:
        return f.read()


class PrefixEncoder:
    """Encoder and decoder for a BPE model with the identity normaliser, dummy prefix and byte fallback."""

    def __init__(self, model: bytes, memory: int = 100_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.normalize("①  a ") != f"{SPACE}①{SPACE * 2}a{SPACE}":
            raise ValueError("only models that keep the text, with a dummy prefix, are supported")
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        normal = [i for i in range(size) if i not in special and i not in self.byte_of]
        ids = {self.pieces[i]: i for i in normal}
        self.score = [sp.get_score(i) for i in range(size)]
        self.length = [len(p) for p in self.pieces]
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in ids)
        #: (left, right) -> piece, for each way to cut a piece into two pieces
        self.merged: dict[tuple[int, int], int] = {}
        for i in normal:
            p = self.pieces[i]
            for c in range(1, len(p)):
                if (a := ids.get(p[:c])) is not None and (b := ids.get(p[c:])) is not None:
                    self.merged[a, b] = i
        # inner borders of each piece, from one character up to the piece; pieces that
        # their own text does not encode to never occur
        self.heads: dict[int, list[int]] = {}
        self.tails: dict[int, list[int]] = {}
        automaton = ahocorasick.Automaton()
        for i in sorted(normal, key=lambda i: self.length[i]):
            if self._grow(i, ids):
                automaton.add_word(self.pieces[i], (i, self.length[i]))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.fits: dict[int, bool] = {}
        self.memory, self.known, self.older = memory, {}, {}
        self.decode = Decoder(model).decode

    def _grow(self, i: int, ids: dict[str, int]) -> bool:
        """Encode one piece by merging; record its two borders; False if it does not come out whole."""
        parts = [ids.get(c, -1) for c in self.pieces[i]]
        if -1 in parts:
            if len(parts) > 1:
                raise ValueError("a piece has a character that is no piece")
            return False
        last = None
        while len(parts) > 1:
            found = [(self.score[m], -k, m) for k, pair in enumerate(zip(parts, parts[1:]))
                     if (m := self.merged.get(pair)) is not None]
            if not found:
                return False
            _, k, m = max(found)
            last = parts[-k], parts[-k + 1]
            parts[-k:-k + 2] = [m]
        if parts[0] != i:
            return False
        if last is None:
            self.heads[i] = self.tails[i] = [i]
            return True
        a, b = last
        if any(self.length[x] > 1 and self.score[x] <= self.score[i] for x in last) and self.pieces[i].strip(SPACE):
            raise ValueError(f"piece {i} scores above one of its parts")
        self.heads[i], self.tails[i] = self.heads[a] + [i], self.tails[b] + [i]
        return True

    def compatible(self, a: int, b: int) -> bool:
        """True if the text of ``a`` followed by that of ``b`` encodes to these two pieces."""
        left, right, score, merged = self.tails[a], self.heads[b], self.score, self.merged
        i = j = 0
        never = float("-inf")
        while True:
            up = score[left[i + 1]] if i + 1 < len(left) else never
            down = score[right[j + 1]] if j + 1 < len(right) else never
            m = merged.get((left[i], right[j]))
            if m is not None and score[m] > up and score[m] >= down:
                return False
            if up == never and down == never:
                return True
            if up >= down:
                i += 1
            else:
                j += 1

    def forget(self) -> None:
        """Give back the memory of words and pairs met so far."""
        self.known, self.older, self.fits = {}, {}, {}

    def _chunk(self, text: str) -> tuple[int, ...]:
        # last token by last character; the extra place at the end stands for the beginning (index -1)
        last = [-1] * (len(text) + 1)
        fits = self.fits
        for end, (t, n) in self.matches(text):
            if last[end] >= 0:
                continue
            p = last[end - n]
            if p >= 0:  # else the text begins here, or a character of no piece stands before
                ok = fits.get(p << 16 | t)
                if ok is None:
                    if len(fits) >= 4 * self.memory:
                        fits.clear()
                    ok = fits[p << 16 | t] = self.compatible(p, t)
                if not ok:
                    continue
            last[end] = t
        out, at, length = [], len(text) - 1, self.length
        while at >= 0:
            t = last[at]
            if t >= 0:
                out.append(t)
                at -= length[t]
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[at].encode()))
                at -= 1
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.by_word:
            return list(self._chunk(SPACE + text.replace(" ", SPACE)))
        out: list[int] = []
        known, mark = self.known, SPACE
        for word in text.replace(SPACE, " ").split(" "):
            if not word:
                mark += SPACE
                continue
            key = word if len(mark) == 1 else mark + word
            ids = known.get(key)
            if ids is None:
                ids = self.older.get(key) or self._chunk(mark + word)
                if len(word) <= 64:
                    if len(known) >= self.memory:  # words met again within two fills stay
                        self.older, self.known = known, {}
                        known = self.known
                    known[key] = ids
            out += ids
            mark = SPACE
        if len(mark) > 1:  # spaces at the end; the last split part is empty
            out += self._chunk(mark[:-1])
        return out


class Decoder:
    """Ids to text; a byte below 128 is a character by itself, others are put together."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.high: dict[int, int] = {}
        self.shown, self.blank = [], set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte = int(piece[3:5], 16)
                if byte >= 128:
                    self.high[i] = byte
                self.shown.append(chr(byte) if byte < 128 else "")
            elif sp.is_control(i):
                self.blank.add(i)
                self.shown.append("")
            else:
                self.shown.append(sp.decode([i]) if sp.is_unknown(i) else piece.replace(SPACE, " "))
        self.opens = {i for i in range(sp.get_piece_size()) if sp.id_to_piece(i).startswith(SPACE)}

    def decode(self, ids: list[int]) -> str:
        shown, high = self.shown, self.high
        if high.keys().isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            parts, run = [], bytearray()
            for i in ids:
                b = high.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_utf8(run))
                    run = bytearray()
                parts.append(shown[i])
            if run:
                parts.append(_utf8(run))
            text = "".join(parts)
        first = next((i for i in ids if i not in self.blank), None)
        return text[1:] if first in self.opens else text


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that is not part of a valid character becomes U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _encoded(own: PrefixEncoder, texts: pa.Array) -> pa.ListArray:
    parts = [np.array(own.encode(t.as_py() or ""), np.int32) for t in texts]
    ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.zeros(0, np.int32)])))


def _decoded(own: Decoder | PrefixEncoder, lists: pa.ListArray) -> pa.Array:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *sizes])
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())


def _encoder(model: bytes) -> PrefixEncoder:
    return tx.per_process("encoder" + hashlib.sha256(model).hexdigest(), lambda: PrefixEncoder(model))


def _leave(own: PrefixEncoder) -> None:
    """Give back what a task gathered; the worker process may do other work next."""
    own.forget()
    pa.default_memory_pool().release_unused()


def encode_column(text: Column, model: bytes) -> Column:
    """Ids of each whole text; null counts as empty, which has none."""
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _encoder(model)
        try:
            for texts in batches:
                yield _encoded(own, texts)
        finally:
            _leave(own)

    return encode(text)


def decode_column(ids: Column, model: bytes) -> Column:
    """Text of each id list; null counts as empty."""
    name = "decoder" + hashlib.sha256(model).hexdigest()

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return _decoded(tx.per_process(name, lambda: Decoder(model)), lists)

    return decode(ids)


def round_trip_column(text: Column, model: bytes) -> Column:
    """ids and decoded of each whole text: what `encode_column` gives and `decode_column` makes
    of it, in one worker process and without sending the ids there twice."""
    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _encoder(model)
        try:
            for texts in batches:
                ids = _encoded(own, texts)
                yield pa.StructArray.from_arrays([ids, _decoded(own, ids)], names=["ids", "decoded"])
        finally:
            _leave(own)

    return both(text)
