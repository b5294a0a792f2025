"""License scans: Aho-Corasick finds tags and notices, a shunting-yard parser evaluates expressions.

Notices are phrases of whole words; an identifier tag is followed by a licence
expression of identifiers, ``and``, ``or``, ``with`` and parentheses up to the end of
its line.  The expression is brought to postfix form and evaluated to the freedom that
it leaves: ``and`` binds to the stricter side, ``or`` lets the reader choose the freer
one, ``with`` adds an exception to its licence.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: The phrases that give the base labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause license": "bsd",
    "bsd 2 clause license": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Words that announce an expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "license-identifier:")
#: How freely text under a label can be used, by the start of the label.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "cc0": 1.0, "unlicense": 1.0,
    "cc-by-nc": 0.1, "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc-by": 0.9, "mpl": 0.7, "lgpl": 0.6, "agpl": 0.3,
    "gpl": 0.4, "all-rights-reserved": 0.0,
}
#: What a label that is not listed leaves, and what an exception gives back at least.
UNKNOWN, EXCEPTION = 0.3, 0.8

_STRENGTH = {"or": 1, "and": 2, "with": 3}
_ITEM = re.compile(r"[()\n]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {i: i + 32 for i in range(65, 91)}


def freedom(label: str) -> float:
    """Of the listed starts that fit a label, the longest counts."""
    fits = [k for k in FREEDOM if label == k or label.startswith((k + "-", k + "."))]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def postfix(text: str, at: int = 0) -> list[str]:
    """Items, in postfix order, of the expression from ``at`` on; it ends where the line or the grammar does.

    Operators bind in the order with, and, or, and from the left.  A closing parenthesis
    too many ends the expression; missing ones are added; an operator without a right
    side is left out.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for item in _ITEM.finditer(text, at):  # lazily: many tags of one long line do not each read all of it
        word = item.group().lower()
        if word == "\n":
            break
        if operand_next:
            if word == "(":
                waiting.append(word)
            elif word in _STRENGTH or word == ")":
                break
            else:
                out.append(word)
                operand_next = False
        elif word == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return out
            waiting.pop()
        elif word in _STRENGTH:
            while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            break
    if operand_next:
        while waiting and waiting[-1] in "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    return out + [x for x in reversed(waiting) if x != "("]


def evaluate(items: list[str]) -> tuple[set[str], float]:
    """Labels of a postfix expression, and the freedom it leaves (1 if it is empty)."""
    stack: list[tuple[set[str], float]] = []
    for item in items:
        if item not in _STRENGTH:
            stack.append(({item}, freedom(item)))
            continue
        b, a = stack.pop(), stack.pop()
        if item == "with":
            stack.append((a[0], max(a[1], EXCEPTION)))
        else:
            stack.append((a[0] | b[0], (min if item == "and" else max)(a[1], b[1])))
    return stack[0] if stack else (set(), 1.0)


class Scanner:
    def __init__(self):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for phrase, label in (BASE | NOTICES).items():
            self.phrases.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.tags.make_automaton()

    def scan(self, text: str) -> dict:
        """Everything found in one whole text; ``places`` are (first word, words, label) of each notice."""
        low = text.translate(_UPPER) if not text.isascii() else text.lower()
        flat = f" {_GAP.sub(' ', low).strip(' ')} "
        n_words = flat.count(" ") - 1 if len(flat) > 2 else 0
        places, base, labels, strictest = [], [], set(), 1.0
        at = word = 0
        for end, (phrase, label, is_base) in self.phrases.iter(flat):
            start = end - len(phrase) - 1
            # places of one scan go up by their ends; starts may step back a little
            word += flat.count(" ", at, start) if start >= at else -flat.count(" ", start, at)
            at = start
            places.append((word, phrase.count(" ") + 1, label))
            strictest = min(strictest, freedom(label))
            labels.add(label)
            if is_base:
                base.append((word, label))
        expressions = []
        for end, length in self.tags.iter(low):
            begin = end + 1 - length
            if begin and (low[begin - 1].isalnum() or low[begin - 1] in "-_"):
                continue
            expression = postfix(low, end + 1)
            if expression:
                expressions.append(" ".join(expression))
                own, free = evaluate(expression)
                labels |= own
                strictest = min(strictest, free)
        return {"n_words": n_words, "n_base": len(base), "first_word": min(base)[0] if base else None,
                "last_word": max(base)[0] if base else None, "base_labels": sorted({x for _, x in base}),
                "labels": sorted(labels), "score": strictest, "expressions": expressions,
                "places": [{"word": w, "words": n, "label": x} for w, n, x in sorted(places)]}


SCAN = ("struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: array<string>, "
        "labels: array<string>, score: double, expressions: array<string>, "
        "places: array<struct<word: bigint, words: int, label: string>>>")
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                    ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
                    ("labels", pa.list_(pa.string())), ("score", pa.float64()),
                    ("expressions", pa.list_(pa.string())),
                    ("places", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()),
                                                   ("label", pa.string())])))])


def scan_column(text: Column) -> Column:
    """What `Scanner.scan` finds in each whole text; null counts as empty.

    score is the freedom that the strictest notice or expression leaves, from 0 to 1;
    a text without any has 1.  Repeated labels count once, places each time.
    """
    held: list[Scanner] = []

    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner())
        return pa.array([held[0].scan(t.as_py() or "") for t in texts], _ARROW)

    return scan(text)
