"""Texts that match a regular expression, as a Column of draws.

Alternation, groups, classes with ranges, escapes for digits, word characters and
blanks, the dot, and repetition; a repetition without an end goes GROWTH beyond its
least. Anything else (look-around, back references) has no sampler.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.draw import Draw

GROWTH = 4
#: Repetitions of up to so many are written out.
UNROLLED = 6
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORD = LETTERS + LETTERS.upper() + DIGITS + "_"
PRINTABLE = "".join(map(chr, range(33, 127)))
ESCAPES = {"d": DIGITS, "w": WORD, "s": " ", "n": "\n", "t": "\t", "r": "\r"}
OPPOSITES = {"D": DIGITS, "W": WORD, "S": " "}


class Unsupported(Exception):
    pass


class Parser:
    """Nodes: ("chars", text), ("seq", nodes), ("alt", nodes), ("rep", node, least, most)."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def done(self) -> bool:
        return self.at >= len(self.text)

    def next(self) -> str:
        if self.done():
            raise Unsupported
        self.at += 1
        return self.text[self.at - 1]

    def alternation(self) -> tuple:
        branches = [self.sequence()]
        while not self.done() and self.text[self.at] == "|":
            self.at += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self) -> tuple:
        out = []
        while not self.done() and self.text[self.at] not in "|)":
            node = self.atom()
            if node is not None:
                out.append(self.repeated(node))
        return ("seq", out)

    def atom(self) -> tuple | None:
        c = self.next()
        if c in "^$":
            return None
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            elif self.text.startswith("?", self.at):
                raise Unsupported
            node = self.alternation()
            if self.done() or self.next() != ")":
                raise Unsupported
            return node
        if c == "[":
            return ("chars", self.charset())
        if c == ".":
            return ("chars", WORD)
        if c == "\\":
            return ("chars", self.escaped())
        if c in "*+?{":
            raise Unsupported
        return ("chars", c)

    def escaped(self) -> str:
        c = self.next()
        if c in ESCAPES:
            return ESCAPES[c]
        if c in OPPOSITES:
            return "".join(x for x in PRINTABLE if x not in OPPOSITES[c])
        if c.isalnum():
            raise Unsupported
        return c

    def charset(self) -> str:
        negated = self.text.startswith("^", self.at)
        self.at += negated
        found: list[str] = []
        first = True
        while True:
            c = self.next()
            if c == "]" and not first:
                break
            first = False
            if c == "\\":
                found += self.escaped()
            elif c == "[" and self.text.startswith(":", self.at):
                end = self.text.index(":]", self.at)
                named = {"digit": DIGITS, "alpha": LETTERS + LETTERS.upper(), "alnum": LETTERS + LETTERS.upper() + DIGITS, "lower": LETTERS, "upper": LETTERS.upper(), "space": " "}
                found += named[self.text[self.at + 1 : end]]
                self.at = end + 2
            elif self.text.startswith("-", self.at) and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                found += map(chr, range(ord(c), ord(self.next()) + 1))
            else:
                found.append(c)
        unique = list(dict.fromkeys(found))
        text = "".join(x for x in PRINTABLE if x not in unique) if negated else "".join(unique)
        if not text:
            raise Unsupported
        return text

    def repeated(self, node: tuple) -> tuple:
        while not self.done() and self.text[self.at] in "*+?{":
            c = self.next()
            if c == "{":
                end = self.text.index("}", self.at)
                body = self.text[self.at : end]
                self.at = end + 1
                low, high = body.split(",") if "," in body else (body, body)
                least = int(low or 0)
                most = int(high) if high else least + GROWTH
            else:
                least, most = {"*": (0, GROWTH), "+": (1, 1 + GROWTH), "?": (0, 1)}[c]
            if not self.done() and self.text[self.at] in "?+":
                self.at += 1  # laziness and possession don't change what matches
            node = ("rep", node, least, most)
        return node


def sampler(pattern: str, draw: Draw) -> Column | None:
    """A text that matches, or None where the pattern has no sampler."""
    try:
        p = Parser(pattern)
        node = p.alternation()
        if not p.done():
            return None
    except (Unsupported, ValueError, KeyError, RecursionError):
        return None
    slots = iter(range(1 << 20))

    def emit(node: tuple, d: Draw) -> Column:
        kind = node[0]
        if kind == "chars":
            chars = node[1]
            return F.lit(chars) if len(chars) == 1 else F.substr(F.lit(chars), (d.below(len(chars), next(slots)) + 1).cast("int"), F.lit(1))
        if kind == "seq":
            parts = [emit(x, d) for x in node[1]]
            return F.concat(*parts) if parts else F.lit("")
        if kind == "alt":
            which = d.below(len(node[1]), next(slots))
            branches = [emit(x, d) for x in node[1]]
            return reduce(lambda out, k: F.when(which == k, branches[k]).otherwise(out), range(len(branches) - 1), branches[-1])
        _, inner, least, most = node
        times = F.lit(least) if least == most else F.lit(least) + d.below(most - least + 1, next(slots))
        if most <= UNROLLED:
            parts = [emit(inner, d) for _ in range(most)]
            return F.concat(*(x if k < least else F.when(times > k, x).otherwise("") for k, x in enumerate(parts))) if parts else F.lit("")
        attempt = d.attempt if isinstance(d.attempt, Column) else F.lit(d.attempt)
        each = F.transform(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")), lambda k: emit(inner, replace(d, attempt=attempt.cast("long") * 1009 + k)))
        return F.when(times > 0, F.array_join(each, "")).otherwise("")

    return emit(node, draw)
