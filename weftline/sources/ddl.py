"""Models from DDL text: Postgres, MySQL and SQLite.

One tokenizer and one recursive parser serve the three; what differs is quoting, types
and a few clauses. A statement that can't be read is skipped. CHECKs are kept as text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from weftline.sources.kinds import RANGES, bits_of, kind_of, sizes
from weftline.sources.model import Column, ForeignKey, Partition, Schema, Table

# The schema of names that state none.
HOME = {"postgres": "public", "mysql": "main", "sqlite": "main"}

PIECES = {
    "space": r"\s+",
    "comment": r"--[^\n]*|/\*.*?\*/",
    "dollar": r"\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$",
    "string": r"[EeNnBbXx]?'(?:[^']|'')*'",
    "quoted": r'"(?:[^"]|"")*"',
    "number": r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+",
    "word": r"[^\W\d][\w$]*",
    "mark": r"::|<>|!=|<=|>=|\|\||.",
}
SPECIAL = {
    "postgres": {},
    "mysql": {"string": r"(?:[EeNnBbXx]|_\w+\s*)?(?:'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")", "quoted": r"`(?:[^`]|``)*`", "comment": r"--[^\n]*|#[^\n]*|/\*.*?\*/", "dollar": r"(?!)(?P<tag>)"},
    "sqlite": {"quoted": r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]', "dollar": r"(?!)(?P<tag>)"},
}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text if self.kind == "mark" else ""


def tokenize(text: str, dialect: str) -> list[Token]:
    pieces = PIECES | SPECIAL[dialect]
    if dialect != "mysql":
        pattern = re.compile("|".join(f"(?P<{k}>{v})" for k, v in pieces.items()), re.DOTALL)
    else:
        order = ["space", "comment", "string", "quoted", "number", "word", "mark"]
        pattern = re.compile("|".join(f"(?P<{k}>{pieces[k]})" for k in order), re.DOTALL)
    return [Token("string" if m.lastgroup in ("dollar", "tag") else m.lastgroup, m.group(), m.start(), m.end()) for m in pattern.finditer(text) if m.lastgroup not in ("space", "comment")]


def statements(tokens: list[Token]) -> list[list[Token]]:
    out, now = [], []
    for t in tokens:
        if t.low == ";":
            out.append(now)
            now = []
        else:
            now.append(t)
    return [s for s in [*out, now] if s]


class Unreadable(Exception):
    pass


def bare(t: Token) -> str:
    """An identifier's name."""
    if t.kind == "quoted":
        mark = t.text[-1] if t.text[-1] != "]" else ""
        return t.text[1:-1].replace(mark * 2, mark) if mark else t.text[1:-1]
    if t.kind == "word":
        return t.text
    raise Unreadable


def unquoted(t: Token) -> str:
    """A string's value."""
    mark = t.text[-1]
    body = t.text[t.text.index(mark) + 1 : -1].replace(mark * 2, mark)
    return body


#: What ends a DEFAULT or a type: words that begin another clause of a column.
CLAUSES = {"not", "null", "default", "primary", "unique", "check", "references", "constraint", "generated", "collate", "auto_increment", "autoincrement", "comment", "on", "deferrable", "initially", "key", "character", "charset", "visible", "invisible", "storage", "as", "identity", "virtual", "stored"}


@dataclass
class Draft:
    """A table while it is read."""

    schema: str
    name: str
    columns: list[Column] = field(default_factory=list)
    primary: tuple[str, ...] = ()
    uniques: list[tuple[str, ...]] = field(default_factory=list)
    foreign: list[tuple[tuple[str, ...], tuple[str, str], tuple[str, ...]]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    partition: Partition | None = None
    declared: dict[str, str] = field(default_factory=dict)  # column -> type as written

    def unique(self, columns: tuple[str, ...]) -> None:
        if columns and columns not in self.uniques and columns != self.primary:
            self.uniques.append(columns)


class Reader:
    def __init__(self, text: str, dialect: str) -> None:
        self.text, self.dialect, self.home = text, dialect, HOME[dialect]
        self.tables: dict[tuple[str, str], Draft] = {}
        self.enums: dict[str, tuple[str, ...]] = {}
        self.domains: dict[str, tuple[Column, tuple[str, ...]]] = {}
        self.records: dict[str, tuple[Column, ...]] = {}
        self.toks: list[Token] = []
        self.at = 0

    # -- moving over one statement's tokens

    def peek(self, *words: str, ahead: int = 0) -> bool:
        at = self.at + ahead
        return at < len(self.toks) and self.toks[at].low in words

    def take(self, *words: str) -> Token:
        if self.at >= len(self.toks) or words and not self.peek(*words):
            raise Unreadable
        self.at += 1
        return self.toks[self.at - 1]

    def maybe(self, *words: str) -> bool:
        """All the words one after another, or nothing."""
        if all(self.peek(w, ahead=i) for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def inside(self) -> list[Token]:
        """The tokens of a balanced pair of parentheses, which is passed."""
        self.take("(")
        begin, depth = self.at, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(self.take().low, 0)
        return self.toks[begin : self.at - 1]

    def raw(self, tokens: list[Token]) -> str:
        return self.text[tokens[0].start : tokens[-1].end] if tokens else ""

    def name(self) -> tuple[str, str]:
        first = bare(self.take())
        if self.maybe("."):
            return first, bare(self.take())
        return self.home, first

    def names(self) -> tuple[str, ...]:
        """Column names in parentheses; a length or an order after a name is passed over, an expression is unreadable."""
        out = []
        for part in split(self.inside()):
            if len(part) > 1 and part[1].low == "(" and not part[2].text.isdigit():
                raise Unreadable
            out.append(bare(part[0]))
        return tuple(out)

    # -- statements

    def read(self) -> None:
        for toks in statements(tokenize(self.text, self.dialect)):
            self.toks, self.at = toks, 0
            try:
                self.statement()
            except (Unreadable, IndexError, KeyError, ValueError):
                continue

    def statement(self) -> None:
        if self.maybe("use"):
            self.home = bare(self.take())
        elif self.maybe("create", "type"):
            self.create_type()
        elif self.maybe("create", "domain"):
            self.create_domain()
        elif self.maybe("alter", "table"):
            self.alter_table()
        elif self.maybe("create"):
            if self.maybe("unique"):
                self.take("index")
                self.create_unique_index()
                return
            while self.peek("temp", "temporary", "unlogged", "global", "local"):
                self.take()
            self.take("table")
            self.create_table()

    def create_type(self) -> None:
        _, name = self.name()
        self.take("as")
        if self.maybe("enum"):
            self.enums[name.lower()] = tuple(unquoted(t) for t in self.inside() if t.kind == "string")
        else:
            parts = split(self.inside())
            self.records[name.lower()] = tuple(self.typed(bare(p[0]), p[1:])[0] for p in parts)

    def create_domain(self) -> None:
        _, name = self.name()
        self.maybe("as")
        begin = self.at
        while self.at < len(self.toks) and not self.peek("check", "not", "default", "constraint", "null", "collate"):
            self.take()
        column, _ = self.typed(name, self.toks[begin : self.at])
        checks = []
        while self.at < len(self.toks):
            if self.maybe("check"):
                checks.append(self.raw(self.inside()))
            elif self.maybe("not", "null"):
                column = replace(column, nullable=False)
            else:
                self.take()
        self.domains[name.lower()] = column, tuple(checks)

    def create_table(self) -> None:
        self.maybe("if", "not", "exists")
        schema, name = self.name()
        if self.maybe("partition", "of"):
            self.partition_of(self.name())
            return
        draft = Draft(schema, name)
        end = self.at
        body = self.inside()
        after = self.at
        outer = self.toks
        for part in split(body):
            self.toks, self.at = part, 0
            try:
                self.entry(draft)
            except (Unreadable, IndexError):
                continue
        self.toks, self.at = outer, after
        if end and self.maybe("partition", "by"):
            strategy = self.take("range", "list", "hash").low
            try:
                columns = self.names()
            except Unreadable:
                columns = ()
            draft.partition = Partition(strategy, columns)
        self.tables[schema, name] = draft

    def partition_of(self, parent: tuple[str, str]) -> None:
        draft = self.tables[parent]
        p = draft.partition
        if p is None:
            raise Unreadable
        if self.maybe("default"):
            draft.partition = replace(p, has_default=True)
            return
        self.take("for")
        self.take("values")
        if self.maybe("in"):
            values = tuple(unquoted(t) if t.kind == "string" else t.text for part in split(self.inside()) for t in part[:1])
            draft.partition = replace(p, values=p.values + values)
        elif self.maybe("from"):
            low = self.bound()
            self.take("to")
            draft.partition = replace(p, ranges=(*p.ranges, (low, self.bound())))

    def bound(self) -> str | None:
        """The first value of a partition's bound; None for MINVALUE and MAXVALUE."""
        t = split(self.inside())[0]
        if t[0].low in ("minvalue", "maxvalue"):
            return None
        strings = [x for x in t if x.kind == "string"]
        return unquoted(strings[0]) if strings else "".join(x.text for x in t)

    def create_unique_index(self) -> None:
        self.maybe("concurrently")
        self.maybe("if", "not", "exists")
        if not self.peek("on"):
            self.name()
        self.take("on")
        self.maybe("only")
        draft = self.tables[self.name()]
        if self.maybe("using"):
            self.take()
        columns = self.names()
        if not self.peek("where"):
            draft.unique(columns)

    def alter_table(self) -> None:
        self.maybe("if", "exists")
        self.maybe("only")
        draft = self.tables[self.name()]
        for part in split(self.toks[self.at :]):
            self.toks, self.at = part, 0
            if self.maybe("add") and not self.peek("column"):
                self.constraint(draft)

    # -- entries of a table

    def entry(self, draft: Draft) -> None:
        if self.peek("constraint", "primary", "unique", "foreign", "check", "exclude", "key", "index", "fulltext", "spatial", "like"):
            if self.peek("key", "index", "fulltext", "spatial", "exclude", "like") and not self.column_named():
                return
            if not self.column_named():
                self.constraint(draft)
                return
        self.column(draft)

    def column_named(self) -> bool:
        """Whether a word such as key is a column's name here: a type follows, not a parenthesis or a clause."""
        nxt = self.toks[self.at + 1] if self.at + 1 < len(self.toks) else None
        return self.peek("key", "index", "check", "like") and nxt is not None and nxt.kind == "word" and kind_of(nxt.text, self.dialect if self.dialect != "sqlite" else "postgres") != "unsupported"

    def constraint(self, draft: Draft) -> None:
        if self.maybe("constraint") and not self.peek("primary", "unique", "foreign", "check"):
            self.take()
        if self.maybe("primary", "key"):
            while not self.peek("("):
                self.take()
            draft.primary = self.names()
        elif self.maybe("unique"):
            while not self.peek("("):
                self.take()
            draft.unique(self.names())
        elif self.maybe("foreign", "key"):
            while not self.peek("("):
                self.take()
            self.references(draft, self.names())
        elif self.maybe("check"):
            draft.checks.append(self.raw(self.inside()))

    def references(self, draft: Draft, columns: tuple[str, ...]) -> None:
        self.take("references")
        parent = self.name()
        draft.foreign.append((columns, parent, self.names() if self.peek("(") else ()))

    def column(self, draft: Draft) -> None:
        name = bare(self.take())
        begin = self.at
        while self.at < len(self.toks) and (not self.peek(*CLAUSES) or self.peek("character") and self.at == begin):
            if self.peek("("):
                self.inside()
            else:
                self.take()
        type_tokens = self.toks[begin : self.at]
        c, checks = self.typed(name, type_tokens)
        draft.declared[name] = self.raw(type_tokens)
        draft.checks += checks
        if self.dialect == "mysql" and type_tokens and type_tokens[0].text.lower() == "serial":
            draft.unique((name,))  # an alias that says so
        while self.at < len(self.toks):
            if self.maybe("not", "null"):
                c = replace(c, nullable=False)
            elif self.maybe("null"):
                pass
            elif self.maybe("default"):
                c = replace(c, default=True)
                self.skip_value()
            elif self.maybe("primary", "key") or self.maybe("key"):
                draft.primary = (name,)
            elif self.maybe("unique"):
                self.maybe("key")
                draft.unique((name,))
            elif self.maybe("check"):
                draft.checks.append(self.raw(self.inside()))
            elif self.peek("references"):
                self.references(draft, (name,))
            elif self.peek("auto_increment", "autoincrement"):
                self.take()
                c = replace(c, identity=True, nullable=False)
            elif self.maybe("generated") or self.peek("as"):
                c = self.made(c)
            elif self.maybe("on"):
                while self.at < len(self.toks) and not self.peek(*(CLAUSES - {"null", "default", "on"})):
                    self.take()
            elif self.peek("("):
                self.inside()
            else:
                self.take()
        if name in draft.primary:
            c = replace(c, nullable=False)
        draft.columns.append(c)

    def made(self, c: Column) -> Column:
        """GENERATED ... AS IDENTITY, or a computed column."""
        while self.peek("always", "by", "default"):
            self.take()
        self.take("as")
        if self.maybe("identity"):
            if self.peek("("):
                self.inside()
            return replace(c, identity=True, nullable=False)
        self.inside()
        return replace(c, generated=True)

    def skip_value(self) -> None:
        if self.peek("("):
            self.inside()
        else:
            self.take()  # also the word null of DEFAULT NULL
        while self.at < len(self.toks) and not self.peek(*CLAUSES):
            if self.peek("("):
                self.inside()
            else:
                self.take()

    # -- types

    def typed(self, name: str, toks: list[Token]) -> tuple[Column, list[str]]:
        """(column, CHECKs that a domain brings) from a type's tokens."""
        depth, words, args, inner = 0, [], [], []
        for t in toks:
            if t.low == "(":
                depth += 1
            elif t.low == ")":
                depth -= 1
            elif depth:
                inner.append(t)
                if t.low != ",":
                    args.append(unquoted(t) if t.kind == "string" else t.text)
            else:
                words.append(t)
        lows = [t.low or t.text.lower() for t in words]
        is_array = "[" in lows or "array" in lows
        lows = [w for w in lows if w not in ("[", "]", "array") and not w.isdigit()]
        if len(lows) >= 3 and lows[-2] == ".":
            lows = lows[-1:]
        first = lows[0].strip('"') if lows else ""
        if self.dialect == "sqlite":
            first = " ".join(lows)
        c, checks = self.scalar(name, first, lows, tuple(args))
        if self.dialect == "postgres" and is_array:
            c = Column(name, "array", element=replace(c, name=f"{name}_element"))
        return c, checks

    def scalar(self, name: str, first: str, lows: list[str], args: tuple[str, ...]) -> tuple[Column, list[str]]:
        if self.dialect == "postgres":
            if first in self.enums:
                return Column(name, "enum", labels=self.enums[first]), []
            if first in self.records:
                return Column(name, "composite", fields=self.records[first]), []
            if first in RANGES:
                return Column(name, "range", element=Column(f"{name}_bound", RANGES[first])), []
            if first in self.domains:
                base, checks = self.domains[first]
                return replace(base, name=name), [re.sub(r"(?i)\bvalue\b", f'"{name}"', x) for x in checks]
        if self.dialect == "mysql" and first in ("enum", "set"):
            return Column(name, "enum", labels=args if first == "enum" else (",".join(args),)), []
        kind = kind_of(first, self.dialect, args)
        c = Column(name, kind, bits=bits_of(first, self.dialect) if kind == "integer" else 64, **sizes(kind, args))
        if self.dialect == "postgres" and "serial" in first:
            c = replace(c, default=True, nullable=False)
        if self.dialect == "mysql" and first == "serial":
            c = replace(c, identity=True, nullable=False)
        return c, []

    # -- the model

    def schema(self) -> Schema:
        out = Schema()
        for d in self.tables.values():
            columns = tuple(replace(c, nullable=False) if c.name in d.primary else c for c in d.columns)
            if self.dialect == "sqlite" and len(d.primary) == 1 and d.declared.get(d.primary[0], "").strip().upper() == "INTEGER":
                columns = tuple(replace(c, identity=True) if c.name == d.primary[0] else c for c in columns)
            fks = tuple(ForeignKey(cols, f"{s}.{t}", to) for cols, (s, t), to in d.foreign)
            out.add(Table(d.name, columns, d.schema, d.primary, tuple(d.uniques), fks, tuple(d.checks), d.partition))
        return out.resolved()


def split(toks: list[Token]) -> list[list[Token]]:
    """At commas outside parentheses and brackets."""
    out, now, depth = [], [], 0
    for t in toks:
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(t.low, 0)
        if t.low == "," and not depth:
            out.append(now)
            now = []
        else:
            now.append(t)
    return [p for p in [*out, now] if p]


def load(text: str, dialect: str = "postgres") -> Schema:
    """The model that DDL text declares."""
    reader = Reader(text, dialect)
    reader.read()
    return reader.schema()
