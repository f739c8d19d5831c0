"""The graph of foreign keys: order of tables, cycles, groups of join keys."""

from __future__ import annotations

from weftline.sources.model import Schema


def parents_of(schema: Schema) -> dict[str, set[str]]:
    """Parents of each table within the schema, without itself."""
    return {k: {f.parent for f in t.foreign if f.parent in schema.tables and f.parent != k} for k, t in schema.tables.items()}


def cyclic_tables(schema: Schema) -> set[str]:
    """Tables that refer to themselves over any number of foreign keys."""
    parents = parents_of(schema)
    found = {k for k, t in schema.tables.items() if any(f.parent == k for f in t.foreign)}
    for start in schema.tables:
        seen, todo = set(), list(parents[start])
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += parents[k]
        if start in seen:
            found.add(start)
    return found


def order(schema: Schema) -> tuple[list[str], list[list[str]]]:
    """(tables with parents before children, the waves they come in).

    Tables of a wave depend on earlier waves only. Where only cycles are left, the table
    with the fewest parents missing goes first (ties: as declared).
    """
    parents = parents_of(schema)
    done: list[str] = []
    waves: list[list[str]] = []
    left = list(schema.tables)
    while left:
        wave = [k for k in left if parents[k] <= set(done)]
        if not wave:
            wave = [min(left, key=lambda k: len(parents[k] - set(done)))]
        waves.append(wave)
        done += wave
        left = [k for k in left if k not in wave]
    return done, waves


def key_groups(schema: Schema) -> list[list[tuple[str, str]]]:
    """Columns (table, column) that foreign keys tie together, each group sorted, of two columns at least."""
    root: dict[tuple[str, str], tuple[str, str]] = {}

    def find(x: tuple[str, str]) -> tuple[str, str]:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, t in schema.tables.items():
        for f in t.foreign:
            if f.parent in schema.tables:
                for c, p in zip(f.columns, f.parent_columns, strict=True):
                    a, b = sorted((find((k, c)), find((f.parent, p))))
                    root[b] = a
    groups: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for x in sorted(root):
        groups.setdefault(find(x), []).append(x)
    return [g for g in groups.values() if len(g) > 1]


def representative(schema: Schema, group: list[tuple[str, str]]) -> tuple[str, str]:
    """The first member that a foreign key refers to, or the first by name."""
    referred = {(f.parent, p) for t in schema.tables.values() for f in t.foreign for p in f.parent_columns}
    return next((x for x in group if x in referred), group[0])


def protected(schema: Schema) -> set[tuple[str, str]]:
    """Columns of primary keys and foreign keys, and columns these refer to."""
    out = set()
    for k, t in schema.tables.items():
        out |= {(k, c) for c in t.primary}
        for f in t.foreign:
            out |= {(k, c) for c in f.columns} | {(f.parent, c) for c in f.parent_columns}
    return out
