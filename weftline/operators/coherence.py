"""Columns that tell of one person or place agree with each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import vocabulary as V
from weftline.functions.draw import Draw
from weftline.functions.generators import digits, first_name
from weftline.functions.names import rule, tokens
from weftline.sources.model import Table

# What a name tells of; the first that matches counts.
ROLES = (
    rule("email", "email"),
    rule("username", "", "username login handle"),
    rule("first", "firstname givenname"),
    rule("last", "lastname surname familyname"),
    rule("full", "fullname displayname contactname", "", "name"),
    rule("sex", "", "gender sex"),
    rule("state", "", "state province region"),
    rule("zip", "zipcode postalcode postcode", "zip"),
    rule("city", "", "city town municipality"),
    rule("country", "", "country"),
)
# Words that tell a role; the others tell whose columns they are.
ROLE_WORDS = frozenset(
    """first firstname given givenname fname last lastname sur surname family familyname lname
    middle middlename name full fullname display displayname contact contactname
    email emailaddress mail user username login handle gender sex state province region
    zip zipcode postal postalcode postcode code city town municipality country nation address addr""".split()
)


def role(name: str) -> tuple[str, str] | None:
    """(role, whose) of a column."""
    found = next((r.maker for r in ROLES if r.matches(name)), None)
    return (found, "".join(w for w in tokens(name) if w not in ROLE_WORDS)) if found else None


def groups(table: Table, skip: set[str] = frozenset()) -> list[dict[str, list[str]]]:
    """Groups of columns (role -> names) that hold both names, or a state with a ZIP code or city."""
    found: dict[str, dict[str, list[str]]] = {}
    for c in table.columns:
        r = role(c.name)
        if r and c.name not in skip and (c.kind == "text" or r[0] == "sex" and c.kind == "enum"):
            found.setdefault(r[1], {}).setdefault(r[0], []).append(c.name)
    return [g for g in found.values() if {"first", "last"} <= set(g) or "state" in g and {"zip", "city"} & set(g)]


def places(d: Draw) -> tuple[Column, Column]:
    """A state, and its draw's place in the list."""
    return d.pick(list(V.STATES)), d.below(len(V.STATES))


def coherent(rows: DataFrame, table: Table, draw: Draw, frozen: set[str]) -> DataFrame:
    """rows with each group's columns agreeing; frozen columns and nulls stay.

    A frozen state, first name or last name is what the rest of its group follows; a
    state that isn't known keeps the ZIP code and city that were drawn.
    """
    new: dict[str, Column] = {}

    def put(names: list[str], made: Callable[[int], Column]) -> None:
        """made(k): the value of the k-th column of a role."""
        for k, name in enumerate(names):
            if name not in frozen:
                limit = table.column(name).length
                v = F.substring(made(k), 1, limit) if limit else made(k)
                new[name] = F.when(F.col(name).isNotNull(), v) if table.column(name).nullable else v

    for n, g in enumerate(groups(table)):
        d = draw.of(f"{draw.name}.group{n}")
        of = lambda role: g.get(role, [])  # noqa: B023, E731
        own = lambda role, made: F.coalesce(F.col(g[role][0]), made) if g[role][0] in frozen else made  # noqa: B023, E731
        if {"first", "last"} <= set(g):
            first = own("first", first_name(d, F.col(g["sex"][0]) if "sex" in g else None))
            last = own("last", d.pick(V.LAST, 5))
            put(of("first"), lambda _: first)  # noqa: B023
            put(of("last"), lambda _: last)  # noqa: B023
            put(of("full"), lambda _: F.concat_ws(" ", first, last))  # noqa: B023
            put(of("email"), lambda k: F.concat(F.lower(first), F.lit("."), F.lower(last), d.below(10_000, 6 + 20 * k).cast("string"), F.lit("@"), d.pick(V.DOMAINS, 7 + 20 * k)))  # noqa: B023
            put(of("username"), lambda k: F.concat(F.lower(first), F.lit("_"), F.lower(last), d.below(10_000, 8 + 20 * k).cast("string")))  # noqa: B023
        if "state" in g and {"zip", "city"} & set(g):
            state = own("state", d.pick(list(V.STATES), 10))
            known = F.create_map(*(x for s, (z, cities) in V.STATES.items() for x in (F.lit(s), F.struct(F.lit(f"{z:03d}").alias("zip"), F.array(*map(F.lit, cities)).alias("cities")))))
            here = F.element_at(known, state)
            city = F.element_at(here["cities"], (F.pmod(d.below(1 << 30, 12), F.size(here["cities"])) + 1).cast("int"))
            put(of("state"), lambda _: state)  # noqa: B023
            put(of("zip"), lambda k: F.coalesce(F.concat(here["zip"], digits(d, 2, 11 + 20 * k)), F.col(g["zip"][k])))  # noqa: B023
            put(of("city"), lambda k: F.coalesce(city, F.col(g["city"][k])))  # noqa: B023
            put(of("country"), lambda _: F.lit("United States"))
    return rows.withColumns(new) if new else rows
