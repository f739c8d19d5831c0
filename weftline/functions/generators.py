"""One value a row for a column of the model: by setting, label, name, type and CHECK bounds.

Every generator is an expression over draws. Dates and timestamps are milliseconds here
(a long) and become what they are in ``finished``, so that the passes that follow can
compare and move them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as Col
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import instants
from weftline.functions import vocabulary as V
from weftline.functions.checks import Bounds
from weftline.functions.draw import Draw
from weftline.functions.instants import DAY
from weftline.functions.names import MONEY_TOP, json_rule, number_rule, text_rule
from weftline.functions.patterns import LETTERS, sampler
from weftline.functions.spread import Spread, label_draw
from weftline.sources.model import Column, Partition, Table, lookup

NULLS = 0.08
#: Width of a number range that is open on one side.
SPAN = 1000
#: Where dates lie unless settings say otherwise.
UNTIL = instants.millis("2025-01-01")


@dataclass(frozen=True)
class Context:
    """Settings for a run's generators; columns: overrides; spreads: value distributions."""

    columns: dict = field(default_factory=dict)
    spreads: dict[str, Spread] = field(default_factory=dict)
    until: int = UNTIL


def title(word: Col) -> Col:
    return F.initcap(word)


def words(d: Draw, least: int, most: int) -> Col:
    """From least to most words; slots 0 to most."""
    n = d.between(least, most)
    return F.array_join(F.slice(F.array(*(d.pick(V.WORDS, k + 1) for k in range(most))), F.lit(1), n.cast("int")), " ")


def first_name(d: Draw, sex: Col | None = None) -> Col:
    pools = {"f": V.WOMEN, "m": V.MEN}
    own = {k: d.pick(pool, 1) for k, pool in pools.items()}
    if sex is None:
        return F.when(d.below(2) == 0, own["f"]).otherwise(own["m"])
    hint = F.lower(sex)
    return F.when(hint.isin("male", "m"), own["m"]).when(hint.isin("female", "f"), own["f"]).otherwise(first_name(d))


def uuid(d: Draw) -> Col:
    h = F.md5(F.concat_ws("|", d.bits(0).cast("string"), d.bits(1).cast("string"), F.lit("uuid")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(d.pick(list("89ab"), 2), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def digits(d: Draw, n: int, slot: int = 0) -> Col:
    """n decimal digits, 15 at most."""
    return F.lpad(d.below(10**n, slot).cast("string"), n, "0")


def octets(d: Draw, n: int) -> Col:
    return F.concat_ws(":", *(F.lower(F.lpad(F.hex(d.below(256, k)), 2, "0")) for k in range(n)))


def moment(lo: int, hi: int) -> Callable[[Draw, Context], Col]:
    """Milliseconds between two offsets from the context's end."""
    return lambda d, ctx: F.lit(ctx.until + lo) + d.below(hi - lo)


def plain(make: Callable[[Draw], Col]) -> Callable[[Draw, Context], Col]:
    return lambda d, _: make(d)


def email(d: Draw) -> Col:
    return F.concat(F.lower(first_name(d)), F.lit("."), F.lower(d.pick(V.LAST, 2)), d.below(1000, 3).cast("string"), F.lit("@"), d.pick(V.DOMAINS, 4))


#: Named generators, for overrides and name rules; dates give milliseconds.
MAKERS: dict[str, Callable[[Draw, Context], Col]] = {
    "internet.email": plain(email),
    "internet.username": plain(lambda d: F.concat(F.lower(first_name(d)), F.lit("_"), F.lower(d.pick(V.LAST, 2)), d.below(1000, 3).cast("string"))),
    "internet.password": plain(lambda d: sampler("[A-Za-z0-9]{12}", d)),
    "internet.url": plain(lambda d: F.concat(F.lit("https://"), d.pick(V.WORDS), F.lit("-"), d.pick(V.WORDS, 1), F.lit("."), d.pick(V.DOMAINS, 2))),
    "internet.userAgent": plain(lambda d: d.pick(V.AGENTS)),
    "internet.ipv4": plain(lambda d: F.concat_ws(".", *(d.between(1, 254, k).cast("string") for k in range(4)))),
    "internet.mac": plain(lambda d: octets(d, 6)),
    "image.url": plain(lambda d: F.concat(F.lit("https://images.example.com/"), d.below(100_000).cast("string"), F.lit(".png"))),
    "person.firstName": plain(first_name),
    "person.middleName": plain(first_name),
    "person.lastName": plain(lambda d: d.pick(V.LAST)),
    "person.fullName": plain(lambda d: F.concat(first_name(d), F.lit(" "), d.pick(V.LAST, 2))),
    "person.jobTitle": plain(lambda d: F.concat(d.pick(V.LEVELS), F.lit(" "), d.pick(V.JOBS, 1))),
    "person.sex": plain(lambda d: d.pick(V.SEXES)),
    "company.name": plain(lambda d: F.concat(d.pick(V.LAST), F.lit(" "), d.pick(V.FIRMS, 1))),
    "phone.number": plain(lambda d: F.concat(F.lit("+1-"), digits(d, 3), F.lit("-555-"), digits(d, 4, 1))),
    "lorem.slug": plain(lambda d: F.concat_ws("-", *(d.pick(V.WORDS, k) for k in range(3)))),
    "lorem.word": plain(lambda d: d.pick(V.WORDS)),
    "lorem.words": plain(lambda d: words(d, 1, 3)),
    "lorem.sentence": plain(lambda d: F.concat(title(d.pick(V.WORDS, 9)), F.lit(" "), words(d, 1, 5))),
    "lorem.paragraph": plain(lambda d: F.concat(F.concat_ws(" ", *(F.concat(title(d.pick(V.WORDS, 10 * k + 9)), F.lit(" "), words(d.at(10 * k), 4, 8), F.lit(".")) for k in range(3))))),
    "location.street": plain(lambda d: F.concat(d.between(1, 999).cast("string"), F.lit(" "), title(d.pick(V.WORDS, 1)), F.lit(" "), d.pick(V.STREETS, 2))),
    "location.city": plain(lambda d: d.pick([c for _, cities in V.STATES.values() for c in cities])),
    "location.state": plain(lambda d: d.pick(list(V.STATES))),
    "location.country": plain(lambda d: d.pick(V.COUNTRIES)),
    "location.zipCode": plain(lambda d: digits(d, 5)),
    "location.latitude": plain(lambda d: ((d.below(1_800_001) - 900_000) / 10_000).cast("string")),
    "location.longitude": plain(lambda d: ((d.below(3_600_001) - 1_800_000) / 10_000).cast("string")),
    "location.timeZone": plain(lambda d: d.pick(V.ZONES)),
    "finance.currencyCode": plain(lambda d: d.pick(V.CURRENCIES)),
    "finance.iban": plain(lambda d: F.concat(F.lit("NO"), digits(d, 2), digits(d, 11, 1))),
    "finance.creditCardNumber": plain(lambda d: F.concat(F.lit("4"), digits(d, 15))),
    "commerce.price": plain(lambda d: (d.between(100, 100_000) / 100).cast("decimal(12,2)").cast("string")),
    "commerce.productName": plain(lambda d: F.concat(title(d.pick(V.WORDS)), F.lit(" "), d.pick(V.MATERIALS, 1), F.lit(" "), d.pick(V.PRODUCTS, 2))),
    "commerce.product": plain(lambda d: d.pick(V.PRODUCTS)),
    "color.human": plain(lambda d: d.pick(V.COLORS)),
    "date.past": moment(-730 * DAY, 0),
    "date.recent": moment(-30 * DAY, 0),
    "date.future": moment(0, 365 * DAY),
    "date.birthdate": moment(-80 * 365 * DAY, -18 * 365 * DAY),
    "string.uuid": plain(uuid),
    "number.int": plain(lambda d: d.below(1_000_001)),
    "datatype.boolean": plain(lambda d: d.below(2) == 1),
}


def bounded(d: Draw, b: Bounds, col: Column) -> Col:
    """A number within the bounds: SPAN wide where one side is open, but a decimal under an upper bound starts at zero, or the bound if that is less."""
    if col.kind == "integer":
        lo = None if b.low is None else math.floor(b.low) + 1 if b.low_open else math.ceil(b.low)
        hi = None if b.high is None else math.ceil(b.high) - 1 if b.high_open else math.floor(b.high)
        lo, hi = lo if lo is not None else hi - SPAN, hi if hi is not None else lo + SPAN
        return d.between(lo, max(lo, hi))
    n = places(col)
    one = 10**n
    lo = None if b.low is None else math.ceil(round(b.low * one, 6)) + int(b.low_open and round(b.low * one, 6) == math.ceil(round(b.low * one, 6)))
    hi = None if b.high is None else math.floor(round(b.high * one, 6)) - int(b.high_open and round(b.high * one, 6) == math.floor(round(b.high * one, 6)))
    lo = lo if lo is not None else min(0, hi)
    hi = hi if hi is not None else lo + SPAN * one
    return scaled(d.between(lo, max(lo, hi)), n)


def places(col: Column) -> int:
    """Digits after the point that are drawn."""
    return min(2 if col.scale is None else col.scale, 6)


def scaled(number: Col, n: int) -> Col:
    """A whole number divided by ten to the n, as a double."""
    return number / F.lit(float(10**n))


def decimal(d: Draw, col: Column, top: int) -> Col:
    n = places(col)
    most = top * 10**n
    if col.precision:
        most = min(most, 10 ** (col.precision - (col.scale or 0) + n) - 1)
    return scaled(d.between(0, most), n)


def sized(text: Col, d: Draw, least: int | None, most: int | None) -> Col:
    """Padded with letters to the least length, cut to the most."""
    if least:
        fill = F.concat(*(d.pick(list(LETTERS), 40 + k) for k in range(4)))
        text = F.when(F.char_length(text) < least, F.substr(F.concat(text, F.repeat(fill, F.lit(-(-least // 4)))), F.lit(1), F.lit(least))).otherwise(text)
    return F.substr(text, F.lit(1), F.lit(most)) if most is not None else text


def json_text(name: str, d: Draw) -> Col:
    """A JSON document whose shape follows the column's name."""
    m = lambda key, at: MAKERS[key](d.at(at), Context())
    few = lambda pool: F.slice(F.array(*(F.element_at(F.lit(pool), (F.pmod(d.below(len(pool), 8) + k, F.lit(len(pool))) + 1).cast("int")) for k in range(4))), F.lit(1), d.between(1, 4).cast("int"))
    shapes: dict[str, Callable[[], Col]] = {
        "address": lambda: F.struct(m("location.street", 0).alias("street"), m("location.city", 10).alias("city"), m("location.state", 15).alias("state"), m("location.zipCode", 20).alias("zip"), m("location.country", 30).alias("country")),
        "point": lambda: F.struct(scaled(d.below(1_800_001) - 900_000, 4).alias("lat"), scaled(d.below(3_600_001, 1) - 1_800_000, 4).alias("lng")),
        "tags": lambda: F.slice(F.array(*(d.pick(V.WORDS, k + 1) for k in range(4))), F.lit(1), d.between(1, 4).cast("int")),
        "permissions": lambda: few(V.PERMISSIONS),
        "settings": lambda: F.struct(d.pick(["light", "dark"]).alias("theme"), d.pick(["en", "de", "fr", "ja"], 1).alias("language"), (d.below(2, 2) == 1).alias("notifications")),
        "dimensions": lambda: F.struct(d.between(1, 500).alias("width"), d.between(1, 500, 1).alias("height"), d.pick(["cm", "mm", "in"], 2).alias("unit")),
        "contact": lambda: F.struct(m("internet.email", 0).alias("email"), m("phone.number", 10).alias("phone")),
        "price": lambda: F.struct(scaled(d.between(100, 100_000), 2).alias("amount"), d.pick(V.CURRENCIES, 1).alias("currency")),
        "profile": lambda: F.struct(m("lorem.sentence", 0).alias("bio"), m("image.url", 20).alias("avatar"), m("internet.url", 30).alias("website")),
        "record": lambda: F.struct(uuid(d).alias("id"), d.pick(V.WORDS, 4).alias("source"), d.between(1, 9, 5).alias("version")),
    }
    return F.to_json(shapes[json_rule(name)]())


def by_type(d: Draw, col: Column, ctx: Context) -> Col:
    """What the type alone suggests."""
    kind = col.kind
    if kind in ("array", "composite", "range"):
        return nested(d, col, ctx)
    made: dict[str, Callable[[], Col]] = {
        "boolean": lambda: d.below(2) == 1,
        "uuid": lambda: uuid(d),
        "integer": lambda: d.between(0, 30_000 if col.bits == 16 else 1_000_000),
        "decimal": lambda: decimal(d, col, 100_000),
        "money": lambda: scaled(d.between(0, 10_000_000), 2),
        "date": lambda: moment(-3 * 365 * DAY, 0)(d, ctx),
        "time": lambda: F.concat_ws(":", *(F.lpad(d.below(n, k).cast("string"), 2, "0") for k, n in enumerate((24, 60, 60)))),
        "timestamp": lambda: moment(-730 * DAY, 0)(d, ctx),
        "json": lambda: json_text(col.name, d),
        "bytea": lambda: F.encode(sampler("[A-Za-z0-9]{16}", d), "utf-8"),
        "inet": lambda: MAKERS["internet.ipv4"](d, ctx),
        "interval": lambda: F.make_dt_interval(d.below(91).cast("int"), d.below(24, 1).cast("int"), d.below(60, 2).cast("int"), d.below(60, 3).cast("decimal(18,6)")),
        "macaddr": lambda: octets(d, 6),
        "xml": lambda: F.concat(F.lit("<record><id>"), d.below(1_000_000).cast("string"), F.lit("</id></record>")),
        "unsupported": lambda: F.lit(None).cast("string"),
    }
    return made.get(kind, lambda: words(d, 1, 3))()


def nested(d: Draw, col: Column, ctx: Context) -> Col:
    """Arrays of 0 to 3 elements, records, and half-open ranges; parts come finished."""
    part = lambda inner, k: finished(base(d.of(f"{d.name}.{k}"), inner, ctx), inner)
    if col.kind == "array":
        return F.slice(F.array(*(part(col.element, k) for k in range(3))), F.lit(1), d.below(4).cast("int"))
    if col.kind == "composite":
        return F.struct(*(part(f, f.name).alias(f.name) for f in col.fields))
    kind = col.element.kind
    step = d.between(1, 100, 8) * (DAY if kind == "date" else 3_600_000 if kind == "timestamp" else 1)
    low = base(d.of(f"{d.name}.lower"), col.element, ctx)
    return F.struct(finished(low, col.element).alias("lower"), finished(low + step, col.element).alias("upper"))


def base(d: Draw, col: Column, ctx: Context) -> Col:
    """By labels, name and type, without settings and bounds."""
    if col.labels:
        return d.pick(list(col.labels))
    if col.kind in ("integer", "decimal"):
        rule = number_rule(col.name)
        if rule == "money":
            return F.round(decimal(d, Column(col.name, "decimal"), MONEY_TOP)).cast("long") if col.kind == "integer" else decimal(d, col, MONEY_TOP)
        if rule:
            return d.between(*rule) if col.kind == "integer" else d.between(*rule).cast("double")
    if col.kind in ("text", "date", "time", "timestamp") and (maker := text_rule(col.name)):
        dated = maker.startswith("date.")
        if col.kind == "text":
            made = MAKERS[maker](d, ctx)
            return F.date_format(instants.timestamp(made), "yyyy-MM-dd'T'HH:mm:ss") if dated else made
        if dated and col.kind != "time":
            return MAKERS[maker](d, ctx)
    return by_type(d, col, ctx)


def within(d: Draw, col: Column, b: Bounds | None, ctx: Context) -> Col:
    """base() under the CHECK bounds."""
    if b and b.among:
        return d.pick(list(b.among))
    if b and b.pattern is not None and (made := sampler(b.pattern, d)) is not None:
        return made
    if b and (b.low is not None or b.high is not None) and col.kind in ("integer", "decimal", "money"):
        return bounded(d, b, col)
    made = base(d, col, ctx)
    if col.kind == "text":
        limits = [x for x in (col.length, b.max_length if b else None) if x is not None]
        made = sized(made, d, b.min_length if b else None, min(limits, default=None))
    return made


def override(d: Draw, setting, ctx: Context) -> Col:
    """A generator's name, {"value": v}, or {"values": [...]}; an unknown name is an error."""
    if isinstance(setting, dict):
        return d.pick(list(setting["values"])) if "values" in setting else F.lit(setting.get("value"))
    if setting not in MAKERS:
        raise ValueError(f"no generator {setting!r}")
    return MAKERS[setting](d, ctx)


def key_of_partition(d: Draw, col: Column, p: Partition | None) -> Col | None:
    """A key that some partition takes: none is needed with a default, by hash, or for other columns."""
    if p is None or p.has_default or p.strategy == "hash" or not p.columns or p.columns[0] != col.name:
        return None
    cast = int if col.kind == "integer" else instants.millis if col.kind in ("date", "timestamp") else float if col.kind == "decimal" else str
    if p.strategy == "list":
        return d.pick([cast(v) for v in p.values]) if p.values else None
    if col.kind not in ("integer", "date", "timestamp", "decimal") or not p.ranges:
        return None
    width = 1000 * (DAY if col.kind in ("date", "timestamp") else 1)
    ends = []
    for lo, hi in p.ranges:
        low = cast(lo) if lo is not None else cast(hi) - width if hi is not None else 0
        ends.append((low, cast(hi) if hi is not None else low + width))
    which = d.below(len(ends))
    lo, hi = (F.element_at(F.array(*(F.lit(int(e[k])) for e in ends)), (which + 1).cast("int")) for k in (0, 1))
    if col.kind == "date":
        return lo + d.below(F.expr("1L") * F.floor((hi - lo) / DAY), 1) * DAY
    return lo + d.below(hi - lo, 1)


def labels_for(spread: Spread, setting, col: Column, b: Bounds | None) -> list:
    """The labels a spread ranks: its own, a pick-list's, the type's, or the CHECK's."""
    if spread.weights:
        return [v for v, _ in spread.weights]
    if isinstance(setting, dict) and "values" in setting:
        return list(setting["values"])
    return list(col.labels) or list(b.among if b and b.among else ())


def value(d: Draw, table: Table, col: Column, b: Bounds | None, ctx: Context) -> Col:
    """The column's value, not yet null anywhere."""
    setting, spread = lookup(ctx.columns, table, col.name), lookup(ctx.spreads, table, col.name)
    if spread is not None and (made := label_draw(d, spread, labels_for(spread, setting, col, b))) is not None:
        return made
    if setting is not None:
        return override(d, setting, ctx)
    if (made := key_of_partition(d, col, table.partition)) is not None:
        return made
    return within(d, col, b, ctx)


def finished(made: Col, col: Column) -> Col:
    """Cast to the column's type; dates and timestamps come as milliseconds."""
    if col.kind == "date":
        return instants.day(made.cast("long"))
    if col.kind == "timestamp":
        return instants.timestamp(made.cast("long"))
    if col.kind in ("array", "composite", "range"):
        return made
    kind = col.spark_type()
    return made.cast(kind) if not isinstance(kind, T.DayTimeIntervalType) else made
