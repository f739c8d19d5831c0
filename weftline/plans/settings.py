"""Settings from a JSON file and from ``name=value`` specs."""

from __future__ import annotations

import json
import math
from pathlib import Path

from weftline.functions.spread import Spread
from weftline.operators.engine import DEFAULT_ROWS, Config


def split(spec: str, last: bool = False) -> tuple[str, str]:
    name, mark, rest = spec.rpartition("=") if last else spec.partition("=")
    if not mark or not name.strip():
        raise ValueError(f"{spec!r} is not name=value")
    return name.strip(), rest


def coerced(text: str):
    """A JSON value where the text is one, or the text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def rows(specs: list[str]) -> dict[str, int]:
    """table=count"""
    out = {}
    for spec in specs:
        name, count = split(spec, last=True)
        try:
            n = float(count)
        except ValueError:
            n = -1.0
        if not math.isfinite(n) or n < 0:
            raise ValueError(f"{spec!r}: no row count")
        out[name] = int(n)
    return out


def positive(text: str, spec: str) -> float:
    try:
        x = float(text)
    except ValueError:
        x = 0.0
    if not math.isfinite(x) or x <= 0:
        raise ValueError(f"{spec!r}: {text!r} must be a number above 0")
    return x


def spread(body: str, spec: str) -> Spread:
    kind, mark, arg = body.partition(":")
    if kind == "uniform" and not mark:
        return Spread()
    if kind == "zipf":
        return Spread("zipf", positive(arg, spec) if mark else 1.0)
    if kind == "weighted":
        pairs = [split(p.strip(), last=True) for p in arg.split(",") if p.strip()]
        if not pairs:
            raise ValueError(f"{spec!r}: weighted needs value=weight pairs")
        return Spread("weighted", weights=tuple((coerced(v), positive(w, spec)) for v, w in pairs))
    raise ValueError(f"{spec!r}: a spread is uniform, zipf[:skew], or weighted:v=w,...")


def distributions(specs: list[str]) -> dict[str, Spread]:
    """column=uniform, column=zipf[:skew], column=weighted:v=w,..."""
    return {name: spread(body, spec) for spec in specs for name, body in [split(spec)]}


def columns(specs: list[str]) -> dict:
    """column=generator.name, column=value:literal, column=values:a,b"""
    out = {}
    for spec in specs:
        name, body = split(spec)
        if not body:
            raise ValueError(f"{spec!r}: no generator")
        if body.startswith("value:"):
            out[name] = {"value": coerced(body[6:])}
        elif body.startswith("values:"):
            items = [x.strip() for x in body[7:].split(",")]
            if items == [""]:
                raise ValueError(f"{spec!r}: no values")
            out[name] = {"values": [coerced(x) for x in items]}
        else:
            out[name] = body
    return out


def stated(given) -> Spread:
    """A spread as the file states it: a name, or an object with kind, skew, weights."""
    if isinstance(given, str):
        return spread(given, given)
    weights = given.get("weights") or ()
    pairs = weights.items() if isinstance(weights, dict) else [(w["value"], w["weight"]) for w in weights]
    return Spread(given["kind"], float(given.get("skew", 1.0)), tuple((v, float(w)) for v, w in pairs))


def load(path: str | None) -> dict:
    """The settings file (JSON); without a path weftline.json in the working folder, if it is there."""
    file = Path(path or "weftline.json")
    if path is None and not file.exists():
        return {}
    return json.loads(file.read_text())


def config(found: dict, **given) -> Config:
    """File settings under given ones: scalars and maps are overruled, lists are joined."""
    pick = lambda k, name, default: given.get(k) if given.get(k) is not None else found.get(name, default)
    return Config(
        rows=found.get("rows", {}) | given.get("rows", {}),
        default_rows=pick("default_rows", "defaultRows", DEFAULT_ROWS),
        columns=found.get("columns", {}) | given.get("columns", {}),
        distributions={k: stated(v) for k, v in found.get("distributions", {}).items()} | given.get("distributions", {}),
        skip=(*found.get("skip", ()), *given.get("skip", ())),
        seed=pick("seed", "seed", 0),
        since=pick("since", "since", None),
        until=pick("until", "until", None),
        anonymize=(*found.get("anonymize", ()), *given.get("anonymize", ())),
        preserve=(*found.get("preserve", ()), *given.get("preserve", ())),
        rng=pick("rng", "rng", "xxhash64"),
    )
