"""Condition trees, templates and expressions, compiled to column expressions before anything runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.numbers import half_up

Leaf = Mapping[str, object]


def number(c: Column) -> Column:
    """Text as a number: empty is 0, what isn't a number is null (and compares as false)."""
    x = F.trim(c)
    return F.when(x == "", 0.0).otherwise(x.try_cast("double"))


def leaf(cond: Leaf, values: Mapping[str, Column]) -> Column:
    """One comparison. ``element``: the name of a value (``text`` if none); ``operator`` and ``value``; null counts as empty."""
    name = str(cond.get("elementId") or cond.get("element") or "text")
    value = F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit("")
    wanted = F.lit(str(cond.get("seconds", 0)) if cond.get("data") == "seconds" else str(cond.get("value", "")))
    kind = cond.get("operator") or ("isRunning" if cond.get("element") == "timer" else "is")
    tests: dict[str, Callable[[], Column]] = {
        "is": lambda: value == wanted,
        "isNot": lambda: value != wanted,
        "has": lambda: F.contains(value, wanted),
        "hasNot": lambda: ~F.contains(value, wanted),
        "isAbove": lambda: F.coalesce(number(value) > number(wanted), F.lit(False)),
        "isBelow": lambda: F.coalesce(number(value) < number(wanted), F.lit(False)),
        "isRunning": lambda: F.coalesce(values[f"{name}.running"], F.lit(False)) if f"{name}.running" in values else F.lit(False),
    }
    return tests[kind]() if kind in tests else F.lit(True)


def condition(tree: Sequence | Mapping | None, values: Mapping[str, Column]) -> Column:
    """OR of AND of OR of AND of comparisons. No condition is true, an empty tree false; the old form (an object with
    ``values``) is one conjunction."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Mapping):
        tree = [[[list(tree["values"])]]] if tree.get("values") else []

    def fold(node, depth: int) -> Column:
        if depth == 4:
            return leaf(node, values)
        parts = [fold(x, depth + 1) for x in node]
        if depth % 2:
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    return fold(tree, 0)


def bound(bindings: Column, output: str) -> Column:
    """Items without bindings are shown everywhere."""
    return (F.coalesce(F.size(bindings), F.lit(0)) <= 0) | F.array_contains(bindings, output)


def _value(many: list[Column], pattern: str) -> Callable[[Column], Column]:
    def value_of(token: Column) -> Column:
        k = F.coalesce(F.regexp_extract(token, pattern, 1).try_cast("int"), F.lit(0))
        fallback = F.regexp_extract(token, pattern, 2)
        given = F.substring(fallback, 2, 1 << 20)
        value = F.get(F.array(*(m.cast("string") for m in many)), k)
        return F.when(value.isNull(), F.when(fallback != "", given).otherwise(token)).when(value == "", given).otherwise(value)

    return value_of


def _filler(name: str, many: list[Column]) -> Callable[[Column], Column]:
    pattern = r"\{" + re.escape(name) + r"(?:#(\d+))?(\|[^}]*)?\}"

    def filled(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        rest = F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001")
        pairs = F.arrays_zip(rest, F.transform(tokens, _value(many, pattern)))
        return F.array_join(F.flatten(F.transform(pairs, lambda z: F.array(F.coalesce(z["0"], F.lit("")), F.coalesce(z["1"], F.lit(""))))), "")

    return filled


def fill(text: Column, values: Mapping[str, Column | Sequence[Column]]) -> Column:
    """Put values for ``{id}``, ``{id#2}`` (by number, from 0) and ``{id|fallback}``.

    An empty value gives the fallback or nothing; a missing one the fallback or the token as it stands. Tokens are
    filled name by name over arrays of text pieces, so values may hold anything, dollar signs and braces too."""
    for name, given in values.items():
        text = F.get(F.transform(F.array(text), _filler(name, list(given) if isinstance(given, (list, tuple)) else [given])), F.lit(0))
    return text


def percent(c: Column) -> Column:
    return F.concat(half_up(c * 100).cast("string"), F.lit("%"))
