"""Selectors and getters of a layer configuration, compiled to Columns over a tag map.

A selector is a dict: ``{tag: true}`` (present), ``{tag: [values]}`` (listed), or
``{"compound": "and"|"or"|"not", "clauses": [...]}``. A getter is a dict with one of the
keys get, constant, switch, ifpresent, gather, alternative, min, max, more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def selector(config: dict, tags: Column) -> Column:
    """Boolean Column, never null. ``not`` takes exactly one clause."""
    if "compound" in config:
        parts = [selector(c, tags) for c in config["clauses"]]
        how = config["compound"]
        if how == "not":
            if len(parts) != 1:
                raise ValueError("not takes one clause")
            return ~parts[0]
        if how not in ("and", "or"):
            raise ValueError(f"unknown compound {how}")
        return reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), parts)
    parts = []
    for tag, want in config.items():
        value = tags[tag]
        parts.append(value.isNotNull() if want is True else F.coalesce(value.isin(*[str(w) for w in want]), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def number(value: Column) -> Column:
    """The first white-space token as a double; null if it isn't one."""
    return F.element_at(F.split(F.trim(value), r"\s+"), 1).try_cast("double")


def getter(config: dict, tags: Column) -> Column:
    """String Column; ``more`` gives an array of the distinct values that are present."""
    if "get" in config:
        return tags[config["get"]]
    if "constant" in config:
        return F.lit(str(config["constant"]))
    if "switch" in config:
        cases = F.create_map(*(F.lit(str(x)) for kv in config["cases"].items() for x in kv))
        value = tags[config["switch"]]
        return F.when(value.isNotNull(), cases[value])
    if "ifpresent" in config:
        return F.when(tags[config["ifpresent"]].isNotNull(), F.lit(str(config["value"])))
    if "gather" in config:
        return F.coalesce(*(tags[k] for k in config["gather"]))
    if "alternative" in config:
        return F.coalesce(*(getter(c, tags) for c in config["alternative"]))
    for how, fold in (("min", F.array_min), ("max", F.array_max)):
        if how in config:
            return fold(F.array(*(number(getter(c, tags)) for c in config[how]))).cast("string")
    if "more" in config:
        return F.array_distinct(F.array_compact(F.array(*(getter(c, tags) for c in config["more"]))))
    raise ValueError(f"unknown getter {sorted(config)}")


def typed(value: Column, kind: str) -> Column:
    """A getter's value as the attribute's type; what doesn't parse is null.

    A boolean is true unless the text is empty or ``0`` (so ``no`` is true).
    """
    if kind in ("string", "enumstring"):
        return value
    if kind == "float":
        return number(value)
    if kind == "int":
        return F.floor(number(value)).cast("long")
    if kind == "boolean":
        return F.when(value.isNotNull(), ~value.isin("", "0"))
    raise ValueError(f"unknown type {kind}")


def any_prefix(code: Column, prefixes: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (code.startswith(p) for p in prefixes)), F.lit(False))


def first_prefix(code: Column, prefixes: list[str]) -> Column:
    """The first configured prefix that the code begins with; else null."""
    return reduce(lambda rest, p: F.when(code.startswith(p), p).otherwise(rest), reversed(prefixes), F.lit(None).cast("string"))


def wildcard(columns: list[str], pattern: str, exclude: tuple[str, ...] = ("code_int",)) -> str:
    """The first column that fits ``NAME*`` regardless of case."""
    stem = pattern.rstrip("*").lower()
    for c in columns:
        low = c.lower()
        if low not in exclude and (low.startswith(stem) if pattern.endswith("*") else low == stem):
            return c
    raise KeyError(f"no column {pattern} in {columns}")


def lenient_double(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")


def lenient_int(value: Column) -> Column:
    return F.trim(value).try_cast("long")


def lenient_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1"), F.lit(False))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
