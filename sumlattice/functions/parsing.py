"""Small languages of the API: conditions, item counts, item sets and choices."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of columns, criteria and modes that callers and stored tables use.
CONDITION_COLUMNS = ("sensitivity", "specificity", "auc", "youden", "accuracy", "ppv", "npv", "n_items", "cutoff")
RANK_COLUMNS = ("auc", "youden", "sensitivity", "specificity", "accuracy")
RESULT_RANK_COLUMNS = (*RANK_COLUMNS, "ppv", "npv")
CRITERIA = ("auc", "youden", "sensitivity", "specificity")
CUTOFF_METHODS = ("youden", "closest_topleft")
PARALLEL_MODES = ("none", "outer", "chunks", "threads", "hybrid")
_CONDITION = re.compile(r"\s*(>=|<=|==|!=|>|<)\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*")
_OPERATORS: dict[str, Callable[[Column, float], Column]] = {
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v,
}


def choice(value: object, allowed: Sequence[str], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return str(value)


def parse_condition(text: object) -> tuple[str, float]:
    """(operator, value) of a condition such as ``>= 0.90``."""
    m = _CONDITION.fullmatch(text) if isinstance(text, str) else None
    if not m:
        raise ValueError(f"not a condition: {text!r}; write an operator and a number, such as '>= 0.90'")
    return m[1], float(m[2])


def filter_conditions(df: DataFrame, conditions: dict[str, str | None]) -> DataFrame:
    """Rows that meet all conditions; a null meets none."""
    for column, text in conditions.items():
        if text is None:
            continue
        choice(column, CONDITION_COLUMNS, "a condition's column")
        op, value = parse_condition(text)
        if column not in df.columns:
            raise ValueError(f"the table has no column {column}")
        df = df.filter(_OPERATORS[op](F.col(column), F.lit(value)))
    return df


def parse_item_count(text: object, n_available: int | None = None) -> tuple[int, int]:
    """(min_items, max_items) of ``==n``, ``<=n`` or ``a:b``; blanks don't matter."""
    if not isinstance(text, str):
        raise ValueError("item_count must be text such as '==4', '<=4' or '2:4'")
    words = [int(w) if w.isdecimal() else w for w in re.findall(r"==|<=|\d+|.", "".join(text.split()))]
    match words:
        case ["==", int(n)]:
            low, high = n, n
        case ["<=", int(n)]:
            low, high = 1, n
        case [int(a), ":", int(b)]:
            low, high = a, b
        case _:
            raise ValueError(f"not an item count: {text!r}; write '==4', '<=4' or '2:4'")
    if not 1 <= low <= high:
        raise ValueError(f"the sizes of {text!r} must ascend from 1")
    if n_available is not None and high > n_available:
        raise ValueError(f"{text!r} asks for more than the {n_available} items")
    return low, high


def describe_item_count(min_items: int, max_items: int) -> str:
    if min_items == max_items:
        return f"exactly {min_items}"
    return f"up to {max_items}" if min_items == 1 else f"{min_items} to {max_items}"


def item_bounds(item_count: str | None, min_items: int | None, max_items: int | None, n_available: int | None, defaults: tuple[int, int] = (1, 4)) -> tuple[int, int]:
    """Sizes from either ``item_count`` or explicit bounds; giving both is an error."""
    if item_count is not None:
        if min_items is not None or max_items is not None:
            raise ValueError("give either item_count or min_items and max_items")
        return parse_item_count(item_count, n_available)
    return defaults[0] if min_items is None else min_items, defaults[1] if max_items is None else max_items


def parse_items(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


def format_items(items: Sequence[str]) -> str:
    return ", ".join(items)


def resolve_items(df: DataFrame, items: object) -> list[str]:
    """Column names from names, 0-based positions, a ``slice`` of names, ``"Q1:Q5"`` or a function of the columns."""
    names = df.columns
    if callable(items):
        items = items(names)
    if isinstance(items, str):
        items = slice(*[x.strip() for x in items.split(":")]) if items.count(":") == 1 and items not in names else [items]
    if isinstance(items, slice):
        for end in (items.start, items.stop):
            if end not in names:
                raise ValueError(f"no such column: {end}")
        a, b = names.index(items.start), names.index(items.stop)
        return names[a : b + 1] if a <= b else names[b : a + 1][::-1]
    out = []
    for x in items:  # type: ignore[union-attr]
        if isinstance(x, int) and not isinstance(x, bool):
            if not 0 <= x < len(names):
                raise ValueError(f"no column at position {x}")
            x = names[x]
        if x not in names:
            raise ValueError(f"no such column: {x}")
        out.append(x)
    if not out:
        raise ValueError("there are no items")
    if len(set(out)) < len(out):
        raise ValueError("an item is named twice")
    return out


def resolve_parallel(mode: object, context: str) -> str:
    """The parallel mode's name; Spark schedules by itself, so it only checks that the mode exists."""
    if mode is False or mode is None:
        return "none"
    if mode is True:
        return "outer" if context == "nested" else "chunks"
    if mode == "auto":
        raise ValueError("parallel mode 'auto' is reserved")
    return choice(mode, PARALLEL_MODES, "parallel")
