"""Input tables: strict validation, and lenient coercion with listwise deletion."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import scratch, staged

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def missing(column: str, kind: T.DataType) -> Column:
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def _where_any(flags: Sequence[Column]) -> Column:
    """The flags as an array if any is set, else null, which is cheaper to write and to group by."""
    return F.when(reduce(Column.__or__, flags), F.array(*flags)) if flags else F.lit(None).cast("array<boolean>")


def _checked_columns(df: DataFrame, outcome: str, items: Sequence[str]) -> None:
    if outcome not in df.columns:
        raise ValueError(f"the outcome column {outcome} is missing")
    if gone := [i for i in items if i not in df.columns]:
        raise ValueError(f"item columns are missing: {', '.join(gone)}")


@dataclass
class Prepared:
    """A checked input: pattern counts and, if rows were asked for, (row_id, y, x), both written; and how many rows there were."""

    patterns: DataFrame
    rows: DataFrame | None
    n_original: int
    n_analyzed: int


def prepared(df: DataFrame, outcome: str, items: Sequence[str], positive: object = 1, negative: object = 0, row_id: str | None = None, lenient: bool = False) -> Prepared:
    """The patterns of a table, and its rows if ``row_id`` is given, checked in one pass over it.

    What a check counts is counted by pattern in the aggregate that makes the patterns, gaps
    being nulls in ``x``, so that the written patterns answer all checks.  (Observed metrics
    would do so beside the plan, but count a task anew that a lost executor makes Spark repeat.)
    Strict tables may have no gap, lenient ones are coerced and lose the rows that have one.
    The first rule that is broken is an error, classes below 5 % of the rows cause a warning.
    """
    _checked_columns(df, outcome, items)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    none = F.lit(False)
    if lenient:
        made = {c: _coerced(df, c) for c in (outcome, *items)}
    else:
        made = {c: (F.when(~missing(c, kinds[c]), F.col(f"`{c}`") if c == outcome or numeric(kinds[c]) else F.col(f"`{c}`").try_cast("double")), none) for c in (outcome, *items)}
    label, wrong = made[outcome]
    y = F.when(label == F.lit(positive), 1).when(label == F.lit(negative), 0)
    doubtful = [i for i in (outcome, *items) if lenient and not isinstance(kinds[i], T.IntegralType)]  # those that can hold text or infinities
    given = [F.col(f"`{i}`").isNull() if not lenient and not numeric(kinds[i]) else made[i][0].isNull() for i in items]
    x = F.array(*(made[i][0].cast("double") if lenient or numeric(kinds[i]) else made[i][0] for i in items))
    key = [F.col(f"`{row_id}`").alias("row_id")] if row_id else []
    rows = df.select(*key, y.alias("y"), label.isNull().alias("gap"), x.alias("x"), _where_any(given).alias("gaps"), _where_any([made[c][1] for c in doubtful]).alias("bad"))
    if row_id:
        rows = staged(rows, "rows")
    one = lambda c: F.count(F.when(c, 1))
    counts = rows.groupBy("x", "gaps").agg(
        one(F.col("y") == 1).alias("p"), one(F.col("y") == 0).alias("n"), one(~F.col("gap") & F.col("y").isNull()).alias("others"), one(F.col("gap")).alias("missing"),
        *(one(F.get("bad", F.lit(k))).alias(f"bad{k}") for k in range(len(doubtful))),
    )
    counts = staged(counts, "counts")
    whole = F.col("gaps").isNull()
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = F.col("p") + F.col("n") + F.col("others")
    seen = counts.agg(
        of(total + F.col("missing")).alias("rows"), of(F.when(whole, total)).alias("complete"), of("missing").alias("missing"),
        *(of(F.when(whole, F.col(c)) if lenient else F.col(c)).alias(c) for c in ("p", "n", "others")),
        *(of(F.when(F.get("gaps", F.lit(k)), total + F.col("missing"))).alias(f"gap{k}") for k in range(len(items))), *(of(f"bad{k}").alias(f"bad{k}") for k in range(len(doubtful))),
    ).first()
    for k, c in enumerate(doubtful):
        if seen[f"bad{k}"]:
            raise ValueError(f"column {c} contains non-numeric values")
    if seen["missing"] and not lenient:
        raise ValueError("the outcome has NA values")
    if seen["others"]:
        raise ValueError("the outcome has values other than the two labels")
    if not seen["p"] or not seen["n"]:
        raise ValueError("the outcome has only one class")
    for k, i in enumerate([] if lenient else items):
        if seen[f"gap{k}"]:
            raise ValueError(f"item {i} has NA values")
        if not numeric(kinds[i]):
            raise ValueError(f"item {i} must be numeric")
    share = seen["p"] / (seen["p"] + seen["n"])
    if not 0.05 <= share <= 0.95:
        warnings.warn(f"class proportion is extreme: {share:.1%} of the rows are positive", stacklevel=3)
    patterns = counts.where(whole).where("p + n > 0").select("x", "p", "n")
    own = rows.where(whole).where("NOT gap").select("row_id", "y", "x") if row_id else None
    return Prepared(patterns, own, seen["rows"], seen["complete"])


def strict(df: DataFrame, outcome: str, items: Sequence[str], positive: object = 1, negative: object = 0, row_id: str | None = None) -> DataFrame:
    """(row_id,) y and x from a table without gaps, lazily; the checks are a pass of their own.

    The outcome must have both labels and no other, items must be numeric and none may
    be null.  Classes below 5 % of the rows cause a warning.
    """
    with scratch(df.sparkSession, results=False):
        prepared(df, outcome, items, positive, negative)
    key = [F.col(f"`{row_id}`").alias("row_id")] if row_id else []
    return df.select(*key, F.when(F.col(f"`{outcome}`") == F.lit(positive), 1).otherwise(0).alias("y"), F.array(*(F.col(f"`{i}`").cast("double") for i in items)).alias("x"))


def _coerced(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(value, whether a given text isn't a number) of a column as doubles, null where missing."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        text = F.nullif(F.trim(c), F.lit(""))
        value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
        return value, text.isNotNull() & value.isNull()
    if not numeric(kind):
        raise ValueError(f"column {column} must be numeric or coercible to numbers")
    value = c.cast("double")
    return F.when(~F.isnan(value), value), F.coalesce(F.abs(value) == float("inf"), F.lit(False))


def lenient(df: DataFrame, outcome: str, items: Sequence[str], row_id: str | None = None) -> DataFrame:
    """The selected columns as doubles, without rows that lack any of them.

    Text is trimmed and parsed, empty text and NaN are missing; text that isn't a
    number, infinities, and other types are errors.
    """
    _checked_columns(df, outcome, items)
    made = {c: _coerced(df, c) for c in (outcome, *items)}
    bad = df.agg(*(F.count(F.when(flag, 1)).alias(f"c{k}") for k, (_, flag) in enumerate(made.values()))).first()
    for k, c in enumerate(made):
        if bad[k]:
            raise ValueError(f"column {c} contains non-numeric values")
    key = [F.col(f"`{row_id}`")] if row_id else []
    return df.select(*key, *(v.alias(c) for c, (v, _) in made.items())).dropna(subset=[outcome, *items])
