"""Registry of named queries: a Spark callable and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tie_break(digits: int) -> float:
    """A shift far below the last kept digit and far above summation noise."""
    return float(f"1e-{digits + 3}")


def break_ties(sql: str) -> str:
    """Shift every literal `round(x, n)` as `rounded` does, so that exact halves round alike."""
    out, i = [], 0
    while (start := sql.find("round(", i)) >= 0:
        depth, j = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        body = sql[start + 6:j - 1]
        head, comma, digits = body.rpartition(", ")
        if comma and digits.strip().isdigit() and int(digits) >= 4:
            out.append(sql[i:start] + f"round({break_ties(head)} + {tie_break(int(digits))}, {digits})")
        else:
            out.append(sql[i:start] + f"round({break_ties(body)})")
        i = j
    return "".join(out) + sql[i:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = break_ties(sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that the order of summation does not show in a comparison."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[(F.round(F.col(c) + tie_break(digits), digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c)
                       for c in df.columns])


def joined(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)
