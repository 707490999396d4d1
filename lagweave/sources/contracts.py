"""Contract checks and include-list filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def filter_ids(df: DataFrame, col: str, ids: DataFrame | None) -> DataFrame:
    """Keep rows whose id is listed; no list means no filter."""
    if ids is None:
        return df
    return df.join(ids.select(col).distinct(), col, "left_semi")


def validate_contract(df: DataFrame, required: dict[str, str], rules: dict[str, Column]) -> DataFrame:
    """Violations (kind, name, n_rows): missing or mistyped columns, and rows that break a rule. One pass over the rows."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shape = [("missing_column", c, None) for c in required if c not in have]
    shape += [("wrong_type", c, None) for c, t in required.items() if c in have and have[c] != t]
    structs = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(r).cast("long").alias("n_rows")) for k, n, r in shape]
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    structs += [F.struct(F.lit("broken_rule").alias("kind"), F.lit(n).alias("name"), F.col(n).alias("n_rows")) for n in rules]
    out = counts.select(F.explode(F.array(*structs)).alias("v")).select("v.*")
    return out.where(F.col("n_rows").isNull() | (F.col("n_rows") > 0))
