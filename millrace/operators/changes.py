"""Changes to tables as plans: each gives the new table and the rows that RETURNING would show; nothing is written here.

A caller writes the new table beside the old one (copy on write) and swaps them.  Conditions are SQL expressions; a
condition that is null changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns that rows lacks are null."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in rows.columns]
    new = rows.select("*", *missing).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    return df.unionAll(new), new


def delete(df: DataFrame, where: str) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(F.expr(where), F.lit(False))
    return df.where(~hit), df.where(hit)


def update(df: DataFrame, where: str, sets: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """sets: column -> expression over the old row; all of them see the old values."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    made = {f.name: F.expr(sets[f.name]).cast(f.dataType) if f.name in sets else F.col(f.name) for f in df.schema.fields}
    new = df.select(*(F.when(hit, made[c]).otherwise(F.col(c)).alias(c) for c in df.columns))
    return new, df.where(hit).select(*(made[c].alias(c) for c in df.columns))


def upsert(df: DataFrame, rows: DataFrame, key: str, sets: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT ... ON CONFLICT (key) DO UPDATE.  sets may use `old.c` and `new.c`; None: the new values; {}: DO NOTHING.

    A key that stands several times in rows takes the row that is greatest by its columns.
    """
    others = [c for c in df.columns if c != key]
    if sets is None:
        sets = {c: f"new.{c}" for c in others}
    one = rows.groupBy(key).agg(F.max(F.struct(*others)).alias("_v")).select(key, "_v.*").select(*df.columns)
    both = df.alias("old").join(one.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    old, new = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    made = {c: F.expr(sets[c]) if c in sets else F.col(f"old.{c}") for c in others} | {key: F.col(f"old.{key}")}
    value = lambda c: F.when(old & new, made[c]).when(old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    out = both.where(old | new).select(*(value(c).cast(df.schema[c].dataType).alias(c) for c in df.columns), (new & (~old if not sets else F.lit(True))).alias("_changed"))
    nulls = df.where(F.col(key).isNull()).unionAll(one.where(F.col(key).isNull()))
    return out.drop("_changed").unionAll(nulls), out.where("_changed").drop("_changed")
