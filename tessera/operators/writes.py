"""Changes of tables as new DataFrames: the caller writes what comes back, so that a list of
changes takes effect whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational as R


def insert(df: DataFrame, rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """df and the rows; fields they lack take their default, else null."""
    for c, v in (defaults or {}).items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def upsert(df: DataFrame, rows: DataFrame, keys) -> DataFrame:
    """df with the rows' fields over those of equal keys; fields that the rows lack or leave null
    stay, and new keys are added. One full join by the keys."""
    keys = list(keys)
    given = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in given])
    out = df.join(new, keys, "full")
    return out.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in given else F.col(c) for c in df.columns])


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def increment(df: DataFrame, where: Column, field: str, by=1) -> DataFrame:
    return update(df, where, **{field: F.col(field) + F.lit(by)})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """df without rows for which the condition holds; null keeps a row."""
    return df.where(~F.coalesce(where, F.lit(False)))


def returning(before: DataFrame, after: DataFrame, keys) -> DataFrame:
    """Rows that differ, with their old fields as old_*."""
    keys = list(keys)
    old = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in before.columns if c not in keys])
    both = after.join(old, keys, "full")
    same = F.lit(True)
    for c in before.columns:
        if c not in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return both.where(~same)


def versioned(df: DataFrame, rows: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(new table, conflicts): rows replace those of equal key and version, which rises by one;
    others are conflicts."""
    known = df.select(key, F.col(version).alias("__v"))
    hit = rows.join(known, key, "left")
    good = hit.where(F.col("__v") == F.col(version)).drop("__v")
    bad = hit.where(~F.coalesce(F.col("__v") == F.col(version), F.lit(False))).drop("__v")
    good = good.withColumn(version, F.col(version) + 1)
    return df.join(good.select(key), key, "left_anti").unionByName(good), bad


def expired(df: DataFrame, now_ms: int, ttl: str = "_ttl") -> DataFrame:
    """df without rows whose time to live, in epoch milliseconds, has passed; null lives on."""
    return df.where(F.col(ttl).isNull() | (F.col(ttl) > now_ms))


def numbered(df: DataFrame, rows: DataFrame, key: str, order) -> DataFrame:
    """rows with keys after the greatest of df, in order."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    rows = R.numbered_rows(rows, order, "__n").join(F.broadcast(top), F.lit(True))
    return rows.withColumn(key, F.col("__top") + F.col("__n") + 1).drop("__top", "__n")


def transplant(source: DataFrame, target: DataFrame, where: Column, names: dict[str, str] | None = None, retract: bool = False) -> tuple[DataFrame, DataFrame]:
    """(source, target) after the matching rows went over, renamed; with retract they leave."""
    moved = source.where(where)
    for a, b in (names or {}).items():
        moved = moved.withColumnRenamed(a, b)
    return (delete(source, where) if retract else source), insert(target, moved.select(*[c for c in moved.columns if c in target.columns]))


def apply_all(df: DataFrame, steps) -> DataFrame:
    """The changes in turn; an error in any leaves the table as it was."""
    out = df
    for step in steps:
        out = step(out)
    return out


def refuse_transaction(verb: str) -> None:
    raise NotImplementedError(f"{verb}: tables have no open transactions; apply_all changes them as a whole")


def add_field(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """df with a new field of a type, its default everywhere."""
    if name in df.columns:
        raise ValueError(f"field {name} is there")
    return df.withColumn(name, F.lit(default).cast(kind))


def drop_field(df: DataFrame, name: str, keys=()) -> DataFrame:
    """df without a field; a key field, or one that is not there, is refused."""
    if name not in df.columns or name in keys:
        raise ValueError(f"field {name} cannot be dropped")
    return df.drop(name)


def collapsed(df: DataFrame, keys, branch: int) -> DataFrame:
    """The rows of one branch, and of keys that it lacks those of branch 0, without the column."""
    keys = list(keys)
    own = df.where(F.col("branch") == branch)
    rest = df.where("branch = 0").join(own.select(*keys), keys, "left_anti") if branch else df.limit(0)
    return own.unionByName(rest).drop("branch")
