"""Weighted pattern hunting and constrained search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PATTERNS: dict[str, Pattern] = {}


@dataclass(frozen=True)
class Pattern:
    """Conjuncts and a weight, as SQL expressions over the record's fields."""

    name: str
    conjuncts: tuple[str, ...]
    weight: str = "1"
    using: tuple[str, ...] = ()


def define(name: str, conjuncts, weight: str = "1", using=(), replace: bool = False) -> Pattern:
    if name in _PATTERNS and not replace:
        raise ValueError(f"pattern {name} is defined")
    _PATTERNS[name] = Pattern(name, (conjuncts,) if isinstance(conjuncts, str) else tuple(conjuncts), weight, tuple(using))
    return _PATTERNS[name]


def drop(name: str) -> None:
    _PATTERNS.pop(name)


def show() -> list[Pattern]:
    return sorted(_PATTERNS.values(), key=lambda p: p.name)


def _pattern(p) -> Pattern:
    return p if isinstance(p, Pattern) else _PATTERNS[p]


def _excluded(df: DataFrame, key: str, excluding) -> DataFrame:
    for other in excluding:
        df = df.join(other.select(key), key, "left_anti")
    return df


def hunt(df: DataFrame, pattern, key: str, excluding=(), top: int | None = None) -> DataFrame:
    """Matching rows with _score, best first, ties to the lesser key; rows whose key is in one of
    `excluding` are left out, and a missing field weighs 0."""
    p = _pattern(pattern)
    out = _excluded(df.where(" and ".join(f"({c})" for c in p.conjuncts)), key, excluding)
    filled = {f: F.coalesce(F.col(f), F.lit(0)) for f in p.using}
    score = F.expr(p.weight)
    if filled:
        held = out.withColumns({f"__raw_{f}": F.col(f) for f in filled}).withColumns(filled).withColumn("_score", score.cast("double"))
        out = held.withColumns({f: F.col(f"__raw_{f}") for f in filled}).drop(*[f"__raw_{f}" for f in filled])
    else:
        out = out.withColumn("_score", score.cast("double"))
    out = out.orderBy(F.desc("_score"), key)
    return out.limit(top) if top is not None else out


def violations(df: DataFrame, conjuncts, name: str = "violated") -> DataFrame:
    """df with the number of conjuncts a row does not satisfy (null is not satisfied)."""
    terms = [F.when(F.expr(c), 0).otherwise(1) for c in conjuncts]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def near_misses(df: DataFrame, pattern, key: str, budget: int = 1, top: int | None = None) -> DataFrame:
    """Rows that violate one to `budget` conjuncts, fewest first, then by score and key."""
    p = _pattern(pattern)
    out = violations(df, p.conjuncts).where(F.col("violated").between(1, budget)).withColumn("_score", F.expr(p.weight).cast("double"))
    out = out.orderBy("violated", F.desc("_score"), key)
    return out.limit(top) if top is not None else out


def verdict(df: DataFrame, pattern, key: str, budget: int = 1) -> DataFrame:
    """(verdict, n_matches, near_miss_count): sat, near_miss or unsat, from one pass."""
    p = _pattern(pattern)
    v = violations(df, p.conjuncts)
    row = v.agg(F.count(F.when(F.col("violated") == 0, 1)).alias("n_matches"), F.count(F.when(F.col("violated").between(1, budget), 1)).alias("near_miss_count"))
    return row.select(F.when(F.col("n_matches") > 0, "sat").when(F.col("near_miss_count") > 0, "near_miss").otherwise("unsat").alias("verdict"), "n_matches", "near_miss_count")


def relaxation(df: DataFrame, pattern) -> DataFrame:
    """(conjunct, gained): for each conjunct, how many rows fail it alone."""
    p = _pattern(pattern)
    v = violations(df, p.conjuncts).where("violated = 1")
    row = v.agg(*[F.count(F.when(~F.coalesce(F.expr(c), F.lit(False)), 1)).alias(f"c{i}") for i, c in enumerate(p.conjuncts)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("conjunct"), F.col(f"c{i}").alias("gained")) for i, c in enumerate(p.conjuncts)])))


def explained(df: DataFrame, pattern, key: str, value) -> DataFrame:
    """(depth, expression, value): the weight of one record, part by part: the expression and all
    that it is made of, outermost first."""
    p, spark = _pattern(pattern), df.sparkSession
    parser = spark._jsparkSession.sessionState().sqlParser()
    parts: list[tuple[int, str]] = []

    def walk(node, depth):
        parts.append((depth, node.sql()))
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i), depth + 1)

    walk(parser.parseExpression(p.weight), 0)
    row = df.where(F.col(key) == F.lit(value)).limit(1)
    return row.select(F.inline(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(e).alias("expression"), F.expr(e).cast("double").alias("value")) for d, e in parts])))


def menu(df: DataFrame, pattern) -> DataFrame:
    """(conjunct, gained, cost): what relaxing each conjunct alone would gain, and how far the nearest
    of these rows is beyond a bound `field op number`, over the field's range (null for others)."""
    p = _pattern(pattern)
    v = violations(df, p.conjuncts).where("violated = 1")
    rows = []
    for i, c in enumerate(p.conjuncts):
        m = re.fullmatch(r"\s*`?(\w+)`?\s*(<=|>=|<|>)\s*(-?[0-9.]+)\s*", c)
        miss = ~F.coalesce(F.expr(c), F.lit(False))
        cost = F.min(F.when(miss, F.abs(F.col(m[1]) - float(m[3])))) if m else F.lit(None).cast("double")
        rows.append((c, F.count(F.when(miss, 1)).alias(f"n{i}"), cost.cast("double").alias(f"c{i}"), m))
    spans = df.agg(F.lit(1).alias("one"), *[(F.max(m[1]) - F.min(m[1])).cast("double").alias(f"s{i}") for i, (_, _, _, m) in enumerate(rows) if m])
    out = v.agg(*[x for _, n, c, _ in rows for x in (n, c)]).join(F.broadcast(spans), F.lit(True))
    each = [F.struct(F.lit(c).alias("conjunct"), F.col(f"n{i}").alias("gained"), (F.col(f"c{i}") / F.col(f"s{i}") if m else F.lit(None).cast("double")).alias("cost")) for i, (c, _, _, m) in enumerate(rows)]
    return out.select(F.inline(F.array(*each)))
