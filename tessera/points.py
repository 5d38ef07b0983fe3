"""Points of a session's tables: list, upsert, patch, delete; and a cache of statement results that
forgets them when a table changes."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import Session
from .operators import relational as R
from .operators import writes as WR


class Points:
    """The records of one table by their key."""

    def __init__(self, session: Session, table: str):
        self.s, self.table = session, table
        self.key = session.keys[table]

    @property
    def df(self) -> DataFrame:
        return self.s.tables[self.table]

    def list(self, where: str | None = None, first: int = 100, skip: int = 0) -> DataFrame:
        return R.page(self.df.where(where) if where else self.df, [self.key], first, skip)

    def get(self, value) -> DataFrame:
        return R.point(self.df, **{self.key: value})

    def _rows(self, records: list[dict]) -> DataFrame:
        unknown = {k for r in records for k in r} - set(self.df.columns)
        if unknown:
            raise ValueError(f"no field {sorted(unknown)[0]}")
        names = [c for c in self.df.columns if any(c in r for r in records)]
        schema = self.df.select(*names).schema
        return self.s.spark.createDataFrame([tuple(r.get(c) for c in names) for r in records], schema)

    def upsert(self, records: list[dict]) -> None:
        self.s.replace(self.table, WR.upsert(self.df, self._rows(records), [self.key]))

    def patch(self, value, **fields) -> None:
        self.s.replace(self.table, WR.update(self.df, F.col(self.key) == F.lit(value), **fields))

    def delete(self, values: list) -> None:
        self.s.replace(self.table, WR.delete(self.df, F.col(self.key).isin(*values)))


class ResultCache:
    """Rows of read statements, at most `most` results of at most `rows` rows, for `seconds`; a
    changed table's results are gone with its generation. The least recently used go first."""

    def __init__(self, session: Session, most: int = 1000, seconds: float = 60.0, rows: int = 10_000, clock=time.monotonic):
        self.s, self.most, self.seconds, self.rows, self.clock = session, most, seconds, rows, clock
        self.held: OrderedDict[tuple, tuple[float, list]] = OrderedDict()
        self.hits = 0

    def rows_of(self, statement: str) -> list:
        key = (" ".join(statement.split()), self.s.generation())
        found = self.held.get(key)
        if found and self.clock() - found[0] < self.seconds:
            self.held.move_to_end(key)
            self.hits += 1
            return found[1]
        df = self.s.execute(statement)
        if df is None:
            return []
        got = df.limit(self.rows + 1).collect()
        if len(got) > self.rows:
            return df.collect()
        key = (key[0], self.s.generation())
        self.held[key] = (self.clock(), got)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return got
