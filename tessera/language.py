"""The query language: text to DataFrames over named tables.

A session holds tables by name, with their keys. Statements that read return a DataFrame; those that
change a table put the changed DataFrame in its place. Unknown names, unknown fields and words left
over at the end are errors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import predicates as P
from .operators import anomaly as A
from .operators import geometry as G
from .operators import patterns as PT
from .operators import relational as R
from .operators import vectors as V
from .operators import writes as WR
from .sources import catalog_views, files
from .verbs import Verbs

_WORDS = re.compile(r"\s*(?:(--[^\n]*)|('(?:[^'\\]|\\.|'')*')|([A-Za-z_][A-Za-z_0-9.]*)|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(<=|>=|!=|<>|[-+*/%=<>(),;.:]))")
_MEASURES = {
    "COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "STDDEV": lambda c: R.population(c)["stddev"], "VARIANCE": lambda c: R.population(c)["variance"],
    "MEDIAN": F.median, "ARRAY_AGG": lambda c: F.sort_array(F.collect_list(c)),
}


class LanguageError(ValueError):
    pass


class Session:
    """Tables by name: session.add("orders", df, key="o_orderkey")."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.keys, self.lenses = spark, {}, {}, {}

    def add(self, name: str, df: DataFrame, key: str | None = None) -> Session:
        self.tables[name], self.keys[name] = df, key or df.columns[0]
        return self

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def generation(self) -> tuple:
        """What changes whenever a table or lens does."""
        return tuple(sorted((n, df._jdf.queryExecution().id()) for n, df in self.tables.items())), tuple(sorted(self.lenses.items()))

    def execute(self, text: str) -> DataFrame | None:
        """Runs the statements; the result of the last one."""
        out = None
        parser = _Parser(self, text)
        while not parser.done():
            out = parser.statement()
            if not parser.done():
                parser.need(";")
        return out


class _Parser(Verbs):
    def __init__(self, session: Session, text: str):
        self.s, self.at, self.tokens, self.bundle = session, 0, [], None
        text, i = text.rstrip(), 0
        while i < len(text):
            m = _WORDS.match(text, i)
            if not m:
                raise LanguageError(f"cannot read {text[i : i + 20]!r}")
            i = m.end()
            if m[2]:
                self.tokens.append(("text", re.sub(r"\\(.)|''", lambda x: x[1] or "'", m[2][1:-1])))
            elif m[3]:
                self.tokens.append(("word", m[3]))
            elif m[4]:
                self.tokens.append(("number", float(m[4]) if re.search("[.eE]", m[4]) else int(m[4])))
            elif m[5]:
                self.tokens.append(("sign", m[5]))

    # -- Tokens

    def done(self) -> bool:
        return self.at >= len(self.tokens)

    def peek(self, *words: str) -> bool:
        for k, w in enumerate(words):
            if self.at + k >= len(self.tokens):
                return False
            kind, value = self.tokens[self.at + k]
            if kind in ("text", "number") or str(value).upper() != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                found = self.tokens[self.at][1] if not self.done() else "the end"
                raise LanguageError(f"{w} is wanted before {found!r}")

    def name(self) -> str:
        if self.done() or self.tokens[self.at][0] != "word":
            raise LanguageError("a name is wanted")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self):
        if self.done():
            raise LanguageError("a value is wanted")
        kind, v = self.tokens[self.at]
        if kind in ("text", "number"):
            self.at += 1
            return v
        word = self.name()
        known = {"TRUE": True, "FALSE": False, "VOID": None, "NULL": None}
        if word.upper() not in known:
            raise LanguageError(f"not a value: {word}")
        return known[word.upper()]

    def number(self):
        v = self.value()
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise LanguageError("a number is wanted")
        return v

    def listed(self, one):
        self.need("(")
        out = [one()]
        while self.take(","):
            out.append(one())
        self.need(")")
        return out

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def pair(self):
        n = self.name()
        if not self.take("="):
            self.need(":")
        return n, self.value()

    def table(self) -> tuple[str, DataFrame]:
        n = self.bundle = self.name()
        if n == "__bundles__":
            return n, catalog_views.bundles(self.s.spark)
        if n in self.s.lenses:
            return n, _Parser(self.s, self.s.lenses[n]).statement()
        if n not in self.s.tables:
            raise LanguageError(f"no bundle {n}")
        return n, self.s.tables[n]

    def field(self, df: DataFrame) -> str:
        f = self.name()
        if f not in df.columns:
            raise LanguageError(f"no field {f}")
        return f

    def query(self) -> DataFrame:
        self.need("(")
        out = self.statement()
        self.need(")")
        return out

    # -- Predicates

    def atom(self, df: DataFrame) -> Column:
        if self.take("("):
            p = self.predicate(df)
            self.need(")")
            return p
        if self.take("NOT"):
            return ~self.atom(df)
        if self.function_ahead():
            return self.compared(df)
        f = self.field(df)
        if self.take("VOID"):
            return P.void(f)
        if self.take("DEFINED"):
            return P.defined(f)
        if self.take("BETWEEN"):
            low = self.value()
            self.need("AND")
            return P.between(f, self._literal(df, f, low), self._literal(df, f, self.value()))
        for word, p in (("CONTAINS", P.contains), ("STARTSWITH", P.starts_with), ("ENDSWITH", P.ends_with)):
            if self.take(word):
                return p(f, str(self.value()))
        if self.take("STARTS", "WITH"):
            return P.starts_with(f, str(self.value()))
        if self.take("ENDS", "WITH"):
            return P.ends_with(f, str(self.value()))
        if self.take("MATCHES"):
            v = str(self.value())
            return P.matches(f, v[1:-1]) if len(v) > 1 and v[0] == v[-1] == "/" else P.glob(f, v)
        if self.take("IN"):
            return P.one_of(f, self.listed(self.value))
        if self.take("NOT", "IN"):
            return P.not_in(f, self.listed(self.value))
        for sign, p in (("=", P.eq), ("!=", P.ne), ("<>", P.ne), ("<=", P.le), (">=", P.ge), ("<", P.lt), (">", P.gt)):
            if self.take(sign):
                return p(f, self._literal(df, f, self.value()))
        raise LanguageError(f"no condition after {f}")

    # -- Row functions: CURVATURE(f), CONFIDENCE(), ANOMALY(), Z_SCORE()

    _SYSTEM = ("CURRENT_ROLE", "CURRENT_BUNDLE", "VERSION")
    _FUNCTIONS = ("CURVATURE", "CONFIDENCE", "ANOMALY", "Z_SCORE", "CAPACITY")

    def function_ahead(self) -> bool:
        return any(self.peek(w, "(") for w in self._FUNCTIONS)

    def function(self, df: DataFrame) -> Column:
        word = self.name().upper()
        self.need("(")
        f = self.field(df) if word == "CURVATURE" and not self.peek(")") else None
        self.need(")")
        name = {"CURVATURE": f"__k_{f}" if f else "__kappa", "CONFIDENCE": "__confidence", "ANOMALY": "__anomaly", "Z_SCORE": "__z", "CAPACITY": "__capacity"}[word]
        if name not in df.columns:
            raise LanguageError(f"{word}() is not known here")
        return F.col(name)

    def compared(self, df: DataFrame) -> Column:
        c = self.function(df)
        for sign, op in (("=", "__eq__"), ("!=", "__ne__"), ("<=", "__le__"), (">=", "__ge__"), ("<", "__lt__"), (">", "__gt__")):
            if self.take(sign):
                return getattr(c, op)(F.lit(self.value()))
        raise LanguageError("a comparison is wanted")

    def with_functions(self, n: str, df: DataFrame) -> DataFrame:
        """df with the columns that row functions of the statement read; none if it has no such."""
        ahead = self.tokens[self.at :]
        if not any(k == "word" and str(v).upper() in self._FUNCTIONS and ahead[i + 1 : i + 2] == [("sign", "(")] for i, (k, v) in enumerate(ahead)):
            return df
        fields = self.numeric(n, df)
        stats = G.field_stats(df, fields)
        rows = df.join(F.broadcast(stats), F.lit(True)).withColumn("__kappa", G.kappa(fields))
        rows = rows.withColumns({f"__k_{f}": F.abs(F.col(f) - F.col(f"m_{f}")) / F.col(f"r_{f}") for f in fields}).drop(*stats.columns)
        of = rows.agg(F.avg("__kappa").alias("__mu"), F.stddev_pop("__kappa").alias("__sd"))
        rows = rows.join(F.broadcast(of), F.lit(True))
        z = F.when(F.col("__sd") > 0, (F.col("__kappa") - F.col("__mu")) / F.col("__sd")).otherwise(0.0)
        return rows.withColumns({"__z": z, "__anomaly": z > 2, "__confidence": 1 / (1 + F.col("__kappa")), "__capacity": 1 / F.col("__kappa")}).drop("__mu", "__sd")

    def _literal(self, df: DataFrame, f: str, v):
        return P.at(v) if dict(df.dtypes)[f].startswith("timestamp") and isinstance(v, (str, int)) else v

    def predicate(self, df: DataFrame) -> Column:
        def term():
            p = self.atom(df)
            while self.take("AND"):
                p = p & self.atom(df)
            return p

        p = term()
        while self.take("OR"):
            p = p | term()
        return p

    def at_key(self, df: DataFrame) -> dict:
        out = {}
        while True:
            f = self.field(df)
            self.need("=")
            out[f] = self.value()
            if not self.take("AND") and not self.take(","):
                return out

    def filtered(self, df: DataFrame) -> DataFrame:
        if self.take("ALL"):
            return df
        if self.take("ON"):
            df = self._on(df)
        return df.where(self.predicate(df)) if self.take("WHERE") else df

    def _on(self, df: DataFrame) -> DataFrame:
        while True:
            f = self.field(df)
            if self.take("IN"):
                if self.peek("(", "COVER") or self.peek("(", "INTEGRATE"):
                    df = R.semi(df, (q := self.query()), f, q.columns[0])
                else:
                    df = R.lookup(df, f, self.listed(self.value))
            else:
                self.need("=")
                df = df.where(P.eq(f, self._literal(df, f, self.value())))
            if not self.take("AND"):
                return df

    def tail(self, df: DataFrame, key: str | None) -> DataFrame:
        """Distinct, projection, rank, page, confidence."""
        if self.take("CONFIDENCE"):
            strict = self.take(">") or not self.take(">=")
            fields = [n for n, k in df.dtypes if k in ("int", "bigint", "float", "double") and n != key]
            c = G.confidence("kappa")
            at = self.number()
            df = G.record_kappa(df, fields).where(c > at if strict else c >= at).drop("kappa")
        by = []
        while self.take("RANK", "BY"):
            while True:
                f = self.field(df)
                by.append(F.desc(f) if self.take("DESC") else (self.take("ASC"), F.col(f))[1])
                if not self.take(","):
                    break
        first = skip = None
        while True:
            if self.take("FIRST"):
                first = self.number()
            elif self.take("SKIP"):
                skip = self.number()
            else:
                break
        if by:
            df = df.orderBy(*by, *([key] if key in df.columns else []))
        if skip:
            df = df.offset(skip)
        if first is not None:
            df = df.limit(first)
        if self.take("DISTINCT"):
            df = R.distinct_values(df, self.field(df))
        if self.take("PROJECT"):
            df = df.select(*self.listed(lambda: self.projected(df)))
        return df

    def projected(self, df: DataFrame) -> Column:
        c = self.arithmetic(df)
        return c.alias(self.name()) if self.take("AS") else c

    def arithmetic(self, df: DataFrame) -> Column:
        def one():
            if self.tokens[self.at][0] in ("text", "number"):
                return F.lit(self.value())
            if self.take("("):
                c = self.arithmetic(df)
                self.need(")")
                return c
            if self.function_ahead():
                return self.function(df)
            if any(self.peek(w, "(", ")") for w in self._SYSTEM):
                word = self.name().upper()
                self.need("(", ")")
                from . import __version__

                return {"CURRENT_ROLE": F.current_user(), "CURRENT_BUNDLE": F.lit(self.bundle), "VERSION": F.lit(__version__)}[word]
            return F.col(self.field(df))

        c = one()
        while not self.done() and self.tokens[self.at][1] in ("+", "-", "*", "/", "%") and self.tokens[self.at][0] == "sign":
            sign = self.name_sign()
            d = one()
            c = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b}[sign](c, d)
        return c

    def name_sign(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def measures(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        while True:
            kind = self.name().upper()
            if kind not in _MEASURES:
                raise LanguageError(f"no measure {kind}")
            self.need("(")
            f = "*" if self.take("*") else self.field(df)
            self.need(")")
            c = _MEASURES[kind](f)
            if self.take("FILTER"):
                self.need("(")
                self.need("WHERE")
                p = self.predicate(df)
                self.need(")")
                c = _MEASURES[kind](R.measure_if(p, None if f == "*" else F.col(f)))
            name = self.name() if self.take("AS") else f"{kind.lower()}_{f}".replace("_*", "")
            out[name] = c
            if not self.take(","):
                return out

    # -- Statements

    def statement(self) -> DataFrame | None:
        verb = self.name().upper()
        do = getattr(self, f"do_{verb.lower()}", None)
        if do is None:
            raise LanguageError(f"no statement {verb}")
        try:
            return do()
        except ValueError as e:
            raise e if isinstance(e, LanguageError) else LanguageError(str(e)) from e

    def do_cover(self):
        n, df = self.table()
        df = self.with_functions(n, df)
        if self.take("NEAR"):
            at = {k: float(v) for k, v in self.listed(self.pair)}
            self.need("WITHIN")
            within = float(self.number())
            metric = "cosine" if self.take("METRIC", "COSINE") else "euclid"
            row = df.agg(*[(F.max(f) - F.min(f)).cast("double").alias(f) for f in at]).first()
            df = V.near(df, at, within, {f: row[f] or 1.0 for f in at}, metric).orderBy("distance", self.s.keys.get(n))
        out = self.tail(self.filtered(df), self.s.keys.get(n))
        out = out.drop(*[c for c in out.columns if c.startswith("__")])
        if self.take("EMIT"):
            kind = self.name().upper()
            if self.take("TO"):
                path = str(self.value())
                root = self.s.spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
                {"CSV": files.emit_csv, "JSON": files.emit_json}[kind](out, root, path)
            elif kind == "JSON":
                out = files.as_json(out)
        return out

    def do_exists(self):
        self.need("SECTION")
        _, df = self.table()
        self.need("AT")
        return R.exists(df, P.all_of(*[P.eq(k, v) for k, v in self.at_key(df).items()]))

    def do_section(self):
        n, df = self.table()
        if self.take("AT"):
            out = R.point(df, **self.at_key(df))
            return out.select(*self.listed(lambda: self.projected(df))) if self.take("PROJECT") else out
        row = dict(self.listed(self.pair))
        for f in row:
            if f not in df.columns:
                raise LanguageError(f"no field {f}")
        one = self.s.spark.range(1).select(*[F.lit(v).cast(df.schema[f].dataType).alias(f) for f, v in row.items()])
        self.s.tables[n] = WR.upsert(df, one, [self.s.keys[n]]) if self.take("UPSERT") else WR.insert(df, one)
        return one if not self.take("RETURNING") else one.select(*self.names())

    def do_redefine(self):
        n, df = self.table()
        p = P.all_of(*[P.eq(k, v) for k, v in self.at_key(df).items()]) if self.take("AT") else (self.need("ON"), self.predicate(df))[1]
        self.need("SET")
        self.s.tables[n] = WR.update(df, p, **dict(self.listed(self.pair)))
        return None

    def do_retract(self):
        n, df = self.table()
        p = P.all_of(*[P.eq(k, v) for k, v in self.at_key(df).items()]) if self.take("AT") else (self.need("ON"), self.predicate(df))[1]
        self.s.tables[n] = WR.delete(df, p)
        return None

    def do_integrate(self):
        _, df = self.table()
        if self.take("ON") or self.peek("WHERE"):
            df = self._on(df) if not self.peek("WHERE") else df
            df = df.where(self.predicate(df)) if self.take("WHERE") else df
        over = self.names() if self.take("OVER") else []
        for f in over:
            if f not in df.columns:
                raise LanguageError(f"no field {f}")
        self.need("MEASURE")
        m = self.measures(df)
        if self.take("RESTRICT", "TO"):
            q = self.query()
            df = R.semi(df, q, q.columns[0], q.columns[0])
        out = R.integrate(df, over, **m)
        if self.take("HAVING"):
            out = out.where(self.predicate(out))
        return self.tail(out, over[0] if over else None)

    def do_pullback(self):
        _, df = self.table()
        steps = []
        while self.take("ALONG"):
            f = self.name()
            self.need("ONTO")
            steps.append((f, *self.table()))
        keep = self.take("PRESERVE", "LEFT")
        for f, n, right in steps:
            if f not in df.columns:
                raise LanguageError(f"no field {f}")
            df = R.pullback(df, right, f, self.s.keys[n], keep)
        return self.tail(df, None)

    def do_fiber(self):
        kind = self.name().upper()
        n, df = self.table()
        f = self.field(df) if self.take("OF") else None
        self.need("OVER")
        over = [self.field(df)]
        key = self.s.keys[n]
        if kind in ("RANK", "PERCENTRANK"):
            self.need("RANK", "BY")
            by = self.field(df)
            if kind == "RANK":
                return R.ranked(df, over, [by, key])
            return df.withColumn("percent_rank", F.percent_rank().over(Window.partitionBy(*over).orderBy(by)))
        self.need("WINDOW")
        order = self.field(df)
        self.need("ROWS", "(")
        low = None if self.take("UNBOUNDED") else self.number()
        self.need(",")
        high = self.number()
        self.need(")")
        return R.running(df, over, [order], _MEASURES[kind](f), low, high, f"{kind.lower()}_{f}")

    def do_transport(self):
        n, df = self.table()
        self.need("OF")
        f = self.field(df)
        self.need("ALONG")
        along = self.field(df)
        self.need("SHIFT")
        self.take("+")
        shift = self.number()
        over = self.names() if self.take("OVER") else []
        return R.transported(df, f, over, [along], shift, f"{f}_shift")

    def _pair_of(self, word: str):
        a = self.query()
        self.need(word)
        return a, self.query()

    def do_union(self):
        return R.union(*self._pair_of("WITH"))

    def do_intersect(self):
        return R.intersect(*self._pair_of("WITH"))

    def do_subtract(self):
        return R.subtract(*self._pair_of("MINUS"))

    def do_glue(self):
        a, b = self._pair_of("WITH")
        return R.glued(a, b, a.columns[0]) if self.take("CHECK", "OVERLAP") else a.unionByName(b).distinct()

    def do_with(self):
        if self.take("RECURSIVE"):
            return self._recursive()
        n = self.name()
        self.need("AS")
        held, key = self.s.tables.get(n), self.s.keys.get(n)
        self.s.add(n, self.query())
        try:
            return self.statement()
        finally:
            if held is None:
                self.s.tables.pop(n)
            else:
                self.s.tables[n], self.s.keys[n] = held, key

    def _recursive(self):
        """WITH RECURSIVE n AS ((base) UNION (step)) statement: the step, which names n, runs over the
        rows found last until it finds no new one."""
        n = self.name()
        self.need("AS")
        self.need("(")
        found = front = R.cut(self.query().distinct())
        self.need("UNION")
        start = self.at
        key = found.columns[0]
        while True:
            self.at = start
            held = self.s.tables.get(n), self.s.keys.get(n)
            self.s.add(n, front, key)
            new = self.query().toDF(*found.columns).distinct().exceptAll(found)
            front = R.cut(new)
            self.s.tables.pop(n), self.s.keys.pop(n)
            if held[0] is not None:
                self.s.tables[n], self.s.keys[n] = held
            if front.isEmpty():
                break
            found = R.cut(found.unionByName(front))
        self.need(")")
        held = self.s.tables.get(n), self.s.keys.get(n)
        self.s.add(n, found, key)
        try:
            return self.statement()
        finally:
            self.s.tables.pop(n), self.s.keys.pop(n)
            if held[0] is not None:
                self.s.tables[n], self.s.keys[n] = held

    def do_lens(self):
        n = self.name()
        self.need("AS")
        start = self.at
        self.statement()
        said = " ".join(f"'{v}'" if k == "text" else str(v) for k, v in self.tokens[start : self.at])
        self.s.lenses[n] = said

    def do_collapse(self):
        n, _ = self.table()
        self.s.tables.pop(n, None)
        self.s.lenses.pop(n, None)

    def do_restrict(self):
        _, df = self.table()
        self.need("TO")
        q = self.query()
        out = R.semi(df, q, q.columns[0], q.columns[0])
        if self.take("AS"):
            self.s.add(self.name(), out)
        return out

    def do_diff(self):
        _, a = self.table()
        self.need("AGAINST")
        _, b = self.table()
        if self.take("SHOW", "CURVATURE"):
            fields = [c for c, k in a.dtypes if k in ("int", "bigint", "float", "double") and c in b.columns]
            ka, kb = (G.curvature(x, fields).select(F.col("k").alias(f"k_{side}")) for x, side in ((a, "a"), (b, "b")))
            return ka.join(F.broadcast(kb), F.lit(True)).withColumn("delta_k", F.col("k_b") - F.col("k_a"))
        return R.difference(a, b)

    def do_iterate(self):
        _, df = self.table()
        self.need("START", "AT")
        (key, start), = self.at_key(df).items()
        self.need("STEP", "ALONG")
        step = self.field(df)
        self.need("UNTIL")
        depth = 100 if self.take("VOID") else (self.need("DEPTH"), self.number())[1]
        if self.take("MAX", "DEPTH"):
            depth = min(depth, self.number())
        if self.take("ACCUMULATE"):
            self.need("SUM", "(")
            total = self.field(df)
            self.need(")")
            return R.iterate(df, key, step, start, depth, total)
        return R.iterate(df, key, step, start, depth)

    def do_curvature(self):
        n, df = self.table()
        fields = self.names() if self.take("ON") else [c for c, k in df.dtypes if k in ("int", "bigint", "float", "double") and c != self.s.keys[n]]
        for f in fields:
            if f not in df.columns:
                raise LanguageError(f"no field {f}")
        return G.curvature(df, fields, [self.field(df)] if self.take("BY") else ())

    def do_confidence(self):
        n, df = self.table()
        df = self._on(df) if self.take("ON") else df
        fields = [c for c, k in df.dtypes if k in ("int", "bigint", "float", "double") and c != self.s.keys[n]]
        return G.curvature(df, fields).select("confidence")

    def do_entropy(self):
        _, df = self.table()
        self.need("ON")
        return G.entropy(df, self.names())

    def do_consistency(self):
        n, df = self.table()
        self.need("ON")
        f = self.field(df)
        self.need("BY")
        return A.consistency(df, self.s.keys[n], self.field(df), f)

    def do_predict(self):
        _, df = self.table()
        self.need("ON")
        f = self.field(df)
        self.need("BY")
        return A.volatility(df, [f], [self.field(df)])

    def do_divergence(self):
        self.need("FROM")
        _, a = self.table()
        self.need("TO")
        _, b = self.table()
        fields = [c for c, k in a.dtypes if k in ("int", "bigint", "float", "double") and c in b.columns]
        return G.divergence(a, b, fields)

    def do_flow(self):
        _, df = self.table()
        self.need("COARSEN", "BY")
        return G.coarse_grain(df, self.names())

    def do_hunt(self):
        pattern = self.name()
        self.need("IN")
        n, df = self.table()
        gone = []
        while self.take("EXCLUDING", "IN"):
            gone.append(self.table()[1])
        top = self.number() if self.take("TOP") else None
        return PT.hunt(df, pattern, self.s.keys[n], gone, top)

    def do_generate(self):
        self.need("BASE")
        n = self.name()
        self.need("FROM")
        k, low = self.pair()
        self.need("TO")
        _, high = self.pair()
        self.need("STEP")
        step = self.number()
        rest = dict(self.listed(self.pair)) if self.take("WITH") else {}
        out = R.series(self.s.spark, low, high, step, k, **rest)
        self.s.add(n, out, k)
        return out

    def do_show(self):
        more = self.show_more()
        if more is not None:
            return more
        self.need("BUNDLES")
        rows = [(n, self.s.keys[n], len(df.columns)) for n, df in sorted(self.s.tables.items())]
        return self.s.spark.createDataFrame(rows, "name string, key string, fields int")

    def do_describe(self):
        return catalog_views.fields(self.table()[1])

    def do_explain(self):
        if self.take("SECTION"):
            return self.do_explain_section()
        df = self.statement()
        said = df._jdf.queryExecution().explainString(self.s.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.s.spark.createDataFrame([(said,)], "plan string")

    def do_atlas(self):
        WR.refuse_transaction("ATLAS")
