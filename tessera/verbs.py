"""Statements of the query language for graphs, series, scans, models, patterns, gaps, files and
subscriptions. The class is mixed into the parser, whose tokens and session it reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import advanced as X
from .operators import anomaly as A
from .operators import geometry as G
from .operators import graph as GR
from .operators import inference as I
from .operators import patterns as PT
from .operators import relational as R
from .operators import series as S
from .operators import vectors as V
from .operators import writes as WR
from .sources import catalog_views, files
from .streaming import subscriptions as ST

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


class Verbs:
    # -- What statements share

    def numeric(self, n: str, df) -> list[str]:
        return [c for c, k in df.dtypes if k in _NUMERIC and c != self.s.keys.get(n)]

    def categorical(self, df, n: str) -> list[str]:
        return [c for c, k in df.dtypes if k in ("string", "boolean") and c != self.s.keys.get(n)]

    def fields_of(self, df) -> list[str]:
        out = [self.field(df)]
        while self.take(","):
            out.append(self.field(df))
        return out

    def field_list(self, df) -> list[str]:
        return self.listed(lambda: self.field(df))

    def number_after(self, *words: str, default=None):
        return self.number() if self.take(*words) else default

    def series_of(self, df, *names: str):
        """The table as one series, or one for each value of OVER."""
        if self.take("OVER"):
            return df, self.field(df)
        return df.withColumn("__series", F.lit(0)), "__series"

    def options(self) -> dict:
        out = {}
        if self.take("WITH"):
            while True:
                k, v = self.pair()
                out[k.upper()] = v
                if not self.take(","):
                    break
        return out

    # -- Geometry

    def do_capacity(self):
        n, df = self.table()
        k = G.curvature(df, self.numeric(n, df)).select("k")
        return k.select("k", G.capacity("k", float(self.number_after("TOLERANCE", default=1.0))).alias("capacity"))

    def do_horizon(self):
        n, df = self.table()
        by = self.field_list(df) if self.take("ON") else self.categorical(df, n)
        return X.horizon(df, self.numeric(n, df), by, float(self.number_after("TOLERANCE", default=1.0)))

    def do_depth(self):
        n, df = self.table()
        by = self.field_list(df) if self.take("ON") else self.categorical(df, n)
        return X.horizon(df, self.numeric(n, df), by).select("k", "gap", "depth")

    def do_freeenergy(self):
        n, df = self.table()
        by = self.field(df) if self.take("BY") else self.categorical(df, n)[0]
        f = self.field(df) if self.take("ON") else self.numeric(n, df)[0]
        span = df.agg((F.max(f) - F.min(f)).cast("double")).first()[0] or 1.0
        return X.free_energy(df, self.s.keys[n], by, f, span, [float(self.number_after("TOLERANCE", default=1.0))])

    def do_health(self):
        n, df = self.table()
        by = self.field_list(df) if self.take("ON") else self.categorical(df, n)
        return X.health(df, self.s.keys[n], self.numeric(n, df), by)

    def do_profile(self):
        return files.profile(self.table()[1])

    def do_mutual(self):
        _, df = self.table()
        self.need("ON")
        return G.mutual_information(df, *self.fields_of(df)[:2])

    def do_fisher(self):
        n, df = self.table()
        return G.fisher(df, self.fields_of(df) if self.take("ON") else self.numeric(n, df))

    def do_correlate(self):
        n, df = self.table()
        return G.metric_tensor(df, self.fields_of(df) if self.take("ON") else self.numeric(n, df))

    def do_holonomy(self):
        n, df = self.table()
        near = None
        if self.take("NEAR"):
            at = {k: float(v) for k, v in self.listed(self.pair)}
            self.need("WITHIN")
            near = at, float(self.number()), ("cosine" if self.take("METRIC", "COSINE") else (self.take("METRIC", "EUCLIDEAN"), "euclid")[1])
        self.need("ON", "FIBER")
        f1, f2 = self.field_list(df)[:2]
        self.need("AROUND")
        around = self.field(df)
        if near is None:
            return G.holonomy(df, f1, f2, around)
        row = df.agg(*[(F.max(f) - F.min(f)).cast("double").alias(f) for f in near[0]]).first()
        return X.holonomy_near(df, f1, f2, around, near[0], near[1], {f: row[f] or 1.0 for f in near[0]}, near[2])

    def do_gauge(self):
        n, a = self.table()
        if self.take("TRANSFORM"):
            self.need("(")
            maps = {}
            while True:
                f = self.field(a)
                self.need("=")
                maps[f] = (float(self.number()), 0.0)
                if not self.take(","):
                    break
            self.need(")")
            self.s.tables[n] = G.affine(a, maps)
            return None
        self.need("VS")
        _, b = self.table()
        self.need("ON", "FIBER")
        f1, f2 = self.field_list(a)[:2]
        self.need("AROUND")
        return X.gauge_test(a, b, f1, f2, self.field(a))

    def do_project(self):
        self.need("INVARIANT")
        self.need("(")
        said, deep = [], 0
        while deep or not self.peek(")"):
            kind, v = self.tokens[self.at]
            self.at += 1
            deep += {"(": 1, ")": -1}.get(v, 0) if kind == "sign" else 0
            said.append(str(v).lower() if kind == "word" else str(v))
        self.need(")")
        self.need("FROM")
        n, df = self.table()
        df = self.filtered(df)
        text = " ".join(said)
        if not set(w for w in text.replace("(", " ").replace(")", " ").split() if w[0].isalpha()) <= {"curvature", "confidence", "capacity", "spectral_gap", "entropy", "beta_0", "beta_1", "k", "records"}:
            raise ValueError(f"no invariant {text}")
        by, key = self.categorical(df, n), self.s.keys[n]
        h = X.health(df, key, self.numeric(n, df), by).withColumn("curvature", F.col("k"))
        if "spectral_gap" in text:
            h = h.join(F.broadcast(GR.spectral_gap(df, by).select(F.coalesce("gap", F.lit(0.0)).alias("spectral_gap"))), F.lit(True))
        import re

        text = re.sub(r"capacity \( ([0-9.e+-]+) \)", r"(\1 / k)", text).replace("capacity", "(1 / k)")
        return h.select(F.expr(text).cast("double").alias("value"))

    # -- Graphs

    def _indexed(self):
        n, df = self.table()
        return n, df, (self.field_list(df) if self.take("ON") else self.categorical(df, n))

    def do_betti(self):
        n, df, by = self._indexed()
        return GR.betti(df, self.s.keys[n], by)

    def do_euler(self):
        n, df, by = self._indexed()
        return X.euler(df, self.s.keys[n], by)

    def do_mixing(self):
        _, df, by = self._indexed()
        return GR.mixing(df, by)

    do_bottleneck = do_mixing

    def do_laplacian(self):
        _, df, by = self._indexed()
        return GR.spectrum(df, by)

    def do_conductance(self):
        _, df, by = self._indexed()
        self.need("WHERE")
        return GR.conductance(df, by, self.predicate(df))

    def do_spectral(self):
        n, df = self.table()
        if self.take("ON", "FIBER"):
            f = self.field_list(df)
            self.need("MODES")
            return V.modes(df, f, self.number())
        by = [self.field(df)] if self.take("ON") else self.categorical(df, n)
        return GR.spectrum(df, by) if self.take("FULL") else GR.spectral_gap(df, by)

    def do_geodesic(self):
        """Over an edge table (src, dst, w): GEODESIC edges FROM src = a TO dst = b."""
        _, df = self.table()
        self.need("FROM")
        _, a = self.pair()
        self.need("TO")
        _, b = self.pair()
        return GR.path(df.select("src", "dst", "w"), a, b)

    def do_circulation(self):
        _, df = self.table()
        return GR.cyclic_edges(df.select("src", "dst", "w"), self.number()) if self.take("TOP") else GR.circulation(df.select("src", "dst", "w"))

    def do_ricci(self):
        n, df = self.table()
        self.need("BETWEEN")
        a = self.value()
        self.need("AND")
        return GR.ricci(df, self.s.keys[n], self.numeric(n, df), a, self.value())

    # -- Series

    def _along(self, df):
        self.need("ALONG")
        return self.field(df)

    def do_texture(self):
        _, df = self.table()
        self.need("ON")
        f, order = self.field(df), self._along(df)
        df, by = self.series_of(df)
        o = self.options()
        return S.texture(df, by, order, f, float(o.get("Q", 2.0)), int(o.get("MIN_LAG", 1)), o.get("MAX_LAG")).drop("__series")

    def do_precedence(self):
        _, df = self.table()
        self.need("ON")
        x, y = self.fields_of(df)
        order = self._along(df)
        df, by = self.series_of(df)
        return S.precedence(df, by, order, x, y).drop("__series")

    def do_cadence(self):
        _, df = self.table()
        self.need("ON")
        f = self.field(df)
        kind = dict(df.dtypes)[f]
        if kind.startswith("timestamp"):
            df = df.withColumn(f, F.unix_micros(F.col(f).cast("timestamp")))
        df, by = self.series_of(df)
        return S.cadence(df, by, f).drop("__series")

    def do_episodic(self):
        _, df = self.table()
        self.need("ON")
        f = self.field(df)
        if dict(df.dtypes)[f].startswith("timestamp"):
            df = df.withColumn(f, F.unix_micros(F.col(f).cast("timestamp")))
        by = self.field(df) if self.take("OVER") else None
        return A.episodes(df, f, float(self.number_after("RATIO", default=3.0)), by)

    def do_trend(self):
        _, df = self.table()
        self.need("ON")
        f, order = self.field(df), self._along(df)
        df, by = self.series_of(df)
        return S.rolling_curvature(df, by, order, f, self.number_after("WINDOW", default=30)).drop("__series")

    def do_changepoints(self):
        _, df = self.table()
        self.need("ON")
        f, order = self.field(df), self._along(df)
        df, by = self.series_of(df)
        return S.change_points(df, by, order, f, self.number_after("WINDOW", default=40), float(self.number_after("THRESHOLD", default=6.0))).drop("__series")

    # -- Anomalies, completion, models

    def do_anomalies(self):
        n, df = self.table()
        f = self.fields_of(df) if self.take("ON") else self.numeric(n, df)
        where = self.predicate(df) if self.take("WHERE") else None
        return A.anomalies(df, f, float(self.number_after("SIGMA", default=2.0)), where)

    def do_outlier(self):
        _, df = self.table()
        self.need("ON")
        fields = self.fields_of(df)
        sigma = float(self.number_after("SIGMA", default=3.0))
        by = [self.field(df)] if self.take("BY") else []
        out = None
        for f in fields:
            one = A.field_anomalies(df, f, sigma, by).withColumn("field", F.lit(f))
            out = one if out is None else out.unionByName(one)
        return out

    def do_scan(self):
        """SCAN b [ON fields] [CONTEXT f] [INTERACTION f * axis] [VELOCITY entity ALONG time] [BUDGET x]."""
        n, df = self.table()
        fields = self.fields_of(df) if self.take("ON") else self.numeric(n, df)
        rows, lenses = A.scan_global(df, fields), ["global"]
        while True:
            if self.take("CONTEXT"):
                rows = A.scan_context(rows, self.field(df), fields)
                lenses.append("context")
            elif self.take("INTERACTION"):
                c = self.field(df)
                self.need("*")
                axis = self.field(df)
                rows = A.scan_interaction(rows, c, axis, fields, 12 if dict(df.dtypes)[axis] in _NUMERIC else None)
                lenses.append("interaction")
            elif self.take("VELOCITY"):
                e = self.field(df)
                rows = A.scan_velocity(rows, e, self._along(df))
                lenses.append("velocity")
            else:
                break
        budget = float(self.number_after("BUDGET", default=0.05))
        for x in lenses:
            rows = A.robust_z(rows, x).drop(x).withColumnRenamed("z", x)
        return A.fused(rows, lenses, budget=budget)

    def _completing(self):
        n, df = self.table()
        self.need("ON")
        f = self.field(df)
        self.need("BY")
        return n, df, f, self.field(df)

    def do_complete(self):
        n, df, f, by = self._completing()
        return GR.completed(df, self.s.keys[n], f, by)

    def do_propagate(self):
        n, df, f, by = self._completing()
        self.need("SETTING")
        return X.propagate(df, self.s.keys[n], f, by, self.query())

    def do_suggest_adjacency(self):
        n, df = self.table()
        self.need("ON")
        f = self.field(df)
        self.need("FROM")
        return X.suggest_adjacency(df, self.s.keys[n], f, self.field_list(df))

    def do_infer(self):
        """INFER b PREDICT target FROM (fields) [USING method] [K n]: rows without the target."""
        n, df = self.table()
        self.need("PREDICT")
        target = self.field(df)
        self.need("FROM")
        fields = self.field_list(df)
        method = self.name().lower() if self.take("USING") else "local_linear"
        k = self.number_after("K", default=20)
        rows = R.cut(I.standardised(df, self.s.keys[n], fields, target))
        known, asked = rows.where("y is not null"), rows.where("y is null").select("key", "x")
        do = {
            "local_linear": lambda: I.local_linear(known, asked, k), "ols": lambda: I.least_squares(known, asked), "gp": lambda: I.conformal(rows, k),
            "diffusion": lambda: I.diffusion(rows, k), "labels": lambda: I.propagated_labels(rows, k), "svm": lambda: I.linear_classes(known, asked),
            "knn": lambda: X.infer(known, asked, "key", "x", "y", k), "knn_vote": lambda: X.vote(known, asked, "key", "x", "y", k),
        }
        if method not in do:
            raise ValueError(f"no method {method}")
        return do[method]()

    def do_attend(self):
        n, df = self.table()
        self.need("ON")
        f = self.field(df)
        self.need("TO")
        at = [float(x) for x in self.listed(self.number)]
        out = V.attend(df, self.s.keys[n], f, at, float(self.number_after("SIGMA", default=1.0)))
        top = self.number_after("TOP")
        return out if top is None else out.orderBy(F.desc("weight"), self.s.keys[n]).limit(top)

    def do_reduce(self):
        n, df = self.table()
        self.need("ON")
        return V.pca(df, self.s.keys[n], self.field(df), self.number_after("MODES", default=2), self.take("WHITEN"))

    def do_cluster(self):
        n, df = self.table()
        self.need("ON")
        f = self.field(df)
        method = self.name().lower() if self.take("USING") else "kmeans"
        k = self.number_after("K", default=3)
        do = {"kmeans": V.kmeans, "gmm": V.mixture, "spectral": X.spectral_clusters}
        return X.dbscan(df, self.s.keys[n], f) if method == "dbscan" else do[method](df, self.s.keys[n], f, k)

    def do_partition(self):
        n, df = self.table()
        self.need("AT")
        at = {k: float(v) for k, v in self.at_key(df).items()}
        self.need("TOLERANCE")
        row = df.agg(*[(F.max(f) - F.min(f)).cast("double").alias(f) for f in at]).first()
        return X.attend_partition(df, self.s.keys[n], at, {f: row[f] or 1.0 for f in at}, float(self.number()))

    # -- Patterns

    def do_define(self):
        replace = self.take("OR", "REPLACE")
        self.need("PATTERN")
        name = self.name()
        self.need("AS")
        conjuncts = [self._said("AND", "WEIGHT", "USING", ";")]
        while self.take("AND"):
            conjuncts.append(self._said("AND", "WEIGHT", "USING", ";"))
        weight = "1"
        if self.take("WEIGHT"):
            weight = self._said("USING", ";")
        using = self.listed(self.name) if self.take("USING") else ()
        PT.define(name, conjuncts, weight, using, replace)
        return None

    def _said(self, *stops: str) -> str:
        """Tokens up to one of the words outside parentheses, as an SQL expression."""
        out, deep, between = [], 0, False
        while not self.done():
            kind, v = self.tokens[self.at]
            if not deep and kind in ("word", "sign") and str(v).upper() in stops and not (between and str(v).upper() == "AND"):
                break
            if kind == "word":
                between = str(v).upper() == "BETWEEN" or (between and str(v).upper() != "AND")
            deep += {"(": 1, ")": -1}.get(v, 0) if kind == "sign" else 0
            out.append("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if kind == "text" else str(v))
            self.at += 1
        return " ".join(out)

    def do_drop(self):
        self.need("PATTERN")
        PT.drop(self.name())

    def do_verdict(self):
        """VERDICT p IN b [BUDGET n] | RELAX p IN b."""
        p = self.name()
        self.need("IN")
        n, df = self.table()
        return PT.verdict(df, p, self.s.keys[n], self.number_after("BUDGET", default=1))

    def do_relax(self):
        p = self.name()
        self.need("IN")
        return PT.relaxation(self.table()[1], p)

    # -- Gaps, moves, files, streams

    def do_fill(self):
        """FILL b ON f ALONG at OVER g USING TRANSPORT | INTERPOLATE LINEAR | CONSTANT (v)."""
        _, df = self.table()
        self.need("ON")
        f = self.field(df)
        at = self._along(df)
        df, over = self.series_of(df)
        self.need("USING")
        method, constant = "transport", 0.0
        if self.take("INTERPOLATE"):
            self.take("LINEAR")
            method = "linear"
        elif self.take("CONSTANT"):
            method, constant = "constant", self.listed(self.value)[0]
        else:
            self.need("TRANSPORT")
        low, high = df.agg(F.min(at), F.max(at)).first()
        return R.filled(df, over, at, f, low, high, method, constant).drop("__series")

    def do_transplant(self):
        a, source = self.table()
        self.need("INTO")
        b, target = self.table()
        where = self.predicate(source) if self.take("WHERE") else F.lit(True)
        names = dict(self.listed(lambda: (self.name(), (self.need("="), self.name())[1]))) if self.take("MAP") else None
        self.s.tables[a], self.s.tables[b] = WR.transplant(source, target, where, names, self.take("RETRACT", "SOURCE"))
        return None

    def do_product(self):
        _, a = self.table()
        self.need("WITH")
        _, b = self.table()
        if b.limit(R.INLINE_KEYS + 1).count() > R.INLINE_KEYS:
            a, b = b, a
        return R.theta(a, b.select(*[F.col(c).alias(f"{c}_right") if c in a.columns else F.col(c) for c in b.columns]), F.lit(True))

    def do_ingest(self):
        n = self.name()
        self.need("FROM")
        path = str(self.value())
        self.need("FORMAT")
        kind = self.name().upper()
        key = self.name() if self.take("KEY") else None
        spark = self.s.spark
        if kind == "CSV":
            df = files.ingest_csv(spark, path, key)
        elif kind in ("JSONL", "NDJSON", "JSON"):
            if key is None:
                raise ValueError("JSONL needs a KEY")
            df = files.ingest_jsonl(spark, path, key)
        elif kind == "NPZ":
            df, key = files.ingest_npz(spark, path), "row_idx" if key is None else key
            if key != "row_idx":  # one member of the archive
                df, key = df.where(F.col("array_name") == key), "row_idx"
        else:
            raise ValueError(f"no format {kind}")
        self.s.add(n, df, key or df.columns[0])
        return df

    def do_snapshot(self):
        _, df = self.table()
        self.need("AS")
        root = self.s.spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        files.snapshot(df, root, str(self.value()))
        return None

    def do_subscribe(self):
        """Rows of a table that is a stream: matching ones, anomalies against a table, or drift."""
        if self.take("ANOMALIES"):
            n, df = self.table()
            fields = self.fields_of(df) if self.take("ON") else self.numeric(n, df)
            self.need("AGAINST")
            return ST.anomalies(df, self.table()[1], fields)
        if self.take("CURVATURE"):
            _, df = self.table()
            self.need("ON")
            f = self.field(df)
            by = self.field(df) if self.take("BY") else None
            self.need("DRIFT", ">")
            drift = float(self.number())
            if by is None:
                df, by = df.withColumn("__series", F.lit(0)), "__series"
            return ST.running_moments(df, by, f, drift)
        _, df = self.table()
        return ST.matching(df, self.predicate(df)) if self.take("ON") else df

    def do_explain_section(self):
        """EXPLAIN SECTION b AT k = v | k IN (...) [VECTOR (f, ...)]: why a record is curved; with
        VECTOR the fields together as one, by the length of their parts."""
        n, df = self.table()
        self.need("AT")
        key = self.field(df)
        values = self.listed(self.value) if self.take("IN") else [(self.need("="), self.value())[1]]
        fields = self.field_list(df) if self.take("VECTOR") else None
        out = G.explain_kappa(df, key, values, fields or self.numeric(n, df))
        if fields is None:
            return out.orderBy(key, F.desc("kappa"), "field")
        return out.groupBy(key).agg(F.sqrt(F.sum(F.pow("kappa", 2))).alias("length"), F.avg("kappa").alias("record_kappa"), F.max_by("field", F.struct("kappa", "field")).alias("loudest")).orderBy(key)

    def do_kappa_rank(self):
        n, df = self.table()
        return G.kappa_rank(df, self.fields_of(df) if self.take("ON") else self.numeric(n, df))

    def do_sameness_rank(self):
        _, df = self.table()
        self.need("TO")
        at = {k: float(v) for k, v in self.listed(self.pair)}
        return G.sameness_rank(df, list(at), at)

    def do_asof(self):
        """ASOF a WITH b ON k, ... ALONG a.time MATCH b.time PROJECT (fields of b)."""
        _, a = self.table()
        self.need("WITH")
        _, b = self.table()
        self.need("ON")
        on = self.fields_of(a)
        at = self._along(a)
        self.need("MATCH")
        to = self.field(b)
        self.need("PROJECT")
        return R.as_of(a, b, on, at, to, self.field_list(b))

    def show_more(self):
        if self.take("PATTERNS"):
            rows = [(p.name, " and ".join(p.conjuncts), p.weight) for p in PT.show()]
            return self.s.spark.createDataFrame(rows, "name string, predicate string, weight string")
        if self.take("FIELDS"):
            return catalog_views.fields(self.table()[1])
        if self.take("STATISTICS"):
            return catalog_views.statistics(self.table()[1])
        if self.take("GEOMETRY"):
            n, df = self.table()
            return G.curvature(df, self.numeric(n, df))
        return None
