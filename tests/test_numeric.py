"""Queries without SQL against plain numpy, hashlib and loops over the same tables."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tessera.operators import advanced as X
from tessera.operators import anomaly as A
from tessera.operators import graph as GR
from tessera.operators import inference as I
from tessera.operators import series as S
from tessera.operators import vectors as V
from tessera.plans import catalog

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def q(spark, sf):
    return lambda name: catalog.queries()[name](spark, sf).toPandas()


@pytest.fixture(scope="module")
def t(sf):
    return lambda name: pd.read_parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def vectors(t):
    e = t("embeddings").sort_values("vec_id")
    return e.vec_id.to_numpy(), np.stack(e.embedding).astype(float), e.label.to_numpy()


def adjacency(c):
    n, m = c.c_nationkey.to_numpy(), c.c_mktsegment.to_numpy()
    a = ((n[:, None] == n) | (m[:, None] == m)).astype(float)
    np.fill_diagonal(a, 0)
    return a


def laplacian(a):
    s = 1 / np.sqrt(a.sum(1))
    return np.linalg.eigvalsh(np.eye(len(a)) - a * s[:, None] * s)


def test_spectra(q, t):
    c = t("customer")
    lam = laplacian(adjacency(c))
    assert q("spectral_gap").gap[0] == pytest.approx(lam[1])
    got = q("spectrum")
    assert np.allclose(np.repeat(got.value, got.multiplicity), lam, atol=1e-8)
    m = q("mixing").iloc[0]
    assert (m.mixing, m.cheeger_low, m.cheeger_high) == pytest.approx((1 / lam[1], lam[1] / 2, math.sqrt(2 * lam[1])))
    k = c.c_acctbal.var(ddof=0) / (c.c_acctbal.max() - c.c_acctbal.min()) ** 2
    h = q("horizon").iloc[0]
    assert (h.k, h.gap, h.length, h.horizon) == pytest.approx((k, lam[1], lam[1] ** -0.5, lam[1] ** 0.5 / k))


def test_effective_dimension_and_modes(q, t):
    x = t("lineitem")[LINE].to_numpy(float)
    lam = np.linalg.eigvalsh(np.corrcoef(x.T))
    got = q("effective_dimension").iloc[0]
    assert got.condition == pytest.approx(lam[-1] / lam[0]) and got.dimension == pytest.approx(lam.sum() ** 2 / (lam**2).sum())
    values, w = np.linalg.eigh(np.cov(x.T))
    got = q("spectral_modes")
    order = np.argsort(-values)[: len(got)]
    assert np.allclose(got["lambda"], values[order]) and np.allclose(got.ipr, (w[:, order] ** 4).sum(0))


def test_ridge_path(q, t):
    li = t("lineitem")
    x = np.column_stack((np.ones(len(li)), li.l_quantity, li.l_tax)).astype(float)
    g = x.T @ x + np.diag([0, 10.0, 10.0])
    beta = np.linalg.solve(g, x.T @ li.l_extendedprice.to_numpy(float))
    got = q("ridge_path").set_index("term").coefficient
    assert np.allclose(got[["intercept", "l_quantity", "l_tax"]], beta)


def test_sketch_of_distinct_values(spark, sf):
    got = catalog.queries()["agg_approx_distinct"](spark, sf).toPandas()
    n = pd.read_parquet(f"{sf}/orders.parquet").o_custkey.nunique()
    assert abs(got.customers[0] - n) <= 0.06 * n


def test_changepoints(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(m, 1, 150) for m in (0, 6, 0, 9)])
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", i, 1.0) for i in range(20)], "s string, o int, v double")
    got = [(r["i"], r["stat"]) for r in S.change_points(df, "s", "o", "v", 40, 6.0).collect()]
    z = (v - v.mean()) / v.std()
    stat = {}
    for i in range(40, len(z) - 40):
        b, a = z[i - 40 : i], z[i : i + 40]
        stat[i] = abs(a.mean() - b.mean()) / (math.sqrt((a.var() + b.var()) / 2) * math.sqrt(2 / 40))
    want, i = [], 40
    while i < len(z) - 40:
        if stat[i] > 6 and stat[i] >= max(stat.get(j, 0) for j in range(i - 40, i + 40)):
            want.append(i)
            i += 40
        else:
            i += 1
    assert sorted(i for i, _ in got) == want and len(want) == 3
    assert all(s == pytest.approx(stat[i]) for i, s in got)


def test_jackknife(q, t):
    got = q("jackknife").set_index("event_type")
    for kind, g in t("events").sort_values("ts").groupby("event_type"):
        v = g.value.to_numpy()
        c, n = v - v.mean(), len(v)
        rho = lambda lag: (c[:-lag] * c[lag:]).sum() / ((n - lag) * v.var())
        tau = 0.5
        for lag in range(1, n // 2):
            tau += rho(lag)
            if rho(lag) <= 0 or lag >= 6 * tau:
                break
        tau = max(tau, 0.5)
        naive = v.std() / math.sqrt(n - 1)
        assert tuple(got.loc[kind, ["mean", "error", "naive", "tau", "n_eff"]]) == pytest.approx((v.mean(), naive * math.sqrt(2 * tau), naive, tau, n / (2 * tau)))


def test_precedence_null(q, t):
    got = q("precedence_null").set_index("event_type").p
    for kind, g in t("events").sort_values("ts").groupby("event_type"):
        dx, dy = np.diff(g.value.to_numpy(float)), np.diff(g.user_id.to_numpy(float))

        def area(dy):
            total = x = y = 0.0
            for a, b in zip(dx, dy):
                total += x * b - y * a
                x, y = x + a, y + b
            return abs(total)

        own = area(dy)
        shifts = np.random.default_rng(1).integers(1, len(dy), 199)
        assert got[kind] == pytest.approx((1 + sum(area(np.concatenate((dy[-k:], dy[:-k]))) >= own * (1 - 1e-12) for k in shifts)) / 200)


def test_cadence(spark):
    rng = np.random.default_rng(2)
    series = {"bursty": np.cumsum(rng.exponential(1, 300) ** 3), "steady": np.cumsum(rng.exponential(1, 300)), "regular": np.cumsum(1 + 0.01 * rng.random(300)), "few": np.arange(20.0), "equal": np.arange(100.0), "coarse": np.cumsum(rng.integers(1, 4, 200)).astype(float), "lattice": np.cumsum(np.where(rng.random(200) < 0.3, 7.77, rng.exponential(5, 200) + 0.3))}
    df = spark.createDataFrame([(k, float(x)) for k, v in series.items() for x in (*v, v[0])], "s string, t double")
    got = {r["s"]: r for r in S.cadence(df, "s", "t").collect()}
    assert {k: r["refused"] for k, r in got.items()} == {"bursty": None, "steady": None, "regular": None, "few": "few stamps", "equal": "equal gaps", "coarse": "coarse stamps", "lattice": "lattice"}
    index = lambda g: math.sqrt(max(0, (len(g) + 1) / (len(g) - 1) * (len(g) * (g**2).sum() / g.sum() ** 2 - 1)))
    for k in ("bursty", "steady", "regular"):
        g, r = np.diff(np.unique(series[k])), got[k]
        n, c = len(g), np.log(g) - np.log(g).mean()
        blocked = np.mean([index(g[b * 64 : b * 64 + 64]) for b in range(n // 64)])
        memory = (c[:-1] * c[1:]).sum() / (c**2).sum()
        want = (n, index(g), (index(g) - 1) / (n / math.sqrt((n - 1) * (n + 2) * (n + 3))), blocked, memory, memory * math.sqrt(n))
        assert tuple(r)[1:7] == pytest.approx(want)
    assert [got[k]["verdict"] for k in ("bursty", "steady", "regular")] == ["BURSTY", "STEADY", "THROTTLED"]


def test_autochart(spark, t):
    e = t("events").sort_values("ts")
    got = catalog.queries()["autochart"](spark, "/root/testdata/sf0.001").toPandas()
    for kind, g in e.groupby("event_type"):
        charts = []
        for v in g.value:
            best = min(charts, key=lambda c: abs(v - np.mean(c)), default=None)
            if best is not None:
                sd = np.std(best) if len(best) > 1 else abs(np.mean(best)) * 0.1 + 1e-9
                if abs(v - np.mean(best)) <= 2 * max(sd, 1e-9):
                    new = [*best, v]
                    span = max(new) - min(new)
                    if span == 0 or np.var(new) / span**2 <= (0.25 if len(best) < 3 else 0.1) + 1e-9:
                        best.append(v)
                        continue
            charts.append([v])
        own = got[got.event_type == kind].sort_values("chart")
        assert own.n.tolist() == [len(c) for c in charts] and np.allclose(own["mean"], [np.mean(c) for c in charts])


def test_persistence(q, t):
    s = t("supplier")[["s_acctbal", "s_nationkey"]].to_numpy(float)
    edges = sorted((np.linalg.norm(s[i] - s[j]), i, j) for i in range(len(s)) for j in range(i))
    root, bars = list(range(len(s))), []
    for d, i, j in edges:
        a, b = root[i], root[j]
        if a != b:
            root = [a if r == b else r for r in root]
            bars.append(d)
    assert np.allclose(sorted(q("persistence").death), sorted(bars))


def test_clusters_of_models(q, vectors):
    ids, x, _ = vectors
    for name in ("kmeans", "spectral_clusters"):
        got = q(name)
        key = got.columns[0]
        assert sorted(got[key]) == sorted(ids)
    c = q("kmeans").set_index("vec_id").cluster[ids].to_numpy()
    centres = np.array([x[c == k].mean(0) for k in sorted(set(c))])
    near = np.linalg.norm(x[:, None] - centres, axis=2).argmin(1)
    assert (near == np.searchsorted(sorted(set(c)), c)).mean() > 0.9


def test_models_find_what_is_there(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for out in (V.kmeans(df, "id", "v", 3), V.mixture(df, "id", "v", 3), X.spectral_clusters(df, "id", "v", 3)):
        got = {r[0]: r[1] for r in out.collect()}
        assert [len({got[i] for i in range(a, a + 60)}) for a in (0, 60, 120)] == [1, 1, 1] and len(set(got.values())) == 3


def test_pca(q, vectors):
    ids, x, _ = vectors
    c = x - x.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    got = np.stack(q("pca").set_index("vec_id").reduced[ids])
    assert np.allclose(np.abs(got), np.abs(c @ axes.T), atol=1e-6)
    _, values, _ = np.linalg.svd(c / math.sqrt(len(c)), full_matrices=False)
    report = q("pca_report")
    assert np.allclose(report.variance, values[:5] ** 2) and np.allclose(report.share, values[:5] ** 2 / (values**2).sum())
    for i, r in enumerate(report.rmse):
        axes = np.linalg.svd(c, full_matrices=False)[2][: i + 1]
        assert r == pytest.approx(math.sqrt(((c - c @ axes.T @ axes) ** 2).mean()))


def test_whitening(spark):
    x = np.random.default_rng(2).normal(0, [1, 5, 0.1], (200, 3)) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = {r["id"]: r["reduced"] for r in V.pca(df, "id", "v", 3, True).collect()}
    assert got.pop(999) is None and np.allclose(np.cov(np.array(list(got.values())).T, bias=True), np.eye(3), atol=1e-6)


def test_factors(q, t):
    e = t("events")
    got = q("als").iloc[0]
    assert 0 < got.rmse < e.groupby(["user_id", "event_type"]).value.mean().std() and got.n == len(e.groupby(["user_id", "event_type"]))


def test_prescribe(q, vectors):
    ids, x, _ = vectors
    d = np.sort(np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2))), 1)[:, 1:11]
    got = q("prescribe").iloc[0]
    assert got.dimension == pytest.approx(1 / (np.log(d[:, -1]) - np.log(d).mean(1)).mean(), rel=1e-6) and got.spread == pytest.approx(d[:, -1].std() / d[:, -1].mean(), rel=1e-6)


def test_recall_of_approximate_neighbours(q, vectors):
    ids, x, _ = vectors
    want = set(ids[np.argsort(np.linalg.norm(x - 0.05, axis=1), kind="stable")[:10]])
    got = q("approximate_neighbours")
    assert len(got) == 10 and len(want & set(got.vec_id)) >= 9


def test_sample(q, t):
    li, got = t("lineitem"), q("sample")
    for f in ("l_quantity", "l_tax"):
        assert len(got) == 1000 and abs(got[f].mean() - li[f].mean()) < 4 * li[f].std() / math.sqrt(1000) and got[f].std() == pytest.approx(li[f].std(), rel=0.15)


def test_gibbs_follows_the_exact_distribution(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "src int, dst int")
    got = X.gibbs(edges, 0.4, 4, 1500).toPandas()
    weights = defaultdict(float)
    for s in range(16):
        v = [1 if s >> i & 1 else -1 for i in range(4)]
        weights[sum(v) / 4] += math.exp(0.4 * sum(v[i] * v[(i + 1) % 4] for i in range(4)))
    total = sum(weights.values())
    seen = Counter(round(m, 2) for m in got.mean_spin)
    for m, w in weights.items():
        assert seen[round(m, 2)] / len(got) == pytest.approx(w / total, abs=0.03)


def test_transport_rotation(q, t):
    o = t("orders").set_index("o_orderkey")
    a, b = (o.loc[k, ["o_custkey", "o_totalprice"]].to_numpy(float) for k in (1, 7))
    got = q("transport_rotation").set_index("field")
    m = np.stack(got.row)
    assert np.allclose(got.displacement, b - a) and np.allclose(m @ m.T, np.eye(2)) and np.linalg.det(m) == pytest.approx(1)
    assert np.allclose(m @ (a / np.linalg.norm(a)), b / np.linalg.norm(b))


def test_hashes(q, t):
    n = t("nation")
    said = lambda r: json.dumps({k: (int(v) if isinstance(v, (int, np.integer)) else v) for k, v in sorted(r.items())}, separators=(",", ":"))
    level = [hashlib.sha256(said(r).encode()).hexdigest() for r in n.sort_values("n_nationkey").to_dict("records")]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    got = q("merkle_root").iloc[0]
    assert got.leaves == len(n) and got.root == level[0]
    assert len(q("content_version")) == 1


def test_content_version_follows_rows(spark):
    from tessera.operators import sealing as SE

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    one = SE.content_version(df).first()
    assert one == SE.content_version(df.orderBy("v", ascending=False).repartition(3)).first()
    assert one != SE.content_version(df.union(df.limit(1))).first() and one != SE.content_version(df.where("k = 1")).first()


def test_thermodynamics(q, t):
    c = t("customer").sort_values("c_custkey")
    v, g = c.c_acctbal.to_numpy(), c.c_nationkey.to_numpy()
    step = max(1, len(c) // 50)
    p = np.arange(0, step * min(50, -(-len(c) // step)), step)

    def f(tau):
        z = [sum(math.exp(-abs(v[i] - v[j]) / 11000 / tau) for j in np.flatnonzero(g == g[i]) if j != i) for i in p]
        return -tau * np.mean(np.log1p(z))

    share = pd.Series(g).value_counts(normalize=True)
    for r in q("thermodynamics").itertuples():
        h = 0.01 * r.tau + 1e-6
        assert r.f == pytest.approx(f(r.tau))
        assert r.heat == pytest.approx(r.tau**2 * (f(r.tau + h) - 2 * f(r.tau) + f(r.tau - h)) / h**2, rel=1e-3)
        assert r.entropy == pytest.approx(-(share * np.log(share)).sum()) and r.k == pytest.approx(v.var() / (v.max() - v.min()) ** 2)


def test_holonomy_near(q, t):
    c = t("customer")
    near = c[abs(c.c_acctbal - 5000) / 11000 <= 0.3]
    assert q("holonomy_near").groups[0] == near.c_nationkey.nunique()


def test_ricci(q, t):
    n = t("nation")
    x = n[["n_nationkey", "n_regionkey"]].to_numpy(float)
    a, b = x[n.n_nationkey.to_numpy() == 3][0], x[n.n_nationkey.to_numpy() == 9][0]
    d = np.linalg.norm(a - b)
    p, q_ = (x[np.linalg.norm(x - c, axis=1) <= d] for c in (a, b))
    cost = sorted((np.linalg.norm(u - w), i, j) for i, u in enumerate(p) for j, w in enumerate(q_))
    left, right, w1 = [1 / len(p)] * len(p), [1 / len(q_)] * len(q_), 0.0
    for c, i, j in cost:
        m = min(left[i], right[j])
        w1, left[i], right[j] = w1 + m * c, left[i] - m, right[j] - m
    got = q("ricci").iloc[0]
    assert (got.distance, got.w1, got.curvature) == pytest.approx((d, w1, 1 - w1 / d), rel=1e-6)


def test_geodesic_path_is_connected(q):
    got, all_of = q("geodesic_path"), q("geodesic").set_index("node").distance
    assert got.node.iloc[0] == 0 and got.node.iloc[-1] == 13 and got.distance.tolist() == list(range(len(got))) and all_of[13] == len(got) - 1


def test_profile_and_fields(q, t):
    o = t("orders")
    fields = q("describe_fields")
    assert [str(v) for v in fields.iloc[:, 0]] == list(o.columns)
    profile = q("profile")
    assert set(o.columns) <= {str(v) for v in profile.iloc[:, 0]}


def test_supervised_weights(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(a > 2)) for i, (a, b) in enumerate(rng.exponential(1.5, (600, 2)))]
    df = spark.createDataFrame(rows, "id int, good double, noise double, label int")
    got = A.fitted_weights(df, "id", ["good", "noise"], "label").toPandas().set_index("lens")
    assert got.weight["good"] > 5 * abs(got.weight["noise"]) and got.auc["good"] > 0.95


def test_scan_completion(q, vectors):
    ids, x, _ = vectors
    got = q("scan_completion").set_index("key").completion
    for i in range(0, len(ids), 37):
        d = np.linalg.norm(x - x[i], axis=1)
        near = x[[j for j in np.lexsort((ids, d)) if j != i][:10]]
        c = near - near.mean(0)
        assert 0 <= got[ids[i]] <= np.linalg.norm(x[i] - near.mean(0)) + 1e-9
        # Ten neighbours leave directions of no variance: the fit takes one of them.
        assert np.linalg.matrix_rank(c) < x.shape[1]


def features(t):
    p = t("part")
    f = np.column_stack((p.p_size, p.p_partkey % 1000)).astype(float)
    known = (p.p_partkey % 5 != 0).to_numpy()
    return p.p_partkey.to_numpy(), (f - f.mean(0)) / f.std(0), p.p_retailprice.to_numpy(), known


def plain_local(x, q, near, y):
    d = np.linalg.norm(x[near] - x[q], axis=1)
    w = (1 - np.minimum(d / d.max(), 1) ** 3) ** 3
    b = np.column_stack((np.ones(len(near)), x[near] - x[q]))
    a = b.T @ np.diag(w) @ b + np.diag([0, 0.5 * w.sum(), 0.5 * w.sum()])
    return np.linalg.solve(a, b.T @ (w * y[near]))[0]


def test_local_linear_and_conformal(q, t):
    keys, x, y, known = features(t)
    got = q("infer_local_linear").set_index("key")["mean"]
    for i in np.flatnonzero(~known)[::7]:
        d = np.linalg.norm(x - x[i], axis=1)
        near = [j for j in np.lexsort((keys, d)) if known[j]][:20]
        assert got[keys[i]] == pytest.approx(plain_local(x, i, near, y), rel=1e-5)
    c = q("infer_conformal").set_index("key")
    truth = pd.Series(y, keys)[c.index]
    assert np.mean((truth >= c.lower) & (truth <= c.upper)) > 0.7 and (c.lower <= c["mean"]).all()


def test_diffusion(spark):
    rows = [(i, [float(i), 0.0], float(i) if i in (0, 9) else None) for i in range(10)]
    df = spark.createDataFrame(rows, "key int, x array<double>, y double")
    got = {r["key"]: r["mean"] for r in I.diffusion(df, k=2, rounds=60).collect()}
    assert sorted(got) == list(range(1, 9)) and all(got[i] < got[i + 1] for i in range(1, 8)) and 0 < got[1] < got[8] < 9


def test_labels(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.5, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    rows = [(i, v.tolist(), "abc"[i // 40] if i % 8 == 0 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key int, x array<double>, y string")
    for got in (I.propagated_labels(df, 8, 20), I.linear_classes(df.where("y is not null"), df.where("y is null").select("key", "x"))):
        said = {r["key"]: r["label"] for r in got.collect()}
        assert said == {i: "abc"[i // 40] for i in range(120) if i % 8}


def test_medians_and_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(v)) for i, v in enumerate(rng.integers(0, 50, 500))] + [("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    p = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    got = {r["g"]: (r["med"], r["n"]) for r in A.group_median(df.where("g is not null"), "g", "v").collect()}
    assert got == {g: (x.v.median(), len(x)) for g, x in p.groupby("g")}
    v = [x for _, x in rows if x is not None]
    for share in (0, 0.5, 0.95, 1):
        assert A.quantile(df, "v", share) == pytest.approx(np.quantile(v, share))
    assert A.quantile(df.limit(0), "v", 0.5) is None and GR.completed(df.limit(0).selectExpr("1 as k", "g", "v"), "k", "v", "g").count() == 0


def test_leave_one_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    b = np.column_stack((np.ones(40), x))
    for r in V.ridge_path(df, "y", ["a", "b"], [0.0, 3.0]).collect():
        errors = []
        for i in range(40):
            k = np.arange(40) != i
            beta = np.linalg.solve(b[k].T @ b[k] + np.diag([0, r["ridge"], r["ridge"]]), b[k].T @ y[k])
            errors.append(y[i] - b[i] @ beta)
        assert r["loo"] == pytest.approx(math.sqrt(np.mean(np.square(errors))))


def test_inclusion_proofs(spark):
    from tessera.operators import sealing as SE

    for n in (1, 2, 7, 8):
        df = spark.createDataFrame([(i, f"é{i}") for i in range(n)], "k int, v string")
        root = SE.merkle_root(df, "k").first()["root"]
        for i in (0, n - 1):
            proof = [tuple(r) for r in SE.inclusion_proof(df, "k", i).collect()]
            assert SE.verify_proof(SE.leaf_of({"k": i, "v": f"é{i}"}), proof, root)
            assert not SE.verify_proof(SE.leaf_of({"k": i, "v": "x"}), proof, root)
    assert SE.inclusion_proof(df, "k", 99).count() == 0


def test_inpainting_patterns(spark):
    from tessera.operators import geometry as G

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ [[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(300, None, 1.0, None), (301, None, None, None), (302, 0.5, None, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: [r["a"], r["b"], r["c"]] for r in G.inpainted(df, "id", ["a", "b", "c"]).collect()}
    m, c = x.mean(0), np.cov(x.T, bias=True)
    assert set(got) == {300, 301, 302} and np.allclose(got[301], m)
    assert np.allclose(got[300], [m[0] + c[0, 1] / c[1, 1] * (1 - m[1]), 1.0, m[2] + c[2, 1] / c[1, 1] * (1 - m[1])])
    k = [0, 2]
    assert got[302][1] == pytest.approx(m[1] + c[1, k] @ np.linalg.solve(c[np.ix_(k, k)], np.array([0.5, 2.0]) - m[k]))


def test_schema_changes_are_checked(spark):
    from tessera.operators import writes as WR

    df = spark.createDataFrame([(1, 2)], "k int, v int")
    for bad in (lambda: WR.add_field(df, "v", "int"), lambda: WR.drop_field(df, "k", ["k"]), lambda: WR.drop_field(df, "x")):
        with pytest.raises(ValueError):
            bad()
