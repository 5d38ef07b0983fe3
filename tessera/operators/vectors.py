"""Vectors and models: top-k, proximity, attention, density, clustering, reduction, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _array(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Higher is nearer: cosine, -L2, or the dot product."""
    if metric == "cosine":
        return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-300))
    return -F.sqrt(squared(a, b)) if metric == "l2" else dot(a, b)


def top_k(df: DataFrame, key: str, field: str, query, k: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """(key, score): the k most similar vectors of the query's length, ties to the lesser key."""
    rows = df.where(where) if where is not None else df
    rows = rows.where(F.size(field) == len(query)).select(key, similarity(F.col(field), _array(query), metric).alias("score"))
    return rows.orderBy(F.desc("score"), key).limit(k)


def near(df: DataFrame, at: dict[str, float], within: float, ranges: dict[str, float], metric: str = "euclid") -> DataFrame:
    """df with its distance from a point of scalar fields, each over its range, up to `within`."""
    if metric == "cosine":
        a, b = F.array(*[F.col(f).cast("double") for f in at]), _array(at.values())
        d = 1 - similarity(a, b, "cosine")
    else:
        d = F.sqrt(sum((F.pow((F.col(f) - v) / ranges[f], 2) for f, v in at.items()), F.lit(0.0)))
    return df.withColumn("distance", d).where(F.col("distance") <= within)


def attend(df: DataFrame, key: str, field: str, query, sigma: float = 1.0) -> DataFrame:
    """(key, weight): softmax of -d^2 / 2 sigma^2 over all rows, shifted by the least d^2."""
    d = df.select(key, squared(F.col(field), _array(query)).alias("d"))
    low = d.agg(F.min("d").alias("low"))
    w = d.join(F.broadcast(low), F.lit(True)).withColumn("w", F.exp(-(F.col("d") - F.col("low")) / (2 * sigma**2)))
    total = w.agg(F.sum("w").alias("total"))
    return w.join(F.broadcast(total), F.lit(True)).select(key, (F.col("w") / F.col("total")).alias("weight"))


def density(df: DataFrame, field: str, query, sigma: float = 1.0) -> DataFrame:
    """(density): mean of exp(-d^2 / 2 sigma^2)."""
    return df.agg(F.avg(F.exp(-squared(F.col(field), _array(query)) / (2 * sigma**2))).alias("density"))


def membership(df: DataFrame, fields, label: str, of, limit: float) -> DataFrame:
    """Rows whose diagonal Mahalanobis distance from the class `of` is at most `limit`, with d2."""
    c = df.where(F.col(label) == F.lit(of)).agg(*[x for f in fields for x in (F.avg(f).alias(f"__m_{f}"), F.greatest(F.var_pop(f), F.lit(1e-12)).alias(f"__v_{f}"))])
    d2 = sum((F.pow(F.col(f) - F.col(f"__m_{f}"), 2) / F.col(f"__v_{f}") for f in fields), F.lit(0.0))
    return df.join(F.broadcast(c), F.lit(True)).withColumn("d2", d2).where(F.col("d2") <= limit).drop(*c.columns)


def kmeans(df: DataFrame, key: str, field: str, k: int = 3, seed: int = 1) -> DataFrame:
    """(key, cluster) by k-means++."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.select(key, array_to_vector(F.col(field).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))


def mixture(df: DataFrame, key: str, field: str, k: int = 3, seed: int = 1) -> DataFrame:
    """(key, cluster) by a Gaussian mixture."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    v = df.select(key, array_to_vector(F.col(field).cast("array<double>")).alias("features"))
    return GaussianMixture(k=k, seed=seed, maxIter=20).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))


def moments(df: DataFrame, field: str, parts: int = 16):
    """(n, mean, covariance over n) of the vectors of a column, of one length, by partial sums: at
    most `parts` matrices of dim x dim reach the driver. Null vectors are left out."""
    import numpy as np
    import pandas as pd

    v = df.select(F.col(field).cast("array<double>").alias("v")).where("v is not null")

    def sums(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf.v.to_numpy())
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    def added(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            for r in pdf.itertuples():
                n, s, g = n + r.n, r.s if s is None else s + r.s, r.g if g is None else g + r.g
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g]})

    kind = "n long, s array<double>, g array<double>"
    got = v.mapInPandas(sums, kind).repartition(parts).mapInPandas(added, kind).collect()
    if not got:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, s = sum(r["n"] for r in got), sum(np.array(r["s"]) for r in got)
    mean = s / n
    return n, mean, sum(np.array(r["g"]) for r in got).reshape(len(s), len(s)) / n - np.outer(mean, mean)


def axes(df: DataFrame, field: str, k: int = 2):
    """(mean, axes (k x dim), variances of all axes, descending); an axis's largest part is positive."""
    import numpy as np

    _, mean, cov = moments(df, field)
    lam, v = np.linalg.eigh(cov)
    order = np.argsort(-lam, kind="stable")
    v = v[:, order[:k]].T
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return mean, v, np.maximum(lam[order], 0.0)


def pca(df: DataFrame, key: str, field: str, k: int = 2, whiten: bool = False) -> DataFrame:
    """(key, reduced): coordinates on the k main axes of the centred vectors, with whiten over the
    axes' deviations. The projection is one pass of array sums."""
    mean, v, lam = axes(df, field, k)
    if whiten:
        v = v / (lam[: len(v), None] ** 0.5).clip(1e-12)
    x = F.col(field).cast("array<double>")
    return df.select(key, F.when(x.isNotNull(), F.array(*[dot(x, _array(a)) - float(a @ mean) for a in v])).alias("reduced"))


def pca_report(df: DataFrame, field: str, k: int = 2) -> DataFrame:
    """(axis, variance, share, rmse): of each of the k main axes its variance, its share of the whole,
    and the root mean squared error per component of the rebuilt vectors with axes up to it."""
    _, v, lam = axes(df, field, k)
    total = float(lam.sum())
    rows = [(i, float(lam[i]), float(lam[i] / total) if total else 0.0, float(lam[i + 1 :].sum() / len(lam)) ** 0.5) for i in range(len(v))]
    return df.sparkSession.createDataFrame(rows, "axis int, variance double, share double, rmse double")


def modes(df: DataFrame, fields, k: int = 3) -> DataFrame:
    """(mode, lambda, ipr): largest eigenvalues of the sample covariance, and how few fields carry
    each. The matrix is of fields, from one pass over the rows."""
    import numpy as np

    pairs = [(i, j) for i in range(len(fields)) for j in range(i, len(fields))]
    row = df.agg(*[F.covar_samp(fields[i], fields[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    c = np.zeros((len(fields), len(fields)))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    lam, v = np.linalg.eigh(c)
    order = np.argsort(-lam)[:k]
    return df.sparkSession.createDataFrame([(n, float(lam[i]), float((v[:, i] ** 4).sum())) for n, i in enumerate(order)], "mode int, lambda double, ipr double")


def regression(df: DataFrame, y: str, xs, ridge: float = 0.0) -> DataFrame:
    """(term, coefficient) of least squares with a ridge on the slopes, from the Gram sums."""
    import numpy as np

    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    sums = {f"g{i}_{j}": F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))} | {f"y{i}": F.sum(t * F.col(y)) for i, t in enumerate(terms)}
    row = df.dropna(subset=[y, *xs]).agg(*[s.alias(n) for n, s in sums.items()]).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(len(terms))] for i in range(len(terms))], float)
    g[1:, 1:] += ridge * np.eye(len(xs))
    beta = np.linalg.solve(g, np.array([row[f"y{i}"] for i in range(len(terms))], float))
    return df.sparkSession.createDataFrame(list(zip(["intercept", *xs], map(float, beta))), "term string, coefficient double")


def ridge_path(df: DataFrame, y: str, xs, ridges) -> DataFrame:
    """(ridge, loo): for each ridge the root mean squared leave-one-out error, exactly, from the
    leverages of one fit: a residual over 1 - h. The Gram matrix takes one pass and all errors a
    second; rows with a null are left out."""
    import numpy as np

    rows = df.dropna(subset=[y, *xs])
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    p = len(terms)
    sums = {f"g{i}_{j}": F.sum(terms[i] * terms[j]) for i in range(p) for j in range(i, p)} | {f"y{i}": F.sum(t * F.col(y)) for i, t in enumerate(terms)}
    row = rows.agg(*[s.alias(n) for n, s in sums.items()]).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    b = np.array([row[f"y{i}"] for i in range(p)], float)
    errors = []
    for n, ridge in enumerate(ridges):
        inverse = np.linalg.inv(g + np.diag([0.0, *[float(ridge)] * (p - 1)]))
        beta = inverse @ b
        fit = sum((float(beta[i]) * terms[i] for i in range(p)), F.lit(0.0))
        h = sum((float(inverse[i, j]) * terms[i] * terms[j] for i in range(p) for j in range(p)), F.lit(0.0))
        errors.append(F.sqrt(F.avg(F.pow((F.col(y) - fit) / (1 - h), 2))).alias(f"e{n}"))
    out = rows.agg(*errors)
    return out.select(F.inline(F.array(*[F.struct(F.lit(float(r)).alias("ridge"), F.col(f"e{n}").alias("loo")) for n, r in enumerate(ridges)])))


def factors(df: DataFrame, user: str, item: str, rating: str, rank: int = 4, seed: int = 1) -> DataFrame:
    """(rmse, n): fit of alternating least squares to ratings with the mean taken off."""
    from pyspark.ml.recommendation import ALS

    mean = df.agg(F.avg(rating).alias("mu"))
    r = df.join(F.broadcast(mean), F.lit(True)).select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i"), (F.col(rating) - F.col("mu")).alias("r"))
    got = ALS(rank=rank, maxIter=8, regParam=0.05, userCol="u", itemCol="i", ratingCol="r", seed=seed, coldStartStrategy="drop").fit(r).transform(r)
    return got.agg(F.sqrt(F.avg(F.pow(F.col("r") - F.col("prediction"), 2))).alias("rmse"), F.count("*").alias("n"))
