"""Encrypted fields, what can be computed on them, and integrity of tables."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import cut, numbered_rows


def affine(v, a: float, b: float) -> Column:
    return F.lit(a) * F.col(v) + F.lit(b)


def unaffine(w, a: float, b: float) -> Column:
    return (F.col(w) - F.lit(b)) / F.lit(a)


def rekeyed(w, a1: float, b1: float, a2: float, b2: float) -> Column:
    """A value under (a1, b1) brought under (a2, b2) without being read."""
    return F.lit(a2 / a1) * F.col(w) + F.lit(b2 - b1 * a2 / a1)


def recovered(w: str, a: float, b: float) -> dict[str, Column]:
    """Aggregates of v from w = a v + b. Order statistics swap ends if a is negative."""
    low, high = (F.min(w), F.max(w)) if a > 0 else (F.max(w), F.min(w))
    back = lambda c: (c - F.lit(b)) / F.lit(a)
    return {
        "count": F.count(w), "sum": (F.sum(w) - F.count(w) * F.lit(b)) / F.lit(a), "avg": back(F.avg(w)), "min": back(low), "max": back(high),
        "variance": F.var_pop(w) / F.lit(a * a), "stddev": F.stddev_pop(w) / F.lit(abs(a)), "range": (F.max(w) - F.min(w)) / F.lit(abs(a)), "median": back(F.median(w)),
    }


def indexed(v, key: str) -> Column:
    """A keyed digest: equal values stay equal, and only equality can be asked."""
    return F.sha2(F.concat(F.lit(key), F.lit("|"), F.col(v).cast("string")).cast("binary"), 256)


def sealed(v, key: bytes) -> Column:
    """AES-GCM: nothing can be asked of it."""
    return F.base64(F.aes_encrypt(F.col(v).cast("string"), F.lit(key), F.lit("GCM")))


def unsealed(w, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(F.col(w)), F.lit(key), F.lit("GCM")).cast("string")


def rotated(fields, matrix) -> dict[str, Column]:
    """Fields times an orthogonal matrix: distances and lengths stay."""
    return {f"{f}_rot": sum((F.lit(float(m)) * F.col(g) for m, g in zip(row, fields)), F.lit(0.0)) for f, row in zip(fields, matrix)}


def content_version(df: DataFrame) -> DataFrame:
    """(rows, version): an order-free hash of all rows."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("version"))


def merkle_root(df: DataFrame, key: str) -> DataFrame:
    """(leaves, root): SHA-256 of rows in key order, paired level by level by a distributed sort;
    an odd node rises as it is."""
    leaf = F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)
    level = df.select(F.col(key).alias("k"), leaf.alias("h"))
    level = cut(numbered_rows(level, ["k", "h"]).select("i", "h"))
    n = leaves = level.count()
    while n > 1:
        level = level.groupBy((F.col("i") / 2).cast("long").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("p"))
        level = cut(level.select("i", F.when(F.size("p") == 2, F.sha2(F.concat(F.col("p")[0]["h"], F.col("p")[1]["h"]).cast("binary"), 256)).otherwise(F.col("p")[0]["h"]).alias("h")))
        n = (n + 1) // 2
    return level.select(F.lit(leaves).cast("long").alias("leaves"), F.col("h").alias("root"))


def tag(invariants: dict[str, float], key: bytes, digits: int = 9) -> str:
    """HMAC of a table's invariants, rounded so that recomputation agrees."""
    said = ",".join(f"{k}={v:.{digits}g}" for k, v in sorted(invariants.items()))
    return hmac.new(key, said.encode(), hashlib.sha256).hexdigest()


def verify(invariants: dict[str, float], key: bytes, given: str, digits: int = 9) -> bool:
    return hmac.compare_digest(tag(invariants, key, digits), given)


def belief_distances(p: DataFrame, q: DataFrame, on: str, weight: str) -> DataFrame:
    """(tv, hellinger, kl_bits) of two histograms; kl is null where q lacks what p has."""
    a = p.groupBy(on).agg(F.sum(weight).alias("a"))
    b = q.groupBy(on).agg(F.sum(weight).alias("b"))
    both = a.join(b, on, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    both = both.join(F.broadcast(total), F.lit(True)).select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))
    kl = F.when(F.sum(F.when((F.col("p") > 0) & (F.col("q") == 0), 1).otherwise(0)) == 0, F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.log2(F.col("p") / F.col("q"))).otherwise(0.0)))
    return both.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), F.sqrt(F.sum(F.pow(F.sqrt("p") - F.sqrt("q"), 2)) / 2).alias("hellinger"), kl.alias("kl_bits"))


def recovered_quantile(w: str, a: float, b: float, p: float) -> Column:
    """The p-quantile of v from w = a v + b; a negative map turns the order round."""
    return (F.percentile(w, p if a > 0 else 1 - p) - F.lit(b)) / F.lit(a)


def recovered_extremes(w: str, a: float, key: str) -> dict[str, Column]:
    """Keys of the least and the greatest v under w = a v + b, ties to the lesser key."""
    first = F.min(F.struct(F.col(w), F.col(key)))[key]
    last = F.min(F.struct((-F.col(w)).alias("w"), F.col(key)))[key]
    return {"argmin": first if a > 0 else last, "argmax": last if a > 0 else first}


def _levels(df: DataFrame, key: str) -> list[DataFrame]:
    """All levels of the Merkle tree of df, (i, h) from the leaves to the root."""
    leaf = F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)
    level = cut(numbered_rows(df.select(F.col(key).alias("k"), leaf.alias("h")), ["k", "h"]).select("i", "h"))
    out, n = [level], level.count()
    while n > 1:
        level = level.groupBy((F.col("i") / 2).cast("long").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("p"))
        level = cut(level.select("i", F.when(F.size("p") == 2, F.sha2(F.concat(F.col("p")[0]["h"], F.col("p")[1]["h"]).cast("binary"), 256)).otherwise(F.col("p")[0]["h"]).alias("h")))
        out.append(level)
        n = (n + 1) // 2
    return out


def inclusion_proof(df: DataFrame, key: str, value) -> DataFrame:
    """(level, side, hash): the siblings on the way from the record at `value` to the root of
    merkle_root, one lookup a level; side says where the sibling stands. No rows for no record."""
    kind = "level int, side string, hash string"
    spark = df.sparkSession
    before = df.where(F.col(key) < F.lit(value)).count()
    if df.where(F.col(key) == F.lit(value)).limit(1).count() == 0:
        return spark.createDataFrame([], kind)
    i, rows = before, []
    for n, level in enumerate(_levels(df, key)):
        if (near := level.where(F.col("i") == (i ^ 1)).first()) is not None:
            rows.append((n, "left" if i & 1 else "right", near["h"]))
        i >>= 1
    return spark.createDataFrame(rows, kind)


def leaf_of(record: dict) -> str:
    """The leaf of a record whose values JSON says as Spark does (integers, texts, booleans)."""
    import json

    said = json.dumps({k: record[k] for k in sorted(record) if record[k] is not None}, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(said.encode()).hexdigest()


def verify_proof(leaf: str, proof: list, root: str) -> bool:
    """Whether the proof's rows (level, side, hash) lead from the leaf to the root."""
    for _, side, other in sorted(proof):
        leaf = hashlib.sha256(((other + leaf) if side == "left" else (leaf + other)).encode()).hexdigest()
    return hmac.compare_digest(leaf, root)


def probabilistic(v, a: float, b: float, sigma: float, seed: int = 1) -> Column:
    """a v + b with noise of deviation sigma: sums and means come back in expectation; with sigma
    over 0 order statistics are refused by probabilistic_recovered."""
    return F.lit(a) * F.col(v) + F.lit(b) + F.lit(sigma) * F.randn(seed)


def probabilistic_recovered(w: str, a: float, b: float, sigma: float) -> dict[str, Column]:
    r = recovered(w, a, b)
    if sigma > 0:
        return {k: r[k] for k in ("count", "sum", "avg")} | {"variance": (F.var_pop(w) - F.lit(sigma**2)) / F.lit(a * a)}
    return r


_PRIME = (1 << 521) - 1


def split(secret: bytes, shares: int, needed: int, seed: bytes | None = None) -> list[tuple[int, int]]:
    """Shamir's shares of a secret of up to 56 bytes, any `needed` of which give it back. Without a
    seed the polynomial is drawn from the system's randomness."""
    import secrets

    if not 0 < needed <= shares or len(secret) > 56:
        raise ValueError("0 < needed <= shares, and at most 56 bytes")

    def draw(i: int) -> int:
        return secrets.randbelow(_PRIME) if seed is None else int.from_bytes(hashlib.shake_256(seed + bytes([i])).digest(65), "big") % _PRIME

    c = [int.from_bytes(b"\1" + secret + hashlib.sha256(secret).digest()[:7], "big"), *[draw(i) for i in range(1, needed)]]
    return [(x, sum(k * pow(x, i, _PRIME) for i, k in enumerate(c)) % _PRIME) for x in range(1, shares + 1)]


def joined(shares: list[tuple[int, int]]) -> bytes:
    """The secret of enough shares."""
    total = 0
    for x, y in shares:
        num = den = 1
        for other, _ in shares:
            if other != x:
                num, den = num * -other % _PRIME, den * (x - other) % _PRIME
        total += y * num * pow(den, -1, _PRIME)
    whole = (total % _PRIME).to_bytes(66, "big").lstrip(b"\0")
    secret = whole[1:-7]
    if whole[:1] != b"\1" or hashlib.sha256(secret).digest()[:7] != whole[-7:]:
        raise ValueError("not enough shares, or wrong ones")
    return secret


def ratchet(key: bytes, label: bytes = b"") -> tuple[bytes, bytes]:
    """(next chain key, message key): neither leads back to the key."""
    return hmac.new(key, b"\1" + label, hashlib.sha256).digest(), hmac.new(key, b"\2" + label, hashlib.sha256).digest()
