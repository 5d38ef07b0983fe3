"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its character 3- to 6-grams inside words (a word's blanks belong to it), each
hashed to a row of an embedding table; a word that occurs c times weighs sqrt(c), so that a line
repeated a thousand times does not drown the rest. The weighted mean of the rows goes through a linear layer and a
softmax. Table and layer are trained together, so a misspelling that was never seen still shares
most of its n-grams, and their vectors, with the words that were. Because the layer is linear, a
fitted model scores with one number for each row of the table: the scan of the corpus is a hash, a
gather and a sum for each character."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import blocks, narrowed, small_batches, stored, trim

NGRAMS = (3, 4, 5, 6)
ROW_BITS = 20
#: Blank n-grams added to each bag, so that the mean of a short text is not that of few n-grams.
DAMP = 60
#: Code points whose n-grams are in memory at a time.
CHARS = 500_000
_BLANK = np.zeros(0x10000, bool)
_BLANK[[i for i in range(0x10000) if chr(i).isspace()]] = True


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each text's distinct lower-cased words, a blank before each; each text's
    start; and for each code point the root of how often its word occurs in the text."""
    parts, starts, weights, sizes, at = [], [1], [], [], 1
    for t in texts:
        found = Counter((t or "").lower().split())
        said = " ".join(found)
        parts.append(said)
        at += len(said) + 2
        starts.append(at)
        weights.append(np.sqrt(np.fromiter(found.values(), np.float32, len(found))))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    data = ("  " + "  ".join(parts) + "  ").encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, np.uint32)
    weight = np.zeros(len(codes), np.float32)
    for s, w, n in zip(starts, weights, sizes):
        if len(w):
            weight[s : s + int(n.sum())] = np.repeat(w, n)
    return codes, np.array(starts), weight


def ngrams(texts: list[str | None]):
    """For each n: (rows, weights) of the n-grams that begin at each code point; and text starts.

    An n-gram weighs what its word does, and nothing if a blank lies inside it; it may begin or end
    with one."""
    c, starts, weight = _codes(texts)
    blank = _BLANK[np.minimum(c, 0xFFFF)]
    before = np.concatenate(([0], np.cumsum(blank)))
    h, found = c * np.uint32(0x9E3779B1), []
    size = len(c)
    for n in range(2, max(NGRAMS) + 1):
        m = size - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x85EBCA6B)
        if n in NGRAMS:
            row = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - ROW_BITS)
            valid = before[n - 1 : n - 1 + m] == before[1 : m + 1]
            found.append((row, weight[:m] * valid))
    return found, starts


def _bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct rows and their shares of the bag, for each text."""
    for a, b in blocks(texts, CHARS):
        found, starts = ngrams(texts[a:b])
        for i in range(b - a):
            s, e = starts[i], starts[i + 1]
            rows = np.concatenate([r[s:e] for r, _ in found]) if found else np.zeros(0, np.uint32)
            w = np.concatenate([x[s:e] for _, x in found]) if found else np.zeros(0, np.float32)
            rows, back = np.unique(rows[w > 0], return_inverse=True)
            n = np.bincount(back, w[w > 0], len(rows))
            yield rows.astype(np.int32), (n / (DAMP + n.sum())).astype(np.float32)


@dataclass
class Subwords:
    """A fitted model: `row` holds each table row's part of the logit, `bias` the rest."""

    row: np.ndarray
    bias: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in blocks(texts, CHARS):
            found, starts = ngrams(texts[a:b])
            total, n = np.zeros(b - a), np.zeros(b - a)
            for row, weight in found:
                at = np.minimum(starts, len(row))
                value = np.concatenate(([0.0], np.cumsum(weight * self.row[row], dtype=np.float64)))
                count = np.concatenate(([0.0], np.cumsum(weight, dtype=np.float64)))
                total += value[at[1:]] - value[at[:-1]]
                n += count[at[1:]] - count[at[:-1]]
            out[a:b] = total / (DAMP + n) + self.bias
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -50, 50)))


def fit_subwords(texts: list, marks: list[int], prior: float | None = None, dims: int = 8, epochs: int = 6, updates: int = 1000, rate: float = 1.5, batch: int = 32, least: int = 3, seed: int = 7) -> Subwords:
    """Trains table and layer with Adagrad, `epochs` times over all texts, more often where these
    are too few for `updates` steps; `least`: texts an n-gram must occur in to be trained.

    prior: the share of marks 1 where texts were drawn from, if the sample's share differs; it
    moves the bias. With no texts or one class only, scores are the prior (0 without texts)."""
    y = np.asarray(marks, int)
    share = float(y.mean()) if len(y) else 0.0
    prior = share if prior is None else prior
    if not len(y) or share in (0.0, 1.0):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Subwords(np.zeros(1 << ROW_BITS, np.float32), float(np.log(p / (1 - p))))
    seen = np.zeros(1 << ROW_BITS, np.int32)
    for rows, _ in _bags(texts):
        seen[rows] += 1
    known = seen >= least
    slot = (np.cumsum(known) - 1).astype(np.int32)
    bags = []
    for rows, part in _bags(texts):
        ok = known[rows]
        bags.append((slot[rows[ok]], part[ok]))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (int(known.sum()), dims)).astype(np.float32)
    layer = rng.normal(0, 0.5, (dims, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # A row's squared gradients start at a floor, so that rows of few texts move little.
    power, power_layer, power_bias = np.full(table.shape, 1e-7, np.float32), np.full(layer.shape, 1e-4, np.float32), np.full(2, 1e-2, np.float32)
    for _ in range(max(epochs, -(-updates * batch // len(bags)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            some = some[[len(bags[i][0]) > 0 for i in some]]
            if not len(some):
                continue
            rows = np.concatenate([bags[i][0] for i in some])
            part = np.concatenate([bags[i][1] for i in some])
            sizes = np.array([len(bags[i][0]) for i in some])
            offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            hidden = np.add.reduceat(table[rows] * part[:, None], offset)
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            g_layer, g_hidden = hidden.T @ g, g @ layer.T
            sort = np.argsort(rows, kind="stable")
            to, first = np.unique(rows[sort], return_index=True)
            text_of = np.repeat(np.arange(len(some)), sizes)[sort]
            g_rows = np.add.reduceat(g_hidden[text_of] * part[sort][:, None], first)
            power[to] += g_rows**2
            table[to] -= rate * g_rows / np.sqrt(power[to])
            power_layer += g_layer**2
            layer -= rate * 0.1 * g_layer / np.sqrt(power_layer)
            g_bias = g.sum(0)
            power_bias += g_bias**2
            bias -= rate * 0.1 * g_bias / np.sqrt(power_bias)
    weight = np.zeros(1 << ROW_BITS, np.float32)
    weight[known] = table @ (layer[:, 1] - layer[:, 0])
    p = min(max(prior, 1e-6), 1 - 1e-6)
    shift = np.log(p / (1 - p)) - np.log(share / (1 - share))
    return Subwords(weight, float(bias[1] - bias[0] + shift))


def held_out(id: str) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 0 on division by 5."""
    return F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "toxic", label_id: str = "doc_id", most_per_class: int = 2000, most_chars: int = 20_000_000) -> Subwords:
    """Fits on labelled rows that are not held out: at most `most_per_class` of each mark, the
    first by a hash of the id, and of these, in that order, whole texts of at most `most_chars` code
    points together (the bounds of the training sample; all rows if there are fewer).

    Repeated labels of an id count once, with their largest mark; a repeated id's text is its least
    one; null ids, marks other than 0 and 1 and labels without a document are passed over; null
    texts are empty ones."""
    own = narrowed(labels, doc_id=label_id, mark=mark).where("doc_id is not null and mark in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("mark").alias("mark")).where(~held_out("doc_id"))
    counts = {r["mark"]: r["count"] for r in own.groupBy("mark").count().collect()}
    picked = None
    for m in (0, 1):
        part = own.where(F.col("mark") == m).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class)
        picked = part if picked is None else picked.union(part)
    # At most 2 * most_per_class narrow rows: a proven bound for the broadcast.
    rows = narrowed(docs, doc_id=id, text=text).join(F.broadcast(picked), "doc_id")
    rows = stored(rows.groupBy("doc_id", "mark").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "training")
    total = F.sum(F.char_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    # At most 2 * most_per_class rows are ordered in one task, by id and length only.
    fits = rows.select("doc_id", total.alias("total")).where(F.col("total") <= most_chars).select("doc_id")
    rows = sorted(rows.join(F.broadcast(fits), "doc_id").collect(), key=lambda r: r["doc_id"])
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    model = fit_subwords([r["text"] for r in rows], [r["mark"] for r in rows], prior)
    del rows
    trim()
    return model


def score(df: DataFrame, model: Subwords, text: str = "text", out: str = "score") -> DataFrame:
    """df with the column `out`, the model's probability of mark 1 for the whole text (null and
    empty texts: that of an empty bag). Other columns pass through; one already named `out` is
    replaced. No shuffle; the model is one broadcast table of fixed size."""
    held = df.sparkSession.sparkContext.broadcast((model.row, model.bias))

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        found = pa.array(Subwords(*held.value).scores(texts.to_pylist()), pa.float64())
        trim()
        return found

    return small_batches(df).withColumn(out, run(F.col(f"`{text}`")))


def without_toxic(df: DataFrame, model: Subwords, text: str = "text", most: float = 0.5) -> DataFrame:
    """df without the rows that score `most` or more; the columns are those of df."""
    return score(df, model, text, "__toxicity").where(F.col("__toxicity") < most).drop("__toxicity")
