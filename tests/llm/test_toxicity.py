"""Held-out accuracy of the classifier, unseen misspellings, and edges."""

import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import queries, toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op2(spark, d).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    mark = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(mark[r["doc_id"]], r["predicted"], r["score"]) for r in got if r["held_out"] and r["doc_id"] in mark]
    assert np.mean([a == b for a, b, _ in held]) > 0.95
    good = np.array([s for m, _, s in held if m == 0])
    assert np.mean([(s > good).mean() for m, _, s in held if m]) > 0.94
    # An eighth of the documents marked toxic hold no word whose beginning is several times commoner
    # in toxic training documents than in others; the bound of 0.96 is for the rest.
    begins = lambda t: {w[:n] for w in re.findall(r"\w+", t.lower()) for n in (6, 7, 8) if len(w) >= n}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {m: Counter(w for i, t in mark.items() if t == m and i in texts and zlib.crc32(str(i).encode()) % 5 for w in begins(texts[i])) for m in (0, 1)}
    signs = {w for w, n in seen[1].items() if n >= 4 and n > 4 * seen[0][w]}
    toxic = [(r["score"], bool(begins(texts[r["doc_id"]]) & signs)) for r in got if r["held_out"] and mark.get(r["doc_id"]) == 1]
    told = [s for s, sign in toxic if sign]
    assert len(told) > 0.85 * len(toxic) and np.mean([(s > good).mean() for s in told]) > 0.96


def row(gram):
    h = (ord(gram[0]) * 0x9E3779B1) & 0xFFFFFFFF
    for c in gram[1:]:
        h = (h * 0x01000193 + ord(c) * 0x85EBCA6B) & 0xFFFFFFFF
    return (((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - toxicity.ROW_BITS)


def plain_logit(model, text, known):
    """The logit by one n-gram after another; known: sums of words seen before."""
    total = size = 0.0
    for word, n in Counter((text or "").lower().split()).items():
        if word not in known:
            said = f" {word} "
            grams = [said[i : i + k] for k in toxicity.NGRAMS for i in range(len(said) - k + 1)]
            known[word] = sum(float(model.row[row(g)]) for g in grams), len(grams)
        total += n**0.5 * known[word][0]
        size += n**0.5 * known[word][1]
    return total / (toxicity.DAMP + size) + model.bias


def test_scores_equal_plain_ngrams():
    rng = np.random.default_rng(6)
    model = toxicity.Subwords(rng.normal(0, 5, 1 << toxicity.ROW_BITS).astype(np.float32), 0.3)
    texts = ["", None, "a", "ab", "One two  two three", "réeux\tÀb ßx", "x" * 50, "a b c d e f g " * 40, *(" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(30)) for _ in range(40))]
    known = {}
    assert np.allclose(model.logits(texts), [plain_logit(model, t, known) for t in texts], atol=1e-3)


def test_misspellings_share_ngrams():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(200)]
    clean = [" ".join(rng.choice(words, 30)) for _ in range(150)]
    toxic = [" ".join([*rng.choice(words, 28), "worthless", "worthless"]) for _ in range(150)]
    model = toxicity.fit_subwords(clean + toxic, [0] * 150 + [1] * 150)
    a, b, c = model.scores([" ".join(words[:28]), " ".join([*words[:28], "worthlesss", "w0rthless"]), ""])
    assert a < 0.5 < b and 0 <= c <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ab " * 60_000, "x"), (None, "c", "x"), (3, "d", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (9, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == docs.columns and out.count() == 5 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).count() == 0
    one = toxicity.fit_subwords(["a"], [1])
    assert one.scores(["a"])[0] > 0.9


def test_training_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit_subwords", lambda texts, marks, prior: (texts, marks, prior))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:20]
    docs = spark.createDataFrame([(i, f"b{i:02d}") for i in ids] + [(ids[0], "a"), (ids[1], None), (1000, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)] + [(1000, 1)][:20], "doc_id long, toxic int")
    texts, marks, prior = toxicity.fit(docs, labels)
    assert texts == ["a", "", *(f"b{i:02d}" for i in ids[2:])] and marks == [n % 2 for n in range(20)]
    assert len(toxicity.fit(docs, labels, most_chars=30)[0]) in range(10, 13)
    assert sorted(toxicity.fit(docs, labels, most_per_class=3)[1]) == [0, 0, 0, 1, 1, 1]
