"""The pipeline's stages against brute-force versions, each on what its predecessor kept, and on rows
at the edges."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import pii, toxicity
from tessera.llm._common import stored
from tessera.llm.queries import MIX_DEFAULT, MIX_SEED, MIX_WEIGHTS

from .test_minhash import brute
from .test_packing import whole
from .test_pii import brute as base_spans
from .test_toxicity import plain_logit


def copies(rows):
    """{doc_id: copies of each of its rows} by the Poisson distribution's terms."""
    n = Counter(r["source"] for r in rows)
    weight = {s: MIX_WEIGHTS.get(s, MIX_DEFAULT) for s in n}
    out = {}
    for r in rows:
        rate = weight[r["source"]] / sum(weight.values()) * len(rows) / n[r["source"]]
        parts = max(1, math.ceil(rate / 32))
        total = 0
        for part in range(1, parts + 1):
            name = "null" if r["doc_id"] is None else r["doc_id"]
            u = int(hashlib.md5(f"{MIX_SEED}|{name}|{part}".encode()).hexdigest()[:13], 16) / 2**52
            k, p, c = 0, math.exp(-rate / parts), math.exp(-rate / parts)
            while c <= u:
                k += 1
                p *= rate / parts / k
                c += p
            total += k
        out[r["doc_id"]] = total
    return out


def check_pieces(pieces, docs):
    """Every copy of every row of docs lies in the pieces, each id once; sequences are gapless."""
    texts = defaultdict(list)
    for r in docs:
        texts[r["doc_id"]].append(r["text"])
    unnamed = texts.pop(None, [])  # documents of their own, with other texts
    assert sum(p["length"] for p in pieces if p["doc_id"] is None) == sum(map(len, whole(unnamed)))
    ids = dict(zip(texts, whole([t[0] for t in texts.values()])))
    covered, seqs = {d: np.zeros(len(x), int) for d, x in ids.items()}, defaultdict(list)
    for p in pieces:
        a, n = p["start"], p["length"]
        seqs[p["sequence_id"]].append((p["offset"], n))
        if p["doc_id"] is None:
            continue
        assert np.frombuffer(p["ids"], "<u4").tolist() == ids[p["doc_id"]][a : a + n] and p["doc_tokens"] == len(ids[p["doc_id"]])
        covered[p["doc_id"]][a : a + n] += 1
    assert all((covered[d] == len(t)).all() for d, t in texts.items())
    for parts in seqs.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        n = sum(n for _, n in parts)
        assert n <= 4096 and n & (n - 1) == 0


def verify(name, before, rows, spark, sf, docs):
    """rows, the stage's result on the rows `before`, against a plain version of the stage."""
    if name == "toxicity":
        model, known = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")), {}
        want = Counter(tuple(r) for r in before if plain_logit(model, r["text"], known) < 0)
        assert Counter(map(tuple, rows)) == want and len(rows) > 0.8 * len(before)
    elif name == "near_dedup":
        least = {}
        for r in sorted((r for r in before if r["doc_id"] is not None), key=lambda r: (r["text"] is not None, r["text"] or "")):
            least.setdefault(r["doc_id"], r["text"])
        found = brute({r["doc_id"]: r["text"] for r in before if r["doc_id"] is not None}, 5)
        assert {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None} == {(d, least[d]) for d, (_, c) in found.items() if c == d}
        assert len(rows) == sum(d == c for d, (_, c) in found.items()) + sum(r["doc_id"] is None for r in before)
    elif name == "pii":
        told = lambda r: (str(r["doc_id"]), str(r["source"]), str(r["lang"]))
        assert sorted(map(told, rows)) == sorted(map(told, before))
        texts = defaultdict(set)
        for r in before:
            texts[r["doc_id"]].add(r["text"])
        for r in rows:
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
            assert r["text"] in {pii.masked(t) for t in texts[r["doc_id"]]}
            # Nothing is left that plain expressions find, and what they found in is gone.
            assert not base_spans(r["text"] or "")
            for t in texts[r["doc_id"]]:
                for kind, a, b in base_spans(t or ""):
                    assert kind != "email" or t[a:b] not in (r["text"] or "")
    elif name == "mixing":
        want = Counter()
        for d, n in copies(before).items():
            for r in before:
                if r["doc_id"] == d:
                    want[tuple(r)] += n
        assert Counter(map(tuple, rows)) == +want
    else:
        check_pieces(rows, before)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns
        out = stored(out, "t")
        verify(name, before, out.collect(), spark, sf, docs)
        docs = out
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == docs.columns
    sums = ["sum(length)", "count(distinct doc_id)", "sum(doc_tokens)"]
    assert got.selectExpr(*sums[:2]).first() == docs.selectExpr(*sums[:2]).first()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edges_of_each_stage(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    same = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None, None, "src0", None), (2, "", "en", None, 0), (3, "word " * 40_000 + "me@a.example", "en", "src0", 200_012), (4, same, "en", "src1", len(same)), (5, same, "de", "src2", len(same)),
        (4, same, "en", "src1", len(same)), (None, "a b c +1 (242) 555-3475", "en", "src1", 23), (None, None, None, None, None), (6, "tie one two", "en", "src3", 11), (7, "tie  ONE two", "en", "src3", 12),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["score", "copy", "start", "ids", "pii", "component_id", "kept", "rate", "rep"]
    wide = df.select("*", *[df.lang.alias(c) for c in extra])
    for docs in (df, wide):
        got = stage(spark, docs, sf)
        if name != "packing":
            assert got.columns == docs.columns
        verify(name, df.collect(), stored(got if name == "packing" else got.select(*df.columns), "e").collect(), spark, sf, df)
    assert stage(spark, wide.limit(0), sf).count() == 0
