"""Packing is an exact round trip of the tokenizer's ids."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import tokenizer_path


def whole(texts):
    tok = Tokenizer.from_file(tokenizer_path())
    return [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check(rows, texts):
    """rows with ids; texts by doc_id."""
    want = dict(zip(texts, whole(texts.values())))
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        docs[r["doc_id"]].append((r["start"], r["doc_tokens"], ids))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert docs.keys() == want.keys()
    for d, parts in docs.items():
        parts.sort(key=lambda p: p[0])
        assert np.concatenate([p[2] for p in parts]).tolist() == want[d]
        assert all(p[1] == len(want[d]) for p in parts)
        assert [p[0] for p in parts] == np.cumsum([0] + [len(p[2]) for p in parts])[:-1].tolist()
    for parts in seqs.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist()
        n = sum(p[1] for p in parts)
        assert n <= 4096 and n & (n - 1) == 0


def test_round_trip(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for n in (1, 5):
        check(packing.pack(df.repartition(n), tokenizer_path(), with_ids=True).collect(), texts)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "Don't  stop now\u0085é́\tÀ\x0bb\x1cc <|endoftext|>x", 4: "word " * 30_000, 5: "ΣΑΣ ΑΣ.", 6: "x" * 20_000}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, length int").coalesce(1)
    check(packing.pack(df, tokenizer_path(), with_ids=True).collect(), texts)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(twice, tokenizer_path()).collect()
    assert sum(r["length"] for r in rows) == 8 and {r["doc_id"] for r in rows} == {1, None}
    assert packing.pack(twice.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, tokenizer_path(), length=1000)


def test_every_plain_code_point_in_a_word():
    signs = [chr(i) for i in range(0x260)]
    texts = ["Əli", "naƐ.", *[t for c in signs for t in (c, f"{c}li", f"na{c}.", f"Na{c}li", f"{c}{c}", f"7{c}'s")]]
    words = packing.Words(tokenizer_path(), 2)
    assert words.chunked
    got = [x.tolist() for x in words.ids([t.encode() for t in texts])]
    assert [t for t, a, b in zip(texts, got, whole(texts)) if a != b] == []


def test_costs_are_balanced():
    lengths = [900] * 40 + [100] * 46 + [5]
    total = sum(lengths)
    bins = [4096] * (total // 4096) + [1 << b for b in reversed(range(12)) if total % 4096 >> b & 1]
    cost = defaultdict(float)
    room = defaultdict(int)
    for _, _, n, s in packing.assign(lengths, bins, 1.0, 1 / 2048):
        cost[s] += n + n * n / 2048
        room[s] += n
    assert [room[i] for i in range(len(bins))] == bins
    full = [cost[i] for i in range(total // 4096)]
    assert max(full) < 1.2 * min(full)


def thue_morse(n):
    """Two different words that any polynomial hash modulo a power of two takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_by_form():
    a, b = thue_morse(2048)
    words = packing.Words(tokenizer_path(), 2)
    texts = [f"{a} x {b}", f"{b} {a}", a, b]
    assert [w.tolist() for w in words.ids([t.encode() for t in texts])] == whole(texts)


def test_colliding_halves_go_through_the_tokenizer(monkeypatch):
    runs = packing.runs
    monkeypatch.setattr(packing, "runs", lambda *a: (lambda s, e, v, o: (s, e, v % np.uint64(7), o))(*runs(*a)))
    words, texts = packing.Words(tokenizer_path(), 2), [f"some words of a text {i}" for i in range(30)]
    assert [w.tolist() for t in texts for w in words.ids([t.encode()])] == whole(texts)


def test_frequent_chunks_stay_when_too_many_are_known(monkeypatch):
    monkeypatch.setattr(packing, "MOST_CHUNKS", 400)
    words, plain, learned = packing.Words(tokenizer_path(), 2), packing.Words(tokenizer_path(), 2), []
    chunk_ids = words.chunk_ids
    monkeypatch.setattr(words, "chunk_ids", lambda chunks: learned.extend(chunks) or chunk_ids(chunks))
    for block in range(40):
        text = " ".join(f"often{i} once{block}x{i}" for i in range(30)).encode()
        assert np.array_equal(next(words.ids([text])), next(plain.plain_ids([text])))
        assert len(words.size) <= 400 + 60
    assert len(learned) == 40 * 30 + 30  # once each; before, the frequent ones were learned again and again
