"""Near-duplicate groups against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import _common, minhash, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    words = WORD.findall((text or "").encode().lower())
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(docs, k, percent=80):
    """{id: (n, component)} for {id: text}."""
    sets = {i: shingle_set(t, k) for i, t in docs.items()}
    comp = {i: i for i in docs}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in docs}


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in df.collect()}, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert got == want


def test_chains_copies_and_edges(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    docs = {}
    for g in range(3):  # chains: neighbours are alike, ends are not; and a group of near copies
        words = base[:]
        for i in range(12):
            docs[g * 100 + i] = " ".join(words)
            for _ in range(6):
                words[rng.randrange(300)] = f"g{g}x{rng.randrange(10**6)}"
    for i in range(40):
        words = [f"p{j}" for j in range(200)]
        words[rng.randrange(200)] = f"own{i}"
        docs[1000 + i] = " ".join(words)
    docs |= {2000: None, 2001: "", 2002: " \n ", 2003: "one two", 2004: "One  TWO", 2005: "two one", 2006: "É a b c d", 2007: "é a b c d", 2008: "word " * 40_000, 2009: "word " * 30_000}
    rows = [(i, t, "x") for i, t in docs.items()] + [(1000, docs[1000], "y"), (None, "one two", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    monkeypatch.setattr(minhash, "CHUNK", 5)
    for hot in (2, 20_000):  # with and without hot keys
        monkeypatch.setattr(minhash, "HOT_PAIRS", hot)
        monkeypatch.setattr(_common, "HOT_ROWS", hot)
        for k in (4, 5):
            got = minhash.near_duplicates(df.select("doc_id", "text", df.n.alias("component_id")), shingle=k).collect()
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, k) and len(got) == len(docs)
            assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = minhash.without_near_duplicates(df, shingle=5)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = brute(docs, 5)
    assert sorted(ids, key=lambda i: (i is None, i)) == sorted(i for i in docs if want[i][1] == i) + [None]
    row = [tuple(r) for r in kept.where("doc_id = 1000").collect()]
    assert row == [(1000, docs[1000], "x")]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.without_near_duplicates(df.limit(0)).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * 2 * share / (1 + share))
        other = np.sort(np.concatenate((base[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64))))
        low = minhash.minima([np.sort(base), other])
        same = ((low[:, 0] ^ low[:, 1]) & 15 == 0).mean()
        assert abs((same - 1 / 16) / (15 / 16) - share) < 0.15
    assert minhash.least_matches(80) < 128 * (0.8 + 0.2 / 16)


def test_sets_equal_plain_ones():
    texts = [b"A b c d e", b"a B  c\td\ne", b"", None, b"x", b"a b c d e a b c d e"]
    sets = shingles.shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1, 5]
    assert (sets[0] == sets[1]).all()


def test_words_that_collide_by_form():
    rng = random.Random(5)
    for n in (64, 1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        a, b = ("".join(x[i] for i in bits) for x in ("ab", "ba"))
        assert len(shingles.shingle_sets([f"{a} {b} {a}".encode()], 1)[0]) == 2
    words = {bytes(rng.choices(range(1, 9), k=rng.randrange(1, 80))) for _ in range(20_000)}
    words |= {w + b"\0" for w in list(words)[:2000]} | {b"\0" * i for i in range(1, 70)}
    assert len(shingles.shingle_sets([b" ".join(words)], 1)[0]) == len(words)


def variants(rng, texts, edits):
    """Texts of 300 words whose words are replaced by own ones at so many places."""
    base = [f"v{i}" for i in range(300)]
    out = []
    for _ in range(texts):
        words = base[:]
        for at in rng.sample(range(300), rng.choice(edits)):
            words[at] = f"own{rng.randrange(40)}"
        out.append(" ".join(words))
    return out


def test_many_variants_of_one_text_list_no_pairs(spark, monkeypatch):
    # Unlike each other, but more alike than the estimate can refuse: all pairs were listed and confirmed one by one.
    docs = dict(enumerate(variants(random.Random(8), 400, (8, 9, 10, 11, 12))))
    rows, stored = {}, minhash.stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert got == brute(docs, 4)
    assert len({c for _, c in got.values()}) > 100
    assert rows["cross"] <= 4 * len(docs)


def test_variants_in_many_chunks_and_blocks(spark, monkeypatch):
    rng = random.Random(9)
    docs = dict(enumerate(variants(rng, 120, (0, 3, 5, 7, 8, 9, 10, 12)) + [" ".join(rng.choices(["a", "b", "c", "d"], k=rng.randrange(3, 60))) for _ in range(60)]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute(docs, 4)
    for chunk, small, shingles_of, rows_of, columns, counted in ((4096, 32, 400_000, 1_000, 1_024, 4_000_000), (7, 3, 900, 2, 50, 10), (40, 2, 3_000, 1_000, 7, 100)):
        for name, value in (("CHUNK", chunk), ("SMALL", small), ("BLOCK_SHINGLES", shingles_of), ("BLOCK_ROWS", rows_of), ("COLUMNS", columns), ("COUNTED", counted)):
            monkeypatch.setattr(minhash, name, value)
        got = minhash.near_duplicates(df, shingle=4).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_intersections_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(2)
    for cheaper in (0, 3, 50, 10**6):
        monkeypatch.setattr(minhash, "CHEAPER", cheaper)
        for columns, counted in ((5, 7), (1_024, 4_000_000)):
            monkeypatch.setattr(minhash, "COLUMNS", columns)
            monkeypatch.setattr(minhash, "COUNTED", counted)
            left, right = ([np.unique(rng.integers(0, 60, rng.integers(0, 30), dtype=np.uint64) ** np.uint64(7)) for _ in range(n)] for n in (9, 13))
            want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
            assert minhash.intersections(left, right).tolist() == want


def test_whole_groups_across_batches():
    rng = random.Random(6)
    keys = sorted((rng.randrange(4), rng.randrange(3)) for _ in range(60))
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_pylist([{"x": x, "y": y} for x, y in keys[i : i + size]]) for i in range(0, 60, size)]
        tables = [[(r["x"], r["y"]) for r in t.to_pylist()] for t in minhash.whole_groups([batches[0].slice(0, 0), *batches], 2)]
        assert [k for t in tables for k in t] == keys
        assert all(not set(a) & set(b) for i, a in enumerate(tables) for b in tables[i + 1 :])
