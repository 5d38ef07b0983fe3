"""Fingerprints of invented recordings, and their alignment against a loop."""

import io
import wave
from collections import Counter

import numpy as np

from tessera.llm import _common, chroma


def recordings(n=48):
    rng = np.random.default_rng(5)
    return {i: chroma.demo_recording({"id": i, "vector": rng.normal(0, 0.1, 64).tolist()}) for i in range(n)}


def brute(prints, every, least_votes=3, most_errors=0.25, least_overlap=12):
    out = set()
    for q in (i for i in prints if i % every == 0):
        for r in prints:
            if r == q:
                continue
            votes = Counter(b - a for a, x in enumerate(prints[q]) for b, y in enumerate(prints[r]) if x is not None and x == y)
            if not votes:
                continue
            shift, n = min(votes.items(), key=lambda v: (-v[1], v[0]))
            both = [(x, prints[r][a + shift]) for a, x in enumerate(prints[q]) if 0 <= a + shift < len(prints[r])]
            both = [(x, y) for x, y in both if x is not None and y is not None]
            errors = sum(bin((x ^ y) & 0xFFFFFFFF).count("1") for x, y in both)
            if n >= least_votes and len(both) >= least_overlap and errors / (32 * len(both)) <= most_errors:
                out.add((q, r, shift, n, len(both), errors))
    return out


def test_alignment(spark, monkeypatch):
    prints = {i: chroma.fingerprint(*r) for i, r in recordings().items()}
    prints[48] = prints[0][:3] + [None] * 40
    df = spark.createDataFrame([(i, c) for i, c in prints.items()] + [(None, [1]), (60, []), (80, None)], "id long, codes array<int>")
    for hot in (20_000, 2):
        monkeypatch.setattr(_common, "HOT_ROWS", hot)
        monkeypatch.setattr(chroma, "HOT_PAIRS", hot)
        monkeypatch.setattr(chroma, "MOST_OFFSETS", hot)
        got = {tuple(r)[:6] for r in chroma.aligned(df, every=20).collect()}
        assert got == brute(prints, 20)
    # The other seven players of each query's melody are found, at three frames for each id.
    for q in (0, 20, 40):
        found = {r: s for a, r, s, *_ in got if a == q}
        assert {r for r in range(q // 8 * 8, q // 8 * 8 + 8)} - {q} <= set(found) | {48}
        assert all(s == 3 * (q - r) for r, s in found.items() if r // 8 == q // 8)
    assert chroma.aligned(df.limit(0)).count() == 0


def test_media_column(spark):
    rate, x = recordings(1)[0]
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    rows = [(1, held.getvalue(), 0), (2, None, 0), (3, b"junk", 0), (4, held.getvalue()[:200], 0), (1, held.getvalue(), 0)]
    df = spark.createDataFrame(rows, "id long, media binary, codes int")
    got = [(r["id"], len(r["codes"])) for r in chroma.fingerprints(df, "id", "media").collect()]
    n = len(chroma.fingerprint(rate, x))
    assert sorted(got) == [(1, n), (1, n), (2, 0), (3, 0), (4, 0)] and n > 40


def test_silence_has_no_code():
    assert set(chroma.fingerprint(4000, np.zeros(40_000))) == {None}
    assert chroma.fingerprint(4000, np.zeros(10)) == []


def test_repeated_ids_are_recordings(spark):
    code = chroma.fingerprint(*recordings(1)[0])
    df = spark.createDataFrame([(20, code), (20, code), (3, code)], "id long, codes array<int>")
    got = sorted((r["query_id"], r["match_id"], r["shift"]) for r in chroma.aligned(df).collect())
    assert got == [(20, 3, 0), (20, 3, 0), (20, 20, 0), (20, 20, 0)]


def test_steady_tones_are_linear(spark):
    n = 30_000
    df = spark.createDataFrame([(0, [5, 7] * n), (1, [7, 5] * n), (2, [5] * n)], "id long, codes array<int>")
    got = {r["match_id"]: tuple(r)[2:6] for r in chroma.aligned(df, most_errors=1.0).collect()}
    assert got == {1: (-1, 2 * n - 1, 2 * n - 1, 0), 2: (-n, n // 2, n, n // 2)}


def test_offsets_equal_a_loop(monkeypatch):
    rng = np.random.default_rng(2)
    for most in (1, 5, 1 << 20):
        monkeypatch.setattr(chroma, "MOST_OFFSETS", most)
        for _ in range(60):
            x, y = (rng.integers(0, 4, rng.integers(1, 30)) for _ in range(2))
            votes = Counter(j - i for i, a in enumerate(x) for j, b in enumerate(y) if a == b)
            if votes:
                shift, n = min(votes.items(), key=lambda v: (-v[1], v[0]))
                rows = [np.array([tuple(map(int, e)) for e in enumerate(v)], [("p", np.int64), ("code", np.int32)]) for v in (x, y)]
                assert chroma.offset_votes(*rows) == (n, shift)


def test_rates_and_widths_give_one_fingerprint():
    def song(rate):
        t = np.arange(20 * rate) / rate
        notes = np.random.default_rng(3).integers(0, 24, 80)
        return 0.4 * np.sin(2 * np.pi * 220 * 2.0 ** (notes[np.minimum((t * 4).astype(int), 79)] / 12) * t)

    def held(rate, width, channels=1):
        x = np.repeat(song(rate)[:, None], channels, 1)
        b = io.BytesIO()
        with wave.open(b, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
            if width == 1:
                w.writeframes((x * 127 + 128).astype("u1").tobytes())
            else:
                whole = (x * (2**31 - 1)).astype("<i4")
                w.writeframes(whole.view(np.uint8).reshape(-1, 4)[:, 4 - width :].tobytes())
        return chroma.fingerprint(*chroma.wav(b.getvalue()))

    base = held(4000, 2)
    for rate, width, channels in ((8000, 2, 1), (44_100, 2, 2), (11_025, 3, 1), (4000, 1, 1), (4000, 4, 2), (22_050, 1, 2)):
        other = held(rate, width, channels)
        both = list(zip(base, other))
        assert abs(len(base) - len(other)) <= 1
        errors = sum(bin((a ^ b) & 0xFFFFFFFF).count("1") for a, b in both)
        assert errors < 0.05 * 32 * len(both), (rate, width, errors / 32 / len(both))
        assert sum(a == b for a, b in both) > 0.5 * len(both)


def test_blocks_change_nothing(monkeypatch):
    rate, x = recordings(1)[0]
    whole = chroma.fingerprint(rate, x)
    monkeypatch.setattr(chroma, "BLOCK", 5000)
    assert chroma.fingerprint(rate, x) == whole


def test_filters_equal_plain_sums(monkeypatch):
    rng = np.random.default_rng(9)
    image = rng.random((24, 12))
    monkeypatch.setattr(chroma, "chroma", lambda *a: image)
    got = chroma.fingerprint(4000, np.zeros(1))
    want = []
    for t in range(len(image) - 15):
        bits = 0
        for shape, c, h, w in chroma.FILTERS:
            part = image[t : t + w, c : min(12, c + h)]
            n = part.shape[1]
            up, left = part[:, n // 2 :].sum() - 0, part[: w // 2].sum()
            k, m = max(1, n // 3), max(1, w // 3)
            a, b = {
                0: (part.sum(), 0.0), 1: (up, part[:, : n // 2].sum()), 2: (part[w // 2 :].sum(), left),
                3: (part[: w // 2, n // 2 :].sum() + part[w // 2 :, : n // 2].sum(), part[: w // 2, : n // 2].sum() + part[w // 2 :, n // 2 :].sum()),
                4: (part[:, k : n - k].sum(), part[:, :k].sum() + part[:, n - k :].sum()), 5: (part[m : w - m].sum(), part[:m].sum() + part[w - m :].sum()),
            }[shape]
            v = np.log((1 + a) / (1 + b)) - (np.log1p(0.25 * w) if shape == 0 else 0)
            level = sum(v > x for x in chroma._LEVELS)
            bits = bits << 2 | (level ^ level >> 1)
        want.append(bits - (1 << 32) if bits >> 31 else bits)
    assert got == want
