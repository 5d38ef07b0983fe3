"""Media columns: chroma audio fingerprints.

Samples become overlapping frames of equal duration at any sample rate, frames the energy of the
twelve pitch classes. Over the image of normalised frames, filters that compare sums of rectangles,
read from an integral image, give two bits each; sixteen of them pack into an integer for every
position. Silent positions have no integer.

Recordings that share integers are paired, each distinct integer of a recording once with its
number, so a tone held for an hour makes one row; a pair whose integers could not give enough votes
is let go. For the others the histogram of offsets between equal integers is counted whole, and at
the best offset the share of differing bits decides."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hot_keys, salted, salts, small_batches, stored

#: Frames and hops in samples at RATE, as far apart in time at other rates; frames of a position.
RATE, FRAME, HOP, WIDTH = 4000, 1024, 512, 16
#: Samples that are floats in memory at a time.
BLOCK = 1 << 21
#: (shape, lowest pitch class, classes, frames): 0 whole, 1 upper-lower halves, 2 left-right halves,
#: 3 quarters crosswise, 4 middle of three classes, 5 middle of three times.
FILTERS = (
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
)
_LEVELS = (-0.12, 0.0, 0.12)
#: Pairs of one recording that a task aligns.
HOT_PAIRS = 2_000
#: Pairs of positions with one integer that are subtracted at a time; beyond, they are correlated.
MOST_OFFSETS = 1 << 20


def wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples, (n x channels) integers of 8 (unsigned), 16, 24 (the upper part of 32) or
    32 bits, of WAV bytes."""
    with wave.open(io.BytesIO(data)) as w:
        held, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
        if width == 3:
            wide = np.zeros((len(held) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(held[: len(wide) * 3], np.uint8).reshape(-1, 3)
            x = wide.view("<i4").ravel()
        elif width in (1, 2, 4):
            x = np.frombuffer(held[: len(held) // width * width], {1: "u1", 2: "<i2", 4: "<i4"}[width])
        else:
            raise ValueError(f"samples of {width} bytes")
        return w.getframerate(), x[: len(x) // channels * channels].reshape(-1, channels)


def mono(samples: np.ndarray) -> np.ndarray:
    """Floats in [-1, 1] of samples, (n) or (n x channels): floats as they are, integers by their range."""
    x = samples.astype(np.float64)
    if samples.dtype.kind == "u":
        x -= 1 << 8 * samples.dtype.itemsize - 1
    if samples.dtype.kind in "ui":
        x /= 1 << 8 * samples.dtype.itemsize - 1
    return x if x.ndim == 1 else x.mean(1)


def _classes(rate: int, frame: int) -> np.ndarray:
    """(bins x 12) which pitch class each frequency of a frame belongs to, 50 Hz to 1800 Hz."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(f), 12))
    use = np.flatnonzero((f >= 50) & (f <= 1800))
    out[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


_shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def chroma(rate: int, samples: np.ndarray) -> np.ndarray:
    """(frames x 12) energies of the pitch classes, each frame of length 1 or, if silent, 0. Samples
    become floats a block at a time."""
    frame = max(2, round(FRAME * rate / RATE))
    if len(samples) < frame:
        return np.zeros((0, 12))
    if rate not in _shapes:
        if len(_shapes) > 16:
            _shapes.clear()
        # Amplitudes weigh alike whatever the rate.
        _shapes[rate] = np.hanning(frame) * (FRAME / frame), _classes(rate, frame)
    window, classes = _shapes[rate]
    n = int((len(samples) - frame) * RATE / (rate * HOP)) + 1
    starts = np.round(np.arange(n) * (HOP * rate / RATE)).astype(np.int64)
    starts = starts[starts + frame <= len(samples)]
    out = np.empty((len(starts), 12))
    step = max(1, BLOCK // frame)
    for a in range(0, len(starts), step):
        at = starts[a : a + step]
        x = mono(samples[at[0] : at[-1] + frame])
        frames = x[(at - at[0])[:, None] + np.arange(frame)]
        power = np.abs(np.fft.rfft(frames * window)) ** 2 @ classes
        size = np.sqrt((power**2).sum(1, keepdims=True))
        out[a : a + step] = np.where(size > 1e-6, power / np.maximum(size, 1e-6), 0.0)
    return out


def fingerprint(rate: int, samples: np.ndarray) -> list[int | None]:
    """The signed 32-bit integer of each position; None where all its frames are silent."""
    image = chroma(rate, samples)
    n = len(image) - WIDTH + 1
    if n < 1:
        return []
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def box(t0, t1, c0, c1):
        return whole[at + t1, c1] - whole[at + t0, c1] - whole[at + t1, c0] + whole[at + t0, c0]

    packed = np.zeros(n, np.uint32)
    for shape, c, h, w in FILTERS:
        c1 = min(12, c + h)
        if shape == 0:
            a, b = box(0, w, c, c1), 0.0
        elif shape == 1:
            m = (c + c1) // 2
            a, b = box(0, w, m, c1), box(0, w, c, m)
        elif shape == 2:
            a, b = box(w // 2, w, c, c1), box(0, w // 2, c, c1)
        elif shape == 3:
            m = (c + c1) // 2
            a = box(0, w // 2, m, c1) + box(w // 2, w, c, m)
            b = box(0, w // 2, c, m) + box(w // 2, w, m, c1)
        elif shape == 4:
            k = max(1, (c1 - c) // 3)
            a = box(0, w, c + k, c1 - k)
            b = box(0, w, c, c + k) + box(0, w, c1 - k, c1)
        else:
            k = max(1, w // 3)
            a = box(k, w - k, c, c1)
            b = box(0, k, c, c1) + box(w - k, w, c, c1)
        value = np.log((1 + a) / (1 + b)) - (np.log1p(0.25 * w) if shape == 0 else 0.0)
        level = np.searchsorted(_LEVELS, value)
        packed = packed << np.uint32(2) | (level ^ (level >> 1)).astype(np.uint32)
    loud = box(0, WIDTH, 0, 12) > 0
    return [int(v) if s else None for v, s in zip(packed.view(np.int32), loud)]


def fingerprints(df: DataFrame, id: str, media: str, decode: Callable = wav) -> DataFrame:
    """(id, codes): the fingerprint of each row's media, decoded by decode(value) -> (rate,
    samples). Null media, media that the decoder refuses (ValueError, EOFError, wave.Error) and
    media shorter than a fingerprint have no codes. One id's rows are recordings of their own."""
    own = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{media}`").alias("media"))

    def run(batches):
        for batch in batches:
            codes = []
            for value in batch.column(1).to_pylist():
                try:
                    codes.append(fingerprint(*decode(value)) if value is not None else [])
                except (ValueError, EOFError, wave.Error):
                    codes.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int32()))], ["id", "codes"])

    return small_batches(own).mapInArrow(run, "id long, codes array<int>")


def offset_votes(ours: np.ndarray, theirs: np.ndarray) -> tuple[int, int]:
    """(votes, shift): how many positions i and i + shift hold equal integers, at the shift that has
    most (ties to the smallest). ours, theirs: structured by positions `p` and integers `code`."""
    low = -int(ours["p"].max())
    counts = np.zeros(int(theirs["p"].max()) - low + 1, np.int64)
    a, b = (np.sort(x, order=["code", "p"], kind="stable") for x in (ours, theirs))
    codes = np.intersect1d(a["code"], b["code"])
    a_at, b_at = (np.searchsorted(x["code"], codes) for x in (a, b))
    a_n, b_n = (np.searchsorted(x["code"], codes, "right") - at for x, at in ((a, a_at), (b, b_at)))
    heavy = a_n * b_n > MOST_OFFSETS
    for c in np.flatnonzero(heavy).tolist():  # one integer at very many positions: correlate
        pa_, pb = a["p"][a_at[c] : a_at[c] + a_n[c]], b["p"][b_at[c] : b_at[c] + b_n[c]]
        size = 1 << int(pa_.max() + pb.max() + 1).bit_length()
        x, y = np.zeros(size), np.zeros(size)
        x[pa_], y[pb] = 1, 1
        found = np.rint(np.fft.irfft(np.conj(np.fft.rfft(x)) * np.fft.rfft(y), size)).astype(np.int64)
        shift = np.arange(-int(pa_.max()), int(pb.max()) + 1)
        counts[shift - low] += found[shift % size]
    light = np.flatnonzero(~heavy)
    sizes = (a_n * b_n)[light]
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(light):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + MOST_OFFSETS, "right")))
        some, n = light[begin:stop], sizes[begin:stop]
        of = np.repeat(np.arange(len(some)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = a_at[some][of] + inner // b_n[some][of], b_at[some][of] + inner % b_n[some][of]
        counts += np.bincount(b["p"][j] - a["p"][i] - low, minlength=len(counts))
        begin = stop
    at = int(counts.argmax())
    return int(counts[at]), at + low


MATCHES = "query_id long, match_id long, shift long, votes long, overlap long, bit_errors long"


def aligned(prints: DataFrame, every: int = 20, least_votes: int = 3, most_errors: float = 0.25, least_overlap: int = 12) -> DataFrame:
    """(query_id, match_id, shift, votes, overlap, bit_errors, error_rate) for each recording whose
    id is divisible by `every` against all others.

    prints: (id, codes); rows that repeat an id are recordings of their own, also to each other.
    shift: position in the match less position in the query that most equal integers share (ties to
    the smallest); overlap: positions compared there, None ones aside; error_rate: differing bits of
    theirs over 32 * overlap. Pairs with fewer votes, less overlap or more errors are no matches.
    Every equal integer votes: recordings of hot integers, and pairs of one query with very many
    recordings, are salted. Null ids and empty fingerprints match nothing."""
    prints = prints.where("id is not null and size(codes) > 0")
    prints = stored(prints.select(F.monotonically_increasing_id().alias("row"), "id", "codes"), "prints")
    held = prints.select("row", "id", F.explode("codes").alias("code")).where("code is not null").groupBy("row", "id", "code").agg(F.count("*").alias("n"))
    held = stored(held, "held")
    asked = held.where(F.col("id") % every == 0).select(F.col("row").alias("query"), F.col("n").alias("qn"), "code")
    hot = hot_keys(held.groupBy("code").agg(F.count("*").alias("rows")), ["code"])
    met = salts(held, hot, ["code"], ["row"]).join(salts(asked, hot, ["code"]), ["code", "salt"]).where("row <> query")
    # At one offset a position votes once.
    pairs = met.groupBy("query", "row").agg(F.sum(F.least("n", "qn")).alias("most")).where(F.col("most") >= least_votes)
    pairs = stored(pairs.select("query", "row"), "pairs")
    ours = prints.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("codes").alias("ours"))
    theirs = prints.select("row", F.col("id").alias("match_id"), F.col("codes").alias("theirs"))
    counts = pairs.groupBy("row").agg(F.count("*").alias("rows"))
    both = salted(salted(pairs, ours, "query", ["row"], hot_rows=HOT_PAIRS), theirs, "row", ["query"], counts, HOT_PAIRS)

    def codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Positions with their integers; and all integers, where they are."""
        has = np.asarray(values.is_valid())
        every_code = values.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.empty(int(has.sum()), [("p", np.int64), ("code", np.int32)])
        out["p"], out["code"] = np.flatnonzero(has), every_code[has]
        return out, np.where(has, every_code, 0).astype(np.int32), has

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                (a, x, x_has), (b, y, y_has) = (codes(batch.column(c)[i].values) for c in ("ours", "theirs"))
                votes, shift = offset_votes(a, b)
                if votes < least_votes:
                    continue
                n = min(len(x) - max(0, -shift), len(y) - max(0, shift))
                p, q = max(0, -shift), max(0, shift)
                use = x_has[p : p + n] & y_has[q : q + n]
                errors = int(np.bitwise_count((x[p : p + n] ^ y[q : q + n]).view(np.uint32))[use].sum())
                out.append((batch.column("query_id")[i].as_py(), batch.column("match_id")[i].as_py(), shift, votes, int(use.sum()), errors))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in MATCHES.split(", ")])

    out = small_batches(both.select("query_id", "match_id", "ours", "theirs")).mapInArrow(run, MATCHES)
    out = out.withColumn("error_rate", F.col("bit_errors") / (32.0 * F.greatest("overlap", F.lit(1))))
    return out.where((F.col("overlap") >= least_overlap) & (F.col("error_rate") <= most_errors))


def demo_recording(value: dict) -> tuple[int, np.ndarray]:
    """An invented recording for a row of `embeddings`, as struct (id, vector): eight neighbouring
    ids play one melody, each from another point of it, and the row's vector sets how loud notes
    and noise are. 8 seconds at RATE."""
    vec, vector = value["id"], np.asarray([x or 0.0 for x in value["vector"] or []], np.float64)
    if not len(vector) or not np.isfinite(vector).all():
        raise ValueError("no vector")
    melody = np.random.default_rng(vec // 8).integers(0, 24, 96)
    start = int(vec % 8) * 3
    notes = melody[start : start + 64]
    loud = 0.3 + 0.2 * np.abs(np.resize(vector, 64))
    t = np.arange(HOP) / RATE
    tone = np.sin(2 * np.pi * 220 * 2.0 ** (notes[:, None] / 12) * (np.arange(64)[:, None] * HOP / RATE + t))
    noise = np.random.default_rng(vec).normal(0, 0.01, 64 * HOP)
    return RATE, (loud[:, None] * tone).ravel() + noise
