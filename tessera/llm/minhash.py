"""Near-duplicate groups by b-bit MinHash, each link confirmed on whole shingle sets.

A text's distinct word shingles give 128 minima. Four minima make a band, so that two texts at the
least similarity of 0.8 share none of the 32 bands with a chance of 5e-8. Of each minimum the low
four bits are kept and packed into eight longs; for two texts that share a band, the equal nibbles,
corrected for chance equality, estimate the similarity, and a pair 5.5 standard deviations under
the threshold is let go. All others are compared on their full sets.

A group of copies never meets in one task: texts with equal sets become one representative (the
hash of the set is the key, combined before the shuffle); each representative is first compared
with the one it seems closest to among the smallest of its buckets; and only representatives that
then lie in different components of a bucket are compared with each other. Many variants of one
text are many such pairs that the estimate cannot refuse, so pairs are never listed: estimates of a
bucket, or of two chunks of it, are tiles of one array, and tell only which representatives of
which two blocks have to meet; the full sets of two blocks are then read once and all their
intersections counted by matrix products. No bucket is capped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, narrowed, salted, small_batches, stored, trim
from .components import connected_components
from .shingles import mix, shared, shingle_sets

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
_RNG = np.random.Generator(np.random.PCG64(971))
_TIMES = _RNG.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(1, 1 << 62, (ROWS + 1,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Most members of a chunk of a bucket whose components still have to be compared, on average, and
#: of a group that is compared together with other groups.
CHUNK, SMALL = 4096, 32
#: Shingles and texts of a block whose full sets meet those of another one, on average.
BLOCK_SHINGLES, BLOCK_ROWS = 400_000, 1_000
#: Columns of a product and pairs counted one by one at a time; how much cheaper a cell of a product is than such a pair.
COLUMNS, COUNTED, CHEAPER = 1_024, 4_000_000, 50
#: Pairs of one text that a task compares.
HOT_PAIRS = 2_000

SIGNATURE = "doc_id long, n long, h1 long, h2 long, bands array<long>, bits array<long>"


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(hashes x sets) minima of nonempty sets under HASHES multiplicative permutations."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, held = np.empty((HASHES, len(sets)), np.uint32), np.empty_like(x)
    for i, a in enumerate(_TIMES):
        np.multiply(x, a, out=held)
        np.minimum.reduceat(held, at, out=out[i])
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """(sets x BANDS) keys; the number of the band is part of its key."""
    rows = low.reshape(BANDS, ROWS, -1).astype(np.uint64)
    key = sum(rows[:, j] * _BAND[j] for j in range(ROWS)) + np.arange(BANDS, dtype=np.uint64)[:, None] * _BAND[ROWS]
    return mix(key).T.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """(sets x LONGS) the low BITS bits of each minimum, 64 / BITS to a long."""
    per = 64 // BITS
    part = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, per, -1)
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.bitwise_or.reduce(part << shift, axis=1).T.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """SIGNATURE of each row of docs (doc_id, text): set size, 128-bit hash of the set, band keys
    and packed bits (empty arrays without words)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in blocks(texts):
                sets = shingle_sets(texts[a:b], shingle)
                have = [i for i, s in enumerate(sets) if len(s)]
                keys, bits = [[] for _ in sets], [[] for _ in sets]
                if have:
                    low = minima([sets[i] for i in have])
                    for i, k, p in zip(have, band_keys(low).tolist(), packed(low).tolist()):
                        keys[i], bits[i] = k, p
                whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                halves = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "h1", "h2", "bands", "bits"],
                )
        trim()

    return small_batches(docs).mapInArrow(run, SIGNATURE)


def least_matches(percent: int, sigmas: float = 5.5) -> int:
    """Equal b-bit values below which a pair at the threshold lies with a chance of about 2e-8."""
    chance = 1 / (1 << BITS)
    p = percent / 100 + (1 - percent / 100) * chance
    return int(HASHES * p - sigmas * (HASHES * p * (1 - p)) ** 0.5)


def matches(a: str, b: str) -> F.Column:
    """Of how many minima the kept bits agree, by bit counts of the packed longs."""
    ones = int("1" * 16, 16)
    differing = F.lit(0)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        y = x
        for s in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        differing = differing + F.bit_count(y.bitwiseAND(F.lit(ones)))
    return F.lit(HASHES) - differing


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b), a stored table, whose full shingle sets have 100 * intersection >= percent * union."""
    both = salted(pairs, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a", ["b"], hot_rows=HOT_PAIRS)
    counts = pairs.groupBy("b").agg(F.count("*").alias("rows"))
    both = salted(both, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b", ["a"], counts, HOT_PAIRS)

    def run(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ta, tb = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            keep = []
            for i in range(batch.num_rows):
                other = tb[i].as_py()
                if other != last:
                    last, held = other, shingle_sets([other], shingle)[0]
                own = shingle_sets([ta[i].as_py()], shingle)[0]
                n = shared(own, held)
                keep.append(100 * n >= percent * (len(own) + len(held) - n) and n > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])
        trim()

    return stored(small_batches(both.select("a", "b", "ta", "tb")).mapInArrow(run, "a long, b long"), "links")


def places(shared_rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, bits, block) of each representative in a bucket: those with the same smallest one in
    any of their buckets are dealt to blocks of a bounded size on average."""
    place = shared_rows.groupBy("rep").agg(F.min("low").alias("home")).join(reps.select("rep", "n", "bits"), "rep")
    place = stored(place, "places")
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    homes = stored(place.groupBy("home").agg(F.count("*").alias("rows"), parts.alias("parts")), "homes")
    place = salted(place, homes.select("home", "parts"), "home", ["rep"], homes.select("home", "rows"))
    return place.select("rep", "bits", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))


def whole_groups(batches, keys: int) -> Iterator[pa.Table]:
    """The rows of batches, sorted by their first `keys` columns, in tables that cut no group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1] + 1)])
            held = [batch.slice(cuts[-1] + 1)]
        elif held and any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def edges_of(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal values of sorted columns begin, and the end of the last."""
    change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(columns[0])]))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of how many minima the kept bits agree; packed longs (unsigned) on the first axis."""
    differing: np.ndarray | int = 0
    for x, y in zip(a, b):
        x = x ^ y
        y = x.copy()
        for s in range(1, BITS):
            y |= x >> np.uint64(s)
        y &= np.uint64(int("1" * 16, 16))
        differing = differing + np.bitwise_count(y)
    return HASHES - differing


def small_pairs(group: np.ndarray, chunk: np.ndarray, one: np.ndarray, comp: np.ndarray, bits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows within small groups, all groups at once; one: the group is one chunk."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = np.arange(len(group))
    for d in range(1, SMALL):
        live = live[live + d < len(group)]
        live = live[group[live] == group[live + d]]
        if not len(live):
            break
        p = live[(comp[live] != comp[live + d]) & (one[live] | (chunk[live] != chunk[live + d]))]
        p = p[agreeing(bits[:, p], bits[:, p + d]) >= least]
        first.append(p)
        second.append(p + d)
    return np.concatenate(first), np.concatenate(second)


def large_hits(left: np.ndarray, right: np.ndarray, comp: np.ndarray, block: np.ndarray, bits: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, block of a candidate partner) of rows left and right, both sorted by block; they may be the same rows."""
    same = left is right
    at, to = edges_of(block[left])[:-1], edges_of(block[right])[:-1]
    rows, columns = np.zeros((len(left), len(to)), bool), np.zeros((len(at), len(right)), bool)
    number = np.searchsorted(at, np.arange(len(left)), "right") - 1
    theirs = np.ascontiguousarray(bits[:, right])
    for a in range(0, len(left), 64):
        own = left[a : a + 64]
        mask = np.zeros((len(own), len(right)), bool)
        for b in range(a if same else 0, len(right), 1024):
            part = agreeing(bits[:, own][:, :, None], theirs[:, None, b : b + 1024]) >= least
            mask[:, b : b + 1024] = part & (comp[own][:, None] != comp[right[b : b + 1024]][None])
        rows[a : a + 64] = np.logical_or.reduceat(mask, to, axis=1)
        for k in np.unique(number[a : a + 64]):
            columns[k] |= mask[number[a : a + 64] == k].any(axis=0)
    p, k = np.nonzero(rows)
    yield left[p], block[right[to[k]]]
    k, q = np.nonzero(columns)
    yield right[q], block[left[at[k]]]


def candidates(rows: DataFrame, least: int) -> DataFrame:
    """(x, y, rep, comp, block), repeated: representatives that have a candidate partner of another
    component where blocks x and y meet. rows: key, i, j, chunk, rep, comp, block, bits, all
    members of a key with chunk i or j under (key, i, j)."""

    def run(batches):
        for t in whole_groups(batches, 3):
            key, i, j, chunk, rep, comp, block = (t.column(c).to_numpy() for c in range(7))
            bits = t.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS).T
            cut = edges_of(key, i, j)
            size = np.diff(cut)
            group = np.repeat(np.arange(len(size)), size)
            few = np.flatnonzero(size[group] <= SMALL)
            p, q = small_pairs(group[few], chunk[few], (i == j)[few], comp[few], np.ascontiguousarray(bits[:, few]), least)
            p, q = few[p], few[q]
            found = [(p, block[q]), (q, block[p])]
            for g in np.flatnonzero(size > SMALL).tolist():
                of = np.arange(cut[g], cut[g + 1])
                of = of[np.argsort(block[of], kind="stable")]
                k, m = i[of[0]], j[of[0]]
                left = of if k == m else of[chunk[of] == k]
                right = of if k == m else of[chunk[of] == m]
                if len(left) and len(right):
                    found.extend(large_hits(left, right, comp, block, bits, least))
            row, partner = (np.concatenate(c) for c in zip(*found))
            own = block[row]
            out = [np.minimum(own, partner), np.maximum(own, partner), rep[row], comp[row], own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["x", "y", "rep", "comp", "block"])
        trim()

    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j")
    return small_batches(rows.sortWithinPartitions("key", "i", "j")).mapInArrow(run, "x long, y long, rep long, comp long, block long")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left x right) sizes of the intersections of sets of distinct numbers. Numbers in many sets
    are columns of a matrix product, those in few are counted pair by pair."""
    nl, nr = len(left), len(right)
    out = np.zeros((nl, nr), np.int64)
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    held = sum(map(len, left))
    lc, rc = column[:held], column[held:]
    lr, rr = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    most = int(column.max()) + 1 if len(column) else 0
    ln, rn = np.bincount(lc, minlength=most), np.bincount(rc, minlength=most)
    dense = ln * rn * CHEAPER > nl * nr
    place, sides = np.cumsum(dense) - 1, []
    for n, r, c in ((nl, lr, lc), (nr, rr, rc)):
        r, c = r[dense[c]], place[c[dense[c]]]
        order = np.argsort(c, kind="stable")
        sides.append((n, r[order], c[order]))
    for a in range(0, int(dense.sum()), COLUMNS):
        parts = []
        for n, r, c in sides:
            s, e = np.searchsorted(c, (a, a + COLUMNS))
            part = np.zeros((n, COLUMNS), np.float32)
            part[r[s:e], c[s:e] - a] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    rare = (ln > 0) & (rn > 0) & ~dense
    lc, lr, rc, rr = lc[rare[lc]], lr[rare[lc]], rc[rare[rc]], rr[rare[rc]]
    rr = rr[np.argsort(rc, kind="stable")]
    begin = np.cumsum(rn * rare) - rn * rare
    times = rn[lc]
    ends = np.cumsum(times)
    a = 0
    while a < len(lc):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COUNTED, "right")))
        n = times[a:b]
        of = np.repeat(begin[lc[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(lr[a:b], n) * nr + rr[of], minlength=nl * nr).reshape(nl, nr)
        a = b
    return out


def meetings(meeting: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between the representatives that meet under each (x, y), a stored table: of
    those that a has in one component, one."""
    rows = salted(meeting, texts.select(F.col("doc_id").alias("rep"), "text"), "rep", ["x", "y"], hot_rows=HOT_PAIRS)
    rows = rows.select("x", "y", "rep", "comp", "block", "text")

    def run(batches):
        for t in whole_groups(batches, 2):
            x, y, rep, comp, block = (t.column(c).to_numpy() for c in range(5))
            cut, found = edges_of(x, y).tolist(), [(rep[:0], rep[:0])]
            sets: list[np.ndarray] = []
            texts = t.column(5).cast(pa.binary()).to_pylist()
            for a, b in blocks(texts):
                sets += shingle_sets(texts[a:b], shingle)
            for s, e in zip(cut, cut[1:]):
                own = np.arange(s, e)
                right = own[block[s:e] == y[s]]
                for a in range(0, e - s, BLOCK_ROWS):
                    left = own[a : a + BLOCK_ROWS]
                    left = left[block[left] == x[s]]
                    if not len(left) or not len(right):
                        continue
                    if len(left) * len(right) <= 4:
                        both = np.array([[shared(sets[i], sets[k]) for k in right] for i in left])
                    else:
                        both = intersections([sets[i] for i in left], [sets[k] for k in right])
                    n, m = (np.array([len(sets[i]) for i in side]) for side in (left, right))
                    linked = (both > 0) & (100 * both >= percent * (n[:, None] + m - both)) & (comp[left][:, None] != comp[right])
                    p, q = np.nonzero(linked)
                    if len(p):
                        p, q = left[p], right[q]
                        _, one = np.unique(np.stack((p, comp[q])), axis=1, return_index=True)
                        found.append((rep[p[one]], rep[q[one]]))
            a, b = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
        trim()

    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y")
    return stored(small_batches(rows.sortWithinPartitions("x", "y")).mapInArrow(run, "a long, b long").distinct(), "links")


def _groups(df: DataFrame, id: str, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The result of near_duplicates, and the signatures of all rows (a stored table)."""
    docs = narrowed(df, doc_id=id, text=text).where("doc_id is not null")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sig = stored(signatures(docs, shingle), "signatures")
    reps = sig.where("n > 0").groupBy("n", "h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    reps = stored(reps, "representatives")

    member = reps.select("rep", F.explode("bands").alias("key"))
    bucket = member.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("rows")).where("rows > 1")
    bucket = stored(bucket, "keys")
    shared_rows = stored(salted(member, bucket.select("key", "low"), "key", ["rep"], bucket.select("key", "rows")), "buckets")
    bits = reps.select("rep", "bits")
    least = least_matches(percent)
    # Every text that may have to be compared goes through one shuffle, at any size of the table.
    ids = shared_rows.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash")
    texts = stored(docs.join(ids, "doc_id", "left_semi"), "texts")

    star = shared_rows.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    star = stored(star.join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("pa")), "a"), "closest")
    star = salted(star, bits.select(F.col("rep").alias("b"), F.col("bits").alias("pb")), "b", ["a"])
    star = star.withColumn("m", matches("pa", "pb")).where(F.col("m") >= least)
    best = star.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
    links = confirmed(stored(best, "stars"), texts, shingle, percent)

    comp = connected_components(links)
    rows = shared_rows.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    rows = rows.select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    rows = stored(rows, "members")
    mixed = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    mixed = stored(mixed.where("x <> y").select("key", "rows", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks")), "mixed")
    rows = salted(rows, mixed.select("key", "chunks"), "key", ["rep"], mixed.select("key", "rows")).join(places(shared_rows, reps), "rep")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "comp", "block", "bits")
    meeting = stored(candidates(rows, least).distinct(), "cross")
    more = meetings(meeting, texts, shingle, percent)

    comp = stored(connected_components(links.union(more)), "components")
    classes = reps.select("n", "h1", "h2", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    out = out.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("c"))
    out = out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")), sig


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document of df.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable over links and kept says that it is the
    document's own. Null and wordless texts have an empty set and are linked with nothing. Rows
    that repeat a doc_id are one document (n_shingles: the most of its rows); rows without a
    doc_id are left out. Other columns of df play no part. An empty table gives no rows."""
    return _groups(df, id, text, shingle, percent)[0]


def without_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """df without the rows whose document is not the kept one of its group; of rows that repeat a
    doc_id the one of least text stays, then of least other columns as JSON (rows without a doc_id
    all stay). The columns are those of df. Texts are shuffled once more only by the ids that go;
    rows of repeated ids, if there are any, are reduced apart."""
    found, sig = _groups(df, id, text, shingle, percent)
    key = F.col(f"`{id}`").cast("long")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone"))
    rest = df.join(gone, key == F.col("_gone"), "left_anti")
    again = sig.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"))
    again = stored(again, "repeated")
    if again.isEmpty():
        return rest
    row = F.struct(*[f"`{c}`" for c in df.columns])
    one = rest.join(again, key == F.col("_again"), "left_semi").groupBy(key.alias("_id"))
    one = one.agg(F.min_by(row, F.struct(f"`{text}`", F.to_json(row))).alias("_row")).select("_row.*")
    return rest.join(again, key == F.col("_again"), "left_anti").unionByName(one)
