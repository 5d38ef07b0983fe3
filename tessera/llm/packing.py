"""Cost-balanced packing of tokenised documents into sequences.

Attention over a piece of n tokens costs about linear * n + quadratic * n**2. Within a pool of
tokens that fills a whole number of sequences, documents go in descending order to the sequence of
least cost that has room; one that fits nowhere is cut, and its parts fill the cheapest sequences
with any room. So no sequence of a pool is padded. What a partition leaves at its end, less than a
sequence, is cut into sequences of powers of two, which need no padding either.

Each partition packs its own rows as they stream by, a pool at a time: nothing is shuffled, memory
is bounded by the pool, and a task that runs again makes the same pieces."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, small_batches, trim
from .shingles import runs

#: Tokens of a pool, as a number of sequences.
POOL = 256
#: Chunks, and pieces of chunks, whose ids a worker keeps.
MOST_CHUNKS, MOST_PIECES = 1_000_000, 150_000
#: Of a tokenizer's file, what allows the ids of chunks to be kept.
LAYOUT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if i != 0x130 and unicodedata.category(chr(i))[0] == kind)


_LETTER, _NUMBER, _BLANK = _class("L"), _class("N"), r"\t\n\x0b\x0c\r \x85\xa0"
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Below U+0250 in lower case too: without the capitals whose small letters lie beyond, or are two code points.
_PLAIN = re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x250) if len(chr(i).lower()) == 1 and chr(i).lower() < "\u0250") + "]*").fullmatch
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+").findall
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Words:
    """Token ids of texts.

    For a tokenizer that lower-cases, drops white space and splits runs of letters, digits and
    other signs (LAYOUT), the ids of a text are those of its white-space separated chunks in turn.
    Chunks are found and hashed (128 bits) in arrays; each worker keeps the ids of a bounded number
    of them, and of the pieces that they consist of. 64 bits of the hash find a chunk, the others
    must agree; a block of texts where they do not goes through the tokenizer as it is. Chunks that stay below U+0250 in lower
    case are split here and their pieces skip the normalisation they do not need; other chunks, and
    all texts for any other tokenizer, go through the tokenizer as it is."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.end = path, end_id
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        self.chunked = {k: shape.get(k) for k in LAYOUT} == LAYOUT
        if self.chunked:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.reset()
        self.pieces: dict[str, list[int]] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def reset(self) -> None:
        """Forgets all chunks. keys, place: sorted hashes and their chunks' numbers, older and
        newer ones apart; the other half of each chunk's hash; start and size of its ids in flat;
        seen: in how many blocks of texts it stood."""
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.place = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.other, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.start, self.flat, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def thin(self) -> None:
        """Forgets chunks that stood in one block only, and of others the rarer if they are over half
        of those that may be kept; what is forgotten is learned again when it comes."""
        most = MOST_CHUNKS // 2
        stay = np.flatnonzero(self.seen > 1)
        if len(stay) > most:
            stay = np.sort(stay[np.argsort(-self.seen[stay], kind="stable")[:most]])
        keys, place = np.concatenate(self.keys), np.concatenate(self.place)
        number = np.full(len(self.size), -1, np.int64)
        number[stay] = np.arange(len(stay))
        number = number[place]
        keys, number = keys[number >= 0], number[number >= 0]
        order = np.argsort(keys, kind="stable")
        size, start, flat, other, seen = self.size[stay], self.start[stay], self.flat, self.other[stay], self.seen[stay]
        self.reset()
        self.keys[0], self.place[0], self.other, self.seen = keys[order], number[order], other, seen // 2
        ends = np.cumsum(size)
        self.size, self.start, self.n = size, ends - size, int(size.sum())
        self.flat = np.concatenate((flat[np.repeat(start - self.start, size) + np.arange(self.n)], np.zeros(1 << 16, np.uint32)))

    def encoded(self, tokenizer, texts: list[str]) -> list[list[int]]:
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        have, odd = self.pieces, []
        split: list = []
        for i, c in enumerate(chunks):
            if (c.isascii() or _PLAIN(c)) and "<|" not in c:
                split.append(_PIECES(c.lower()))
            else:
                split.append(None)
                odd.append(i)
        new = list({p for s in split if s for p in s if p not in have})
        have.update(zip(new, self.encoded(self.bare, new)))
        out = [None if s is None else have[s[0]] if len(s) == 1 else [x for p in s for x in have[p]] for s in split]
        for i, found in zip(odd, self.encoded(self.tokenizer, [chunks[i] for i in odd]) if odd else ()):
            out[i] = found
        return out

    def learn(self, keys: np.ndarray, other: np.ndarray, chunks: list[str]) -> np.ndarray:
        """Numbers of new chunks with these sorted hashes and other halves."""
        ids = self.chunk_ids(chunks)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        if self.n + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.n], np.zeros(self.n + total, np.uint32)))
        self.flat[self.n : self.n + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        place = np.arange(len(self.size), len(self.size) + len(ids))
        self.start = np.concatenate((self.start, self.n + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.other = np.concatenate((self.other, other))
        self.seen = np.concatenate((self.seen, np.zeros(len(ids), np.int64)))
        self.n += total
        for level in (1, 0):
            keys, at = np.concatenate((self.keys[level], keys)), np.concatenate((self.place[level], place if level else self.place[1]))
            order = np.argsort(keys, kind="stable")
            self.keys[level], self.place[level] = keys[order], at[order]
            if level and len(keys) * 8 < len(self.keys[0]):
                break
            keys = self.keys[1]
            if not level:
                self.keys[1], self.place[1] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return place

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the chunks with these hashes, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        for known, place in zip(self.keys, self.place):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, place[at], out)
        return out

    def plain_ids(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for found in self.encoded(self.tokenizer, [(t or b"").decode() for t in texts]):
            yield np.array([*found, self.end], np.uint32)

    def ids(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text, given as UTF-8, the end id last."""
        if not self.chunked:
            for a, b in blocks(texts):
                yield from self.plain_ids(texts[a:b])
            return
        for a, b in blocks(texts, 1_000_000):
            joined = b" ".join(t or b"" for t in texts[a:b])
            bounds = np.cumsum([0] + [len(t or b"") + 1 for t in texts[a:b]])
            start, stop, value, other = runs(np.frombuffer(joined, np.uint8), _BLANKS, 2)
            keys, one, back = np.unique(value, return_index=True, return_inverse=True)
            if len(self.size) > MOST_CHUNKS:
                self.thin()
            number = self.numbers(keys)
            new = np.flatnonzero(number < 0)
            if len(new):
                s, e = start[one[new]].tolist(), stop[one[new]].tolist()
                number[new] = self.learn(keys[new], other[one[new]], [joined[i:j].decode() for i, j in zip(s, e)])
            self.seen[number] += 1
            at = number[back]
            if not np.array_equal(self.other[at], other):
                yield from self.plain_ids(texts[a:b])
                continue
            size = self.size[at]
            ends = np.concatenate(([0], np.cumsum(size)))
            flat = self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
            cut = ends[np.searchsorted(start, bounds)].tolist()
            for i, j in zip(cut, cut[1:]):
                out = np.empty(j - i + 1, np.uint32)
                out[:-1] = flat[i:j]
                out[-1] = self.end
                yield out


@lru_cache(1)
def worker_words(path: str, end_id: int) -> Words:
    """The worker's Words, kept for its later tasks."""
    return Words(path, end_id)


def assign(lengths: list[int], capacity: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, start in it, length, sequence) so that the sequences, whose capacities add up to the
    lengths, are all full. Order of the result: by sequence, as they were filled."""
    room, cost = np.array(capacity, np.int64), np.zeros(len(capacity))
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, rest = 0, lengths[item]
        while rest:
            fit = np.flatnonzero(room >= rest)
            if len(fit):
                to, n = int(fit[cost[fit].argmin()]), rest
            else:
                # The cheapest of the roomiest: the fewest cuts.
                most = np.flatnonzero(room == room.max())
                to = int(most[cost[most].argmin()])
                n = int(room[to])
            out.append((item, start, n, to))
            room[to] -= n
            cost[to] += linear * n + quadratic * n * n
            start, rest = start + n, rest - n
    return sorted(out, key=lambda p: p[3])


def pack(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with with_ids the piece's ids (little-endian unsigned 32-bit).

    tokenizer: path of the vocabulary file, the same on every executor. length: a power of two.
    A document is the ids of its whole text and end_id; a null or empty text is end_id alone. Rows
    that repeat a doc_id, or have none, are documents of their own. sequence_id holds the
    partition in its upper 23 bits. An empty table gives no rows."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        words, pool, held, made = worker_words(tokenizer, end_id), [], 0, 0

        def packed(pool: list, sizes: list[int]) -> pa.RecordBatch:
            nonlocal made
            rows, at, last = [], 0, -1
            for item, start, n, seq in assign([len(p[3]) for p in pool], sizes, linear, quadratic):
                at, last = (0, seq) if seq != last else (at, last)
                doc, before, tokens, ids = pool[item]
                part = ids[start : start + n].astype("<u4").tobytes()
                rows.append((doc, before + start, n, zlib.crc32(part), tokens, base + made + seq, at, part if with_ids else None))
                at += n
            made += len(sizes)
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECES.split(", ")])

        full = POOL * length
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for doc, tokens in zip(ids, words.ids(texts)):
                n, at = len(tokens), 0
                while held + n - at >= full:
                    cut = full - held
                    if cut:
                        pool.append((doc, at, n, tokens[at : at + cut]))
                    yield packed(pool, [length] * POOL)
                    pool, held, at = [], 0, at + cut
                if at < n:
                    pool.append((doc, at, n, tokens[at:]))
                    held += n - at
        if held:
            tail = [1 << b for b in reversed(range(length.bit_length() - 1)) if (held % length) >> b & 1]
            yield packed(pool, [length] * (held // length) + tail)
        trim()

    out = small_batches(docs).mapInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")
