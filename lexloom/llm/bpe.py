"""Byte-level BPE over padded numpy matrices.

The distinct pieces of a batch go into matrices by length. In each round every row merges its leftmost pair of least
rank; the rank of a pair comes from a hash table in numpy arrays; rows without a pair left are compacted away. Pieces
above MATRIX_BYTES would make rounds and width grow together, so they take the same merges from a heap instead. Both
give the ids of the public rank-file tokenizers for any text.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
MATRIX_BYTES = 256
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, MATRIX_BYTES)
CACHED_PIECES = 200_000  # a worker's cache of encoded pieces starts anew beyond; results do not depend on it
NONE = np.int32(2**31 - 1)


LETTER, NUMBER, OTHER, SPACE, END = range(5)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point, as the public pattern tells them apart."""
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    out, every = np.full(0x110000, OTHER, np.uint8), points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def split_batch(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of public_tokenizers.PATTERN in all texts, one after another, and how many each text has.

    Pieces begin where the kind changes. The last of several spaces before other text goes on its own, and if it is
    U+0020 with the text after it. A contraction counts where its apostrophe begins a piece.
    """
    whole = "\n".join([*texts, ""])
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = _kinds()[points]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[ends] = END
    first = np.empty(len(points) + 1, bool)
    first[0] = first[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:-1])
    first[ends] = first[ends + 1] = True
    text = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE)) + 1
    first[text - 1] = True
    first[text[points[text - 1] == 32]] = False
    q = np.flatnonzero(points == 39)
    q = q[first[q]]
    a, b = points[np.minimum(q + 1, len(points) - 1)], points[np.minimum(q + 2, len(points) - 1)]
    short = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    first[q[short | long] + 1] = False
    first[q[short] + 2] = first[q[long] + 3] = True
    at = np.flatnonzero(first)
    begin, end = at[:-1], at[1:]
    use = kind[begin] != END
    begin, end = begin[use], end[use]
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    return [whole[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)], counts


class Pairs:
    """(left id, right id) to the id of the merged token, in an open-addressing table."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo = np.array([a << 32 | b for a, b in pairs], np.int64)
        ids, self.probes, slot = np.array(list(pairs.values()), np.int32), 0, self.slots(todo)
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ids[slot[put]] = todo[put], ids[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, ids, slot = todo[rest], ids[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where either is padding (-1) or the pair does not merge."""
        keys = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        slot = self.slots(keys)
        out = np.where(self.keys[slot] == keys, self.ids[slot], NONE)
        open_ = np.flatnonzero((out == NONE).ravel() & (self.keys[slot] != -1).ravel())
        flat, k, s = out.ravel(), keys.ravel()[open_], slot.ravel()[open_]
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            s = (s + 1) & ((1 << self.bits) - 1)
            hit = self.keys[s] == k
            flat[open_[hit]] = self.ids[s[hit]]
            more = ~hit & (self.keys[s] != -1)
            open_, k, s = open_[more], k[more], s[more]
        out = flat.reshape(out.shape)
        out[(a < 0) | (b < 0)] = NONE
        return out


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.public = pattern == public_tokenizers.PATTERN
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair_ids = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = Pairs(self.pair_ids)
        by_id = sorted((r, t) for t, r in ranks.items())
        self.lengths = np.zeros(by_id[-1][0] + 1, np.int64)
        self.lengths[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if self.public:
            return split_batch(texts)
        found = [[m[0] for m in self.pattern.finditer(t)] for t in texts]
        return [p for f in found for p in f], np.array([len(f) for f in found], np.int64)

    def merge(self, pieces: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of 1 to width bytes each, all in one row after another, and how many each has."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        cols = np.arange(width)
        ids = np.full((n, width), -1, np.int32)
        ids[cols < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        done, rows = ids.copy(), np.arange(n)
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the least
            r = np.arange(len(rows))
            best = ranks[r, at]
            more = best != NONE
            if not more.all():
                done[rows[~more]] = ids[~more]
                rows, ids, ranks, at, best = rows[more], ids[more], ranks[more], at[more], best[more]
                r = np.arange(len(rows))
                if not len(rows):
                    break
            ids[r, at] = best
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            right = np.minimum(at + 1, width - 1)
            ranks[r, at] = np.where(right > at, self.pairs(best, ids[r, right]), NONE)
            left = at > 0
            ranks[r[left], at[left] - 1] = self.pairs(ids[r[left], at[left] - 1], best[left])
        kept = done >= 0
        return done[kept], kept.sum(1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one piece, in time n log n."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pair_ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[x], k) for k, x in enumerate(zip(ids, ids[1:])) if x in pairs]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or pairs.get((ids[k], ids[j])) != rank:
                continue
            ids[k], ids[j] = rank, -1
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (x := pairs.get((rank, ids[m]))) is not None:
                    heapq.heappush(heap, (x, k))
            if (i := before[k]) >= 0 and (x := pairs.get((ids[i], rank))) is not None:
                heapq.heappush(heap, (x, i))
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct new pieces and keep their ids."""
        raw = [p.encode() for p in pieces]
        by_width: dict[int, list[int]] = {}
        for k, x in enumerate(raw):
            by_width.setdefault(next((w for w in WIDTHS if len(x) <= w), 0), []).append(k)
        flat, sizes, order = [self.flat], [self.size], []
        for width, group in by_width.items():
            order += group
            step = max(1, (1 << 20) // width) if width else 1
            for at in range(0, len(group), step):
                part = [raw[k] for k in group[at : at + step]]
                ids, size = self.merge(part, width) if width else (x := self.merge_long(part[0]), np.array([len(x)]))
                flat.append(ids)
                sizes.append(size)
        n = len(self.size)
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.at = np.cumsum(self.size) - self.size
        self.known.update(zip((pieces[k] for k in order), range(n, n + len(order)), strict=True))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        pieces, counts = self.split(texts)
        if len(self.known) > CACHED_PIECES:
            self.forget()
        if new := list(set(pieces) - self.known.keys()):
            self.learn(new)
        k = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        size = self.size[k]
        ids, upto = _ranges(self.flat, self.at[k], size), np.concatenate([[0], np.cumsum(size)])
        return np.split(ids, upto[np.cumsum(counts)[:-1]])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        return _ranges(self.blob, self.starts[ids], self.lengths[ids]).tobytes()


def _ranges(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of flat, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def _groups(texts: list[str], most: int = 2_000_000):
    """Runs of texts of about so many characters."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the token ids (array<int>) of every whole text, without special tokens; null and empty texts have none.

    A column that already has the name of ids_col is replaced; all others stay. path is a rank file that every
    executor can open.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        t = tokenizer(path, pattern)
        rows = [r for g in _groups([x or "" for x in texts.to_pylist()]) for r in t.encode_batch(g)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the bytes (binary) that the ids stand for; a null array and null ids in it give no bytes. An id that the vocabulary
    does not have, negative ones included, fails the job. Clashing names as in encode()."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    @F.arrow_udf("binary")
    def text(ids: pa.Array) -> pa.Array:
        t = tokenizer(path, pattern)
        return pa.array([t.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in ids], pa.binary())

    return df.withColumn(bytes_col, text(F.col(ids_col)))
