"""MinHash near-dedup with HyperMinHash sketches.

Each text's set of word shingles becomes 256 registers. A register keeps of the least hash dealt to it the count of
leading zeros and ten mantissa bits; empty registers borrow from others in an order fixed per register, so short texts
have full sketches. Bands of registers are the join keys; they alone travel, and where texts meet the registers are
sketched anew from the sets. The documents of a key are compared with its smallest one first: a star, not all pairs.
Pairs pass the collision-corrected estimate before the sets of the whole texts decide. Documents that their stars leave
outside meet all others of the same centre in blocks, where one inverted index counts the common shingles; out of a block
comes one link per document and component, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.components import components
from lexloom.session import discard, materialize

REGISTERS, MANTISSA = 256, 10
MISS = 1e-4  # most that the bands may miss of pairs just at the threshold
MASK = np.uint64((1 << 56) - 1)
_CASE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Hashes(dict):
    """Word to hash; forgets all beyond 250,000 words, since workers live on and each keeps one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text: A-Z in lower case, words between ASCII white
    space. A text of fewer words is one shingle, one without words none."""
    words = (text or "").encode().translate(_CASE).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out + h[j : len(h) - k + 1 + j])
    return np.unique(out)


_ORDER = np.argsort(_mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(REGISTERS, REGISTERS), axis=1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a sorted set; zeros if it is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    at = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    m, e = np.frexp((hashes[first] & MASK).astype(np.float64))
    out[at[first]] = ((57 - e) << MANTISSA) | np.maximum((m * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    empty = np.flatnonzero(out == 0)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), (out != 0)[order].argmax(1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, less the chance that different hashes share a register's bits."""
    chance = 0.7213 / (1 << MANTISSA) * (n_a * n_b / np.square(n_a + n_b, dtype=np.float64))
    return ((a == b).mean(1) - chance) / (1 - chance)


def bands(threshold: float) -> tuple[int, int]:
    """Number and length of the bands: the longest that miss at most MISS of pairs at the threshold."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (REGISTERS // r) <= MISS]
    r = max(fit, default=1)
    return REGISTERS // r, r


def band_keys(registers: np.ndarray, n: int, r: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    x = registers[:, : n * r].reshape(len(registers), n, r).astype(np.uint64)
    out = np.broadcast_to(np.arange(n, dtype=np.uint64), x.shape[:2])
    for j in range(r):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return out.view(np.int64)


def _sketches(df: DataFrame, size: int, threshold: float) -> DataFrame:
    """id, n, two sums that tell sets apart, and the band keys of every row."""
    kinds = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])
    many, r = bands(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, registers = [], np.zeros((batch.num_rows, REGISTERS), np.uint16)
            for k, text in enumerate(batch.column(1)):
                h = shingle_set(text.as_py(), size)
                rows.append((len(h), h.sum(dtype=np.uint64).view(np.int64), _mix(h).sum(dtype=np.uint64).view(np.int64)))
                registers[k] = sketch(h)
            n = pa.array([x[0] for x in rows], pa.int64())
            ends = np.cumsum(np.where(np.array([x[0] for x in rows], np.int64) > 0, many, 0))
            keys = band_keys(registers, many, r)[np.array([x[0] > 0 for x in rows], bool)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *(pa.array([x[k] for x in rows], pa.int64()) for k in (1, 2)), lists], schema=kinds)

    return df.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>")


STAR = 64  # members compared with one copy of their centre's text
SIDE = 128  # texts on each side of a block


def _least_estimate(percent: int) -> float:
    """Five standard errors below the threshold: what an estimate must reach for the sets to be compared."""
    t = percent / 100
    return t - 5 * math.sqrt(t * (1 - t) / REGISTERS)


def _texts_of(wanted: DataFrame, texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The table wanted, stored, and its rows with their texts. The texts of other ids are sifted out in their scan, the rest is
    shuffled at every size."""
    wanted = materialize(wanted, name)
    asked = wanted.filter(F.col("id") > F.lit(-(1 << 63)))  # a comparison lets Spark make the Bloom filter; see sifted()
    low = asked if wanted.filter(F.col("id") == F.lit(-(1 << 63))).isEmpty() else wanted
    return wanted, texts.join(low.hint("merge"), "id")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b), distinct, with 100 * intersection >= percent * union on the sets of the whole texts (id, text).

    The texts of a star meet by centre, at most STAR members to a share of it, and stream past the centre's set; no task
    holds more than that set and a batch. The estimate rules pairs out first.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("shares")).filter("shares > 1")
    shares = materialize(shares, "minhash-shares")  # of the large stars only
    members = pairs.join(shares, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), "shares"), F.lit(0).cast("long")).alias("share"), F.col("b").alias("id"))
    centres = members.select("a", "share").distinct().withColumn("id", F.col("a"))
    wanted, rows = _texts_of(members.unionByName(centres), texts, "minhash-wanted")
    rows, least = rows.select("a", "share", "id", "text", (F.col("id") != F.col("a")).alias("member")), _least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, []
        for batch in batches:
            found = []
            a, share, id_, text, member = batch.columns
            for k, (x, y, i, m) in enumerate(zip(a.to_pylist(), share.to_pylist(), id_.to_pylist(), member.to_pylist(), strict=True)):
                h = shingle_set(text[k].as_py(), size)
                if (x, y) != star:
                    star, centre = (x, y), []
                if not m:
                    centre.append((h, sketch(h)[None]))  # rows that repeat an id may differ in text
                    continue
                mine = sketch(h)[None]
                for c, other in centre:
                    if len(h) and len(c) and estimate(mine, other, len(h), len(c))[0] >= least:
                        both = len(np.intersect1d(c, h, assume_unique=True))
                        if both and 100 * both >= percent * (len(c) + len(h) - both):
                            found.append((x, i))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    near = rows.repartition("a", "share").sortWithinPartitions("a", "share", "member")
    out = materialize(near.mapInArrow(run, "a long, b long"), "minhash-links", sift=wanted.count())
    discard(shares, wanted)
    return out


def _common(sets: list[np.ndarray], one: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many hashes one shares with each of the sets; index: all their hashes in order, and whose each is."""
    hashes, owners = index
    first, last = np.searchsorted(hashes, one, "left"), np.searchsorted(hashes, one, "right")
    n = last - first
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.bincount(owners[at], minlength=len(sets))


class _Block:
    """One side of a block: ids, parts and sets. Parts that a link has joined count as one from then on."""

    def __init__(self):
        self.ids, self.parts, self.sets, self.joined = [], [], [], {}

    def close(self) -> None:
        every = np.concatenate([np.empty(0, np.uint64), *self.sets])
        owner = np.repeat(np.arange(len(self.sets)), [len(v) for v in self.sets])
        order = np.argsort(every, kind="stable")
        self.index, self.sizes = (every[order], owner[order]), np.array([len(v) for v in self.sets], np.int64)
        self.registers = np.stack([sketch(v) for v in self.sets]) if self.sets else np.zeros((0, REGISTERS), np.uint16)
        self.where = np.array(self.parts, np.int64)

    def links(self, part: int, h: np.ndarray, percent: int, least: float) -> list[int]:
        """Positions of one linked set of each other part."""
        part = self.joined.get(part, part)
        if not len(h) or not len(self.sets):
            return []
        maybe = (self.where != part) & (self.sizes > 0)
        maybe[maybe] = estimate(sketch(h)[None], self.registers[maybe], len(h), self.sizes[maybe]) >= least
        if not maybe.any():
            return []
        both = _common(self.sets, h, self.index)
        near = np.flatnonzero(maybe & (both > 0) & (100 * both >= percent * (self.sizes + len(h) - both)))
        found = near[np.unique(self.where[near], return_index=True)[1]].tolist()
        for old in {int(self.where[y]) for y in found}:
            self.where[self.where == old] = part
            self.joined = {x: part if p == old else p for x, p in self.joined.items()} | {old: part}
        return found


def verify_blocks(outside: DataFrame, members: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between outside and members (centre, id, part) of one centre in different parts, on the sets of the whole
    texts; in a block, parts that have a link count as one. Sides above SIDE texts are split, and each pair of parts of the
    sides is a task of bounded size. The estimate rules pairs out first."""
    n = lambda df, name: df.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias(name))
    shape = materialize(n(outside, "xs").join(n(members, "ys"), "centre"), "minhash-shape")
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    own = lambda m: F.pmod(F.xxhash64("id"), F.col(m))
    x = outside.join(shape, "centre").select("centre", own("xs").alias("i"), "id", "part", F.lit(True).alias("x"), "ys").withColumn("j", every("ys")).drop("ys")
    y = members.join(shape, "centre").select("centre", own("ys").alias("j"), "id", "part", F.lit(False).alias("x"), "xs").withColumn("i", every("xs")).drop("xs")
    wanted, rows = _texts_of(x.unionByName(y), texts, "minhash-blocks")
    rows, least = rows.select("centre", "i", "j", "x", "id", "part", "text"), _least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, closed = None, _Block(), False
        for batch in batches:
            found = []
            text = batch.column(6)
            for k, (c, i, j, is_x, id_, part) in enumerate(zip(*(v.to_pylist() for v in batch.columns[:6]), strict=True)):
                if (c, i, j) != now:
                    now, block, closed = (c, i, j), _Block(), False
                h = shingle_set(text[k].as_py(), size)
                if not is_x:
                    block.ids.append(id_)
                    block.parts.append(part)
                    block.sets.append(h)
                    continue
                if not closed:
                    block.close()
                    closed = True
                found += [(id_, block.ids[y]) for y in block.links(part, h, percent, least)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    near = rows.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "x")
    out = materialize(near.mapInArrow(run, "a long, b long"), "minhash-links", sift=wanted.count())
    discard(shape, wanted)
    return out


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept (the id is that one), row by row.

    Links are pairs whose shingle sets have 100 * intersection >= percent * union. Null, empty and blank texts have no
    shingle and no link. A null id has component_id null, is kept and links with nothing. Rows that repeat an id are one
    node, linked if any of their texts is; n_shingles is each row's own. Sets are compared by 64-bit shingle hashes. Other
    columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_ = materialize(_sketches(texts, size, percent / 100), "minhash-sketches")
    # Equal sets are one node. Only sets that occur more than once join back.
    copies = all_.filter("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"))
    copies = materialize(copies.filter("many > 1").drop("many"), "minhash-copies")
    rep = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    nodes = all_.select("id", "n", "s1", "s2").join(copies, ["n", "s1", "s2"], "left").select("id", "n", rep.alias("rep"))
    nodes = materialize(nodes, "minhash-nodes")
    # An id with several sets ties their nodes together.
    several = nodes.filter("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    ties = nodes.join(several, "id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    ties = materialize(ties, "minhash-ties")
    lost = nodes.filter("n > 0 AND id <> rep").select("id").distinct()
    lost = lost.join(nodes.filter("n > 0 AND id = rep").select("id"), "id", "left_anti")  # ids none of whose sets is its own node
    reps = all_.filter("n > 0 AND id IS NOT NULL").join(lost, "id", "left_anti").select("id", "keys")
    reps = materialize(reps, "minhash-bands")
    discard(all_, copies)
    banded = reps.select(F.explode("keys").alias("key"), "id")
    keys = banded.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last"))
    keys = materialize(keys.filter("a < last").select(F.col("key").alias("k"), "a"), "minhash-keys")
    found = materialize(banded.join(keys.hint("merge"), F.col("key") == F.col("k")).select("a", F.col("id").alias("b")).filter("a < b").distinct(), "minhash-stars")
    discard(reps, keys)
    links = verify(found, texts, percent, size)
    part = first = materialize(components(_edges(links)), "minhash-parts")
    # Whoever is not in the centre's component by now is compared with all that share the centre and are in other parts.
    of = lambda x, y: part.select(F.col("node").alias(x), F.col("component").alias(y))
    members = found.select(F.col("a").alias("centre"), F.col("b").alias("id"))
    members = members.join(of("i", "i_part"), F.col("id") == F.col("i"), "left").join(of("c", "c_part"), F.col("centre") == F.col("c"), "left")
    members = members.select("centre", "id", F.coalesce("i_part", "id").alias("part"), F.coalesce("c_part", "centre").alias("centre_part"))
    members = materialize(members, "minhash-members")
    outside = materialize(members.filter("part <> centre_part").drop("centre_part"), "minhash-outside")
    others = members.join(outside.select("centre").distinct(), "centre", "left_semi").drop("centre_part")
    more = verify_blocks(outside, others, texts, percent, size)
    part = components(_edges(links.unionByName(more).unionByName(ties)))
    discard(found, first, members, outside, links, more, ties)
    out = nodes.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
