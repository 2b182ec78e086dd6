"""Embedding near-dedup by spherical-cap filters of a structured random code.

A vector is rotated and cut into four blocks, each with its own random codebook. A filter direction is one code word per
block, so words**4 directions need 4 * words inner products. List decoding finds all directions whose caps a vector lies
in: those that score at least a fixed share of the vector's best, LIST on average and without a limit. (One cap for all
scores would leave vectors of unequal blocks without any.) Codes are independent, and as many as it takes for at most
MISS of the pairs at the threshold to share no direction; finer codes miss more, so their number grows with that of the
vectors. Vectors of one best direction form a cell; cells that share a listed direction are candidates. How many cells list
a direction is bounded by the code, since they are those of directions near it; a dense group of vectors lies in few cells.
Cells go into blocks of about BLOCK vectors and pairs of blocks are verified as matrix products, so each pair of vectors is
compared once, and what leaves a task is a count per vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.components import components
from lexloom.session import materialize

LIST, CODES, BLOCK, PARTS, MISS = 32, 3, 256, 4, 1e-5


@functools.lru_cache(maxsize=8)
def _code(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A rotation of the dimensions, padded to a multiple of four, and the codebooks."""
    r = np.random.default_rng([7, seed, dim])
    padded = -(-dim // PARTS) * PARTS
    turn = np.linalg.qr(r.standard_normal((padded, padded)))[0][:dim]
    books = r.standard_normal((PARTS, words, padded // PARTS))
    if padded == PARTS:  # one dimension each has two directions
        books = np.broadcast_to(np.array([[1.0], [-1.0]]), (PARTS, 2, 1))
    return turn, books / np.linalg.norm(books, axis=2, keepdims=True)


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1 in double precision, and which rows have a length at all (finite, not zero)."""
    x = np.asarray(x, np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1, initial=0.0)
        ok = np.isfinite(top) & (top > 0)
        x = np.where(ok[:, None], x / top[:, None], 0.0)
        n = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(n > 0, n, 1)[:, None], ok


def _decoded(unit: np.ndarray, words: int, seed: int, cap: float) -> Iterator[np.ndarray]:
    """Of each row, the numbers of all directions of one code that score at least `cap` times the best, the best first."""
    turn, books = _code(unit.shape[1], words, seed)
    words = books.shape[1]
    few = max(1, (1 << 20) // words**2)
    for at in range(0, len(unit), few):
        x = (unit[at : at + few] @ turn).reshape(-1, PARTS, turn.shape[1] // PARTS)
        scores = np.einsum("npk,pwk->npw", x, books)
        left = (scores[:, 0, :, None] + scores[:, 1, None, :]).reshape(len(x), -1)
        right = (scores[:, 2, :, None] + scores[:, 3, None, :]).reshape(len(x), -1)
        for a, b, i, j in zip(left, right, left.argmax(1), right.argmax(1), strict=True):
            least = cap * (a[i] + b[j])
            p, q = np.flatnonzero(a + b[j] >= least), np.flatnonzero(b + a[i] >= least)
            u, v = np.nonzero(a[p][:, None] + b[q] >= least)
            found = p[u].astype(np.int64) * words**2 + q[v]
            best = int(i) * words**2 + int(j)
            yield np.r_[best, found[found != best]]


@functools.lru_cache(maxsize=64)
def cap_of(dim: int, words: int) -> float:
    """The cap, as a share of a vector's best score, that LIST directions of a random vector exceed on average."""
    unit, _ = unit_rows(np.random.default_rng([11, dim]).standard_normal((128, dim)))
    low, high = -1.0, 1.0
    if _code(dim, words, 0)[1].shape[1] ** PARTS <= LIST:
        return low
    low = 0.99
    while low > 0 and sum(map(len, _decoded(unit, words, 0, low))) < LIST * len(unit):
        low, high = low - 0.05, low
    for _ in range(10):
        cap = (low + high) / 2
        low, high = (cap, high) if sum(map(len, _decoded(unit, words, 0, cap))) > LIST * len(unit) else (low, cap)
    return low


@functools.lru_cache(maxsize=64)
def code_misses(dim: int, words: int, cosine: float, n: int = 1000) -> float:
    """The share of pairs at this cosine whose lists in one code are disjoint, on n random pairs with three misses added.

    Codes are turned at random, so the share holds for any pair, and codes miss a pair independently of each other.
    """
    r = np.random.default_rng([13, dim])
    x, _ = unit_rows(r.standard_normal((n, dim)))
    g = r.standard_normal(x.shape)
    g, _ = unit_rows(g - (g * x).sum(1, keepdims=True) * x)
    y = cosine * x + (1 - cosine**2) ** 0.5 * g
    cap = cap_of(dim, words)
    missed = sum(not np.intersect1d(a, b).size for a, b in zip(_decoded(x, words, 0, cap), _decoded(y, words, 0, cap), strict=True))
    return min((missed + 3) / n, 0.999)


def n_codes(dim: int, words: int, cosine: float) -> int:
    """So many codes that at most MISS of the pairs at this cosine share no listed direction; CODES at least."""
    return max(CODES, math.ceil(math.log(MISS) / math.log(code_misses(dim, words, cosine))))


def list_decode(unit: np.ndarray, words: int, seed: int = 0) -> np.ndarray:
    """The numbers of each row's listed directions in one code, the best first; short rows repeat the best."""
    lists = list(_decoded(unit, words, seed, cap_of(unit.shape[1], words)))
    out = np.repeat(np.array([[x[0]] for x in lists], np.int64).reshape(-1, 1), max(map(len, lists), default=1), axis=1)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def code_words(vectors: int) -> int:
    """Code words per block, such that two unrelated vectors share a listed direction about four times in `vectors`."""
    return max(4, round((CODES * LIST * LIST * max(vectors, 1) / 4) ** (1 / PARTS)))


def _decode(df: DataFrame, words: int, least: float) -> DataFrame:
    """id, m, v with cell and filters. Vectors of different lengths have different filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                v = part.column(2).to_pylist()
                out: list = [None] * len(v)
                for size in {len(x) for x in v}:
                    rows = [k for k, x in enumerate(v) if len(x) == size]
                    unit, _ = unit_rows(np.frombuffer(b"".join(v[k] for k in rows), np.float64).reshape(len(rows), -1))
                    dim, cap = unit.shape[1], cap_of(unit.shape[1], words)
                    codes = n_codes(dim, words, least)
                    for k, *lists in zip(rows, *(_decoded(unit, words, c, cap) for c in range(codes)), strict=True):
                        out[k] = np.concatenate([(x * codes + c) * 65536 + dim % 65536 for c, x in enumerate(lists)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([f[0] for f in out], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "m", "v", "cell", "filters"])

    return df.select("id", "m", "v").mapInArrow(run, "id long, m long, v binary, cell long, filters array<long>")


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked id to the smallest id of its component."""
    low_a, low_b, most = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(low_a, np.where(linked, low_b, most).min(1))
        new_b = np.minimum(low_b, np.where(linked, new_a[:, None], most).min(0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    ids, low = np.concatenate([a, b]), np.concatenate([low_a, low_b])
    return list({(int(x), int(y)) for x, y in zip(ids[ids != low], low[ids != low], strict=True)})


def _compare(rows: DataFrame, least: float) -> DataFrame:
    """u, v, n: with v null, u has n more links; else u and v are in one component. rows: same, a, b (packed blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for same, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = ([r["id"] for r in z] for z in (x, y))
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                u, w = (unit_rows(np.frombuffer(b"".join(r["v"] for r in z), np.float64).reshape(len(z), -1))[0] for z in (x, y))
                linked = u @ w.T >= least
                if same:
                    np.fill_diagonal(linked, False)
                if linked.any():
                    found += [(int(i), None, int(n)) for i, n in zip(a, linked @ np.array([r["m"] for r in y], np.int64), strict=True) if n]
                    if not same:
                        found += [(int(i), None, int(n)) for i, n in zip(b, linked.T @ np.array([r["m"] for r in x], np.int64), strict=True) if n]
                    found += [(i, j, 0) for i, j in _forest(linked, a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["u", "v", "n"])

    return rows.select("same", "a", "b").mapInArrow(run, "u long, v long, n long")


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """vec_id, n_links (other vectors at a cosine of at least `least`), component_id (the smallest id reachable by links)
    and kept (the id is that one), one row for each of df's.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null id
    (component_id null, kept) or vectors of different lengths. Equal vectors are one node with a weight. Rows that repeat an
    id and a vector count as other vectors; rows that repeat an id with another vector share its component. Candidates come
    from shared filters, so a link is found unless the lists are disjoint in all codes (at most MISS of the pairs at `least`).
    """
    x = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    fine = x.isNotNull() & ~F.exists(x, bad) & F.exists(x, lambda e: e != 0) & F.col(id_col).isNotNull()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), x).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([None if not r.is_valid else r.values.to_numpy(zero_copy_only=False).tobytes() for r in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed], names=["id", "v"])

    all_ = materialize(rows.mapInArrow(pack, "id long, v binary"), "vectors")
    nodes = materialize(all_.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")), "vector-nodes")
    decoded = _decode(nodes, code_words(nodes.count()), least)
    decoded = materialize(decoded, "vector-filters")
    cells = materialize(decoded.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "vector-cells")
    block = F.pmod(F.xxhash64("id"), "blocks")
    packed = decoded.join(cells, "cell").groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("id", "m", "v")).alias("rows"))
    packed = materialize(packed, "vector-blocks")
    listed = decoded.select("cell", F.explode("filters").alias("f")).distinct()
    many = listed.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f")
    listed = materialize(listed.join(many, "f"), "vector-listed")
    pairs = listed.select("f", F.col("cell").alias("c1")).join(listed.select("f", F.col("cell").alias("c2")), "f").filter("c1 < c2").select("c1", "c2").distinct()
    pairs = pairs.unionByName(cells.filter("size > 1").select(F.col("cell").alias("c1"), F.col("cell").alias("c2")))
    side = lambda c, b, r: packed.select(F.col("cell").alias(c), F.col("block").alias(b), F.col("rows").alias(r))
    tasks = pairs.join(side("c1", "b1", "a"), "c1").join(side("c2", "b2", "b"), "c2").filter("c1 <> c2 OR b1 <= b2")
    found = _compare(tasks.withColumn("same", F.expr("c1 = c2 AND b1 = b2")), least)
    found = materialize(found, "vector-links")
    links = found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    part = components(found.filter("v IS NOT NULL").select("u", "v"))
    node = nodes.select("v", F.col("id").alias("node"), "m").join(links.withColumnRenamed("u", "node"), "node", "left").join(part, "node", "left")
    out = all_.join(node, "v", "left")
    component = F.coalesce("component", "node", "id")
    n_links = F.coalesce(F.col("m") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))
    return out.select(F.col("id").alias("vec_id"), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
