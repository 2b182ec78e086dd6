"""Eight-word shingles, 16-function signatures and LSH.

Two word lists are similar if at least 15 of their 16 signature values agree. So they have a masked signature in common:
the signature with one value left out. Equal masks mean similar, and two different signatures share one mask at most, so
existence, numbers of links and greedy rounds are aggregations over 16 masks of every distinct signature, without a
candidate that must be checked and without pairs. Documents of one signature are a class; pairs of classes, and of
documents, are made where a caller asks for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import SPACES
from lexloom.session import discard, materialize

SHINGLE, FUNCTIONS, AGREE, TILES = 8, 16, 15, 4
BROADCAST = 10_000

# The hash functions (a * x + b) mod 2**64 mod 255, and the FNV hash's prime and start.
A = [
    0x12345678, 0x23456789, 0x3456789A, 0x456789AB, 0x56789ABC, 0x6789ABCD, 0x789ABCDE, 0x89ABCDEF,
    0x9ABCDEF0, 0xABCDEF01, 0xBCDEF012, 0xCDEF0123, 0xDEF01234, 0xEF012345, 0xF0123456, 0x01234567,
]
B = [
    0x87654321, 0x98765432, 0xA9876543, 0xBA987654, 0xCBA98765, 0xDCBA9876, 0xEDCBA987, 0xFEDCBA98,
    0x0FEDCBA9, 0x10FEDCBA, 0x210FEDCB, 0x3210FEDC, 0x43210FED, 0x543210FE, 0x6543210F, 0x76543210,
]
FNV_PRIME, FNV_START, MODULUS = 1099511628211, 146959810393466560, 255

_A, _B = np.array(A, np.uint64), np.array(B, np.uint64)


# Slices of rows, and blocks of shingles, that are worked on at a time: a worker holds some 100 bytes for each of their words.
ROWS, WORDS, BLOCK = 512, 1 << 18, 1 << 15
_BLANK = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV hashes (multiply, then xor; bytes sign-extended; modulo 2**64 - 1) of data[start:end], all ranges at once."""
    values = data.view(np.int8).astype(np.int64).view(np.uint64)
    size = end - start
    key = -size.astype(np.int16) if len(size) and size.max() < 1 << 15 else -size  # 16 bits are sorted by digits
    order = np.argsort(key, kind="stable")  # the longest first, so the ranges still open are a prefix
    start, size = start[order], size[order]
    longest = int(size[0]) if len(size) else 0
    still = len(size) - np.searchsorted(size[::-1], np.arange(longest), "right")
    h, got = np.full(len(start), FNV_START, np.uint64), np.empty(len(start), np.uint64)
    for k, n in enumerate(still.tolist()):
        x = h[:n]
        x *= np.uint64(FNV_PRIME)
        x ^= np.take(values[k:], start[:n], out=got[:n], mode="clip")  # clip: no second check, all are inside
    h[h == np.uint64(2**64 - 1)] = 0
    out = np.empty_like(h)
    out[order] = h
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, one after another, and the edges between texts. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    edges = np.frombuffer(places, kind, len(texts) + 1, texts.offset * kind.itemsize).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of texts, the bytes of all words without what separates them, the edges between words, and how many words
    each text has."""
    data, edges = _bytes(texts)
    word = ~_BLANK[data]
    before, after = np.empty_like(word), np.empty_like(word)  # whether the byte before, or after, is of the same text and a word's
    before[1:], after[:-1] = word[:-1], word[1:]
    begins = edges[:-1][np.diff(edges) > 0]
    before[begins], after[begins - 1] = False, False  # -1: the last byte ends the last text
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    return data[word], np.concatenate([[0], np.cumsum(last - first + 1)]), np.diff(np.searchsorted(first, edges))


def list_words(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text_words() of an array of word lists. A null list is an empty one."""
    return *_bytes(lists.flatten()), np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)


def shingle_hashes(data: np.ndarray, edges: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lists' shingles, one after another, and how many each list has. Words join without a separator. Fewer
    than eight words make one shingle; none, one with hash 0."""
    counts = np.maximum(n_words - SHINGLE + 1, 1)
    first_word = np.arange(counts.sum()) + np.repeat(np.cumsum(n_words) - n_words - np.cumsum(counts) + counts, counts)
    last_word = first_word + np.repeat(np.minimum(n_words, SHINGLE), counts)
    h = np.empty(len(first_word), np.uint64)
    for k in range(0, len(h), BLOCK):
        start, end = edges[np.minimum(first_word[k : k + BLOCK], len(edges) - 1)], edges[last_word[k : k + BLOCK]]
        h[k : k + BLOCK] = hash_ranges(data[start[0] : end[-1]], start - start[0], end - start[0])
    h[np.repeat(n_words == 0, counts)] = 0
    return h, counts


def _modulus(x: np.ndarray) -> np.ndarray:
    """x modulo 255, by sums of digits: 2**32, 2**16 and 2**8 are 1 modulo 255. x is overwritten."""
    for bits in (32, 16, 8):
        high = x >> np.uint64(bits)
        x &= np.uint64((1 << bits) - 1)
        x += high
    return (x.astype(np.uint16) % np.uint16(MODULUS)).astype(np.int16)


def sign(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signatures (lists x 16): per function the least value if it is below 128, else the last shingle's value."""
    first = np.cumsum(counts) - counts
    out, v = np.empty((len(counts), FUNCTIONS), np.int16), np.empty(len(hashes), np.int16)
    for j in range(FUNCTIONS):
        for k in range(0, len(v), BLOCK):
            v[k : k + BLOCK] = _modulus(_A[j] * hashes[k : k + BLOCK] + _B[j])
        low = np.minimum.reduceat(v, first) if len(first) else v[:0]
        out[:, j] = np.where(low < 128, low, v[first + counts - 1])
    return out


def slices(column: pa.Array):
    """The words of ROWS rows at a time, or of fewer where rows are long."""
    take = list_words if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else text_words
    k = 0
    while k < len(column):
        part = column.slice(k, ROWS)
        while len(part) > 1 and _length(part) > (WORDS if take is list_words else 8 * WORDS):
            part = part.slice(0, len(part) // 2)
        yield take(part)
        k += len(part)


def _length(part: pa.Array) -> int:
    """Words of lists, bytes of texts."""
    size = pc.list_value_length if pa.types.is_list(part.type) or pa.types.is_large_list(part.type) else pc.binary_length
    return pc.sum(size(part)).as_py() or 0


def _nested(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _signed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each row has, and signatures."""
    parts = [(n, sign(*shingle_hashes(data, edges, n))) for data, edges, n in slices(column)] or [(np.empty(0, np.int32), np.empty((0, FUNCTIONS), np.int16))]
    return np.concatenate([n for n, _ in parts]).astype(np.int32), np.concatenate([x for _, x in parts])


def _signatures(column: pa.Array) -> pa.Array:
    sig = _signed(column)[1]
    return _nested(np.full(len(sig), FUNCTIONS), pa.array(sig.ravel()))


def _counted_signatures(column: pa.Array) -> pa.Array:
    n, sig = _signed(column)
    return pa.StructArray.from_arrays([pa.array(n), _nested(np.full(len(sig), FUNCTIONS), pa.array(sig.ravel()))], ["n_words", "sig"])


def _shingles(column: pa.Array) -> pa.Array:
    parts = [shingle_hashes(*x) for x in slices(column)]
    texts = [pc.cast(pa.array(h), pa.string()) for h, _ in parts]
    return _nested(np.concatenate([c for _, c in parts] or [np.empty(0, np.int64)]), pa.concat_arrays(texts or [pa.array([], pa.string())]))


def _band_hashes(column: pa.Array) -> pa.Array:
    sig = np.array(column.to_pylist(), np.int16).reshape(-1, FUNCTIONS).astype(np.uint8)
    at = np.arange(len(sig) * 2) * SHINGLE
    return pa.array(hash_ranges(np.ascontiguousarray(sig).ravel(), at, at + SHINGLE).astype(str).reshape(-1, 2).tolist(), pa.list_(pa.string()))


def signature(word_list: Column) -> Column:
    """array<smallint> of the 16 distinct values, of a word list or of a text's words; null has none."""
    return F.arrow_udf(_signatures, "array<smallint>")(word_list)


def full_signature(sig: Column) -> Column:
    """All 64 values: the 16, four times."""
    return F.concat(*[sig] * TILES)


def shingles(word_list: Column) -> Column:
    """The shingle hashes in order, unsigned, as text, of a word list or of a text's words."""
    return F.arrow_udf(_shingles, "array<string>")(word_list)


def band_hashes(sig: Column) -> Column:
    """The hashes of the two distinct bands, unsigned, as text."""
    return F.arrow_udf(_band_hashes, "array<string>")(sig)


def add_signatures(df: DataFrame, *, id_col: str = "doc_id", text_col: str | None = "text", words_col: str | None = None) -> DataFrame:
    """id, n_words, sig of every row."""
    both = F.arrow_udf(_counted_signatures, "struct<n_words:int,sig:array<smallint>>")(F.col(words_col or text_col))
    return df.select(F.col(id_col).alias("id"), both.alias("both")).select("id", "both.n_words", "both.sig")


def _masks(column: pa.Array) -> pa.Array:
    sig = column.flatten().to_numpy().reshape(-1, FUNCTIONS).astype(np.uint8)
    out = np.repeat(sig[:, None, :], FUNCTIONS, axis=1)
    out[:, range(FUNCTIONS), range(FUNCTIONS)] = MODULUS  # no value of a signature
    edges = np.arange(0, out.size + 1, FUNCTIONS, dtype=np.int32)
    return _nested(np.full(len(sig), FUNCTIONS), pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(out)]))


def masks(sig: Column) -> Column:
    """array<binary>: the 16 values in a byte each, with each in turn left out (255)."""
    return F.arrow_udf(_masks, "array<binary>")(sig)


def distinct_signatures(signed: DataFrame) -> DataFrame:
    return signed.select("sig").distinct()


def _masked(signatures_: DataFrame, *others: str) -> DataFrame:
    """mask, sig and other columns: 16 rows for each of the distinct signatures."""
    return signatures_.select(F.explode(masks(F.col("sig"))).alias("mask"), "sig", *others)


def _sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted, not broadcast: a table of signatures is small in Parquet, its masks are not."""
    return df.hint("merge")


def similar_signatures(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (sig_a, sig_b) of a distinct signature on either side that agree in 15 values or all; no pair comes twice."""
    a, b = _masked(left).withColumnRenamed("sig", "sig_a"), _masked(right).withColumnRenamed("sig", "sig_b")
    near = a.join(_sorted_side(b), "mask").filter("sig_a <> sig_b").select("sig_a", "sig_b")
    return near.unionByName(left.join(right, "sig", "left_semi").select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b")))


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """id_a, id_b of similar rows of two signed tables. Empty word lists on the left are similar to nothing. The result can
    have as many rows as there are pairs; similar_classes() and links() do not."""
    left, right = left.filter("n_words > 0"), right
    pairs = similar_signatures(distinct_signatures(left), distinct_signatures(right))
    a, b = left.select(F.col("id").alias("id_a"), F.col("sig").alias("sa")), right.select(F.col("id").alias("id_b"), F.col("sig").alias("sb"))
    return pairs.join(a, F.col("sig_a") == F.col("sa")).join(b, F.col("sig_b") == F.col("sb")).select("id_a", "id_b")


def similar_within(signed: DataFrame) -> DataFrame:
    """id_a < id_b of all similar rows of one signed table with words."""
    return similar_pairs(signed.filter("n_words > 0"), signed.filter("n_words > 0")).filter("id_a < id_b")


def _classes(signed: DataFrame) -> DataFrame:
    """sig, class_id (the smallest id) and size of the classes of rows with words."""
    return signed.filter("n_words > 0").groupBy("sig").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size"))


def links(signed: DataFrame) -> DataFrame:
    """id, class_id (the smallest id of the same signature) and n_links (how many other rows are similar). Rows without words
    have no link and are their own class."""
    signed = materialize(signed.select("id", "n_words", "sig"), "signed")
    classes = materialize(_classes(signed), "shingle-classes")
    masked = _masked(classes, "size")
    weight = masked.groupBy("mask").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    near = masked.join(_sorted_side(weight), "mask").groupBy("sig").agg(F.sum(F.col("weight") - F.col("size")).alias("near"))
    of = classes.join(_sorted_side(near.withColumnRenamed("sig", "near sig")), F.col("sig") == F.col("near sig"), "left")
    of = of.select(F.col("sig").alias("class sig"), "class_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = signed.join(_sorted_side(of), (F.col("sig") == F.col("class sig")) & (F.col("n_words") > 0), "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar_classes(signed: DataFrame) -> DataFrame:
    """class_a < class_b: the pairs of similar classes, which with links() stand for all similar pairs of rows."""
    classes = materialize(_classes(signed), "shingle-classes").select("sig", "class_id")
    side = lambda x: _masked(classes, "class_id").select("mask", F.col("class_id").alias(x))
    return side("class_a").join(_sorted_side(side("class_b")), "mask").filter("class_a < class_b").select("class_a", "class_b")


def is_similar(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries with similar: whether a row of corpus is. Existence is decided per distinct signature, never per pair. Both
    tables' signatures are stored first, so each is signed once and one at a time; masks of BROADCAST signatures at most are
    broadcast."""
    queries = materialize(queries.select("id", "n_words", "sig"), "signed")
    corpus = materialize(distinct_signatures(corpus), "signed-corpus")
    known = _masked(corpus).select("mask").distinct()
    known = F.broadcast(known) if corpus.count() <= BROADCAST else _sorted_side(known)
    hit = _masked(distinct_signatures(queries.filter("n_words > 0"))).join(known, "mask", "left_semi").select(F.col("sig").alias("hit")).distinct()
    out = queries.join(_sorted_side(hit), F.col("sig") == F.col("hit"), "left")
    return out.select("id", "n_words", "sig", (F.col("hit").isNotNull() & (F.col("n_words") > 0)).alias("similar"))


def novel(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    return is_similar(queries, corpus).filter("NOT similar").drop("similar")


def greedy_dedup(signed: DataFrame) -> DataFrame:
    """The rows that stay if each is kept unless a kept one before it, by id, is similar. Empty lists always stay.

    Only a signature's first row can stay. In each round a mask knows its first kept and its first undecided signature:
    whoever has no earlier one of either kind in its masks is kept, and whoever has an earlier kept one is dropped. A round's
    states are a table in the shared folder. No join broadcasts, so the driver holds no states, masks or ids.
    """
    signed = materialize(signed, "signed")
    first = signed.groupBy("sig").agg(F.min("id").alias("first"), F.min(F.when(F.col("n_words") == 0, F.col("id"))).alias("empty"))
    state = materialize(first.withColumn("kept", F.lit(None).cast("boolean")), "greedy-state")
    while not state.filter("kept IS NULL").isEmpty():
        masked = _masked(state.filter("kept IS NULL OR kept"), "first", "kept")
        best = masked.groupBy("mask").agg(F.min(F.when(F.col("kept"), F.col("first"))).alias("stays"), F.min(F.when(F.col("kept").isNull(), F.col("first"))).alias("open"))
        seen = masked.filter("kept IS NULL").join(_sorted_side(best), "mask").groupBy(F.col("sig").alias("seen"))
        seen = seen.agg(F.coalesce(F.bool_or(F.col("stays") < F.col("first")), F.lit(False)).alias("near"), F.coalesce(F.bool_or(F.col("open") < F.col("first")), F.lit(False)).alias("waits"))
        decided = F.when(F.col("near"), False).when(~F.col("waits"), True)
        now = state.join(_sorted_side(seen), F.col("sig") == F.col("seen"), "left").select("sig", "first", "empty", F.coalesce("kept", decided).alias("kept"))
        state, old = materialize(now, "greedy-state"), state
        discard(old)
    stay = state.filter("kept").select(F.col("first").alias("id")).unionByName(state.filter("empty IS NOT NULL").select(F.col("empty").alias("id")))
    stay = stay.unionByName(signed.filter("n_words = 0").select("id")).distinct()
    return signed.join(_sorted_side(stay), "id", "left_semi")
