"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

The 2 * sqrt(N) most frequent of N training tokens' words have vectors of their own; all other words share the vectors of
buckets, a quarter as many, which go by a hash of a word's last three bytes. Words, buckets and the end token are the leaves of a tree of three levels, ordered by
frequency; two words before a token give its context vector, and the token's probability is that of its path: at each
level a softmax over the children, exactly normalised by matrix products. So vocabulary and classes grow with the corpus,
and a token costs three times the cube root of their number. Targets start at zero, which makes the untrained model the
unigram model. Inside a bucket words have absolutely discounted unigram probabilities; what the discount frees is shared
by as many unseen words as the counts of rare words suggest. Over all these the probabilities add up to one after any context.

Replicas train on documents dealt by a hash of their ids and texts, in an order fixed by that hash, and are averaged by
their tokens. Their number depends on the corpus alone, so scores do not depend on partitions, files or the cluster.

Texts are split once, into batches of codes with a dictionary of word hashes for each batch; counting, training and scoring
read those. Counts cover all training documents. The FREQUENT commonest words go to the tasks as arrays of that bound; the
others' counts reach the documents by a join on word hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import discard, materialize

FREQUENT, DIM, NOISE, ROUNDS, RATE, STEPS = 1 << 17, 8, 1, 2, 0.2, 1000
LEVELS = ((0, 2), (1, 2))  # those that a batch trains, by turns
_CASE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_key(word: bytes) -> int:
    """47 bits of a hash of the word and 16 of one of its last three bytes, as a negative number."""
    return (xxhash.xxh64_intdigest(word, 42) & ((1 << 63) - (1 << 16)) | xxhash.xxh32_intdigest(word[-3:]) & 0xFFFF) - (1 << 63)


def tokens(text: str | None) -> list[bytes]:
    """A-Z in lower case; words between ASCII white space."""
    return (text or "").encode().translate(_CASE).split()


class _Local(dict):
    """Word to its number in the batch, from 1 on; 0 is the end token."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Tree:
    """Leaves in the order given, width to a parent; two levels of parents. shares: of the leaves."""

    def __init__(self, shares: np.ndarray):
        self.n = len(shares)
        self.width = max(2, int(np.ceil(self.n ** (1 / 3))))
        while self.width**3 < self.n:
            self.width += 1
        w = self.width
        self.shares = [np.add.reduceat(shares, np.arange(0, self.n, step)) for step in (w * w, w, 1)]
        self.counts = [len(x) for x in self.shares]
        self.offsets = [0, self.counts[0], self.counts[0] + self.counts[1]]
        log = [np.log(x) for x in self.shares]
        whole = np.log(shares.sum())
        self.bias = np.concatenate([log[0] - whole, log[1] - log[0][np.arange(self.counts[1]) // w], log[2] - log[1][np.arange(self.n) // w]]).astype(np.float32)

    def rivals(self, leaves: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each leaf its node at a level, and the first and the number of the nodes that this one competes with."""
        w = self.width
        at = leaves // w ** (2 - level)
        first = at // w * w if level else np.zeros_like(at)
        most = np.minimum(w, self.counts[level] - first) if level else np.full_like(at, self.counts[0])
        return at + self.offsets[level], first + self.offsets[level], most


class LogBilinear:
    """contexts (leaves x dim), nodes (nodes of all levels x dim), scales (2 x dim). The last number of a context is always
    one, so that of a node is its bias."""

    def __init__(self, shares: np.ndarray, dim: int | None = None, seed: int = 1):
        self.tree, dim = Tree(shares), dim or DIM
        r = np.random.default_rng(seed)
        self.contexts = r.normal(0, 0.3, (self.tree.n, dim)).astype(np.float32)
        self.nodes = np.zeros((len(self.tree.bias), dim), np.float32)
        self.nodes[:, -1] = self.tree.bias
        self.scales = np.ones((2, dim), np.float32)
        self.squares = [np.full_like(x, 1e-2) for x in self.weights()]

    def weights(self) -> list[np.ndarray]:
        return [self.contexts, self.nodes, self.scales]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.weights():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def mixed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * self.scales[0]
        x += b * self.scales[1]
        x[:, -1] = 1
        return x

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, levels: tuple[int, ...], r: np.random.Generator) -> None:
        """One NCE step: at each of the levels the node of the path against NOISE others of its parent, drawn evenly, all under
        the normaliser 1."""
        a, b, size = _rows(self.contexts, one), _rows(self.contexts, two), len(target)
        x = self.mixed(a, b)
        rows, offset = np.empty((size, len(levels), 1 + NOISE), np.int64), np.empty((size, len(levels), 1), np.float32)
        for k, level in enumerate(levels):
            own, first, most = self.tree.rivals(target, level)
            rows[:, k, 0] = own
            rows[:, k, 1:] = first[:, None] + (r.random((size, NOISE), np.float32) * most[:, None]).astype(np.int64)
            offset[:, k, 0] = np.log(NOISE / most)
        nodes = _rows(self.nodes, rows.reshape(size, -1))
        logit = np.einsum("ikj,ij->ik", nodes, x).reshape(rows.shape) - offset
        error = -1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        error[:, :, 0] += 1
        error = error.reshape(size, -1)
        back = np.einsum("ik,ikj->ij", error, nodes)
        back[:, -1] = 0
        self._update(1, *_rows_sum(rows.ravel(), (error[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1])))
        self._update(0, *_rows_sum(np.concatenate([one, two]), np.concatenate([back * self.scales[0], back * self.scales[1]])))
        self._update(2, np.arange(2), np.stack([(back * a).sum(0), (back * b).sum(0)]))

    def _update(self, k: int, rows: np.ndarray, g: np.ndarray) -> None:
        """AdaGrad on the rows that have a gradient."""
        w, s = self.weights()[k], self.squares[k]
        now = _rows(s, rows)
        now += g * g
        s[rows] = now
        np.sqrt(now, out=now)
        g *= RATE
        g /= now
        g += _rows(w, rows)
        w[rows] = g

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, r: np.random.Generator, batch: int) -> None:
        """The tokens are dealt to the batches at random. Every token trains its leaf; the two levels above take turns."""
        order = r.permutation(len(target))
        for k, at in enumerate(range(0, len(order), batch)):
            at = order[at : at + batch]
            self.step(one[at], two[at], target[at], LEVELS[k % len(LEVELS)], r)

    def log_probs(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, exactly normalised at each level."""
        out = np.empty(len(target))
        for at in range(0, len(target), 1 << 18):
            k = slice(at, at + (1 << 18))
            out[k] = self._log_probs(one[k], two[k], target[k])
        return out

    def _log_probs(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        both = np.sort(target.astype(np.int64) << 18 | np.arange(len(target)))  # then the tokens of a parent stand together at every level
        order, t = both & ((1 << 18) - 1), both >> 18
        x = self.mixed(self.contexts[one[order]], self.contexts[two[order]])
        lp, w = np.zeros(len(t)), self.tree.width
        ones = np.ones(w, np.float32)
        for level, step in enumerate((w**3, w * w, w)):  # the tokens of a node's parent
            first = np.flatnonzero(np.diff(t // step, prepend=-1))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(t)]):
                low = int(t[i]) // step * w
                n = min(w, self.tree.counts[level] - low)
                o = self.tree.offsets[level] + low
                for a in range(i, j, 1 << 14):
                    z = min(j, a + (1 << 14))
                    s = x[a:z] @ self.nodes[o : o + n].T
                    own = s.ravel().take(np.arange(0, n * (z - a), n) + (t[a:z] // (step // w) - low))
                    np.exp(s, out=s)
                    lp[a:z] += own - np.log(s @ ones[:n])
        out = np.empty(len(t))
        out[order] = lp
        return out


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at], much faster."""
    return x.take(at, axis=0, mode="clip")


def _rows_sum(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their values. Sorting row and place as one number keeps the order of summation."""
    both = np.sort(at.astype(np.int64) << 24 | np.arange(len(at)))
    s = both >> 24
    first = np.flatnonzero(np.diff(s, prepend=-1))
    return s[first], np.add.reduceat(_rows(values, both & 0xFFFFFF), first, axis=0)


class Vocabulary:
    """keys of the frequent words, the commonest first, and their counts; the figures that all words share; the leaves."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens_: int, distinct: int, documents: int, once: int, twice: int):
        self.keys, self.counts, self.documents = keys, counts, documents
        self.tokens, self.distinct = tokens_, distinct  # with end tokens
        self.discount = once / (once + 2 * twice) if once > 0 and twice > 0 else 0.5
        self.unseen = max(1.0, once * (once - 1) / (2 * (twice + 1)))  # words there are but that no training text has
        self.own = min(len(keys), max(1000, int(2 * tokens_**0.5)))
        self.buckets = max(1, self.own // 4)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys & 0xFFFF) % self.buckets

    def add_buckets(self, totals: np.ndarray, words: np.ndarray) -> None:
        """totals, words: tokens and distinct words by bucket, those with vectors of their own included."""
        at, c = self.bucket(self.keys[: self.own]), self.counts[: self.own]
        totals = totals - np.bincount(at, c, self.buckets)
        words = words - np.bincount(at, minlength=self.buckets)
        self.reserve = self.discount * words.sum() / self.buckets or 1.0  # of each bucket, for unseen words
        self.mass = np.maximum(totals - self.discount * words, 0.0) + self.reserve
        share = np.r_[c, self.documents, self.mass].astype(np.float64) + 0.5
        order = np.argsort(-share, kind="stable")
        self.shares = share[order] / share.sum()
        leaf = np.empty(len(order), np.int64)
        leaf[order] = np.arange(len(order))
        self.end, self.bucket_leaf = int(leaf[self.own]), leaf[self.own + 1 :]
        bucket = self.bucket(self.keys)
        self.leaf_of = np.where(np.arange(len(self.keys)) < self.own, np.r_[leaf[: self.own], np.zeros(len(self.keys) - self.own, np.int64)], self.bucket_leaf[bucket])
        inside = np.log10(np.maximum(self.counts - self.discount, 1e-9)) - np.log10(self.mass[bucket])
        self.inside_of = np.where(np.arange(len(self.keys)) < self.own, 0.0, inside)
        self.unseen_log = float(np.log10(self.reserve / max(1.0, self.unseen / self.buckets)))  # of an unseen word, before the bucket's mass

    @property
    def replicas(self) -> int:
        """So many that their weights together are about a byte for each token."""
        return max(1, round(self.tokens**0.5 / 256))

    @property
    def batch(self) -> int:
        return int(np.clip(self.tokens // self.replicas // STEPS, 128, 2048))

    @functools.cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The frequent words' keys in order, and their ranks."""
        order = np.argsort(self.keys)
        return self.keys[order], order

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The ranks of words by their keys, -1 for those that are not frequent."""
        known, rank = self.places
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, rank[at], -1)

    def leaves(self, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The leaves of the end token and of a batch's words."""
        own = self.bucket_leaf[self.bucket(keys)]
        own[ranks >= 0] = self.leaf_of[ranks[ranks >= 0]]
        return np.r_[self.end, own]

    def contexts(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves one and two before each token; before a text stand ends."""
        one = np.r_[self.end, leaves[:-1]]
        return one, np.where(one == self.end, self.end, np.r_[self.end, one[:-1]])


def pack(leaves: np.ndarray) -> bytes:
    """Three bytes each."""
    return leaves.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int64)


TEXTS = 1000  # in a batch of codes at most
CODED = "ids array<string>, trains array<boolean>, sizes array<int>, keys binary, codes binary"


def code(docs: DataFrame) -> DataFrame:
    """One row for each batch of docs (id as string, text, trains): the texts' token counts, the keys of the batch's words,
    and the codes of all tokens, one text after another with its end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch, local, codes, sizes = whole.slice(at, TEXTS), _Local(), [], []
                for t in batch.column(1):
                    w = tokens(t.as_py())
                    codes += [np.fromiter(map(local.__getitem__, w), np.int32, len(w)), np.zeros(1, np.int32)]
                    sizes.append(len(w) + 1)
                keys = np.fromiter(map(word_key, local), np.int64, len(local))
                row = [batch.column(0).to_pylist(), batch.column(2).to_pylist(), sizes, keys.tobytes(), pack(np.concatenate(codes))]
                kinds = (pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["ids", "trains", "sizes", "keys", "codes"])

    return docs.select("id", "text", "trains").mapInArrow(run, CODED)


def _coded(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """trains, sizes, keys, codes and further columns of each batch of codes."""
    for b in batches:
        c = {n: b.column(k) for k, n in enumerate(b.schema.names)}
        for k in range(b.num_rows):
            trains, sizes = (c[n][k].values.to_numpy(zero_copy_only=False) for n in ("trains", "sizes"))
            yield trains.astype(bool), sizes.astype(np.int64), np.frombuffer(c["keys"][k].as_py(), np.int64), unpack(c["codes"][k].as_py()), *(c[n][k].as_py() for n in more)


def count_words(coded: DataFrame) -> DataFrame:
    """key and c of every distinct word of all texts that train."""
    kinds = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trains, sizes, keys, codes in _coded(batches):
            c = np.bincount(codes[np.repeat(trains, sizes)], minlength=len(keys) + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array(keys[c > 0]), pa.array(c[c > 0])], schema=kinds)

    return coded.select("trains", "sizes", "keys", "codes").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, documents: int, frequent: int | None = None) -> Vocabulary:
    """The frequent words are those whose counts lie in the highest of fixed count ranges that hold at most `frequent`
    words together; histograms find them, so no task sorts the vocabulary."""
    level, frequent = F.floor(F.log2("c") * 32), frequent or FREQUENT
    one = lambda c: F.sum(F.when(F.col("c") == c, 1).otherwise(0))
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("t"), one(1).alias("once"), one(2).alias("twice")).collect()
    levels.sort(key=lambda r: -r["level"])  # 2048 rows at most
    cut, n = None, 0
    for r in levels:
        if n + r["n"] > frequent:
            break
        cut, n = r["level"], n + r["n"]
    rows = counts.filter(level >= cut).toArrow().to_pandas() if cut is not None else None
    keys, c = (np.empty(0, np.int64),) * 2 if rows is None else (rows["key"].to_numpy(), rows["c"].to_numpy())
    order = np.lexsort((keys, -c))
    total = lambda x: sum(r[x] for r in levels)
    v = Vocabulary(keys[order], c[order], total("t") + documents, total("n") + (documents > 0), documents, total("once"), total("twice"))
    totals, words = np.zeros(v.buckets), np.zeros(v.buckets, np.int64)
    for r in counts.groupBy(F.pmod(F.col("key").bitwiseAND(F.lit(0xFFFF)), F.lit(v.buckets)).alias("b")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("n")).collect():  # a row for each bucket, FREQUENT / 4 at most
        totals[r["b"]], words[r["b"]] = r["t"], r["n"]
    v.add_buckets(totals, words)
    return v


CHUNK = 1 << 18  # tokens that are shuffled together


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """replica, number and leaves of runs of one replica's texts of CHUNK tokens or a little more; rows: replica, leaves."""
    now, k, held, size = None, 0, [], 0
    for b in batches:
        for replica, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if held and (replica != now or size >= 3 * CHUNK):
                yield now, k, unpack(b"".join(held))
                k, held, size = k + 1 if replica == now else 0, [], 0
            now = replica
            held.append(raw.as_py())
            size += len(held[-1])
    if held:
        yield now, k, unpack(b"".join(held))


def train(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """The average of replicas after the last round, over the texts of code() that train.

    Each round takes its share of the texts and starts from the average of the round before. Replicas send their weights in
    pieces, and pieces are summed in two steps on the executors, so the driver gets one model per round.
    """
    model = LogBilinear(vocab.shares)
    many, batch, lots = vocab.replicas, vocab.batch, int(np.ceil(vocab.replicas**0.5))
    shared = coded.sparkSession.sparkContext.broadcast(vocab)
    for k in range(rounds):
        start = coded.sparkSession.sparkContext.broadcast(model.flat())

        def deal(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:
            """A hash of id and leaves deals the texts to rounds and replicas, and orders them."""
            v = shared.value
            for trains, sizes, keys, codes, ids in _coded(batches, "ids"):
                raw = pack(v.leaves(keys, v.ranks(keys))[codes])
                ends, rows = 3 * np.cumsum(sizes), []
                for i in np.flatnonzero(trains):
                    x = raw[ends[i] - 3 * sizes[i] : ends[i]]
                    h = xxhash.xxh64_intdigest(x, xxhash.xxh32_intdigest(ids[i] or ""))
                    if (h >> 40) % rounds == k:
                        rows.append((h % many, h >> 1, x))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["replica", "h", "leaves"])

        def run(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            v, now, m, seen = shared.value, None, None, 0
            for replica, chunk, leaves in _chunks(batches):
                if replica != now:
                    if m is not None:
                        yield _pieces(m.flat(), float(seen), now, lots)
                    now, m, seen = replica, LogBilinear(v.shares), 0
                    m.load(start.value)
                m.train(*v.contexts(leaves), leaves, np.random.default_rng([k, replica, chunk]), batch)
                seen += len(leaves)
            if m is not None:
                yield _pieces(m.flat(), float(seen), now, lots)

        mine = coded.select("ids", "trains", "sizes", "keys", "codes").mapInArrow(deal, "replica int, h long, leaves binary")
        mine = mine.repartitionById(many, F.col("replica")).sortWithinPartitions("replica", "h", "leaves").select("replica", "leaves")
        sums = mine.mapInArrow(run, _PIECE)
        for keys in (("piece", "lot"), ("piece",)):
            sums = sums.repartition(*keys).sortWithinPartitions("piece", "lot", "who").mapInArrow(functools.partial(_add, len(keys) == 2), _PIECE)
        got = sorted(sums.collect(), key=lambda x: x["piece"])
        if got:
            model.load(np.concatenate([np.frombuffer(x["v"], np.float64) / x["n"] for x in got]))
    return model


_PIECE, _PIECES = "piece int, lot int, who int, n double, v binary", 32


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["piece", "lot", "who", "n", "v"])


def _pieces(flat: np.ndarray, n: float, who: int, lots: int) -> pa.RecordBatch:
    return _batch([(p, who % lots, who, n, x.tobytes()) for p, x in enumerate(np.array_split(flat, _PIECES))])


def _add(lots: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of equal (piece, lot), weighted by their tokens, or of equal piece, that come one after another."""
    now, total, n = None, None, 0.0
    for b in batches:
        for piece, lot, _, m, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key, x = (piece, lot if lots else 0), np.frombuffer(v, np.float32) * np.float64(m) if lots else np.frombuffer(v, np.float64)
            if key != now:
                if now is not None:
                    yield _batch([(*now, 0, n, total.tobytes())])
                now, total, n = key, np.zeros(len(x)), 0.0
            total, n = total + x, n + m
    if now is not None:
        yield _batch([(*now, 0, n, total.tobytes())])


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trains: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every row, learning from rows where trains holds (None: all).

    Null and empty texts are one end token. Without a training row every word is unseen: base_score counts with N = V = 0,
    score is that of an untrained model. Rows that repeat an id are scored one by one. Other columns are not read.
    """
    kind = df.select(F.col(id_col)).schema[0].dataType
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.lit(True) if trains is None else F.coalesce(trains, F.lit(False))).alias("trains"))
    coded = materialize(code(docs).withColumn("batch", F.monotonically_increasing_id()), "lm-codes")
    counts = materialize(count_words(coded), "lm-counts")
    learned = coded.agg(F.sum(F.size(F.filter("trains", lambda x: x)))).first()[0] or 0
    vocab = vocabulary(counts, learned)
    model = train(coded, vocab, rounds)
    shared, weights = (df.sparkSession.sparkContext.broadcast(x) for x in (vocab, model.flat()))
    kinds = pa.schema([("batch", pa.int64()), ("at", pa.int32()), ("id", pa.string()), *((x, pa.int64()) for x in ("n_tokens", "n_known")), ("base", pa.float64()), ("lm", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        m = LogBilinear(v.shares)
        m.load(weights.value)
        base, mass = np.r_[np.log10(v.counts + 0.1), 0.0], np.log10(v.mass)
        within = np.r_[v.inside_of, 0.0]
        for _, sizes, keys, codes, ids, number in _coded(batches, "ids", "batch"):
            rank = v.ranks(keys)  # of each word of the batch; what follows holds the end token's figure first
            leaf, known = v.leaves(keys, rank), np.r_[v.documents > 0, rank >= 0]
            log_base = np.r_[np.log10(v.documents + 0.1), base[rank]]
            inside = np.r_[0.0, np.where(rank >= 0, within[rank], -mass[v.bucket(keys)])]
            first, rare, leaves = np.cumsum(sizes) - sizes, np.r_[False, rank < 0][codes], leaf[codes]
            lm = m.log_probs(*v.contexts(leaves), leaves) / np.log(10) + inside[codes]
            ends = np.cumsum(np.add.reduceat(rare, first, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(keys[codes[rare] - 1]))
            sums = [np.add.reduceat(known[codes], first, dtype=np.int64), np.add.reduceat(log_base[codes], first), np.add.reduceat(lm, first)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), number)), pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(ids, pa.string()), pa.array(sizes), *map(pa.array, sums), lists], schema=kinds)

    rows = coded.mapInArrow(run, "batch long, at int, id string, n_tokens long, n_known long, base double, lm double, rare array<long>")
    rows = materialize(rows, "lm-rows")
    discard(coded)
    seen = rows.select("batch", "at", F.explode("rare").alias("key")).groupBy("key", "batch", "at").agg(F.count(F.lit(1)).alias("tf")).join(counts, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    inside = F.when(F.col("c") > 0, F.log10(F.col("c") - F.lit(vocab.discount))).otherwise(F.lit(vocab.unseen_log))
    extra = seen.groupBy("batch", "at").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("x_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 0.1)).alias("x_base"), F.sum(F.col("tf") * inside).alias("x_lm")
    )
    out = rows.drop("rare").join(extra, ["batch", "at"], "left")
    each = float(np.log10(vocab.tokens + 0.1 * (vocab.distinct + 1)))
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        F.col("id").cast(kind).alias("id"), "n_tokens", add("n_known", "x_known").alias("n_known"), F.lit(int(vocab.tokens)).cast("long").alias("train_tokens"),
        (add("base", "x_base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), add("lm", "x_lm").alias("score"),
    )
