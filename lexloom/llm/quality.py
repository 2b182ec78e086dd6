"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in cycles. Each step fits a tree of few leaves to one feature's bins and adds it, shrunk,
to that feature's lookup table; then the pairs with the largest gain get tables over two coarser features each. A text's
score is the logistic of the sum of its entries. Fitting takes a sample of labelled rows with a documented bound, the
lookup tables are a few KB, and scoring adds table entries for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # at most so many labelled rows are fitted, those of the smallest hash of their id
BINS, PAIR_BINS, PAIRS = 32, 8, 5

FEATURES = (
    "log_words", "mean_word", "distinct_words", "top_word", "upper", "digits", "marks", "symbols", "spaces", "line_words",
    "distinct_lines", "stops", "longest_word", "repeats", "distinct_pairs", "ends",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_CLASSES = np.stack([_UPPER, _DIGIT, _MARK, _SYMBOL], 1).astype(np.float64)


def features(text: str | None) -> list[float]:
    """Numbers of one whole text; the empty text has zeros. Upper case is A-Z and two-byte capitals of Latin-1."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    upper, digits, marks, symbols = counts @ _CLASSES / size
    upper += sum(raw.count(b"\xc3" + bytes([c])) for c in range(0x80, 0x9F) if c != 0x97) / size if counts[0xC3] else 0.0
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), (size - counts[32]) / n, len(seen) / n, max(seen.values()) / n, float(upper), float(digits), float(marks), float(symbols),
        (counts[32] + counts[9]) / size, n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), int(counts[46]) / n, float(max(map(len, words))),
        sum(a == b for a, b in zip(words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines)),
    ]


def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(x.as_py()) for x in texts], pa.list_(pa.float64()))


def feature_column(text: Column) -> Column:
    return F.arrow_udf(_features, "array<double>")(text)


@dataclass
class Model:
    cuts: list[np.ndarray]  # of each feature, between its bins
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for a, b, t in self.pairs:
            out += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, ridge: float = 5.0) -> np.ndarray:
    """Leaf values, per bin, of the tree that splits the bins greedily into intervals."""
    spans = [(0, len(grad))]
    gain = lambda a, b: grad[a:b].sum() ** 2 / (hess[a:b].sum() + ridge)
    while len(spans) < leaves:
        best = max(((gain(a, k) + gain(k, b) - gain(a, b), i, k) for i, (a, b) in enumerate(spans) for k in range(a + 1, b)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15) -> Model:
    """No rows: every score is 0.5. One label only: all scores lean to it."""
    n = x.shape[1]
    m = Model([_cuts(x[:, j], BINS) if len(x) else np.empty(0) for j in range(n)], [_cuts(x[:, j], PAIR_BINS) if len(x) else np.empty(0) for j in range(n)])
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    if not len(x):
        return m
    p = (y.sum() + 1) / (len(y) + 2)
    m.base = float(np.log(p / (1 - p)))
    f = np.full(len(x), m.base)
    bins = [np.searchsorted(m.cuts[j], x[:, j], "right") for j in range(n)]
    for _ in range(rounds):
        for j in range(n):
            q = 1 / (1 + np.exp(-f))
            size = len(m.tables[j])
            step = rate * _tree(np.bincount(bins[j], y - q, size), np.bincount(bins[j], q * (1 - q), size))
            m.tables[j] += step
            f += step[bins[j]]
    coarse = [np.searchsorted(m.coarse[j], x[:, j], "right") for j in range(n)]
    q = 1 / (1 + np.exp(-f))
    gains = []
    for a in range(n):
        for b in range(a + 1, n):
            cell, size = coarse[a] * PAIR_BINS + coarse[b], PAIR_BINS * PAIR_BINS
            g, h = np.bincount(cell, y - q, size), np.bincount(cell, q * (1 - q), size)
            gains.append(((g * g / (h + 5)).sum(), a, b))
    for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
        m.pairs.append((a, b, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(pair_rounds):
        for a, b, t in m.pairs:  # a tree of depth two: a cut of one feature, then of the other in each half
            q = 1 / (1 + np.exp(-f))
            cell = coarse[a] * PAIR_BINS + coarse[b]
            g, h = (np.bincount(cell, v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS) for v in (y - q, q * (1 - q)))
            step, cut = np.zeros_like(g), _tree(g.sum(1), h.sum(1), leaves=2)
            for v in np.unique(cut):
                step[cut == v] = _tree(g[cut == v].sum(0), h[cut == v].sum(0), leaves=2)
            t += rate * step
            f += rate * step.ravel()[cell]
    return m


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `rows` labelled documents; no more reach the driver, however often an id is repeated.

    A label is 1 if the mean of the id's labels is at least one half; null ids and labels are left out. The sample takes the
    smallest hashes of the ids that docs has, so the table broadcast has `rows` short rows at most. Of an id's rows the one of
    the smallest text hash counts, once.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    some = one.join(docs.select(F.col(id_col).alias("lid")), "lid", "left_semi").orderBy(F.xxhash64("lid"), "lid").limit(rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("lid"))
    found = found.select("id", F.xxhash64("text").alias("h"), feature_column(F.col("text")).alias("x"), "y")
    got = found.groupBy("id").agg(F.min_by("x", "h").alias("x"), F.min("y").alias("y")).toArrow().sort_by("id")
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return x, got["y"].to_numpy().astype(np.float64)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the score (0 to 1) of every whole text; null and empty texts score alike. A column of that name is replaced."""

    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pa.array(model.score(x))

    return df.withColumn(score_col, F.arrow_udf(run, "double")(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trains: Column | None = None) -> DataFrame:
    """docs with score, fitted on the labels of rows where trains (a column over docs) holds; None: on all labels."""
    x, y = training_rows(docs if trains is None else docs.filter(trains), labels, id_col=id_col, text_col=text_col, label_col=label_col)
    return score(docs, fit(x, y), text_col)
