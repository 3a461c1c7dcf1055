"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the text (no language, source, label or id) are binned by
quantiles; trees grow level by level from sums of gradients in the bins. All
trees lie in flat arrays, so a batch of documents goes down all of them with a
few numpy steps. Features and scores are computed where the documents are; only
the statistics of a bounded sample of labelled documents come to the driver.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.llm.common import text_of

#: Most labelled documents to fit on (in expectation); bins; trees; their depth; step size; least documents in a leaf.
LABELLED, BINS, TREES, DEPTH, RATE, LEAF = 20_000, 64, 80, 4, 0.15, 8
#: From this score on a document is predicted to be good.
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _OTHER, _CONTROL = range(7)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER)
    kind[:128] = _CONTROL
    kind[33:127] = _MARK
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    return kind.astype(np.uint8)


_KIND = _classes()
FEATURES = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "mark", "other", "control", "commonest_mark", "sentence_marks", "bars", "entropy",
    "word_bytes", "word_bytes_spread", "longest_word", "distinct_words", "commonest_word", "repeated_next", "repeated_pairs",
    "lines", "distinct_lines", "words_a_line", "ends_in_mark", "ends_in_two_marks", "starts_upper", "long_words",
)


def statistics(text: str) -> list[float]:
    """The features of a text; all are finite, an empty text included."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [math.log1p(size)] + [0.0] * (len(FEATURES) - 1)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = np.bincount(_KIND, counts, 7) / size
    marks = np.where(_KIND == _MARK, counts, 0)
    p = counts[counts > 0] / size
    kind = _KIND[raw]
    word = kind != _SPACE
    last = np.flatnonzero(word & ~np.append(word[1:], False))
    first = np.flatnonzero(word & ~np.append([False], word[:-1]))
    lengths = last - first + 1
    in_mark = kind[last] == _MARK
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(size), math.log1p(n), *shares.tolist(), marks.max() / size, (counts[46] + counts[33] + counts[63]) / n, counts[124] / n, float(-(p * np.log2(p)).sum()),
        lengths.mean(), lengths.std(), math.log1p(lengths.max()), len(set(words)) / n, Counter(words).most_common(1)[0][1] / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, 1 - pairs / max(1, n - 1),
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(n / len(lines)), in_mark.mean(), (in_mark & (kind[np.maximum(last - 1, 0)] == _MARK)).mean(),
        (kind[first] == _UPPER).mean(), (lengths > 15).mean(),
    ]


class Trees:
    """Complete binary trees of one depth in flat arrays: per tree 2^depth - 1 splits and 2^depth leaves."""

    def __init__(self, base: float, depth: int) -> None:
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, (1 << depth) - 1), np.int64)
        self.cut = np.zeros((0, (1 << depth) - 1))
        self.leaf = np.zeros((0, 1 << depth))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sum of the leaves that each row of ``x`` reaches."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.leaf[trees, node - (1 << self.depth) + 1].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, leaf: int = LEAF, penalty: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss. Without both labels the score is the smoothed share of the label."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(math.log(share / (1 - share)), depth)
    if len(y) < 2 * leaf or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin k: above cuts[k - 1], up to cuts[k]
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            width, start = 1 << level, (1 << level) - 1
            at = node - start
            best = np.full(width, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                code = at * bins + binned[:, j]
                sums = [np.bincount(code, w, width * bins).reshape(width, bins) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = ([np.cumsum(s, axis=1)[:, : len(c)] for s in sums], [s.sum(axis=1, keepdims=True) for s in sums])
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(nl < leaf) | (nt - nl < leaf)] = 0
                k = gain.argmax(axis=1)
                value = gain[np.arange(width), k]
                better = value > best
                best[better], feature[start:][:width][better], cut[start:][:width][better] = value[better], j, c[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - (1 << depth) + 1
        leaves = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + penalty)
        model.feature, model.cut, model.leaf = np.vstack([model.feature, feature]), np.vstack([model.cut, cut]), np.vstack([model.leaf, leaves])
        margin += leaves[at]
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text])


def learn_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Trees:
    """Trees fitted on the labelled documents among those where ``learn_from`` (over the labels' columns) is true.

    If there are more than ``labelled``, those with the smallest hashes of their
    ids are taken, ``labelled`` of them in expectation; so the sample that is
    broadcast and whose statistics come to the driver is bounded. Null labels and
    ids are left out; of contradicting labels of one id the larger counts.
    """
    marked = labels.where(learn_from).select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__label")).where("__id IS NOT NULL AND __label IS NOT NULL")
    many = marked.count()
    if many > labelled:
        marked = marked.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * labelled / many))
    marked = marked.groupBy("__id").agg(F.max("__label").alias("__label"))
    known = docs.select(F.col(f"`{id_col}`").alias("__doc"), text_of(text_col).alias("__text")).join(F.broadcast(marked), F.col("__doc") == F.col("__id"))
    rows = known.select("__id", _statistics("__text").alias("x"), "__label").collect()  # about ``labelled`` rows at most
    rows.sort(key=lambda r: (r["__id"], r["x"]))  # the same trees however the table is stored
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array([r["__label"] for r in rows], float) if rows else np.zeros(0))


def quality_score(model: Trees, text: Column) -> Column:
    """The score, from 0 to 1, of a column of texts (null: empty)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.array([statistics(t) for t in texts])))

    return score(F.coalesce(text, F.lit("")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; learns from all labelled rows.

    A null text is scored as an empty one; texts of any length are read whole;
    ids decide nothing but what is learnt from, and rows with a null id are kept
    or not like any other; rows that repeat have one fate. Without labels every
    row scores the same; an empty table gives an empty one.
    """
    model = learn_quality(docs, labels, F.lit(True), id_col, text_col)
    return docs.where(quality_score(model, F.col(f"`{text_col}`")) >= threshold)
