"""Quality classifier: histogram gradient-boosted trees over document statistics.

Method: every whole text becomes about two dozen statistics (sizes, shares of
character kinds, words, lines, repeats).  Trees of fixed depth are grown level
by level from histograms of gradients over ``BINS`` quantile bins, flattened
into arrays (feature, threshold, leaf value; children of node i are 2i+1 and
2i+2), and a batch of documents walks all trees at once by numpy indexing.

Spark side: labelled rows are joined to the documents, at most ``TRAIN_ROWS`` of
them (those of least id hash; a documented bound, so ids are broadcast and the
statistics collected); scoring is one ``mapInArrow`` over all documents, no
shuffle.  The model is some 100 KB and travels with the task.  Labels, language,
source and id are never inputs of a score.

Defined cases: a null text is the empty text and gets a score; labels that
contradict each other count as their mean, rounded; without any labelled row (or
with one class only) every document gets the smoothed share of label 1, which is
0.9 without labels; a row without an id is not held out; repeated rows give
repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.llm.common import doc_view, map_slices, quoted, slices

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS, DEPTH, TREES, RATE, LEAF_MIN, RIDGE = 64, 4, 80, 0.15, 8, 1.0

#: Text bytes looked at together; the statistics take some 60 bytes of memory for each.
SLICE = 1 << 20

#: Byte kinds counted as shares of the text.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\x0b\x0c\r", "newline": b"\n", "comma": b",;:", "stop": b".!?", "quote": b"\"'`", "bracket": b"()[]{}",
    "symbol": b"#*$%&|<>", "other": b"+-/=@\\^_~", "high": bytes(range(128, 256)),
}
FEATURES = [*KINDS, "bytes", "words", "lines", "word_mean", "line_mean", "short_words", "long_words", "distinct_words",
            "distinct_pairs", "repeated_lines", "upper_words", "digit_words", "bang", "line_ends", "entropy"]
_KIND = np.zeros(256, np.int64)
for _i, _b in enumerate(KINDS.values(), 1):
    _KIND[list(_b)] = _i
_ODD = np.uint64(0x9E3779B97F4A7C15)


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_power_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if not _power_cache or len(_power_cache[0]) < n:
        _power_cache[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)]), dtype=np.uint64) for x in (_ODD, _INVERSE)]
    return _power_cache[0][:n], _power_cache[1][:n]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document."""
    mixed = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16)))
    return np.bincount((mixed >> np.uint64(48)).astype(np.int64), minlength=n)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    n = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)  # one newline of its own ends each text
    size = np.fromiter(map(len, raw), np.int64, n)
    own = np.repeat(np.arange(n), size + 1)
    count = np.bincount(own * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    count[:, 10] -= 1
    total = np.maximum(size, 1)
    share = count / total[:, None]
    kinds = np.stack([share[:, list(b)].sum(axis=1) for b in KINDS.values()], axis=1)
    logs = np.log2(share, where=share > 0, out=np.zeros_like(share))
    power, inverse = _powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])

    def hashed(a, b):
        return (sums[b] - sums[a]) * inverse[a] * _ODD

    kind = _KIND[data]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    a, b = _runs(~blank)
    doc, length = own[a], b - a
    words = np.bincount(doc, minlength=n)
    per_word = np.maximum(words, 1)
    h = hashed(a, b)
    same = doc[1:] == doc[:-1]
    pair = (h[1:] * np.uint64(31) + h[:-1])[same]
    pairs = np.maximum(words - 1, 1)
    upper, digits = np.concatenate([[0], np.cumsum(kind == 2)]), np.concatenate([[0], np.cumsum(kind == 3)])
    bang = (data[b - 1] == 33).astype(float)
    la, lb = _runs(data != 10)
    ldoc = own[la]
    lines = np.bincount(ldoc, minlength=n)
    per_line = np.maximum(lines, 1)
    stop = np.isin(data[lb - 1], list(b".!?\"'")).astype(float)
    by_word = lambda v: np.bincount(doc, weights=v, minlength=n) / per_word
    columns = [np.log1p(size), np.log1p(words), np.log1p(lines), by_word(length), np.log1p(size / per_line),
               by_word(length <= 3), by_word(length > 12), _distinct(doc, h, n) / per_word,
               _distinct(doc[1:][same], pair, n) / pairs, 1 - _distinct(ldoc, hashed(la, lb), n) / per_line,
               by_word((upper[b] - upper[a]) * 2 > length), by_word((digits[b] - digits[a]) * 2 > length), by_word(bang),
               np.bincount(ldoc, weights=stop, minlength=n) / per_line, -(share * logs).sum(axis=1)]
    return np.concatenate([kinds, np.stack(columns, axis=1)], axis=1)


class Trees:
    """Boosted trees of fixed depth in arrays: feature and threshold [tree, inner node], value [tree, leaf]."""

    def __init__(self, prior: float):
        self.prior = prior
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int64)
        self.threshold = np.zeros((0, 2**DEPTH - 1))
        self.value = np.zeros((0, 2**DEPTH))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, all trees walked together."""
        n, t = len(x), len(self.feature)
        node = np.zeros((n, t), np.int64)
        tree, row = np.arange(t)[None, :], np.arange(n)[:, None]
        for _ in range(DEPTH):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.prior + self.value[tree, node - (2**DEPTH - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))) if len(x) else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, level-wise growth from gradient histograms."""
    share = (y.sum() + 0.9) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    total = np.full(len(y), model.prior)
    rows, f = np.arange(len(y)), x.shape[1]
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            key = (np.arange(f)[None, :] * width + (node - first)[:, None]) * BINS + binned
            g, h, c = (np.bincount(key.ravel(), weights=np.repeat(w, f), minlength=f * width * BINS).reshape(f, width, BINS).cumsum(axis=2)
                       for w in (grad, hess, np.ones(len(y))))
            gl, hl, cl = g[..., :-1], h[..., :-1], c[..., :-1]
            gt, ht, ct = g[..., -1:], h[..., -1:], c[..., -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((cl >= LEAF_MIN) & (ct - cl >= LEAF_MIN), gain, 0)
            flat = gain.transpose(1, 0, 2).reshape(width, -1)
            best = flat.argmax(axis=1)
            ok = flat[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(ok, best // (BINS - 1), 0)
            cut[first : first + width] = np.where(ok, best % (BINS - 1), BINS)
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        g, h = np.bincount(leaf, grad, 2**DEPTH), np.bincount(leaf, hess, 2**DEPTH)
        value = RATE * g / (h + RIDGE)
        total += value[leaf]
        # a bin above `cut` is a value above the edge of that number
        threshold = np.array([edges[i][k] if k < len(edges[i]) else np.inf for i, k in zip(feature, cut)])
        trees.append((feature, threshold, value))
    model.feature, model.threshold, model.value = (np.stack(v) for v in zip(*trees))
    return model


def held_out(id_column: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees learnt from at most ``train_rows`` labelled documents that are not held out."""
    known = labels.select(quoted(id_col).cast("long").alias("doc_id"), quoted(label_col).cast("double").alias("y")) \
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.round(F.avg("y")).alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = doc_view(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # at most train_rows rows of 16 bytes

    def run(batches):
        for b in slices(batches, most=SLICE):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(statistics(b.column("text").to_pylist())), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = texts.mapInArrow(run, "doc_id long, y double, x array<double>") \
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return train(x, rows.column("y").to_numpy())


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(statistics(b.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    done = map_slices(doc_view(docs, id_col, text_col), run, "doc_id long, score double, predicted int", most=SLICE)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    return filter_rows(docs, lambda texts: model.score(statistics(texts)) >= threshold, text_col)


def filter_rows(docs: DataFrame, wanted: Callable[[list[str]], np.ndarray], text_col: str = "text", most: int = SLICE) -> DataFrame:
    """The rows whose text passes ``wanted`` (called with a bounded slice of texts, nulls as empty texts)."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])

    def run(batches):
        for b in slices(batches, text_col, most):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(wanted(texts)))

    return docs.mapInArrow(run, schema)
