"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts are compared lower-cased with every run of white space as one blank.  An
item is cut into windows of ``WINDOW`` characters every ``STRIDE`` (the last one
ends with the item; a shorter item is one window).  A document is contaminated
by an item when some stretch of it aligns with a whole window at
``m * ERROR`` edits at most (m: the window's length; ERROR 1/16: 4 edits
in 64 characters).  So a verbatim stretch of ``WINDOW + STRIDE - 1`` characters
(71) of an item is always found, wherever it begins, and a whole item always.

Method: a stretch within k edits of a window shares at least m + 1 - q (k + 1)
of its character q-grams, all of them between k + 1 neighbouring diagonals
(document position minus window position).  q-grams of the benchmark are looked
up at every document position; hits are counted in bands of 2 (k + 1) diagonals
that overlap by half, so every such run of diagonals lies whole within one band.
Regions that reach the lemma's count are verified by banded alignment, all
regions of a slice together.  Nothing is missed: the count is a bound, not a
guess.  Windows of items shorter than ``WINDOW`` allow fewer edits where the bound
would fall to zero (none below 30 characters).  Windows of fewer than ``GRAM``
characters have no q-gram: they are looked up whole, by a hash of their length,
and compared.

Spark side: windows are made by Spark and dealt into blocks of bounded size by
a hash; one block at a time is broadcast (``BLOCK_CHARS`` characters at most) and
all documents pass by it in one ``mapInArrow``, no shuffle of texts.  Results are
one row per document, item and window.  A lost executor costs the re-run of its
tasks.  No candidate is capped: hits of a slice are handled in chunks.

Defined cases: a null text is the empty text and is clean; items with null or
blank texts never match; items without an id match under a null id; repeated
documents give each their own rows, repeated items count once; empty tables give
no matches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm.common import doc_view, map_slices, quoted
from gridseries.llm.quality_model import filter_rows

WINDOW, STRIDE, GRAM, LEAST, ERROR = 64, 8, 10, 1, 1 / 16
#: Characters of benchmark windows broadcast together.
BLOCK_CHARS = 8 << 20
#: Document characters compared together, and q-gram hits counted together.
SLICE, HITS = 1 << 20, 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(column):
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(column), r"[\s\p{Z}]+", " "))


@dataclass
class Windows:
    """Windows of the benchmark: item id, place in the item and code points of each."""

    item: list
    place: list[int]
    codes: list[np.ndarray]

    def build(self, gram: int) -> None:
        """The q-gram table: a hash bitmap, and (hash, window, position) sorted by hash."""
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.where(self.length >= WINDOW, (self.length * ERROR).astype(np.int64),
                              np.maximum(0, np.minimum((self.length * ERROR).astype(np.int64), (self.length - gram) // gram - 1)))
        self.least = self.length + 1 - gram * (self.edits + 1)
        flat = np.concatenate(self.codes)
        start = np.cumsum(self.length) - self.length
        h = gram_hashes(flat, gram)
        window = np.repeat(np.arange(len(self.codes)), self.length)
        at = np.arange(len(flat)) - start[window]
        ok = np.flatnonzero(at[: len(h)] <= self.length[window[: len(h)]] - gram)
        order = ok[np.argsort(h[ok], kind="stable")]
        self.hash, self.window, self.at = h[order], window[order].astype(np.int32), at[order].astype(np.int32)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        self.short = []  # (length, hashes, windows by hash) of windows without a q-gram
        for m in np.unique(self.length[self.length < gram]).tolist():
            mine = np.flatnonzero(self.length == m)
            h = np.array([gram_hashes(self.codes[i], m)[0] for i in mine], np.uint64)
            by = np.argsort(h, kind="stable")
            self.short.append((m, h[by], mine[by]))
        width = int(self.length.max())
        self.matrix = np.zeros((len(self.codes), width), np.uint32)
        self.matrix[np.arange(width) < self.length[:, None]] = flat


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of ``gram`` codes."""
    if len(codes) < gram:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - gram + 1, np.uint64)
    for i in range(gram):
        h = (h + codes[i : i + len(h)]) * _ODD
    return h ^ (h >> np.uint64(29))


def text_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def regions(windows: Windows, codes: np.ndarray, doc: np.ndarray, gram: int):
    """(window, first diagonal) of the bands that reach the lemma's count; ``doc`` numbers each character's document."""
    h = gram_hashes(codes, gram)
    pos = np.flatnonzero(windows.bits[(h >> np.uint64(42)).astype(np.int64)])
    pos = pos[doc[pos] == doc[pos + gram - 1]] if len(pos) else pos
    lo, hi = np.searchsorted(windows.hash, h[pos], "left"), np.searchsorted(windows.hash, h[pos], "right")
    n = hi - lo
    pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, found = np.cumsum(n), []
    cut = np.searchsorted(total, np.arange(HITS, int(total[-1]) + HITS, HITS), "left") + 1
    keys, counts = [], []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(pos)]):
        if a >= min(b, len(pos)):
            continue
        m = n[a:b]
        entry = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        w = windows.window[entry].astype(np.int64)
        half = windows.edits[w] + 1
        # document position minus window position, from 0 on: a window's text may begin before the slice by its edits
        diagonal = np.repeat(pos[a:b], m) - windows.at[entry] + WINDOW * 4
        band = diagonal // half
        key = w << 32 | band
        u, c = np.unique(np.concatenate([key, key - 1]), return_counts=True)  # band b holds half-bands b and b + 1
        keys.append(u)
        counts.append(c)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    w, band = key >> 32, key & 0xFFFFFFFF
    good = count >= np.maximum(windows.least[w], 1)
    found = w[good], band[good] * (windows.edits[w[good]] + 1) - WINDOW * 4
    return found


def verify(windows: Windows, codes: np.ndarray, doc: np.ndarray, window: np.ndarray, diagonal: np.ndarray):
    """(document number, edits, end) of each region's best alignment with its whole window, within the band; edits
    beyond the limit where there is none.  The alignment may begin and end anywhere in one document."""
    n = len(window)
    k = windows.edits[window]
    width = int((2 * (k + 1)).max()) + 2 * int(k.max()) + 1 if n else 0
    first = diagonal - k  # document position where diagonal 0 of the band begins
    size = len(codes)
    # the document of a region: that of the band's middle
    middle = np.clip(diagonal + windows.length[window] // 2 + k, 0, size - 1)
    own = doc[middle]
    offset = np.arange(width)
    big = 10_000
    cost = np.zeros((n, width), np.int64)  # before the window's first character: begin on any diagonal
    for i in range(int(windows.length[window].max()) if n else 0):
        live = i < windows.length[window]
        at = first[:, None] + offset + i
        inside = (at >= 0) & (at < size)
        at = np.clip(at, 0, size - 1)
        inside &= doc[at] == own[:, None]
        differs = (codes[at] != windows.matrix[window, i][:, None]) | ~inside
        step = cost + np.where(inside, differs, big)  # match or replace, along the diagonal
        skip = np.concatenate([cost[:, 1:], np.full((n, 1), big)], axis=1) + 1  # window character left out
        new = np.minimum(step, skip)
        new = np.minimum.accumulate(new - offset, axis=1) + offset  # document characters left out
        cost = np.where(live[:, None], np.minimum(new, big), cost)
    best = cost.argmin(axis=1) if n else np.zeros(0, np.int64)
    return own, cost[np.arange(n), best], first + best + windows.length[window]


def short_matches(windows: Windows, codes: np.ndarray, doc: np.ndarray):
    """(document number, window, edits, end) of the first place in each document where a window without a q-gram stands."""
    for m, hashes, by in windows.short:
        h = gram_hashes(codes, m)
        distinct, first = np.unique(hashes, return_index=True)
        at = np.minimum(np.searchsorted(distinct, h), len(distinct) - 1)
        pos = np.flatnonzero((distinct[at] == h) & (doc[: len(h)] == doc[m - 1 :][: len(h)]))
        _, new = np.unique(doc[pos] * len(distinct) + at[pos], return_index=True)
        pos = pos[new]
        lo = first[at[pos]]
        n = np.append(first, len(by))[at[pos] + 1] - lo
        window = by[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        pos = np.repeat(pos, n)
        ok = (codes[pos[:, None] + np.arange(m)] == windows.matrix[window, :m]).all(axis=1)
        yield doc[pos[ok]], window[ok], np.zeros(int(ok.sum()), np.int64), pos[ok] + m


def matches_in(windows: Windows, texts: list[str], gram: int = GRAM):
    """(text number, window number, edits, end in the text) of every match."""
    parts = [text_codes(t) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if not len(codes):
        return [np.zeros(0, np.int64)] * 4
    doc = np.repeat(np.arange(len(parts)), size)
    start = np.cumsum(size) - size
    w, diagonal = regions(windows, codes, doc, gram)
    out = [(d, w_, e, end - start[d]) for d, w_, e, end in short_matches(windows, codes, doc)]
    for lo in range(0, len(w), 4096):
        part = slice(lo, lo + 4096)
        own, edits, end = verify(windows, codes, doc, w[part], diagonal[part])
        ok = edits <= windows.edits[w[part]]
        out.append((own[ok], w[part][ok], edits[ok], (end - start[own])[ok]))
    if not out:
        return [np.zeros(0, np.int64)] * 4
    d, w, e, end = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((end, e, w, d))  # a match seen by two bands counts once, at its fewest edits
    d, w, e, end = d[order], w[order], e[order], end[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(d) else np.zeros(0, bool)
    return d[new], w[new], e[new], end[new]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, place, piece: the windows of all items."""
    n = F.length("t")
    last = F.greatest(n - WINDOW, F.lit(0))
    places = F.array_union(F.sequence(F.lit(0), last, F.lit(STRIDE)), F.array(last))
    return doc_view(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), normal(F.col("text")).alias("t")) \
        .filter(n >= LEAST).select("item_id", "t", F.explode(places).alias("place")) \
        .select("item_id", "place", F.expr(f"substring(t, place + 1, {WINDOW})").alias("piece"))


def _blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str):
    """The windows in broadcasts of at most BLOCK_CHARS characters (checked; dealt finer until they are)."""
    pieces = item_windows(items, id_col, text_col).distinct()  # repeated items count once, here and in the blocks
    most = BLOCK_CHARS // WINDOW
    n = max(1, -(-pieces.count() * 5 // (4 * most)))
    salt = F.xxhash64("item_id", "place", "piece")
    while n > 1 and pieces.groupBy(F.pmod(salt, F.lit(n))).count().agg(F.max("count")).first()[0] > most:
        n *= 2
    for i in range(n):
        rows = pieces.filter(F.pmod(salt, F.lit(n)) == i).orderBy("item_id", "place", "piece").collect()
        if rows:
            windows = Windows([r.item_id for r in rows], [r.place for r in rows], [text_codes(r.piece) for r in rows])
            windows.build(GRAM)
            yield spark.sparkContext.broadcast(windows)


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, place (window's start in the item), edits, doc_end (end of the stretch in the normal text)."""
    schema = "doc_id long, item_id long, place int, edits int, doc_end int"
    view = doc_view(docs, id_col, text_col).select("doc_id", normal(F.col("text")).alias("text"))
    found = spark.createDataFrame([], schema)
    for shared in _blocks(spark, items, item_id_col, item_text_col):
        def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            windows = shared.value
            d, w, e, end = matches_in(windows, b.column("text").to_pylist())
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(d)), pa.array([windows.item[i] for i in w], pa.int64()),
                 pa.array([windows.place[i] for i in w], pa.int32()), pa.array(e, pa.int32()), pa.array(end, pa.int32())],
                ["doc_id", "item_id", "place", "edits", "doc_end"])

        found = found.union(map_slices(view, run, schema, most=SLICE))
    return found


def leaked_items(spark: SparkSession, docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """doc_id, item_id, n_windows, least_edits: one row for each document and each item found in it."""
    return find_leaks(spark, docs, items, **columns).groupBy("doc_id", "item_id").agg(
        F.count_distinct("place").alias("n_windows"), F.min("edits").alias("least_edits"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    kept = docs.withColumn("__normal", normal(F.coalesce(quoted(text_col).cast("string"), F.lit(""))))
    for shared in _blocks(spark, items, item_id_col, item_text_col):
        def clean(texts: list[str], shared=shared) -> np.ndarray:
            ok = np.ones(len(texts), bool)
            ok[matches_in(shared.value, texts)[0]] = False
            return ok

        kept = filter_rows(kept, clean, "__normal", SLICE)
    return kept.drop("__normal")
