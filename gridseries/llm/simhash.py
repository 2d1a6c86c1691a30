"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprint: ASCII letters lower-cased, words are runs of bytes other than
0x20 and 0x09-0x0D, shingles are ``SHINGLE`` words joined by single spaces,
repeats included (fewer words: the whole sequence; none: fingerprint zero).
Each shingle's XXH64 (seed 42) votes for its bits; a bit is set if more than
half of the shingles set it.  Documents link when at most ``MAX_BITS`` bits
differ, a component is what links reach.

Method: distinct fingerprints are sorted by Gray rank; neighbours are grouped
into nodes of a tree.  A node holds the bits on which all its members agree and
which no node above it holds already (mask and pattern).  A search adds up the
differing bits of the masked patterns on the way down and drops a whole group
as soon as the sum passes the limit; groups already in the searcher's component
are dropped as well.

Spark side: 64 bits are cut into ``MAX_BITS + 2`` blocks; two fingerprints
within the limit agree on at least two blocks, so each fingerprint goes to the
group of every pair of blocks (15 rows of 16 bytes for 4 bits) and each group
gets an index of its own.  A group of more than ``GROUP_ROWS`` fingerprints is
cut into salted blocks and each pair of blocks is searched on its own: no group
is ever held whole, none is capped.  Tasks give back a spanning forest (one edge
per fingerprint at most), whose components are found by Spark jobs.  Equal
fingerprints are pre-aggregated, so a hot group of copies is one fingerprint.
Fingerprints and rounds are checkpointed in the shared folder.

Defined cases: a null or empty text has fingerprint zero and links like any
other; a row without an id gets the component's smallest id, null if there is
none; repeated rows stay and share a component; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.llm.common import doc_view, map_slices, quoted
from gridseries.llm.components import components
from gridseries.session import shared_dir

SHINGLE = 4
MAX_BITS = 4
FANOUT = 8
GROUP_ROWS = 50_000
#: Fingerprints indexed together in a task, and (query, node) pairs held at once.
CHUNK_ROWS = 200_000
FRONTIER = 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, last)], np.uint64)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        part = h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_slices(doc_view(docs, id_col, text_col), run, "doc_id long, fp long")


def _gray_rank(code: np.ndarray) -> np.ndarray:
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class _Level:
    """Nodes of one level: group, agreed bits and pattern, leaves [lo, hi), children [first, last) of the level below."""

    def __init__(self, group, agreed, pattern, lo, hi, first, last):
        self.group, self.agreed, self.pattern = group, agreed, pattern
        self.lo, self.hi, self.first, self.last = lo, hi, first, last
        self.own = agreed  # without the bits of the nodes above, once those exist
        self.root = np.zeros(len(group), bool)


class GrayIndex:
    """The hierarchical index over the codes of several groups; links never cross groups."""

    def __init__(self, group: np.ndarray, code: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((_gray_rank(code), group))
        self.order, self.group, self.code = order, group[order], code[order]
        n = len(code)
        i = np.arange(n)
        self.levels = [_Level(self.group, np.full(n, 2**64 - 1, np.uint64), self.code, i, i + 1, i, i)]
        low = self.levels[0]
        nodes = i  # nodes of `low` whose group goes on to the next level
        while len(nodes):
            g = low.group[nodes]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            place = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
            cut = np.flatnonzero(place % fanout == 0)
            both = np.bitwise_and.reduceat(low.agreed[nodes], cut)
            every = np.bitwise_and.reduceat(low.pattern[nodes] & low.agreed[nodes], cut)
            some = np.bitwise_or.reduceat(low.pattern[nodes] & low.agreed[nodes], cut)
            agreed = both & ~(every ^ some)
            ends = np.append(cut[1:], len(g)) - 1
            up = _Level(g[cut], agreed, every & agreed, low.lo[nodes[cut]], low.hi[nodes[ends]], nodes[cut], nodes[ends] + 1)
            low.own = low.agreed.copy()
            low.own[nodes] &= ~np.repeat(agreed, np.diff(np.append(cut, len(g))))
            alone = np.concatenate([[True], up.group[1:] != up.group[:-1]]) & np.concatenate([up.group[1:] != up.group[:-1], [True]])
            up.root = alone
            self.levels.append(up)
            nodes, low = np.flatnonzero(~alone), up
        self.label = np.arange(n)

    def link(self, most: int) -> np.ndarray:
        """Smallest position (in index order) that links reach, for every position."""
        top = []
        for k, level in enumerate(self.levels[1:], 1):
            r = np.flatnonzero(level.root)
            size = level.hi[r] - level.lo[r]
            q = np.concatenate([np.arange(a, b) for a, b in zip(level.lo[r], level.hi[r])]) if len(r) else np.empty(0, int)
            top.append((k, q, np.repeat(r, size)))
        for k, q, node in top:
            for lo in range(0, len(q), 4096):
                self._mark()
                self._descend(k, q[lo : lo + 4096], node[lo : lo + 4096], most)
        return self.label

    def _mark(self) -> None:
        """For every node the label that all its leaves share, else -1."""
        for level in self.levels[1:]:
            cut = np.stack([level.lo, level.hi], axis=1).ravel()
            lab = np.append(self.label, 0)
            low, high = np.minimum.reduceat(lab, cut)[::2], np.maximum.reduceat(lab, cut)[::2]
            level.one = np.where(low == high, low, -1)

    def _descend(self, k, q, node, most) -> None:
        stack = [(k, q, node, np.zeros(len(q), np.uint8))]
        while stack:
            k, q, node, so_far = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(k, q[half:], node[half:], so_far[half:]), (k, q[:half], node[:half], so_far[:half])]
                continue
            level = self.levels[k]
            so_far = so_far + np.bitwise_count((self.code[q] ^ level.pattern[node]) & level.own[node])
            ok = (so_far <= most) & (level.hi[node] - 1 > q)
            if k:
                ok &= level.one[node] != self.label[q]
            q, node, so_far = q[ok], node[ok], so_far[ok]
            if not len(q):
                continue
            if k == 0:
                self._union(q, node)
                continue
            n = level.last[node] - level.first[node]
            child = np.repeat(level.first[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            stack.append((k - 1, np.repeat(q, n), child, np.repeat(so_far, n)))

    def _union(self, a, b) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                return
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while True:
                deeper = label[label]
                if (deeper == label).all():
                    break
                label[:] = deeper


def _forest(group: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, other code) edges that join what links join, at most one for each code."""
    count = np.unique(group, return_inverse=True, return_counts=True)
    many = count[2][count[1]] > 1
    if not many.any():
        return code[:0], code[:0]
    index = GrayIndex(group[many], code[many])
    label = index.link(most)
    own = np.flatnonzero(label != np.arange(len(label)))
    return index.code[own], index.code[label[own]]


def _edges(most: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def work(upto=None):
            nonlocal held, size
            group, code = (np.concatenate(x) for x in zip(*held))
            n = len(group) if upto is None else int(np.searchsorted(group, group[-1]))
            held, size = [(group[n:], code[n:])], len(group) - n
            a, b = _forest(group[:n], code[:n], most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((np.asarray(batch.column("cell")), np.asarray(batch.column("fp")).view(np.uint64)))
                size += batch.num_rows
                if size >= CHUNK_ROWS:
                    yield work("the last group may go on")
        if size:
            yield work()

    return run


def links(fps: DataFrame, most: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b) fingerprints, a forest with the components of all links; ``fps``: distinct column fp."""
    blocks = most + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:])]
    keys = [F.xxhash64(F.lit(i), part[x], part[y]) for i, (x, y) in enumerate(combinations(range(blocks), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows) \
        .select("key", F.ceil(F.col("n") / group_rows).cast("int").alias("parts"))
    salted = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) \
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit("salt")), "parts").cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # at most group_rows/2 * 2 fingerprints meet in a cell: (own, other), smaller salt first
    cell = F.when(F.col("parts") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    cells = salted.select(cell.alias("cell"), "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_edges(most), "a long, b long")


def _rooted(nodes: DataFrame, most: int, group_rows: int) -> DataFrame:
    """``nodes`` (distinct column fp and others) with the root of each component."""
    roots = components(links(nodes.select("fp"), most, group_rows))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row, nulls included: rows with the same two are equal rows."""
    parts = []
    for f in docs.schema.fields:
        c = quoted(f.name)
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        parts += [c.isNull(), F.to_json(F.struct(c)) if nested else c]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, most: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    shared_dir(spark)  # the checkpoint folder
    fps = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    rooted = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), most, group_rows)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Of several rows with that id the one of least row hash stays, so a re-run chooses the same; of the
    component's rows without an id one stays too.
    """
    shared_dir(spark)
    named = docs.withColumns(dict(zip(("__a", "__b"), _row_keys(docs))))
    view = named.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"), "__a", "__b")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "__a", "__b")], pa.array(fp.view(np.int64))], ["doc_id", "a", "b", "fp"])

    fps = map_slices(view, run, "doc_id long, a long, b long, fp long").checkpoint()
    row = F.struct("doc_id", "a", "b")
    has_id = F.col("doc_id").isNotNull()
    least = fps.groupBy("fp").agg(F.min(F.when(has_id, row)).alias("with_id"), F.min(F.when(~has_id, row)).alias("without"))
    first = _rooted(least, most, GROUP_ROWS).groupBy("root").agg(F.min("with_id").alias("with_id"), F.min("without").alias("without"))
    keep = first.select(F.explode(F.array("with_id", "without")).alias("r")).filter("r is not null") \
        .select(F.col("r.a").alias("__a"), F.col("r.b").alias("__b"))
    # equal rows first: they are put together on the map side, so no key has many rows in the join
    return named.dropDuplicates(["__a", "__b"]).join(keep, ["__a", "__b"], "left_semi").select(*[quoted(c) for c in docs.columns])
