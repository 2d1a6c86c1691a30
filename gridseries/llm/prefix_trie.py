"""Conversation prefix trie by time-forward processing.

Every distinct sequence of first turns (role, text) is a node, the empty one is
the root; the conversations that begin with it are its members.  Per node:
members, children, childless nodes below, tokens that sharing the prefix saves
below (a node saves its last text's words for all members but one), and the
conversations that end there.

Method: a node has a *time*, made so that the order of times is the reverse
level order (deepest level first).  A shard is a share of the conversations, by
the hash of their ids; it holds the nodes on the paths of its conversations.
Spark sorts a shard by time (external sort, spilling as any sort does), and one
pass over it takes each node, adds what its children have sent, and sends the
sum to the parent through a priority queue (``TimeQueue``): messages are
buffered, sorted into runs, and runs beyond ``QUEUE_ROWS`` messages spill to
files and are merged when their time comes.  What a node brings itself (its
childlessness, its savings) is brought once, in the shard of its smallest
member.  Across shards: a shard's root and upper nodes occur in other shards as
well, and the shards' sums of one node are added up.  Conversations of more than
``BAND`` turns are cut: a shard is then a share of the conversations in one band
of levels, its roots (the nodes on the band's first level) pass their totals to
the band above in a second run of the same pass over shard roots only.

Spark side: texts are read once and become 120-bit digests with a word count;
everything after that moves rows of about 100 bytes.  The key of a prefix is the
exclusive or of hashes of (turn digest, position), a running aggregate inside
blocks of ``BAND`` positions and over their totals; so no task needs a whole
conversation, and no string of turns is ever built.  Turns are numbered by a
range partitioning with the totals of earlier partitions as offsets; equal turns
are counted first.  Members, minima and sums are grouped aggregates, combined on
the map side: a root that has all conversations costs a row per task.  Parents
with more than 1/4096 of all nodes as children are at most 4,096 and alone are
broadcast.  The member list of a node is streamed through its SHA-256 in chunks
of ids that the range partitioning has sorted.  Tables read by several jobs are
checkpointed in the shared folder; spill files belong to one task, lie where
Spark spills its own sorts, and have no name, so a lost executor leaves nothing
behind and its tasks run again elsewhere.

Defined cases: turns are ordered by number, null first, ties by their digest;
repeated rows are repeated turns; null role and null text are empty; rows
without a conversation id belong to no conversation; other columns are ignored,
whatever their names; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridseries.llm.common import quoted, scratch_file
from gridseries.session import shared_dir

BAND = 1 << 16         # levels of a shard; positions of a block
QUEUE_ROWS = 1 << 20   # messages that a queue holds in memory
BLOCK_ROWS = 1 << 14   # messages read at once from a spilled run
CHUNK_IDS = 1 << 12    # member ids of one chunk
HOT_SHARE = 4096
NONE_SHA = hashlib.sha256(b"").hexdigest()
_LAST = (1 << 63) - 1
_TIME = "S32"          # shard, reversed level, key: four big-endian numbers
_NODE = ["depth", "hi", "lo"]


# --- turns -----------------------------------------------------------------------------------

def digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """conv_id, turn, thi, tlo (digest of role and text), words: one light row per row with a conversation id."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(quoted(conv_col).isNotNull()) \
        .select(quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).cast("long").alias("turn"), *_digest(role, text),
                F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return rows


def _digest(role: Column, text: Column) -> list[Column]:
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return [F.conv(F.substring(whole, a, 15), 16, 10).cast("long").alias(n) for n, a in (("thi", 1), ("tlo", 16))]


def ordered(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, thi, tlo, words) and (conv_id, size): the turns of every conversation, numbered from 0."""
    by = ["conv_id", "turn", "thi", "tlo"]
    same = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    runs = same.repartitionByRange(parts, *by).sortWithinPartitions(*by) \
        .mapInArrow(_count_on, "conv_id long, thi long, tlo long, words long, n long, before long, pid int").checkpoint()
    held = runs.groupBy("conv_id", "pid").agg(F.sum("n").alias("s"))
    sizes = held.groupBy("conv_id").agg(F.sum("s").alias("size"))
    ahead = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    # a partition goes on with at most one conversation of earlier ones: at most one row per partition
    carried = held.withColumn("carry", F.sum("s").over(ahead)).filter("carry > 0").select("conv_id", "pid", "carry")
    first = F.coalesce("carry", F.lit(0)) + F.col("before")
    turns = runs.join(F.broadcast(carried), ["conv_id", "pid"], "left") \
        .select("conv_id", first.alias("first"), "thi", "tlo", "words", "n",
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BAND).cast("long"))).alias("a")) \
        .select("conv_id", "first", "thi", "tlo", "words", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + (BAND - 1), F.col("n") - 1))).alias("k")) \
        .select("conv_id", (F.col("first") + F.col("k")).alias("pos"), "thi", "tlo", "words")
    return turns, sizes


def _count_on(batches):
    """Adds to sorted rows how many turns of their conversation this partition has before them, and the partition's number."""
    pid, last, carry = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv, n = (np.asarray(b.column(c), dtype=np.int64) for c in ("conv_id", "n"))
        start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        upto = np.cumsum(n)
        before = upto - n
        before -= np.repeat(before[start], np.diff(np.r_[start, len(conv)]))
        if conv[0] == last:
            before[: start[1] if len(start) > 1 else None] += carry
        last, carry = conv[-1], int(before[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("conv_id", "thi", "tlo", "words", "n")]
                                         + [pa.array(before), pa.array(np.full(len(conv), pid, np.int32))],
                                         ["conv_id", "thi", "tlo", "words", "n", "before", "pid"])


def with_shared_openings(turns: DataFrame, sizes: DataFrame, step: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The conversations rebuilt: conversation c takes its first h turns from conversation c - c % step.

    h is crc32 of c in decimal, modulo ``most``; all turns if that conversation
    has fewer, none if there is none.  The turns of c itself follow from its h-th.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base"))
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("lent"))
    taken = F.least(F.col("h"), F.coalesce("lent", F.lit(0)))
    convs = convs.join(lent, "base", "left").withColumn("taken", taken).checkpoint()
    heads = turns.filter((F.col("conv_id") % step == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    opening = convs.select("conv_id", "base", "h").join(heads, "base").filter("pos < h").select("conv_id", "pos", "thi", "tlo", "words")
    # a long conversation meets its row of ``convs`` block by block
    blocks = convs.filter("size > h").select("conv_id", "h", "taken", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BAND))).alias("block"))
    own = turns.withColumn("block", F.floor(F.col("pos") / BAND)).join(blocks, ["conv_id", "block"]).filter("pos >= h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "thi", "tlo", "words")
    return opening.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("size"))


# --- prefixes and nodes ------------------------------------------------------------------------

def prefixes(turns: DataFrame, sizes: DataFrame, deepest: int) -> DataFrame:
    """One row per conversation and depth: conv_id, depth, size, key (hi, lo), parent's key, key where its block began, last turn."""
    rows = turns.withColumn("block", F.floor(F.col("pos") / BAND)) \
        .withColumn("xhi", F.xxhash64("thi", "pos")).withColumn("xlo", F.xxhash64("tlo", "pos", F.lit(1)))
    blocks = sizes.filter("size > 0").select("conv_id", "size", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BAND))).alias("block"))
    if deepest > BAND:
        ahead = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("xhi").alias("a"), F.bit_xor("xlo").alias("b"))
        blocks = blocks.join(totals.select("conv_id", "block", F.bit_xor("a").over(ahead).alias("bhi"), F.bit_xor("b").over(ahead).alias("blo")),
                             ["conv_id", "block"])
    else:
        blocks = blocks.withColumns({"bhi": F.lit(None).cast("long"), "blo": F.lit(None).cast("long")})
    upto = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    keyed = rows.withColumn("ihi", F.bit_xor("xhi").over(upto)).withColumn("ilo", F.bit_xor("xlo").over(upto)) \
        .join(blocks, ["conv_id", "block"])
    bhi, blo = F.coalesce("bhi", F.lit(0)), F.coalesce("blo", F.lit(0))
    hi, lo = F.col("ihi").bitwiseXOR(bhi), F.col("ilo").bitwiseXOR(blo)
    below = keyed.select("conv_id", (F.col("pos") + 1).alias("depth"), "size", hi.alias("hi"), lo.alias("lo"),
                         hi.bitwiseXOR(F.col("xhi")).alias("phi"), lo.bitwiseXOR(F.col("xlo")).alias("plo"),
                         bhi.alias("bhi"), blo.alias("blo"), "thi", "tlo", "words")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    top = sizes.select("conv_id", zero.alias("depth"), "size", zero.alias("hi"), zero.alias("lo"), none.alias("phi"), none.alias("plo"),
                       zero.alias("bhi"), zero.alias("blo"), none.alias("thi"), none.alias("tlo"), zero.alias("words"))
    return below.unionByName(top)


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and thi, tlo, the digest of the last turn (null at the root).

    ``turns``: conv_id, pos (from 0, without gaps), thi, tlo, words; ``sizes``:
    conv_id, size, a row per conversation, also for those without turns.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sizes.checkpoint()
    deepest = sizes.agg(F.max("size")).first()[0] or 0
    paths = prefixes(turns, sizes, deepest).checkpoint()
    nodes = paths.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("reach"), F.max("words").alias("words"),
        *[F.max(c).alias(c) for c in ("phi", "plo", "bhi", "blo", "thi", "tlo")]).checkpoint()
    sums = _subtree_sums(paths, nodes, deepest, parts)
    ends = _ends(paths.filter("depth = size").select(*_NODE, "conv_id"), parts)

    # one row per node from its attributes, the shards' sums and the digest of those that end there
    zero, none = F.lit(0).cast("long"), F.lit(None)
    attributes = ["conv_id", "n_convs", "phi", "plo", "thi", "tlo"]
    rows = nodes.select(*_NODE, *attributes, zero.alias("leaves"), zero.alias("saved"), zero.alias("kids"), none.cast("string").alias("ends")) \
        .unionByName(sums.select(*_NODE, *[none.cast("long").alias(c) for c in attributes], "leaves", "saved", "kids", none.cast("string").alias("ends"))) \
        .unionByName(ends.select(*_NODE, *[none.cast("long").alias(c) for c in attributes], zero.alias("leaves"), zero.alias("saved"), zero.alias("kids"), "ends"))
    whole = rows.groupBy(*_NODE).agg(*[F.max(c).alias(c) for c in attributes], *[F.sum(c).alias(c) for c in ("leaves", "saved", "kids")],
                                     F.max("ends").alias("ends"))
    return _with_parents(whole, nodes).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE_SHA)).alias("ends_sha256"), "thi", "tlo")


def _with_parents(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id; the children of parents that have very many do not meet in one task."""
    total = nodes.count()
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent"))
    key = ["depth", "phi", "plo"]
    hot = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > total / HOT_SHARE).drop("n") \
        .join(parents, key).withColumnRenamed("parent", "hot_parent")  # at most HOT_SHARE rows
    rows = whole.join(F.broadcast(hot), key, "left")
    cold = F.col("hot_parent").isNull()
    keyed = rows.withColumns({"jd": F.when(cold, F.col("depth")).otherwise(-1), "jhi": F.when(cold, F.col("phi")).otherwise(F.col("hi")),
                              "jlo": F.when(cold, F.col("plo")).otherwise(F.col("lo"))})
    found = parents.select(F.col("depth").alias("jd"), F.col("phi").alias("jhi"), F.col("plo").alias("jlo"), "parent")
    return keyed.join(found, ["jd", "jhi", "jlo"], "left").withColumn("parent_conv_id", F.coalesce("hot_parent", "parent"))


# --- time-forward processing -------------------------------------------------------------------

def _subtree_sums(paths: DataFrame, nodes: DataFrame, deepest: int, parts: int) -> DataFrame:
    """depth, hi, lo, leaves, saved, kids: every shard's sums of the nodes it holds (a node may have a row in several shards)."""
    bands = deepest // BAND + 1
    zero = F.lit(0).cast("long")
    group = F.pmod(F.xxhash64("conv_id"), F.lit(parts))
    band = F.floor(F.col("depth") / BAND)
    shard = (group * bands + band).alias("shard")
    top = F.col("depth") % BAND == 0
    place = [shard, *_NODE, *[F.when(~top, F.col(c)).alias(c) for c in ("phi", "plo")]]
    carriers = paths.select(*place, zero.alias("leaves"), zero.alias("saved"), zero.alias("born"), zero.alias("kids"))
    owners = nodes.select(*place, (F.col("reach") == F.col("depth")).cast("long").alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.lit(1).cast("long").alias("born"), zero.alias("kids"))
    rows = carriers.unionByName(owners)
    if bands > 1:
        rows = rows.checkpoint()
        rows = rows.unionByName(_passed_up(paths, rows, bands, parts, group, band))
    return sweep(rows, parts)


def _passed_up(paths: DataFrame, rows: DataFrame, bands: int, parts: int, group: Column, band: Column) -> DataFrame:
    """What the roots of lower bands send to their parents, the last nodes of the band above: complete sums of all bands below."""
    local = sweep(rows.filter(F.col("shard") % bands > 0), parts).filter(F.col("depth") % BAND == 0)
    roots = paths.filter((F.col("depth") > 0) & (F.col("depth") % BAND == 0)).select(
        (group * bands + band).alias("shard"), *_NODE, "phi", "plo", "bhi", "blo").distinct()
    key = ["shard", *_NODE]
    # the roots alone are a trie again: a root's parent is the root of the band above (the block of its last turn began there)
    above = F.col("depth") > BAND
    contracted = local.join(roots, key).select(
        F.floor(F.col("shard") / bands).alias("shard"), F.floor(F.col("depth") / BAND).alias("depth"), "hi", "lo",
        F.when(above, F.col("bhi")).alias("phi"), F.when(above, F.col("blo")).alias("plo"), "leaves", "saved", "born", F.lit(0).cast("long").alias("kids"))
    done = sweep(contracted, parts).select(
        (F.col("shard") * bands + F.col("depth")).alias("shard"), (F.col("depth") * BAND).alias("depth"), "hi", "lo", "leaves", "saved", "born")
    sent = done.join(roots, key)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    target = sent.select((F.col("shard") - 1).alias("shard"), (F.col("depth") - 1).alias("depth"), F.col("phi").alias("hi"), F.col("plo").alias("lo"),
                         "leaves", "saved", zero.alias("arrived"), F.col("born").alias("kids"))
    return target.select("shard", *_NODE, none.alias("phi"), none.alias("plo"), "leaves", "saved", F.col("arrived").alias("born"), "kids")


def sweep(rows: DataFrame, parts: int) -> DataFrame:
    """Subtree sums inside shards: shard, depth, hi, lo, leaves, saved, born, kids, one row per node of a shard.

    ``rows``: shard, depth, key, parent's key (null: the parent is not in this
    shard, or another row of the node names it), and the node's own leaves, saved,
    born (1 in the one row that brings the node) and kids; rows of one node add up.
    """
    def number(c):
        return F.lpad(F.hex(c), 16, "0")

    def time(depth, hi, lo):
        return F.unhex(F.concat(number(F.col("shard")), number(F.lit(_LAST) - depth), number(hi), number(lo)))

    own = time(F.col("depth"), F.col("hi"), F.col("lo"))
    up = F.when(F.col("phi").isNotNull(), time(F.col("depth") - 1, F.col("phi"), F.col("plo"))).otherwise(own)
    timed = rows.select("shard", own.alias("time"), up.alias("up"), "leaves", "saved", "born", "kids")
    return timed.repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)).cast("int")).sortWithinPartitions("time") \
        .select("time", "up", "leaves", "saved", "born", "kids") \
        .mapInArrow(_forward, "shard long, depth long, hi long, lo long, leaves long, saved long, born long, kids long")


def _merged(times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal times become one, their values added; sorted by time."""
    order = np.argsort(times, kind="stable")
    times = times[order]
    start = np.flatnonzero(np.r_[True, times[1:] != times[:-1]])
    return times[start], np.add.reduceat(values[order], start, axis=0)


class Run:
    """Messages sorted by time, read from the front: in memory, or block by block from a file without a name."""

    def __init__(self, times: np.ndarray, values: np.ndarray, file=None):
        self.times, self.values, self.file = times, values, file
        if file is not None:
            self.kind = np.dtype([("t", _TIME), ("v", np.int64, values.shape[1:])])
            block = np.empty(len(times), self.kind)
            block["t"], block["v"] = times, values
            block.tofile(file)
            file.seek(0)
            self._load()

    def _load(self) -> None:
        block = np.fromfile(self.file, self.kind, BLOCK_ROWS)
        self.times, self.values = block["t"], block["v"]
        if not len(block):
            self.file.close()
            self.file = None

    def take(self, upto: bytes):
        while len(self.times):
            n = int(np.searchsorted(self.times, upto, side="right"))
            if n:
                yield self.times[:n], self.values[:n]
            self.times, self.values = self.times[n:], self.values[n:]
            if len(self.times) or self.file is None:
                return
            self._load()


class TimeQueue:
    """A priority queue of messages (time, numbers) that spills: ``take`` gives all messages up to a time, added up by time."""

    def __init__(self, width: int, most: int):
        self.width, self.most, self.runs, self.spilled = width, most, [], 0
        self._clear()

    def _clear(self) -> None:
        self.times, self.values, self.size, self.least = [], [], 0, None

    def push(self, times: np.ndarray, values: np.ndarray) -> None:
        if not len(times):
            return
        self.times.append(times)
        self.values.append(values)
        self.size += len(times)
        low = min(times.tolist())
        self.least = low if self.least is None else min(self.least, low)
        if self.size > self.most:
            self._seal(spill=True)

    def _seal(self, spill: bool) -> None:
        times, values = _merged(np.concatenate(self.times), np.concatenate(self.values))
        self._clear()
        self.spilled += spill
        self.runs.append(Run(times, values, scratch_file() if spill else None))

    def take(self, upto: bytes) -> tuple[np.ndarray, np.ndarray]:
        if self.least is not None and self.least <= upto:
            self._seal(spill=False)
        found = [piece for run in self.runs for piece in run.take(upto)]
        self.runs = [run for run in self.runs if len(run.times)]
        if not found:
            return np.empty(0, _TIME), np.empty((0, self.width), np.int64)
        return _merged(np.concatenate([t for t, _ in found]), np.concatenate([v for _, v in found]))


def _fixed(column) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.view(_TIME)


def _forward(batches):
    """Time-forward pass over rows sorted by time; the last node of a batch waits, as it may go on in the next one."""
    queue, held = TimeQueue(3, QUEUE_ROWS), None
    for b in batches:
        if not b.num_rows:
            continue
        times, ups = _fixed(b.column("time")), _fixed(b.column("up"))
        own = np.stack([np.asarray(b.column(c), dtype=np.int64) for c in ("leaves", "saved", "born", "kids")], axis=1)
        if held is not None:
            times, ups, own = (np.concatenate(x) for x in zip(held, (times, ups, own)))
        start = np.flatnonzero(np.r_[True, times[1:] != times[:-1]])
        sums = np.add.reduceat(own, start, axis=0)
        # a row without a parent's time names the node itself: the least time among the rows that differ is the parent's
        parent = times[start].copy()
        named = np.flatnonzero(ups != times)
        parent[np.searchsorted(start, named, side="right") - 1] = ups[named]
        held = times[start[-1:]], parent[-1:], sums[-1:]
        yield from _nodes(queue, times[start[:-1]], parent[:-1], sums[:-1])
    if held is not None:
        yield from _nodes(queue, *held)


def _nodes(queue: TimeQueue, times: np.ndarray, parent: np.ndarray, own: np.ndarray):
    """Whole nodes in time order: level by level, take what was sent to them, send the sums on."""
    if not len(times):
        return
    levels = np.frombuffer(times.tobytes(), np.uint8).reshape(-1, 32)[:, :16]
    cuts = [0, *(np.flatnonzero((levels[1:] != levels[:-1]).any(axis=1)) + 1).tolist(), len(times)]
    for a, z in zip(cuts, cuts[1:]):
        at, total = times[a:z], own[a:z].copy()
        sent_to, sent = queue.take(bytes(at[-1]).ljust(32, b"\0"))
        place = np.searchsorted(at, sent_to)
        if len(place) and (place[-1] >= len(at) or (at[place] != sent_to).any()):
            raise ValueError("a message for a node that is not in this shard")
        total[place, 0] += sent[:, 0]
        total[place, 1] += sent[:, 1]
        total[place, 3] += sent[:, 2]
        goes = parent[a:z] != at
        queue.push(parent[a:z][goes], total[goes][:, :3])
        numbers = np.frombuffer(at.tobytes(), ">i8").reshape(-1, 4).astype(np.int64)
        numbers[:, 1] = _LAST - numbers[:, 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (*numbers.T, *total.T)],
                                         ["shard", "depth", "hi", "lo", "leaves", "saved", "born", "kids"])


# --- conversations that end at a node ------------------------------------------------------------

def _ends(ends: DataFrame, parts: int) -> DataFrame:
    """depth, hi, lo, ends: SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are sorted by range, joined to chunks where they are, and only the chunks
    of a node meet, to be read in order; no task holds them all.
    """
    by = [*_NODE, "conv_id"]
    chunks = ends.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(
        _chunks, "depth long, hi long, lo long, first long, ids string")
    return chunks.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(
        _hashed, "depth long, hi long, lo long, ends string")


def _chunks(batches):
    for b in batches:
        if not b.num_rows:
            continue
        node = np.stack([np.asarray(b.column(c), dtype=np.int64) for c in _NODE], axis=1)
        ids = b.column("conv_id").to_pylist()
        edges = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]).any(axis=1)]).tolist() + [len(ids)]
        cuts = [(a, min(a + CHUNK_IDS, z)) for lo, z in zip(edges, edges[1:]) for a in range(lo, z, CHUNK_IDS)]
        at = [a for a, _ in cuts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in node[at].T]
            + [pa.array([ids[a] for a in at], pa.int64()), pa.array([",".join(map(str, ids[a:z])) for a, z in cuts], pa.string())],
            [*_NODE, "first", "ids"])


def _hashed(batches):
    node, state = None, None
    for b in batches:
        out = []
        for *at, ids in zip(*[b.column(c).to_pylist() for c in (*_NODE, "ids")]):
            if at == node:
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = at, hashlib.sha256(ids.encode())
        if out:
            yield _digest_rows(out)
    if node is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows):
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*_NODE, "ends"])


# --- whole tables ----------------------------------------------------------------------------------

def prefix_trie(conversations: DataFrame, shared_openings: bool = False, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns (see ``trie``); with ``shared_openings`` of the conversations rebuilt."""
    spark = conversations.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns, sizes = ordered(digests(conversations, conv_col, turn_col, role_col, text_col), parts)
    if shared_openings:
        turns, sizes = with_shared_openings(turns, sizes)
    return trie(turns, sizes)


def with_texts(nodes: DataFrame, conversations: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with role and text of their last turn (null at the root) in place of its digest."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = conversations.select(*_digest(role, text), role.alias("role"), text.alias("text")).dropDuplicates(["thi", "tlo"])
    return nodes.join(said, ["thi", "tlo"], "left").drop("thi", "tlo")
