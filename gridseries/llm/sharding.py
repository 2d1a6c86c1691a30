"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with the same link value (equal texts, or a column) are neighbours.
Shards hold equally many rows (counts at most one apart), and neighbours should
share a shard: every linked pair in two shards is a cut edge.

Method: linked documents start in shards dealt in turn.  In each round a
document asks for the shard where most of its neighbours are (ties by hash);
every shard has a quota, and requests are granted up to it.  Documents of equal
link value and shard are interchangeable, so a round works on blocks (link,
shard, count) instead of rows: the wanted shard comes from an equi-join of the
blocks with their link's best block, granted moves are added to the blocks by a
grouped sum.  Quotas: the documents that a shard takes may exceed those it gives
by its room, the rows of it that no link binds (they fill up what is left at the
end).  The requests between shards are shards x shards numbers; they are scaled
down until every shard keeps its quota, so full shards can still swap.  Every
other round looks at shards with room only: what does not fit into a full shard
gathers in another one, and a link that sits in full shards altogether moves to
one with room.  Other moves always join at least as many neighbours as they
leave; the rounds end when two of them move nothing, or after ``rounds``.

A link that half a shard cannot hold is cut into pieces of about half a shard
by the hash of the id, and the pieces spread: no shard can hold it, so cut edges
between its pieces cannot be avoided.

Spark side: the texts are read once (size, checksum and link digest); everything
after that moves rows of about 100 bytes.  Numbering (rows of a link's piece,
rows without links, slots of a shard) is done in two levels: inside hash buckets,
as many as the square root of the rows, then over the totals of the buckets, so
no task needs a whole shard or link.  Links with more than 1/4096 of all rows are at
most 4,096: they alone are broadcast, and their rows are spread in the join.
Tables that several jobs read are checkpointed in the shared folder, so a lost
executor costs tasks only.  The driver sees shards x shards numbers a round.

Defined cases: a null text is the empty text (size 8, checksum 0) and equals it;
a null id is an id like others (rows without an id may be dealt otherwise when
the input is partitioned otherwise); repeated rows are rows of their own; other
columns are ignored, whatever their names; an empty table gives no rows; with
fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridseries.llm.common import quoted
from gridseries.session import shared_dir

SHARDS = 24
ROUNDS = 12
OVERHEAD = 8           # bytes a document takes besides its text
CELLS = 256            # hash cells inside which requests between two shards are granted in order
HOT_SHARE = 4096


def numbered(rows: DataFrame, keys: list[str], buckets: int, attach: DataFrame | None = None) -> DataFrame:
    """``rows`` with __nth, their number from 0 among the rows of equal ``keys``, in two levels.

    ``attach``: a table by ``keys`` whose columns come along (joined to the
    buckets, not to the rows).
    """
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "link", "salt"), F.lit(buckets)).cast("int"))
    by = [*keys, "__bucket"]
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ahead = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    if attach is not None:
        totals = totals.join(attach, keys)
    inside = W.partitionBy(*by).orderBy("doc_id", "link")
    return rows.withColumn("__in", F.row_number().over(inside) - 1).join(totals, by) \
        .withColumn("__nth", F.col("__before") + F.col("__in")).drop("__in", "__before", "__bucket")


def capacities(n: int, shards: int) -> list[int]:
    """Rows of every shard: at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the requests (from, to) are granted: no shard takes more than its room and what it gives."""
    grant = dict(asked)
    for _ in range(1000):
        over = False
        for t in range(len(room)):
            into = sum(v for (_, b), v in grant.items() if b == t)
            most = room[t] + sum(v for (a, _), v in grant.items() if a == t)
            if into > most:
                over = True
                grant |= _scaled({k: v for k, v in grant.items() if k[1] == t}, into, most)
        if not over:
            return grant
    # not settled: room alone, which holds whatever the others give
    for t in range(len(room)):
        into = {k: v for k, v in asked.items() if k[1] == t}
        grant |= into if sum(into.values()) <= room[t] else _scaled(into, sum(into.values()), room[t])
    return grant


def _scaled(flows: dict, total: int, most: int) -> dict:
    """Whole numbers in proportion to ``flows`` (their sum is ``total``) that add up to ``most``; the largest remainders are rounded up."""
    out = {k: v * most // total for k, v in flows.items()}
    for k in sorted(flows, key=lambda k: (-(flows[k] * most % total), k))[: most - sum(out.values())]:
        out[k] += 1
    return out


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _requests(blocks: DataFrame, room: list[int], turn: int) -> DataFrame:
    """(unit, s, t, n, most): blocks that ask to move from s to t, where ``most`` of the unit are.

    Odd turns look at shards with room only; a unit that sits in full shards
    altogether asks for one with room, drawn by hash.
    """
    roomy = turn % 2 == 1
    rank = F.struct("n", F.xxhash64("unit", "s", F.lit(turn)).alias("h"), "s")
    seen = F.when(F.element_at(_array(room), F.col("s") + 1) > 0, rank) if roomy else rank
    best = blocks.groupBy("unit").agg(F.count(F.lit(1)).alias("k"), F.max(seen).alias("top")).filter("k > 1")
    open_ = [s for s, r in enumerate(room) if r > 0]
    drawn = F.element_at(_array(open_), (F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(len(open_))) + 1).cast("int")) if open_ else F.lit(None)
    return blocks.join(best, "unit").withColumn("t", F.coalesce("top.s", drawn).cast("int")) \
        .filter((F.col("s") != F.col("t")) & (F.col("top").isNull() | (F.col("n") <= F.col("top.n")))) \
        .select("unit", "s", "t", "n", F.coalesce("top.n", F.lit(1)).alias("most"))


def _granted(asks: DataFrame, asked: dict, grant: dict) -> DataFrame:
    """(unit, s, t, m): the rows of every request that may move; larger groups first, exactly as many as granted."""
    if grant == asked:
        return asks.select("unit", "s", "t", F.col("n").alias("m"))
    limits = asks.sparkSession.createDataFrame([(s, t, int(v)) for (s, t), v in grant.items()], "s int, t int, quota long")
    asks = asks.withColumn("level", -F.floor(F.log2("most"))).withColumn("cell", F.pmod(F.xxhash64("unit"), F.lit(CELLS)))
    cell = ["s", "t", "level", "cell"]
    ahead = W.partitionBy("s", "t").orderBy("level", "cell").rowsBetween(W.unboundedPreceding, -1)
    totals = asks.groupBy(*cell).agg(F.sum("n").alias("c")) \
        .withColumn("ahead", F.coalesce(F.sum("c").over(ahead), F.lit(0))).drop("c")
    inside = W.partitionBy(*cell).orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("quota") - F.col("ahead") - F.coalesce(F.col("inside"), F.lit(0))
    return asks.withColumn("inside", F.sum("n").over(inside)).join(totals, cell) \
        .join(F.broadcast(limits), ["s", "t"]) \
        .select("unit", "s", "t", F.least(F.col("n"), left).alias("m")).filter("m > 0")  # limits: shards x shards rows


def propagate(blocks: DataFrame, size: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(unit, s, n) after the rounds: how many rows of each unit each shard holds."""
    k = len(size)
    blocks = blocks.checkpoint()
    idle = 0
    for turn in range(rounds):
        held = {r["s"]: r["n"] for r in blocks.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        room = [size[s] - held.get(s, 0) for s in range(k)]
        asks = _requests(blocks, room, turn).checkpoint()
        asked = {(r["s"], r["t"]): r["n"] for r in asks.groupBy("s", "t").agg(F.sum("n").alias("n")).collect()}
        grant = quotas(asked, room)
        if not sum(grant.values()):
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        moves = _granted(asks, asked, grant)
        blocks = blocks.unionByName(moves.select("unit", "s", (-F.col("m")).alias("n"))) \
            .unionByName(moves.select("unit", F.col("t").alias("s"), F.col("m").alias("n"))) \
            .groupBy("unit", "s").agg(F.sum("n").alias("n")).filter("n > 0").checkpoint()
    return blocks


def _light(docs: DataFrame, id_col: str, text_col: str, link_col: str | None) -> DataFrame:
    """One light row per document: the only place where texts are read."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    link = F.md5(text) if link_col is None else quoted(link_col).cast("string")
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text.alias("text"), link.alias("link"))
    return rows.select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"),
                       F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), "link",
                       F.when(F.col("doc_id").isNull(), F.spark_partition_id()).alias("salt"))


def balance(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text",
            link_col: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, link, law, shard, slot, grown_shard: every document's shard and its place there.

    ``link_col``: documents with the same value there are linked (null: no link), instead of those with equal texts.
    ``law`` is ``rows``: the shards' row counts are at most one apart;
    ``grown_shard`` is null, the assignment depends on all rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    light = _light(docs, id_col, text_col, link_col).checkpoint()
    n = light.count()
    size = capacities(n, shards)
    buckets = max(1, math.isqrt(n))
    piece = max(1, n // (2 * shards))

    # links of two rows and more, cut into pieces that half a shard can hold
    counts = light.filter("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter("n > 1") \
        .withColumn("parts", F.ceil(F.col("n") / piece))
    hot = F.broadcast(counts.filter(F.col("n") > n / HOT_SHARE).select("link", F.col("parts").alias("hot_parts")))  # at most HOT_SHARE rows
    spread = light.join(hot, "link", "left").withColumn(
        "key", F.when(F.col("hot_parts").isNull() & F.col("link").isNotNull(), F.col("link"))
        .otherwise(F.concat(F.lit("\0"), F.xxhash64("doc_id", "salt").cast("string"))))
    rest = counts.filter(F.col("n") <= n / HOT_SHARE).select(F.col("link").alias("key"), "parts")
    parts = F.coalesce("hot_parts", "parts")
    unit = F.when(parts.isNotNull(), F.concat_ws(":", "link", F.pmod(F.xxhash64(F.lit("piece"), F.col("doc_id"), F.col("salt")), parts)))
    marked = spread.join(rest, "key", "left").select(*light.columns, unit.alias("unit")).checkpoint()

    linked, free = marked.filter("unit IS NOT NULL"), marked.filter("unit IS NULL")
    start = numbered(linked.select("doc_id", "link", "salt", "unit"), [], buckets)
    blocks = start.groupBy("unit", F.pmod(F.col("__nth"), F.lit(shards)).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    blocks = propagate(blocks, size, rounds)

    # a unit's rows take its blocks in order; rows without links fill the shards up
    upto = W.partitionBy("unit").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    plan = blocks.withColumn("upto", F.sum("n").over(upto)).groupBy("unit") \
        .agg(F.array_sort(F.collect_list(F.struct("upto", "s"))).alias("plan"))  # one entry a shard
    placed = numbered(linked, ["unit"], buckets, plan) \
        .withColumn("shard", F.get(F.filter("plan", lambda b: b["upto"] > F.col("__nth")), F.lit(0))["s"])
    held = {r["s"]: r["n"] for r in blocks.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    ends, total = [], 0
    for s in range(shards):
        total += size[s] - held.get(s, 0)
        ends.append(total)
    filled = numbered(free, [], buckets) \
        .withColumn("shard", F.size(F.filter(_array(ends), lambda e: e <= F.col("__nth"))))
    columns = [*light.columns, F.col("shard").cast("int").alias("shard")]
    both = placed.select(*columns).unionByName(filled.select(*columns)).checkpoint()
    return numbered(both, ["shard"], buckets).select(
        "doc_id", "size", "text_crc32", "link", F.lit("rows").alias("law"), "shard", F.col("__nth").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(assigned: DataFrame) -> DataFrame:
    """(edges, cut): linked pairs, and those in two shards; from counts per link and shard, no pairs are made."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    per = assigned.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    sums = per.groupBy("link").agg(F.sum("n").alias("all"), F.sum(pairs("n")).alias("inside"))
    return sums.agg(F.coalesce(F.sum(pairs("all")), F.lit(0.0)).cast("long").alias("edges"),
                    F.coalesce(F.sum(pairs("all") - F.col("inside")), F.lit(0.0)).cast("long").alias("cut"))
