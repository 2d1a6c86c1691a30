import zlib
from collections import Counter, defaultdict

import pytest

from gridseries.llm import queries
from gridseries.llm import sharding as S

from helpers import SF001, SF01, no_docs, odd_docs, rows_of


def check(rows, got, shards):
    """Every document once, sizes and checksums as counted here, rows at most one apart, slots without gaps."""
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r.slot)
    counts = [len(held[s]) for s in range(shards)]
    assert set(held) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def groups(rows, got):
    """text -> shard -> rows (ids are unique here)."""
    at = {r.doc_id: r.shard for r in got}
    out = defaultdict(Counter)
    for i, t in rows:
        out[t or ""][at[i]] += 1
    return out


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_keeps_its_law_and_groups_together(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(sf, "documents")]
    df = queries.op11_balanced_shards(spark, sf)
    got = df.collect()
    check(rows, got, 24)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                               "slot": "bigint", "grown_shard": "int"}
    half = len(rows) // 48
    for t, at in groups(rows, got).items():
        if sum(at.values()) <= half:
            assert len(at) == 1, (len(t), at)


def test_hot_link_takes_few_shards(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i // 2}") for i in range(300)] + [(2000 + i, f"own {i}") for i in range(500)]
    got = S.balance(spark.createDataFrame(rows, "doc_id long, text string"), 24)
    done = got.collect()
    check(rows, done, 24)
    at = groups(rows, done)
    assert all(len(v) == 1 for t, v in at.items() if t != "hot")
    assert len(at["hot"]) <= 17  # 8 shards would hold it; pieces of half a shard take at most one each
    edges, cut = S.cut_edges(got).first()
    assert edges == 400 * 399 // 2 + 150 and cut == sum(a * b for x, a in at["hot"].items() for y, b in at["hot"].items() if x < y)


def test_no_room_at_all(spark):
    """Every row has a copy: shards can only swap."""
    rows = [(i, f"t{i % 240}") for i in range(480)]
    got = S.balance(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(rows, got, 8)
    whole = sum(len(v) == 1 for v in groups(rows, got).values())
    assert whole > 150  # dealt in turn without moves it would be about 30


def test_odd_rows_small_and_empty_tables(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    check(rows, S.balance(odd_docs(spark), 24).collect(), 24)
    check(rows, S.balance(odd_docs(spark), 3).collect(), 3)
    assert S.balance(no_docs(spark)).count() == 0
    clash = odd_docs(spark).selectExpr("*", "1 AS shard", "'x' AS unit", "2 AS link", "3 AS salt")
    check(rows, S.balance(clash, 3).collect(), 3)
    none = spark.createDataFrame([(None, "same")] * 40 + [(1, None), (1, ""), (1, "")], "doc_id long, text string")
    check([(r.doc_id, r.text) for r in none.collect()], S.balance(none, 5).collect(), 5)


def test_links_by_a_column(spark):
    rows = [(i, f"text {i}", "ab"[i % 2] if i < 8 else None) for i in range(100)]
    got = S.balance(spark.createDataFrame(rows, "doc_id long, text string, host string"), 5, link_col="host").collect()
    check([r[:2] for r in rows], got, 5)
    at = {r.doc_id: r.shard for r in got}
    assert len({at[i] for i in range(0, 8, 2)}) == len({at[i] for i in range(1, 8, 2)}) == 1


def test_quotas_hold():
    asked = {(0, 1): 10, (1, 0): 4, (2, 0): 9, (0, 2): 1, (1, 2): 100}
    for room in ([0, 0, 0], [3, 0, 5], [100, 100, 100], [0, 1, 0]):
        grant = S.quotas(asked, room)
        assert all(0 <= grant[k] <= asked[k] for k in asked)
        for t in range(3):
            into = sum(v for (_, b), v in grant.items() if b == t)
            out = sum(v for (a, _), v in grant.items() if a == t)
            assert into <= room[t] + out
    assert S.quotas(asked, [100, 100, 100]) == asked
