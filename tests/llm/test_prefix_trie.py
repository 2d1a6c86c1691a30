import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridseries.llm import prefix_trie as T
from gridseries.llm import queries

from helpers import SF001, rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def said(rows):
    """conversation -> its turns in order (ties by digest, as the operator states)."""
    def digest(r, x):
        return hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:30]

    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, digest(r or "", x or ""), r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}


def rebuilt(conv):
    out = {}
    for c, ts in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = conv.get(base, [])[:h] + ts[h:]
    return out


def plain(conv):
    """The nodes' rows, from paths as tuples."""
    members = defaultdict(list)
    for c, ts in conv.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    rows = set()
    for k, ms in members.items():
        leaves = saved = 0
        stack = [k]
        while stack:
            x = stack.pop()
            leaves += not kids[x]
            saved += (len(members[x]) - 1) * len(WORDS.findall(x[-1][1])) if x else 0
            stack += kids[x]
        ends = ",".join(map(str, sorted(c for c in ms if len(conv[c]) == len(k))))
        rows.add((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), len(kids[k]), leaves, saved,
                  hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def check(spark, rows, shared=True):
    df = T.prefix_trie(spark.createDataFrame(rows, SCHEMA), shared_openings=shared).drop("thi", "tlo")
    got = [tuple(r) for r in df.collect()]
    conv = said(rows)
    want = plain(rebuilt(conv) if shared else conv)
    assert len(got) == len(set(got)) and set(got) == want


def made(n=260, seed=4):
    rng = random.Random(seed)
    texts = ["hi", "ok ok", "", "é 日本 x", "a b c d", None]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(-45, 120), 40, 7])
        rows.append((c, rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows + rows[:5]


def test_query_equals_plain_version(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of(SF001, "conversations")]
    got = [tuple(r) for r in queries.op12_prefix_trie(spark, SF001).collect()]
    want = plain(rebuilt(said(rows)))
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("shared", [True, False])
def test_nulls_ties_repeats_and_negative_ids(spark, shared):
    check(spark, made(), shared)
    check(spark, made(40, 9) + [(None, 1, "user", "nobody's")], shared)


def test_bands_and_spilling_give_the_same(spark, monkeypatch):
    rows = made(200, 2) + [(5, i, "user", f"t{i % 7}") for i in range(60)] + [(c, i, "user", f"t{i % 7}") for c in (200, 201, 222) for i in range(40 + c % 3)]
    monkeypatch.setattr(T, "BAND", 4)
    check(spark, rows, False)
    check(spark, rows, True)
    monkeypatch.setattr(T, "BAND", 1)
    check(spark, rows[-130:], False)


def test_many_copies_and_one_common_first_turn(spark):
    same = [(c, i, "user", f"say {i}") for c in range(300) for i in range(3)]
    fan = [(1000 + c, i, "system", "be kind" if i == 0 else f"{c} {i}") for c in range(300) for i in range(2)]
    check(spark, same + fan, False)
    check(spark, same + fan, True)


def test_empty_turnless_and_clashing_columns(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA), True).count() == 0
    check(spark, [(c, 0, "user", "only turn") for c in range(21, 40)])  # no conversation 20: turnless ones stay members of the root
    rows = made(60, 1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS size", "'x' AS words", "3 AS pos", "4 AS hi")
    got = {tuple(r) for r in T.prefix_trie(df, True).drop("thi", "tlo").collect()}
    assert got == plain(rebuilt(said(rows)))


def test_very_long_text_and_texts_of_nodes(spark):
    rows = [(1, 0, "user", "word " * 200000), (2, 0, "user", "word " * 200000), (2, 1, "assistant", "ok")]
    nodes = T.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    check(spark, rows, False)
    full = {(r.conv_id, r.depth): (r.role, r.text) for r in T.with_texts(nodes, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert full == {(1, 0): (None, None), (1, 1): ("user", "word " * 200000), (2, 2): ("assistant", "ok")}


def test_queue_gives_messages_in_time_order_and_spills():
    rng = random.Random(3)
    for most in (3, 50, 10**6):
        queue, waiting, now = T.TimeQueue(2, most), defaultdict(lambda: np.zeros(2, np.int64)), 0
        for _ in range(60):
            times = [now + rng.randrange(1, 40) for _ in range(rng.randrange(30))]
            values = np.array([[rng.randrange(9), t] for t in times], np.int64).reshape(-1, 2)
            queue.push(np.array([t.to_bytes(32, "big") for t in times], T._TIME), values)
            for t, v in zip(times, values):
                waiting[t] += v
            now += rng.randrange(8)
            t, v = queue.take(now.to_bytes(32, "big"))
            due = sorted(x for x in waiting if x <= now)
            assert [int.from_bytes(x.ljust(32, b"\0"), "big") for x in t.tolist()] == due
            assert v.tolist() == [waiting.pop(x).tolist() for x in due]
        assert (queue.spilled > 0) == (most < 1000)
