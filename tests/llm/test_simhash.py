import random
from collections import Counter

import numpy as np
import xxhash

from gridseries.llm import queries, simhash
from gridseries.llm.components import components

from helpers import SF001, no_docs, odd_docs, rows_of


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).translate(None)
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes, most):
    """codes: list of ints; the smallest position reachable for each."""
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= most:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def check(rows, got):
    codes = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(codes, 4)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{c:016x}", least.get(r)) for (i, _), c, r in zip(rows, codes, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(SF001, "documents")]
    check(rows, queries.op5_simhash(spark, SF001).collect())


def test_near_copies_and_odd_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for j in range(10):
            text = list(base)
            for _ in range(j):
                text[rng.randrange(400)] = rng.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, simhash.near_duplicates(spark, df).collect())
    check([(r.doc_id, r.text) for r in odd_docs(spark).collect()], simhash.near_duplicates(spark, odd_docs(spark)).collect())
    assert simhash.near_duplicates(spark, no_docs(spark)).count() == 0


def test_index_equals_all_pairs():
    rng = np.random.default_rng(3)
    for trial in range(20):
        centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
        code = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64) for c in centre])
        code = np.unique(code)
        group = rng.integers(0, 3, len(code))
        index = simhash.GrayIndex(group, code)
        label = index.link(4)
        want = plain_components([int(c) | 31 << 64 + 8 * int(g) for c, g in zip(index.code, index.group)], 4)
        same = {}
        for a, b in zip(label.tolist(), want):
            assert same.setdefault(a, b) == b
        assert len(set(label.tolist())) == len(set(want))


def test_salted_groups(spark):
    rng = random.Random(8)
    codes = list({(0x1234567 << 20) ^ sum(1 << rng.randrange(64) for _ in range(3)) for _ in range(300)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, 4, group_rows=20)).collect()}
    want = plain_components(codes, 4)
    by_want = {}
    for c, w in zip(signed, want):
        by_want.setdefault(w, []).append(c)
    for members in by_want.values():
        assert {found.get(c, c) for c in members} == {min(members)}


def test_components_of_a_path(spark):
    n = 60
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 200), (300, 301), (301, 300)], "a long, b long")
    found = {r.node: r.root for r in components(df).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {300: 300, 301: 300}


def test_deduplicate_keeps_one(spark):
    got = simhash.deduplicate(spark, odd_docs(spark))
    assert got.columns == odd_docs(spark).columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "5", "6", "None"]


def test_deduplicate_by_row(spark):
    texts = [" ".join(random.Random(k).choices([f"w{i}" for i in range(500)], k=60)) for k in range(3)]
    rows = [(1, texts[0], [1, None]), (1, texts[1], [1]), (1, texts[1], [None, 1]), (None, texts[2], None), (None, texts[2], None), (None, texts[2], [2]),
            (5, texts[0], None), (5, None, None), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` array<int>")
    got = simhash.deduplicate(spark, docs)
    assert got.columns == docs.columns
    out = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert out == sorted([("1", texts[0]), ("1", texts[1]), ("None", texts[2]), ("5", ""), ("None", "")])
    chosen = {str(sorted(map(str, simhash.deduplicate(spark, docs.repartition(n)).collect()))) for n in (1, 5)}
    assert len(chosen) == 1
