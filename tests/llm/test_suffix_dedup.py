import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from gridseries.llm import queries, suffix_dedup as S

from helpers import SF001, no_docs, odd_docs, rows_of


def plain(rows):
    """rows: (id, text); the digest row of each."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49 if i is not None else 0):
            w = b[a : a + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for a in range(len(b) - 49 if i is not None else 0):
            if first[b[a : a + 50]] < i:
                gone[a : a + 50] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r)[:5] for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(SF001, "documents")]
    assert got(queries.op2_suffix_dedup(spark, SF001)) == plain(rows)


def test_copies_passages_and_periods(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 6000)
    monkeypatch.setattr(S, "RANGE_BYTES", 20000)
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice(["the ", "an", "ér ", "on", "\n", "ti", "日"]) for _ in range(n))
    passage = [prose(60) for _ in range(5)]
    rows = []
    for _ in range(60):
        t = prose(rng.randrange(50)) + rng.choice(passage) + prose(rng.randrange(50)) + rng.choice(passage)[rng.randrange(40) :]
        rows.append((rng.randrange(1000), t))
    rows += [(2000 + k, rows[k][1]) for k in range(20)] + [(3000, "ab" * 200), (3001, "ba" * 150), (3002, "a" * 49), (3003, "a" * 50), (3004, "a" * 300)]
    rows += [rows[3], (None, rows[4][1]), (4000, None), (4001, "")] + [(-5, passage[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.remove_repeats(df)) == plain(rows)
    monkeypatch.setattr(S, "COLLECTION", 300)  # many collections, and hashes that are split into windows
    assert got(S.remove_repeats(df)) == plain(rows)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect() if r.doc_id != 6]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert S.remove_repeats(odd_docs(spark)).count() == odd_docs(spark).count()
    assert S.remove_repeats(no_docs(spark)).count() == 0


def test_transform_equals_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(30):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))).encode() for _ in range(rng.randrange(1, 9))]
        bwt, lcp, place = S.build(strings)
        suffixes = [(s[a:], k, a) for k, s in enumerate(strings) for a in range(len(s) + 1)]
        # a string's end sorts before all symbols, ends by string number
        want = sorted(suffixes, key=lambda e: ([*(c + 1 for c in e[0]), 0, e[1]]))
        assert bwt.tolist() == [strings[k][a - 1] + 1 if a else 0 for _, k, a in want]
        assert [want[p][1:] for p in place] == [(k, 0) for k in range(len(strings))]
        common = [0]
        for (x, *_), (y, *_) in zip(want, want[1:]):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            common.append(n)
        assert lcp.tolist() == common


def test_hot_passage_with_foreign_neighbours_spreads(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join([*(word() for _ in range(12)), passage, *(word() for _ in range(12))])) for i in range(2000)]
    # every document has strings of its own at the passage's edges, under one hash
    group = S.Group([i for i, _ in rows], [t for _, t in rows])
    ordered = group.by_hash()
    found, strings = ordered[1], group.strings_of(ordered, 16)
    assert strings.max() > 1900
    hot = np.empty(int((strings > 100).sum()), S._HOT)
    hot["hash"], hot["parts"] = found[strings > 100], strings[strings > 100] * S.SPAN * S.LENGTH // 7600 + 1
    before = len(group.start)
    group.spread(hot)
    assert len(group.start) > before and group.strings_of(group.by_hash(), 16).max() <= 200  # a collection of 7,600 bytes holds 100 strings
    monkeypatch.setattr(S, "GROUP_BYTES", 30000)
    monkeypatch.setattr(S, "RANGE_BYTES", 100000)
    monkeypatch.setattr(S, "COLLECTION", 7600)
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_long_document_among_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    assert got(S.remove_repeats(odd_docs(spark))) == plain(rows)
    again = [(7, "long " * 3000), (8, "x" + "long " * 2000), (7, "long " * 3000)]
    assert got(S.remove_repeats(spark.createDataFrame(again, "doc_id long, text string"))) == plain(again)


def test_groups_without_anything_in_common(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 2000)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))) for i in range(60)]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    hashes, counts, strings, least, own, item = S.Group([1], [rows[0][1]]).items(np.zeros(0, np.uint64))
    assert len(hashes) == len(counts) == len(strings) == len(own) == len(item) == 0


def hash_of(string):
    return S._spaced(S._mixed_grams(np.frombuffer(string, np.uint8)).min(keepdims=True))[0]


def around(rng, gram, most):
    """Strings of one hash: the gram among foreign bytes, all windows of which hold it."""
    found = []
    while len(found) < most:
        a, b = rng.randrange(27), rng.randrange(27)
        if a + b < 26:
            continue
        text = "".join(rng.choice("abcdefghijkl") for _ in range(a)).encode() + gram + "".join(rng.choice("abcdefghijkl") for _ in range(b)).encode()
        if hash_of(text) == hash_of(gram):
            found.append(text)
    return found


def smallest_gram(rng):
    return min(("".join(rng.choice("abcdefghijkl ") for _ in range(S.GRAM)).encode() for _ in range(20000)),
               key=lambda g: int(S._mixed_grams(np.frombuffer(g, np.uint8))[0]))


def test_strings_that_share_no_window_stay_out_of_the_construction(monkeypatch):
    rng = random.Random(4)
    strings = sorted(set(around(rng, smallest_gram(rng), 40)))
    built, build = [], S.build
    monkeypatch.setattr(S, "build", lambda some: built.extend(some) or build(some))
    hashes = np.full(len(strings), hash_of(strings[0]))
    least = np.arange(len(strings))
    first, count = S._firsts(hashes, pa.array(strings, pa.large_binary()), least, 1 << 20)
    assert not built  # one hash, but foreign bytes on both sides of the gram
    assert first.tolist() == np.repeat(least, count).tolist()


def test_strings_that_share_a_window_are_kept():
    rng = random.Random(6)
    gram = smallest_gram(rng)
    base = around(rng, gram, 12)
    strings = set(base)
    for s in base:  # a piece of a string among other bytes, from one byte too few to all of it
        at = s.index(gram)
        for _ in range(6):
            a, b = rng.randrange(at + 1), rng.randrange(len(s) - at - S.GRAM + 1)
            t = b"mno"[: rng.randrange(4)] + s[at - a : at + S.GRAM + b] + b"pqr"[: rng.randrange(4)]
            if len(t) >= S.LENGTH and hash_of(t) == hash_of(gram):
                strings.add(t)
    for unit in (b"ab", b"a", b"abcde"):  # the gram at several places
        strings |= {(unit * 60)[:n] for n in (50, 51, 60, 76)} | {b"x" + (unit * 60)[:n] for n in (50, 60)}
    strings = sorted(strings)
    hashes = np.array([hash_of(s) for s in strings])
    order = np.argsort(hashes, kind="stable")
    strings, hashes = [strings[i] for i in order], hashes[order]
    kept = S._may_share(hashes, pa.array(strings, pa.large_binary()))
    held = Counter(w for s in strings for w in {s[a : a + 50] for a in range(len(s) - 49)})
    share = np.array([any(held[s[a : a + 50]] > 1 for a in range(len(s) - 49)) for s in strings])
    assert share.sum() > 20 and kept[share].all() and not kept.all()
    least = np.array(rng.sample(range(1000), len(strings)))
    first, count = S._firsts(hashes, pa.array(strings, pa.large_binary()), least, 1 << 20)
    want = [min(i for t, i in zip(strings, least.tolist()) if s[a : a + 50] in t) for s in strings for a in range(len(s) - 49)]
    assert first.tolist() == want


def test_groups_and_keys_on_large_tables():
    assert [S._groups(n) for n in (0, 1 << 20, 100 << 20)] == [1, 1, 50]
    # 6 GB of Parquet are some 10 GB of text: rows from groups to ranges grow as the product
    assert S._groups(10 << 30) <= 2600
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 100, 1000):
        hashes = np.sort(rng.integers(0, 1 << 64, 4000, np.uint64))
        part = S._ranges(hashes, n)
        for a, b in S._cuts(part):
            keys = S._keys_read(S._keys(hashes[a:b], n))
            assert len(keys) == b - a == len(np.unique(keys))


def test_many_groups_and_ranges_over_hot_hashes(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(S, "GROUP_BYTES", 1500)
    monkeypatch.setattr(S, "RANGE_BYTES", 4000)
    monkeypatch.setattr(S, "COLLECTION", 600)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(rng.randrange(400), text(rng.randrange(60)) + line[rng.randrange(3) :] + text(rng.randrange(60)) + rng.choice(["", line])) for _ in range(500)]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
