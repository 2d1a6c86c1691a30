import random
import re
import signal

import numpy as np

from gridseries.llm import decontaminate as D
from gridseries.llm import queries

from helpers import SF001, no_docs, odd_docs, rows_of


def norm(t):
    return re.sub(r"\s+", " ", (t or "").lower()).strip(" ")


def least_edits(window, text):
    """Fewest edits between the window and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text] or [0])[: len(text)]
    j = np.arange(len(text) + 1)
    for c in window:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def plain(docs, items):
    out = set()
    for item, it in items:
        it = norm(it)
        if len(it) < D.LEAST:
            continue
        last = max(len(it) - D.WINDOW, 0)
        for p in sorted({*range(0, last + 1, D.STRIDE), last}):
            w = it[p : p + D.WINDOW]
            k = int(len(w) * D.ERROR) if len(w) >= D.WINDOW else max(0, min(int(len(w) * D.ERROR), (len(w) - D.GRAM) // D.GRAM - 1))
            for doc, t in docs:
                e = least_edits(w, norm(t))
                if e <= k:
                    out.add((doc, item, p, e))
    return out


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[i] = rng.choice("abcdé")
        elif kind == 1:
            del text[i]
        else:
            text.insert(i, rng.choice("xyz"))
    return "".join(text)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    syllables = ["the", "an", "er", "on", "é", "ti", "ou", " ", " ", "st", "\n", "Re"]
    prose = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    items = [(i, prose(rng.choice([12, 25, 40, 90]))) for i in range(12)] + [(50, None), (51, ""), (None, "null id item " * 5)]
    docs = []
    for i in range(60):
        t = norm(items[i % 12][1])
        cut = rng.randrange(0, max(1, len(t) - 70))
        docs.append((i, prose(rng.randrange(60)) + edited(rng, t[cut:], rng.randrange(9)).upper() + prose(rng.randrange(60))))
    docs += [(100, "null id item " * 9), (101, None), (102, ""), (None, norm(items[3][1]))]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:4] for r in D.find_leaks(spark, ddf, idf).collect()]
    want = plain(docs, items)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    gone = {d for d, *_ in want}
    assert sorted(str(r.doc_id) for r in D.decontaminate(spark, ddf, idf).collect()) == sorted(str(d) for d, _ in docs if d not in gone)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = (spark.createDataFrame([(r[k], r["text"]) for r in rows_of(SF001, t)], f"{k} long, text string") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    whole = sorted(map(tuple, D.find_leaks(spark, docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 40 * D.WINDOW)
    monkeypatch.setattr(D, "HITS", 50)
    assert sorted(map(tuple, D.find_leaks(spark, docs, items).collect())) == whole and whole


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(SF001, "documents")]
    items = [(r["item_id"], r["text"]) for r in rows_of(SF001, "benchmark")]
    hold = {(d, i) for d, t in docs for i, x in items if norm(x) in norm(t)}
    got = {(r.doc_id, r.item_id): r.least_edits for r in queries.op1_decontaminate(spark, SF001).collect()}
    assert hold and hold <= set(got)
    for (d, i), e in got.items():
        text, it = norm(dict(docs)[d]), norm(dict(items)[i])
        assert e == min(least_edits(it[p : p + 64], text) for p in {*range(0, max(len(it) - 64, 0) + 1, 32), max(len(it) - 64, 0)}) <= 4


def test_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(spark, odd_docs(spark), none).count() == odd_docs(spark).count()
    items = spark.createDataFrame([(1, "long " * 20), (2, None)], "item_id long, text string")
    out = D.decontaminate(spark, odd_docs(spark), items)
    assert out.columns == odd_docs(spark).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "2", "3", "4", "5", "None"]
    assert D.leaked_items(spark, no_docs(spark), items).count() == 0


def test_stretches_of_71_characters_and_short_items(spark):
    rng = random.Random(9)
    pick = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    long = pick(400)
    items = [(1, long), (2, "日本で一番高い山は何ですか"), (3, "Qué 9?"), (4, "qué  9?"), (5, "0123456789")]
    docs = [(i, pick(30) + long[i : i + 71] + pick(30)) for i in range(330)]
    docs += [(1000, "x日本で一番高い山は何ですか。 日本で一番高い山は何ですか"), (1001, "so qué\n9? yes"), (1002, "a 0123456789"), (1003, "日本で一番高い山"), (1004, "qué 9"), (1005, "")]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.least_edits for r in D.leaked_items(spark, ddf, idf).collect()}
    assert got == {(i, 1): 0 for i in range(330)} | {(1000, 2): 0, (1001, 3): 0, (1001, 4): 0, (1002, 5): 0}
    assert sorted(r.doc_id for r in D.decontaminate(spark, ddf, idf).collect()) == [1003, 1004, 1005]


def test_one_item_repeated_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 10 * D.WINDOW)

    def late(*_):
        raise TimeoutError("the blocks are never small enough")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    try:
        items = spark.createDataFrame([(7, "the same question, asked again and again")] * 50, "item_id long, text string")
        docs = spark.createDataFrame([(1, "here: The same question,  asked again and again."), (2, "another")], "doc_id long, text string")
        assert [tuple(r) for r in D.leaked_items(spark, docs, items).collect()] == [(1, 7, 1, 0)]
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
