import zlib

import numpy as np

from gridseries.llm import quality_model as M
from gridseries.llm import queries

from helpers import SF01, no_docs, odd_docs, rows_of


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op8_quality_trees(spark, SF01).collect()}
    docs, label = {r["doc_id"] for r in rows_of(SF01, "documents")}, {r["doc_id"]: r["quality"] for r in rows_of(SF01, "labels")}
    assert set(got) == docs
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(label[i], r.predicted) for i, r in got.items() if r.held_out and i in label]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_statistics_by_hand():
    f = dict(zip(M.FEATURES, M.statistics(["ab  Cd9 ef!\n\nab.\nab."])[0]))
    assert np.isclose(np.expm1(f["words"]), 5) and np.isclose(np.expm1(f["lines"]), 3)
    assert np.isclose(f["distinct_words"], 4 / 5) and np.isclose(f["distinct_pairs"], 4 / 4) and np.isclose(f["repeated_lines"], 1 / 3)
    assert np.isclose(f["word_mean"], (2 + 3 + 3 + 3 + 3) / 5) and np.isclose(f["bang"], 1 / 5) and np.isclose(f["line_ends"], 1)
    assert np.isclose(f["digit"], 1 / 20) and np.isclose(f["newline"], 3 / 20)
    assert np.isfinite(M.statistics(["", " ", "\n", "é" * 50000, "x"])).all()


def test_a_text_alone_or_among_others():
    texts = [r["text"] or "" for r in rows_of(SF01, "documents")][:60]
    alone = np.concatenate([M.statistics([t]) for t in texts])
    assert np.allclose(alone, M.statistics(texts))


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    m = M.train(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.95

    def walk(row):
        total = m.prior
        for f, t, v in zip(m.feature, m.threshold, m.value):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > t[i])
            total += v[i - len(f)]
        return total

    assert np.allclose(m.raw(x[:40]), [walk(r) for r in x[:40]])


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 0), (None, 1, 0), (6, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = M.fit(odd_docs(spark), labels)
    out = M.score(odd_docs(spark), model).collect()
    assert len(out) == odd_docs(spark).count() and all(0 <= r.score <= 1 for r in out)
    none = M.fit(odd_docs(spark), labels.limit(0))
    assert {round(r.score, 6) for r in M.score(odd_docs(spark), none).collect()} == {0.9}
    assert M.score(no_docs(spark), model).count() == 0
    kept = M.keep(odd_docs(spark), none)
    assert kept.columns == odd_docs(spark).columns and kept.count() == odd_docs(spark).count()
    assert M.keep(odd_docs(spark), none, threshold=0.95).count() == 0
