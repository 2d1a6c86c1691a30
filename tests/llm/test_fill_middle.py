import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.llm import fill_middle as M

from helpers import no_docs, odd_docs

LINE = re.compile(r"[^\n]*\n|[^\n]+")
#: plain units, the same rules as regular expressions or loops
PLAIN_UNITS = {"line": LINE.findall, "word": re.compile(r"\S*\s|\S+").findall, "char": list}


def plain(rows, unit="line", rate=100, spm_rate=50):
    out = []
    for i, t in rows:
        t = t or ""
        us = PLAIN_UNITS[unit](t)
        assert "".join(us) == t
        h = [int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(us) + 1), h[1] % (len(us) + 1)))
        p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            out.append((i, len(us), "plain", None, None, t))
        elif h[3] % 100 < spm_rate:
            out.append((i, len(us), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((i, len(us), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return Counter(out)


def texts(n=300):
    rng = random.Random(5)
    parts = ["a", "Bc ", "\n", "\n\n", "é", "日本", "\U0001f389", "1.5", "\t", "\r\n", "? ", "\u2028", "\x85", "x y"]
    return [(i - 5, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_equals_plain_version(spark, unit):
    rows = texts() + [(900, "<P> here\nx"), (901, None), (902, ""), (903, "\n"), (904, "no end"), (904, "no end"), (None, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rate, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        got = Counter(map(tuple, M.transform(df, unit, rate=rate, spm_rate=spm).collect()))
        assert got == plain(rows, unit, rate, spm)


def test_restored_from_output_and_form(spark):
    rows = texts(200) + [(901, None), (902, ""), (905, "a <S> b\n"), (906, "\\Q.*\n$1")]
    df = M.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    back = df.select("doc_id", M.restored("output", "form").alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)


def test_odd_rows_and_empty_table(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    assert Counter(map(tuple, M.transform(odd_docs(spark)).collect())) == plain(rows)
    assert M.transform(no_docs(spark)).count() == 0
    # other columns with names used inside
    clash = odd_docs(spark).withColumn("n", F.lit(1)).withColumn("form", F.lit("x")).withColumn("__h1", F.lit(2))
    assert Counter(map(tuple, M.transform(clash).collect())) == plain(rows)
    with pytest.raises(ValueError):
        M.transform(odd_docs(spark), unit="page")


def test_one_very_long_text():
    t = "".join(f"line {i} é日\n" for i in range(300000)) + "rest"
    n, a, b = M.cuts(["", t, "x\n"], "line", np.array([3, 70000, 1]), np.array([4, 5000, 0]))
    us = LINE.findall(t)
    assert n.tolist() == [0, len(us), 1]
    assert (a[1], b[1]) == (len("".join(us[:5000])), len("".join(us[:70000])))
    assert (a[2], b[2]) == (0, 2)


def test_wavelet_matrix_equals_counting():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 8, size).astype(np.uint8)
        w = M.WaveletMatrix(codes)
        at = np.arange(size + 1)
        for c in range(8):
            assert w.rank(c, at).tolist() == [int((codes[:i] == c).sum()) for i in at]
        sets = (0, 3, 5)
        total = np.isin(codes, sets).sum()
        nth = np.arange(1, total + 1)
        place = w.select(sets, nth, np.zeros(total, np.int64), np.full(total, size, np.int64))
        assert place.tolist() == (np.flatnonzero(np.isin(codes, sets)) + 1).tolist()


def test_sentences_end_at_stops():
    n, a, b = M.cuts(["One. Two! three\nfour"], "sentence", np.array([1]), np.array([3]))
    assert (n[0], a[0], b[0]) == (4, 4, 16)
